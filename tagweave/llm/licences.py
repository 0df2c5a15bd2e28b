"""Licence scans by sentence rules, in DataFrame expressions alone.

A text is put in lower case with every run of other characters than letters and digits as one blank, and cut at sentence
marks and blank lines.  What is left between is lines, without the signs of comments before them; a known sentence
is one or several whole lines of it, the longest that fit, and becomes its identifier; others nothing.  So sentences may be wrapped, and a
notice may stand on a line of its own.  Lines of a wrapped sentence that are known ones by themselves count too, before it.
A rule names identifiers in order; it holds if they stand in the text in that order.

Known sentences all hold one of a few words, which the table itself supplies; texts without any of
them have no known sentence and are not cut.  The scan is a projection: no shuffle, no Python.

Nulls: a null text is an empty one and has no licence.  Every row gives one row, repeated ones and those
without id too.  An empty table gives an empty one.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.licence_values import RULES, SENTENCES

CUT = r"[.!?]+([ \t\n\r\f\x0B]+|$)|\n+"
OTHER = "[^a-z0-9]+"
#: A sentence's end in a text that is put in lines.
END = "\x01"


def normalised(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip()


#: Identifiers are places in this list, from 1.
KNOWN = [normalised(re.sub(r"[.!?:]+$", "", s)) for _, s in SENTENCES]
NAMES = [name for name, _ in SENTENCES]


def key_words() -> list[str]:
    """A few longer words of which every known sentence holds one: again and again that of most sentences left."""
    left, found = list(KNOWN), []
    while left:
        words = sorted({w for s in left for w in s.split()}, key=lambda w: (len(w) < 7, w))
        words = [w for w in words if len(w) >= 7] or words
        found.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if found[-1] not in s]
    return found


def rule_pattern(names: tuple[str, ...]) -> str:
    """A regular expression over ``,3,14,15,`` for sentences of these names in this order."""
    ids = ["(" + "|".join(str(i + 1) for i, n in enumerate(NAMES) if n == name) + ")" for name in names]
    return "," + ",(.*,)?".join(ids) + ","


def wrapped_pattern() -> str:
    """A regular expression for any known sentence, the longest first, on whole lines up to an end or a line's end."""
    longest = sorted(KNOWN, key=lambda s: (-len(s), s))
    return f"(?<![^\n{END}])(?:" + "|".join(s.replace(" ", "[ \n]") for s in longest) + f")(?![^\n{END}])"


def lines_of(low: Column) -> Column:
    """Words parted by single blanks, lines by line breaks and sentences by ``END``; two line breaks are a blank line."""
    ended = F.regexp_replace(low, r"[.!?]+([ \t\n\r\f\x0B]+|$)", END)
    bare = F.regexp_replace(F.regexp_replace(ended, f"[^a-z0-9\n{END}]+", " "), f" ?([\n{END}]) ?", "$1")
    return F.regexp_replace(F.trim(bare), f"(?<![^\n{END}])(?:rem|dnl) ", "")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in its order."""
    low = F.lower(text)
    may = None
    for word in key_words():
        may = F.contains(low, F.lit(word)) if may is None else may | F.contains(low, F.lit(word))
    known = F.array(*[F.lit(s) for s in KNOWN])
    place = lambda s: F.array_position(known, s)
    found = F.regexp_extract_all(lines_of(low), F.lit(wrapped_pattern()), F.lit(0))
    whole = lambda s: place(F.translate(s, "\n", " "))
    each = lambda s: F.concat(F.when(F.contains(s, F.lit("\n")), F.transform(F.split(s, "\n"), place)).otherwise(F.array().cast("array<bigint>")), F.array(whole(s)))
    ids = F.flatten(F.transform(found, each))
    return F.when(may, F.filter(ids, lambda i: i > 0)).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_known, sentence_ids, licences)``; both lists are joined by commas, licences in their order by name."""
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("ids"))
    line = F.concat(F.lit(","), F.col("line"), F.lit(","))
    hits = [F.when(line.rlike(rule_pattern(names)), F.lit(licence)) for licence, names in RULES]
    return (
        found.withColumn("line", F.array_join("ids", ","))
        .select(
            "doc_id",
            F.size("ids").cast("long").alias("n_known"),
            F.col("line").alias("sentence_ids"),
            F.when(F.col("line") == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")).alias("licences"),
        )
    )


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB for sentences on single lines: it cuts at every line break."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "[" + ", ".join(map(quoted, KNOWN)) + "]"
    hits = ", ".join(f"CASE WHEN regexp_matches(',' || line || ',', {quoted(rule_pattern(names))}) THEN {quoted(licence)} END" for licence, names in RULES)
    return f"""
WITH parts AS (
  SELECT doc_id, list_filter(
    list_transform(string_split_regex(lower(coalesce(text, '')), {quoted(CUT)}),
      lambda s: list_position({known}, trim(regexp_replace(s, {quoted(OTHER)}, ' ', 'g')))), lambda i: i > 0) AS ids
  FROM {table}),
lines AS (SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS line FROM parts)
SELECT doc_id, n_known, line AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda h: h IS NOT NULL))), ',') AS licences
FROM lines"""
