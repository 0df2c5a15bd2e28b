"""The review queue: prompts, run policy, answers, majority and merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions.order import with_rows_before
from tagweave.functions.session import bounded, cut_lineage, stored_with_count

CANONICAL_SHOTS, RETRIEVED_SHOTS, OOD_SHOTS = 2, 4, 2


def direction(indicator: Column) -> Column:
    return F.when(indicator == "D", F.lit("Debit")).otherwise(F.lit("Credit"))


def format_example(description: Column, amount: Column, indicator: Column, mode: Column, label: Column) -> Column:
    """One labelled example of the prompt."""
    return F.format_string(
        fixed.EXAMPLE_FORMAT,
        F.coalesce(description, F.lit("")),
        F.coalesce(amount.cast("double"), F.lit(0.0)),
        direction(indicator),
        F.coalesce(mode, F.lit("N/A")),
        F.coalesce(label, F.lit("")),
    )


def _shot(example: Column, label: Column) -> Column:
    return format_example(
        example.tran_partclr, example.tran_amt_in_ac, example.dr_cr_indctor, example.tran_mode, label
    )


def canonical_shots(examples: DataFrame) -> DataFrame:
    """``(category, canonical)``: text of the first examples of each category."""
    early = examples.filter(F.col("pos") < CANONICAL_SHOTS)
    label = F.coalesce(F.col("example.category"), F.col("category"))
    shots = early.select("category", F.struct("pos", _shot(F.col("example"), label).alias("text")).alias("s"))
    listed = F.array_sort(F.collect_list("s"))
    return shots.groupBy("category").agg(F.array_join(F.transform(listed, lambda s: s.text), "").alias("canonical"))


def ood_shots(examples: DataFrame) -> Column:
    """Text of the first OOD examples, as one value."""
    early = examples.filter(F.col("pos") < OOD_SHOTS)
    shot = F.struct("pos", _shot(F.col("example"), F.lit(fixed.OOD_LABEL)).alias("text"))
    listed = F.array_sort(F.collect_list(shot))
    return early.agg(F.array_join(F.transform(listed, lambda s: s.text), "")).scalar()


def category_list(categories: DataFrame) -> Column:
    """Sorted category names as one array value."""
    return categories.agg(F.array_sort(F.collect_set("category"))).scalar()


def retrieved_shots() -> Column:
    """Text of the nearest neighbours in ``similar``, closest first."""
    near = F.slice(F.coalesce("similar", F.array()), 1, RETRIEVED_SHOTS)
    texts = F.transform(
        near,
        lambda s: format_example(s.record.description, s.record.amount, s.record.dr_cr, s.record.mode, s.record.category),
    )
    return F.array_join(texts, "")


def build_prompts(
    routed: DataFrame,
    categories: DataFrame,
    canonical: DataFrame | None = None,
    ood_examples: DataFrame | None = None,
    step_threshold: float = 0.4,
) -> DataFrame:
    """Add ``prompt`` to rows with the record's columns, ``confidence``,
    ``predicted_category`` and ``similar``.
    """
    df = routed
    if canonical is not None:
        shots = canonical_shots(canonical).withColumnRenamed("category", "predicted_category")
        df = df.join(bounded(shots), "predicted_category", "left")
        canon = F.coalesce("canonical", F.lit(""))
    else:
        canon = F.lit("")
    ood = F.coalesce(ood_shots(ood_examples), F.lit("")) if ood_examples is not None else F.lit("")
    record = F.format_string(
        fixed.RECORD_FORMAT,
        F.coalesce("tran_partclr", F.lit("")),
        F.coalesce("tran_amt_in_ac", F.lit(0.0)),
        direction(F.col("dr_cr_indctor")),
        F.coalesce("tran_mode", F.lit("N/A")),
    )
    answer = F.when(F.col("confidence") < step_threshold, fixed.PROMPT_STEPS).otherwise(F.lit(fixed.PROMPT_DIRECT))
    prompt = F.concat(
        F.lit(fixed.PROMPT_ROLE),
        F.array_join("_categories", ", "),
        F.lit(fixed.PROMPT_OTHER_RULE),
        F.lit(fixed.PROMPT_NOTES),
        F.lit(fixed.PROMPT_EXAMPLES_HEAD),
        canon,
        retrieved_shots(),
        F.col("_ood"),
        F.lit(fixed.PROMPT_RECORD_HEAD),
        record,
        answer,
    )
    df = df.withColumn("_categories", category_list(categories)).withColumn("_ood", ood)
    return df.withColumn("prompt", prompt).drop("_categories", "_ood", "canonical")


def run_policy(
    df: DataFrame,
    step_threshold: float = 0.4,
    high_value: float = 50_000.0,
    runs: int = 3,
    temperature: float = 0.3,
) -> DataFrame:
    """One row per run: ``use_steps, n_runs, temperature, run``."""
    large = F.coalesce(F.col("tran_amt_in_ac"), F.lit(0.0)) > F.lit(high_value)
    return df.withColumns(
        {
            "use_steps": F.col("confidence") < F.lit(step_threshold),
            "n_runs": F.when(large, F.lit(runs)).otherwise(F.lit(1)),
            "temperature": F.when(large & F.lit(runs > 1), F.lit(temperature)).otherwise(F.lit(0.0)),
        }
    ).withColumn("run", F.explode(F.sequence(F.lit(1), F.col("n_runs"))))


#: Prompts of a batch that are strings at once.
ASKED_ROWS = 256


def respond(prompts: DataFrame, make_provider: Callable[[], Callable[[str, float], str]]) -> DataFrame:
    """Ask a user's provider for each ``(query_id, run, prompt, temperature)``.

    The provider is made once per task.  A call that fails leaves ``response`` null, so the row keeps its retrieval
    answer, and its reason in ``error``.  A worker holds ``ASKED_ROWS`` prompts as strings, however long a batch is.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()

        def answer(prompt: str, temperature: float) -> tuple[str | None, str | None]:
            try:
                return provider(prompt, temperature), None
            except Exception as error:  # one bad row must not fail the job
                return None, f"{type(error).__name__}: {error}"

        for batch in batches:
            for at in range(0, batch.num_rows, ASKED_ROWS):
                part = batch.slice(at, ASKED_ROWS)
                asked = zip(part.column("prompt").to_pylist(), part.column("temperature").to_numpy(zero_copy_only=False).tolist())
                said = [answer(p, t) for p, t in asked]
                texts = [pa.array([a[k] for a in said], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("run"), *texts], names=["query_id", "run", "response", "error"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    asked = prompts.select("query_id", F.col("run").cast("int").alias("run"), "prompt", F.col("temperature").cast("double").alias("temperature"))
    return asked.mapInArrow(ask, f"query_id {kind}, run int, response string, error string")


LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def answer_line(response: Column) -> Column:
    """Last non-empty line without a ``category:`` prefix, quotes and end punctuation."""
    lines = F.filter(
        F.transform(F.split(response, LINE_BREAK), lambda line: F.btrim(line, F.lit(" \t"))), lambda line: line != ""
    )
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(last, r"(?i)^category\s*[:\-]?\s*", "")
    return F.btrim(bare, F.lit("\"' .,"))


GRAM = 3
#: Names that are looked through rather than indexed.
FEW_NAMES = 256


def grams(text: Column, size: int = GRAM) -> Column:
    """The different substrings of ``1`` to ``size`` characters, each made from the shorter one at its place."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    parts = longer = chars
    for k in range(2, size + 1):
        longer = F.filter(F.zip_with(longer, F.slice(chars, k, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull())
        parts = F.concat(parts, longer)
    return F.array_distinct(parts)


def contained_names(answers: DataFrame, names: DataFrame) -> DataFrame:
    """``(said, pos)``: for each of the different ``answers(said)`` the first of ``names(pos, low)`` that contains it or that it contains.

    No answer is compared with all names.  A name is posted under its rarest gram, an answer that contains the name has that gram
    too; and under all its grams, among which is the rarest one of any answer it contains.  What meets under a gram is
    verified.  An answer that is itself a gram needs no more than the first name posted under it.
    """
    posted = cut_lineage(names.select("pos", "low", F.explode(grams(F.col("low"))).alias("gram")))
    # Per gram: how many names have it, the first of them, and of the longest grams only the count orders a name's.
    seen = cut_lineage(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("names"), F.min("pos").alias("first")))
    is_full = lambda text: F.char_length("gram") == F.least(F.char_length(text), F.lit(GRAM))
    rarity = F.struct("names", "gram")
    keys = posted.filter(is_full("low")).join(seen, "gram").groupBy("pos", "low").agg(F.min(rarity).alias("key"))
    keys = keys.select("pos", "low", F.col("key.gram").alias("gram"))
    said = cut_lineage(answers.select("said", F.explode(grams(F.col("said"))).alias("gram")))
    inside = said.join(bounded(keys), "gram").filter(F.contains("said", F.col("low"))).select("said", "pos")
    short = answers.join(seen, F.col("said") == F.col("gram")).select("said", F.col("first").alias("pos"))
    # Answers longer than a gram: one whose grams some name all has is looked for under the rarest of them.
    met = said.filter((F.char_length("said") > GRAM) & is_full("said")).join(seen, "gram", "left")
    rarest = met.groupBy("said").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("key")).filter("key.names > 0")
    outside = rarest.select("said", F.col("key.gram").alias("gram")).join(posted, "gram").filter(F.contains("low", F.col("said"))).select("said", "pos")
    found = inside.unionByName(short).unionByName(outside)
    return found.groupBy("said").agg(F.min("pos").alias("pos"))


def parse_responses(df: DataFrame, categories: DataFrame, few_names: int = FEW_NAMES) -> DataFrame:
    """Add ``label``: exact name, else the first name contained either way, else ``other``.

    An empty answer, or none, is ``other``.  Up to ``few_names`` names are looked through in the answer's own row, small
    ones made once.  More are an inverted index: an exact answer is one lookup, and each different one of the rest is met only by names that
    share a rare piece of it.  Both give the same labels.
    """
    names = categories.filter(F.col("category").isNotNull()).select("category").distinct()
    names, n = stored_with_count(names.withColumn("low", F.lower("category")))
    said = F.lower(F.coalesce(answer_line(F.col("response")), F.lit("")))
    asked = F.col("_said").isin("", fixed.OOD_LABEL)
    if n <= few_names:
        listed = names.agg(F.array_sort(F.collect_list(F.struct("category", "low")))).scalar()
        exact = F.try_element_at(F.filter("_names", lambda c: c.low == F.col("_said")), F.lit(-1))
        either = lambda c: F.contains(F.col("_said"), c.low) | F.contains(c.low, F.col("_said"))
        partial = F.try_element_at(F.filter("_names", either), F.lit(1))
        label = F.when(asked, F.lit(fixed.OOD_LABEL)).otherwise(F.coalesce(exact.category, partial.category, F.lit(fixed.OOD_LABEL)))
        return df.withColumn("_said", said).withColumn("_names", listed).withColumn("label", label).drop("_said", "_names")
    numbered = with_rows_before(names.select(F.struct("category", "low").alias("value"), F.lit(1).cast("bigint").alias("n")), stored=True)
    names = cut_lineage(numbered.select(F.col("before").alias("pos"), "value.category", "value.low"))
    rows = cut_lineage(df.withColumn("_said", said))
    exact = bounded(names.groupBy("low").agg(F.max_by("category", "pos").alias("_exact")).withColumnRenamed("low", "_said"))
    different = cut_lineage(rows.filter(~asked).select(F.col("_said").alias("said")).distinct())
    rest = different.join(exact, F.col("said") == F.col("_said"), "left_anti")
    partial = contained_names(cut_lineage(rest), names.select("pos", "low")).join(names.select("pos", "category"), "pos")
    partial = bounded(partial.select(F.col("said").alias("_said"), F.col("category").alias("_partial")))
    found = rows.join(exact, "_said", "left").join(partial, "_said", "left")
    label = F.when(asked, F.lit(fixed.OOD_LABEL)).otherwise(F.coalesce("_exact", "_partial", F.lit(fixed.OOD_LABEL)))
    return found.withColumn("label", label).select(*[F.col(f"`{c}`") for c in df.columns if c != "label"], "label")


def majority_vote(parsed: DataFrame) -> DataFrame:
    """``(query_id, label, votes, responses)``: most frequent label, ties to the earliest run.

    Failed runs (null response) do not vote.
    """
    counted = (
        parsed.filter(F.col("response").isNotNull())
        .groupBy("query_id", "label")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.min("run").alias("first"),
            F.collect_list(F.struct("run", "response")).alias("said"),
        )
    )
    return counted.groupBy("query_id").agg(
        F.max_by("label", F.struct("votes", (-F.col("first")).alias("early"))).alias("label"),
        F.max("votes").alias("votes"),
        F.transform(F.array_sort(F.flatten(F.collect_list("said"))), lambda s: s.response).alias("responses"),
    )


def merge_review(predictions: DataFrame, voted: DataFrame) -> DataFrame:
    """Replace the answer of reviewed rows; confidence is 1.0, or 0.0 for ``other``."""
    answers = voted.select(
        "query_id", F.col("label").alias("_label"), F.col("responses").alias("llm_raw_response")
    )
    merged = predictions.join(answers, "query_id", "left")
    used = F.col("_label").isNotNull()
    return (
        merged.withColumn("llm_overridden", used)
        .withColumn(
            "confidence",
            F.when(~used, F.col("confidence"))
            .when(F.col("_label") == fixed.OOD_LABEL, F.lit(0.0))
            .otherwise(F.lit(1.0)),
        )
        .withColumn("predicted_category", F.coalesce("_label", "predicted_category"))
        .drop("_label")
    )
