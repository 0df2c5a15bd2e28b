"""Read labelled and new records, examples and descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed_values import NULL_TOKENS, OOD_LABEL
from tagweave.functions.session import scratch_path


def null_tokens(value: Column) -> Column:
    """NULL for a cell that only says it is missing."""
    return F.when(~value.isin(NULL_TOKENS), value)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a scan of fewer tasks than cores before heavy work per row; else leave it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    line_breaks_in_cells: bool = False,
) -> DataFrame:
    """Scan a CSV with header, a parquet folder or a table.

    A CSV is read as strings, missing-value spellings become NULL, then each column
    is cast to its type in ``schema``; nothing is inferred from the data.  Cells with line
    breaks keep a file from being split over tasks, so they have to be announced.
    """
    if fmt == "table":
        return spark.read.table(path)
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = {f.name: f.dataType for f in schema.fields} if schema else {}
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks_in_cells, escape='"')
    return raw.select(
        *[null_tokens(F.col(f"`{c}`")).cast(wanted.get(c, T.StringType())).alias(c) for c in raw.columns]
    )


@dataclass(frozen=True)
class CheckedRecords:
    """``good`` rows with their types; ``bad`` rows as text, ``(cells map<string, string>, reasons array<string>)``."""

    good: DataFrame
    bad: DataFrame
    n_rows: int
    n_bad: int


def read_records_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, most_bad: float = 0.01, line_breaks_in_cells: bool = False
) -> CheckedRecords:
    """Read a CSV with header and set aside the rows that do not fit ``schema``, whatever the session does with bad casts.

    A row is bad if its line has another number of cells than the header, or if a cell that is not a missing-value spelling is no value of its
    column's type, or if a column that must not be null is.  Every reason of a row is named.  More than the share ``most_bad`` of
    bad rows stops the job with an error that counts the commonest reasons.  The file is read once; both tables are stored.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = {f.name: f for f in schema.fields}
    options = {"header": True, "escape": '"', "multiLine": line_breaks_in_cells}
    names = spark.read.options(**options).csv(path, inferSchema=False).columns
    missing = sorted(set(wanted) - set(names))
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    line = "_line"
    while line in names:
        line += "_"
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, line]])
    raw = spark.read.schema(text).options(**options, columnNameOfCorruptRecord=line, mode="PERMISSIVE").csv(path)
    cells = {c: null_tokens(F.col(f"`{c}`")) for c in names}
    kinds = {c: wanted[c].dataType if c in wanted else T.StringType() for c in names}
    reasons = [F.when(F.col(f"`{line}`").isNotNull(), "the line has another number of cells")]
    for c, kind in kinds.items():
        if not isinstance(kind, T.StringType):
            odd = cells[c].isNotNull() & cells[c].try_cast(kind).isNull()
            reasons.append(F.when(odd, F.concat(F.lit(f"{c} is no {kind.simpleString()}: "), cells[c])))
        if c in wanted and not wanted[c].nullable:
            reasons.append(F.when(cells[c].isNull(), f"{c} is missing"))
    typed = F.struct(*[cells[c].try_cast(kinds[c]).alias(c) for c in names]).alias("row")
    written = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`") for c in names]))
    why = F.array_compact(F.array(*reasons))
    bad = F.size("reasons") > 0
    marked = raw.select(typed, F.when(F.size(why) > 0, written).alias("cells"), why.alias("reasons"))
    seen, at = Observation(), scratch_path(spark)
    marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).write.parquet(at)
    stored = spark.read.parquet(at)
    n, n_bad = seen.get["n"], seen.get["bad"]
    if n_bad > most_bad * n:
        kind_of = F.regexp_extract("reason", "^[^:]*", 0).alias("kind")
        common = stored.select(F.explode("reasons").alias("reason")).groupBy(kind_of).count().orderBy(F.desc("count"), "kind").limit(5).collect()
        raise ValueError(f"{n_bad} of {n} rows of {path} are bad: " + ", ".join(f"{r['kind']} ({r['count']})" for r in common))
    good = stored.filter(~bad).select("row.*")
    return CheckedRecords(good, stored.filter(bad).select("cells", "reasons"), n, n_bad)


def read_ood(records: DataFrame, label: str = "category", ood: str = OOD_LABEL) -> DataFrame:
    """The rows of a record table that carry the OOD label."""
    return records.filter(F.col(label) == F.lit(ood))


EXAMPLE = "struct<tran_partclr:string,tran_amt_in_ac:double,dr_cr_indctor:string,tran_mode:string,category:string>"


LOUD = {"mode": "FAILFAST"}  # a file that is not the announced JSON stops the job


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``(category, pos, example)`` from a JSON object of category to example list."""
    by_category = F.from_json("value", f"map<string,array<{EXAMPLE}>>", LOUD)
    text = spark.read.text(path, wholetext=True)
    return (
        text.select(F.explode(by_category).alias("category", "examples"))
        .select("category", F.posexplode("examples").alias("pos", "example"))
    )


def read_ood_examples(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, example)`` from a JSON list of examples."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<{EXAMPLE}>", LOUD)).alias("pos", "example"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``(category, description)`` from a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>", LOUD)).alias("category", "description"))
