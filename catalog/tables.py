"""The given tables in the shape the operators take, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OOD_ID = 9


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as ``(golden_id, label_id, embedding)``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("golden_id"), F.col("label").alias("label_id"), "embedding"
    )


def golden(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).filter(F.col("label_id") != OOD_ID)


def outside(spark: SparkSession, folder: str) -> DataFrame:
    ood = vectors(spark, folder).filter(F.col("label_id") == OOD_ID)
    return ood.withColumnRenamed("golden_id", "query_id")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select(F.col("golden_id").alias("query_id"), "embedding", F.col("label_id").alias("true_label"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of the in-distribution labels."""
    ids = golden(spark, folder).select("label_id").distinct()
    return ids.select("label_id", F.concat(F.lit("class "), F.col("label_id").cast("string")).alias("category"))


# --- SQL --------------------------------------------------------------------------


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def length(v: str) -> str:
    return f"(sqrt(list_sum(list_transform({v}, lambda x: x * x))) + 1e-9)"


def scaled(v: str, by: str) -> str:
    """A vector divided by a column (which must not be an expression: it would be redone per entry)."""
    return f"list_transform({v}, lambda x: x / {by})"


E = f"""
e AS MATERIALIZED (SELECT vec_id AS id, label AS label_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS MATERIALIZED (SELECT * FROM e WHERE label_id <> {OOD_ID})"""

PAIRS = f"""
pairs AS MATERIALIZED (
  SELECT q.id AS query_id, q.label_id AS true_label, g.id AS golden_id, g.label_id, {d2('q.v', 'g.v')} AS d2
  FROM e q JOIN g ON q.id <> g.id)"""


def top(k: int, source: str = "pairs", name: str = "nn", order: str = "d2, golden_id") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {order}))::INTEGER AS rk
  FROM {source} QUALIFY rk <= {k})"""


PROTO = f"""
means AS (
  SELECT label_id, pos, avg(x) AS m
  FROM (SELECT label_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM g) GROUP BY ALL),
proto AS MATERIALIZED (
  SELECT label_id, list(m / n ORDER BY pos) AS p
  FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label_id)) + 1e-9 AS n FROM means) GROUP BY label_id)"""

VOTE = """
vote AS MATERIALIZED (
  SELECT query_id, label_id, sum(w) / any_value(total) AS share
  FROM (SELECT query_id, label_id, 1 / (d2 + 1e-6) AS w, sum(1 / (d2 + 1e-6)) OVER (PARTITION BY query_id) AS total FROM nn)
  GROUP BY query_id, label_id)"""

SIMS = f"""
sims AS MATERIALIZED (
  SELECT q.id AS query_id, proto.label_id, {dot('q.v', 'proto.p')} AS sim FROM e q CROSS JOIN proto)"""

BLEND = """
blended AS MATERIALIZED (
  SELECT query_id, label_id, 0.6 * coalesce(share, 0) + 0.4 * coalesce((sim - lo) / (hi - lo + 1e-9), 0) AS score
  FROM vote FULL JOIN (
    SELECT *, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM sims
  ) s USING (query_id, label_id)),
best AS MATERIALIZED (
  SELECT query_id, label_id, score / (sum(score) OVER (PARTITION BY query_id) + 1e-9) AS confidence
  FROM blended QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label_id) = 1)"""

DISTANCES = f"""
in_d AS MATERIALIZED (
  SELECT a.id AS golden_id, min({d2('a.v', 'b.v')}) AS d2 FROM g a JOIN g b ON a.id <> b.id GROUP BY a.id),
ood_d AS MATERIALIZED (
  SELECT a.id AS query_id, min({d2('a.v', 'b.v')}) AS d2
  FROM (SELECT * FROM e WHERE label_id = {OOD_ID}) a CROSS JOIN g b GROUP BY a.id),
all_d AS MATERIALIZED (SELECT d2, 0 AS ood FROM in_d UNION ALL SELECT d2, 1 FROM ood_d)"""

SWEEP = """
cand AS (
  SELECT unnest(range(43)) AS pos,
    unnest((SELECT quantile_cont(d2, [""" + ", ".join(f"{p / 100}" for p in range(10, 96, 2)) + """]) FROM all_d)) AS t),
counts AS (
  SELECT pos, t, count(*) FILTER (d2 > t AND ood = 1) AS tp, count(*) FILTER (d2 > t AND ood = 0) AS fp,
    count(*) FILTER (d2 <= t AND ood = 1) AS fn
  FROM cand CROSS JOIN all_d GROUP BY pos, t),
f1s AS (
  SELECT pos, t, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM counts WHERE tp + fp > 0 AND tp + fn > 0),
swept AS (SELECT pos, t, 2 * p * r / (p + r + 1e-9) AS f1 FROM f1s),
threshold AS MATERIALIZED (SELECT t AS threshold, f1 FROM swept WHERE f1 > 0 ORDER BY f1 DESC, pos LIMIT 1)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
