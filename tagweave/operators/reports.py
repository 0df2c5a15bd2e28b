"""Summaries, distributions, export rows and label-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.order import percentiles, value_counts


def low_confidence(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    return df.filter(F.col("confidence") < F.lit(threshold))


def summary(df: DataFrame) -> DataFrame:
    """One row: totals, OOD and review counts with shares, overrides, mean confidence."""
    n = F.count(F.lit(1))
    overridden = F.col("llm_overridden") if "llm_overridden" in df.columns else F.lit(False)
    ood, review = F.count_if("is_ood"), F.count_if("needs_llm")
    return df.agg(
        n.alias("total"),
        ood.alias("ood"),
        (ood / F.greatest(n, F.lit(1))).alias("ood_share"),
        review.alias("needs_llm"),
        (review / F.greatest(n, F.lit(1))).alias("needs_llm_share"),
        F.count_if(overridden).alias("llm_overrides"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def confidence_stats(df: DataFrame) -> DataFrame:
    """One row: exact mean, median, minimum and maximum confidence."""
    median = percentiles(value_counts(df, "confidence"), [0.5]).select("value").scalar()
    return df.agg(
        F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max")
    ).withColumn("median", median)


def category_distribution(df: DataFrame, category: str = "predicted_category") -> DataFrame:
    """``(category, n, share)``, most frequent first."""
    counts = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total).select(
        "category", "n", (F.col("n") / F.col("total")).alias("share")
    ).orderBy(F.desc("n"), "category")


def class_bars(counts: DataFrame, label: str) -> DataFrame:
    """``(label, n, bar)``: a text histogram of at most 40 marks, largest class first."""
    top = counts.agg(F.max("n")).scalar()
    unit = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("top") / 40))
    marks = F.least(F.lit(40).cast("bigint"), F.floor(F.col("n") / unit)).cast("int")
    return counts.withColumn("top", top).select(
        label, "n", F.repeat(F.lit("#"), marks).alias("bar")
    ).orderBy(F.desc("n"), label)


def suspicious_golden(neighbours: DataFrame) -> DataFrame:
    """Golden records that may be mislabelled, one row each.

    ``neighbours`` has ``query_id, expected, predicted, rk, golden_id, label, d2``.  For a
    wrong prediction each neighbour whose label differs from the expected one is a
    hit; the last hit in (query, rank) order is kept, with the number of hits.
    """
    found = neighbours.filter((F.col("expected") != F.col("predicted")) & (F.col("label") != F.col("expected")))
    last = F.max_by(F.struct("query_id", "label", "expected", "d2"), F.struct("query_id", "rk"))
    return found.groupBy("golden_id").agg(last.alias("l"), F.count(F.lit(1)).alias("hits")).select(
        "golden_id",
        F.col("l.label").alias("golden_label"),
        F.col("l.query_id").alias("query_id"),
        F.col("l.expected").alias("expected_label"),
        F.col("l.d2").alias("d2"),
        "hits",
    )


def shorten(text: Column, length: int, mark: str) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def present(df: DataFrame, text: str = "tran_partclr") -> DataFrame:
    """Console columns: shortened text and category, whole-percent confidence, flags."""
    overridden = F.col("llm_overridden") if "llm_overridden" in df.columns else F.lit(False)
    return df.select(
        "query_id",
        shorten(F.col(text), 39, "…").alias("description"),
        F.substring("predicted_category", 1, 23).alias("category"),
        F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("confidence"),
        F.when(F.col("is_ood"), "Y").otherwise(F.lit("-")).alias("ood"),
        F.when(overridden, "Y").when(F.col("needs_llm"), "-").otherwise(F.lit(" ")).alias("llm"),
    )


def summary_table(df: DataFrame, k: int = 10, text: str = "tran_partclr", amount: str = "tran_amt_in_ac") -> DataFrame:
    """Prediction table with the confidence as ``votes`` out of k."""
    votes = F.floor(F.col("confidence") * k).cast("string")
    return df.select(
        "query_id",
        shorten(F.col(text), 50, "...").alias("description"),
        F.col(amount).alias("amount"),
        "predicted_category",
        F.round("confidence", 4).alias("confidence"),
        F.concat(votes, F.lit(f"/{k}")).alias("votes"),
    )


def _top3(field) -> Column:
    return F.array_join(F.transform(F.slice(F.coalesce("similar", F.array()), 1, 3), field), " | ")


def export_rows(df: DataFrame) -> DataFrame:
    """The 14 columns of the result file."""
    overridden = F.col("llm_overridden") if "llm_overridden" in df.columns else F.lit(False)
    return df.select(
        "cust_id",
        "tran_date",
        F.col("tran_partclr").alias("description"),
        F.col("tran_amt_in_ac").alias("amount"),
        F.col("tran_mode").alias("mode"),
        F.col("dr_cr_indctor").alias("dr_cr"),
        "predicted_category",
        F.round("confidence", 4).alias("confidence"),
        "is_ood",
        F.round("ood_distance", 4).alias("ood_distance"),
        "needs_llm",
        overridden.alias("llm_overridden"),
        _top3(lambda s: F.substring(F.coalesce(s.record.description, F.lit("N/A")), 1, 30)).alias("top3_retrieved_desc"),
        _top3(lambda s: F.coalesce(s.record.category, F.lit("N/A"))).alias("top3_retrieved_cats"),
    )


def export_wide(df: DataFrame, truth: str | None = "category") -> DataFrame:
    """One row per record with ``similar_1..3_*`` columns and, if known, the ground truth."""
    known = []
    if truth and truth in df.columns:
        same = F.coalesce(F.col(truth) == F.col("predicted_category"), F.lit(False))
        known = [F.col(truth).alias("ground_truth"), same.alias("correct")]
    near = []
    for j in (1, 2, 3):
        one = F.try_element_at("similar", F.lit(j))
        near += [
            one.golden_id.alias(f"similar_{j}_index"),
            one.record.description.alias(f"similar_{j}_description"),
            one.record.category.alias(f"similar_{j}_label"),
            one.d2.alias(f"similar_{j}_distance"),
        ]
    return df.select(
        F.col("query_id").alias("transaction_index"),
        F.col("tran_partclr").alias("description"),
        F.col("tran_amt_in_ac").alias("amount"),
        F.col("tran_mode").alias("mode"),
        F.col("dr_cr_indctor").alias("dr_cr"),
        "predicted_category",
        "confidence",
        "vote_distribution",
        *known,
        *near,
    )


def explain_votes(df: DataFrame, query_id=None, top: int = 5) -> DataFrame:
    """``(query_id, place, category, share)``: the strongest votes of one or all records."""
    chosen = df if query_id is None else df.filter(F.col("query_id") == F.lit(query_id))
    return chosen.select("query_id", F.posexplode(F.slice("vote_distribution", 1, top)).alias("place", "v")).select(
        "query_id", (F.col("place") + 1).alias("place"), "v.category", "v.share"
    )


def explain_neighbours(df: DataFrame, query_id=None) -> DataFrame:
    """``(query_id, rk, golden_id, d2, record)``: what was retrieved for one or all records."""
    chosen = df if query_id is None else df.filter(F.col("query_id") == F.lit(query_id))
    return chosen.select("query_id", F.explode("similar").alias("s")).select(
        "query_id", "s.rk", "s.golden_id", "s.d2", "s.record.*"
    )


def head(df: DataFrame, n: int, id_col: str = "query_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


