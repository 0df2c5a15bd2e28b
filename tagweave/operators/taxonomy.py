"""Open-vocabulary categories scored by their descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.fixed_values import CATEGORY_DESCRIPTIONS, TEXT_PROMPT
from tagweave.functions.session import literal_rows
from tagweave.operators.blocks import PackedCorpus, ScanLimits, block_scan
from tagweave.operators.features import EncoderSpec, text_vector, union_all
from tagweave.operators.neighbours import TopK
from tagweave.operators.scoring import Scores, every_score, min_max, mix

TEXT_SPEC = EncoderSpec(prompt=TEXT_PROMPT)


def description_table(spark: SparkSession, descriptions: Mapping[str, str] = CATEGORY_DESCRIPTIONS) -> DataFrame:
    return literal_rows(spark, list(descriptions.items()), "category string, description string")


def taxonomy(*layers: DataFrame) -> DataFrame:
    """``(category, description)``; a later layer overrides an earlier one."""
    numbered = [layer.select("category", "description", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    return union_all(numbered).groupBy("category").agg(F.max_by("description", "layer").alias("description"))


def embed_taxonomy(table: DataFrame, spec: EncoderSpec = TEXT_SPEC) -> DataFrame:
    """``(category, description, embedding)`` by the text part of the encoder."""
    return text_vector(table, "description", spec, "embedding")


def add_category(embedded: DataFrame, category: str, description: str, spec: EncoderSpec = TEXT_SPEC) -> DataFrame:
    """Add or replace one category; only the new description is embedded."""
    new = description_table(embedded.sparkSession, {category: description})
    others = embedded.filter(F.col("category") != category)
    return others.unionByName(embed_taxonomy(new, spec))


def with_taxonomy_scores(
    queries: DataFrame, embedded: DataFrame | PackedCorpus, limits: ScanLimits = ScanLimits()
) -> DataFrame:
    """Add ``taxonomy_scores array<struct<category, sim>>`` by category name.

    Queries carry the text vector as ``embedding``: both sides use the text part.
    """
    if not isinstance(embedded, PackedCorpus):
        embedded = embedded.select(F.col("category").alias("golden_id"), "embedding")
    scored = block_scan(queries, embedded, Scores(), "_scores", every_score(limits))
    renamed = F.transform("_scores", lambda s: F.struct(s.label_id.alias("category"), s.sim.alias("sim")))
    return scored.withColumn("taxonomy_scores", renamed).drop("_scores")


def taxonomy_scores(queries: DataFrame, embedded: DataFrame | PackedCorpus, **options) -> DataFrame:
    """The scores as rows ``(query_id, category, sim)``."""
    scored = with_taxonomy_scores(queries.select("query_id", "embedding"), embedded, **options)
    return scored.select("query_id", F.explode("taxonomy_scores").alias("s")).select("query_id", "s.category", "s.sim")


def taxonomy_predict(scored: DataFrame) -> DataFrame:
    """Add ``category`` and ``sim`` of the best description, ties to the first name."""
    best = F.array_min(
        F.transform("taxonomy_scores", lambda s: F.struct((-s.sim).alias("minus"), s.category.alias("category")))
    )
    named = scored.withColumn("_best", best)
    return named.withColumns({"category": F.col("_best.category"), "sim": -F.col("_best.minus")}).drop("_best")


def taxonomy_nearest(queries: DataFrame, embedded: DataFrame | PackedCorpus, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """Add ``category`` and ``sim`` of the best description without the scores of the others; the same choice as ``taxonomy_predict``."""
    if not isinstance(embedded, PackedCorpus):
        embedded = embedded.select(F.col("category").alias("golden_id"), "embedding")
    found = block_scan(queries, embedded, TopK(1, "ip"), "_best", limits)
    best = F.try_element_at("_best", F.lit(1))
    return found.withColumns({"category": best.golden_id, "sim": -best.sort_key}).drop("_best")


def taxonomy_blend(scored: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Rows ``(query_id, category, score)``: votes and descriptions blended, summing to 1.

    ``scored`` has ``named_vote array<struct<category, share>>`` and ``taxonomy_scores``.
    """
    blended = mix(F.map_from_entries("named_vote"), min_max(F.col("taxonomy_scores"), "category"), alpha)
    total = F.aggregate("_blend", F.lit(0.0), lambda sum_, b: sum_ + b.value) + F.lit(1e-9)
    summed = scored.select("query_id", blended.alias("_blend")).withColumn("_sum", total)
    return summed.select("query_id", "_sum", F.explode("_blend").alias("b")).select(
        "query_id", F.col("b.key").alias("category"), (F.col("b.value") / F.col("_sum")).alias("score")
    )
