"""From neighbour lists to predictions.

Every step is an expression on the query's own row (its neighbour array and its
prototype scores), so scoring adds no shuffle to the neighbour scan.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed_values import OOD_LABEL
from tagweave.functions.session import bounded, cut_lineage, stored_and_small
from tagweave.functions.vectors import each
from tagweave.operators.blocks import Kernel, PackedCorpus, ScanLimits, block_scan, pack

MAX_LABELS = 4_096


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def with_vote(scored: DataFrame) -> DataFrame:
    """Inverse-distance vote: ``vote array<struct<label_id, share>>`` by label."""
    weight = lambda n: F.lit(1.0) / (n.d2 + F.lit(1e-6))
    labels = F.array_sort(F.array_distinct(F.transform("neighbours", lambda n: n.label_id)))
    sums = F.transform(
        labels,
        lambda label: F.struct(
            label.alias("label_id"),
            _total(F.transform(F.filter("neighbours", lambda n: n.label_id == label), weight)).alias("sum"),
        ),
    )
    share = lambda s, total: F.struct(s.label_id.alias("label_id"), (s.sum / total).alias("share"))
    return scored.withColumn("vote", each(sums, _total(F.transform("neighbours", weight)), share))

SCORE_ROWS = 2048


def distance_vote(scored: DataFrame) -> DataFrame:
    """The vote as rows ``(query_id, label_id, share)``."""
    return with_vote(scored).select("query_id", F.explode("vote").alias("v")).select("query_id", "v.label_id", "v.share")


class Scores(Kernel):
    """Inner product of each query with each corpus row, in corpus id order."""

    def result_type(self, id_type):
        return T.ArrayType(
            T.StructType([T.StructField("label_id", id_type), T.StructField("sim", T.DoubleType())])
        )

    def run(self, ids, queries, extras, block):
        n, width = len(queries), len(block.ids)
        sims = queries @ block.matrix.T if width else np.zeros((n, 0))
        labels = block.ids.take(pa.array(np.tile(np.arange(width), n)))
        values = pa.StructArray.from_arrays([labels, pa.array(sims.ravel())], names=["label_id", "sim"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)

    def merge(self, value: Column) -> Column:
        return F.array_sort(F.flatten(F.collect_list(value)))


def pack_prototypes(prototypes: DataFrame, limits: ScanLimits = ScanLimits()) -> PackedCorpus | DataFrame:
    return pack(prototype_corpus(prototypes), limits)


def prototype_corpus(prototypes: DataFrame) -> DataFrame:
    return prototypes.select(F.col("label_id").alias("golden_id"), F.col("proto").alias("embedding"))


def with_prototype_scores(
    queries: DataFrame, prototypes: DataFrame | PackedCorpus, limits: ScanLimits = ScanLimits()
) -> DataFrame:
    """Add ``proto_scores array<struct<label_id, sim>>``, all prototypes by label."""
    if isinstance(prototypes, DataFrame) and "proto" in prototypes.columns:
        prototypes = prototype_corpus(prototypes)
    return block_scan(queries, prototypes, Scores(), "proto_scores", every_score(limits))


def every_score(limits: ScanLimits) -> ScanLimits:
    """Limits for a kernel that returns every product: a task then holds a few million of them."""
    return replace(limits, block_rows=min(limits.block_rows, SCORE_ROWS), chunk_rows=min(limits.chunk_rows, SCORE_ROWS), copies=None)


def prototype_scores(queries: DataFrame, prototypes: DataFrame | PackedCorpus, **options) -> DataFrame:
    """The scores as rows ``(query_id, label_id, sim)``."""
    scored = with_prototype_scores(queries.select("query_id", "embedding"), prototypes, **options)
    return scored.select("query_id", F.explode("proto_scores").alias("p")).select("query_id", "p.label_id", "p.sim")


def min_max(scores: Column, name: str) -> Column:
    """Map of ``name`` to its score, stretched to 0..1 within the row."""
    sims = F.transform(scores, lambda p: p.sim)
    span = F.struct(F.array_min(sims).alias("lo"), F.array_max(sims).alias("hi"))
    stretched = each(
        scores, span, lambda p, s: F.struct(p.getField(name), (p.sim - s.lo) / (s.hi - s.lo + F.lit(1e-9)))
    )
    return F.map_from_entries(stretched)


def mix(left: Column, right: Column, alpha: float) -> Column:
    """``alpha * left + (1 - alpha) * right`` per key of either map, by key.

    A full outer join of two maps: a key that one side lacks counts as 0 there.
    """
    zero = F.lit(0.0)
    mixed = F.map_zip_with(
        left,
        right,
        lambda _, a, b: F.lit(alpha) * F.coalesce(a, zero) + F.lit(1.0 - alpha) * F.coalesce(b, zero),
    )
    return F.array_sort(F.map_entries(mixed))


def with_blend(scored: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Blend vote and prototypes; add ``blend``, ``predicted_label_id`` and ``confidence``.

    Equal scores go to the lowest label.
    """
    blended = mix(F.map_from_entries("vote"), min_max(F.col("proto_scores"), "label_id"), alpha)
    best = F.array_min(F.transform("_blend", lambda b: F.struct((-b.value).alias("minus"), b.key.alias("label_id"))))
    named = F.transform("_blend", lambda b: F.struct(b.key.alias("label_id"), b.value.alias("score")))
    return (
        scored.withColumn("_blend", blended)
        .withColumns({"_best": best, "_sum": _total(F.transform("_blend", lambda b: b.value)), "blend": named})
        .withColumn("predicted_label_id", F.col("_best.label_id"))
        .withColumn("confidence", -F.col("_best.minus") / (F.col("_sum") + F.lit(1e-9)))
        .drop("_blend", "_best", "_sum")
    )


def with_ood(scored: DataFrame, threshold: float | None) -> DataFrame:
    """Nearest squared distance against the threshold; no threshold flags nothing."""
    limit = F.lit(threshold).cast("double")
    return (
        scored.withColumn("ood_distance", F.try_element_at("neighbours", F.lit(1)).d2)
        .withColumn("ood_threshold", limit)
        .withColumn("is_ood", F.coalesce(F.col("ood_distance") > limit, F.lit(False)))
    )


def with_routing(scored: DataFrame, confidence_threshold: float = 0.75) -> DataFrame:
    """OOD with low confidence becomes ``other`` at 0.0; either one asks for review."""
    low = F.col("confidence") < F.lit(confidence_threshold)
    overruled = F.col("is_ood") & low
    return (
        scored.withColumn("needs_llm", F.col("is_ood") | low)
        .withColumn("predicted_category", F.when(overruled, F.lit(OOD_LABEL)).otherwise(F.col("predicted_category")))
        .withColumn("confidence", F.when(overruled, F.lit(0.0)).otherwise(F.col("confidence")))
    )


def label_map(labels: DataFrame) -> Column:
    """The label table as one map value, after its size is checked."""
    if labels.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} categories; join label_names() instead")
    return labels.agg(F.map_from_entries(F.collect_list(F.struct("label_id", "category")))).scalar()


def few_labels(labels: DataFrame) -> bool:
    return labels.limit(MAX_LABELS + 1).count() <= MAX_LABELS


def with_names(scored: DataFrame, labels: DataFrame, few: bool | None = None) -> DataFrame:
    """``with_categories`` for a label table of any size: beyond ``MAX_LABELS`` the names of a row's own labels are joined.

    ``few`` says which it is where that is known, so that nothing has to be counted.
    """
    if few_labels(labels) if few is None else few:
        return with_categories(scored, label_map(labels))
    scored = cut_lineage(scored)
    own = F.concat(F.array("predicted_label_id"), F.transform("vote", lambda v: v.label_id), F.transform("neighbours", lambda n: n.label_id))
    used = scored.select("query_id", F.explode(F.array_distinct(own)).alias("label_id")).distinct()
    pairs = F.collect_list(F.struct("label_id", "category"))
    named = used.join(labels.select("label_id", "category"), "label_id").groupBy("query_id").agg(F.map_from_entries(pairs).alias("_own_names"))
    return with_categories(scored.join(named, "query_id", "left"), F.col("_own_names")).drop("_own_names")


def with_categories(scored: DataFrame, names: Column) -> DataFrame:
    """Category names for the prediction, the vote and the neighbours.

    ``vote_distribution`` is an array in falling order because maps have no order.
    """
    name_of = lambda label, default: F.coalesce(F.try_element_at("_names", label), default)
    ordered = F.array_sort(
        F.transform("vote", lambda v: F.struct((-v.share).alias("minus"), v.label_id.alias("label_id")))
    )
    return (
        scored.withColumn("_names", names)
        .withColumn("predicted_category", name_of(F.col("predicted_label_id"), F.lit(OOD_LABEL)))
        .withColumn(
            "vote_distribution",
            F.transform(
                ordered,
                lambda v: F.struct(
                    name_of(v.label_id, v.label_id.cast("string")).alias("category"),
                    F.round(-v.minus, 4).alias("share"),
                ),
            ),
        )
        .withColumn("top_k_labels", F.transform("neighbours", lambda n: name_of(n.label_id, F.lit("N/A"))))
        .withColumn("distances", F.transform("neighbours", lambda n: n.d2))
        .drop("_names")
    )


def label_names(df: DataFrame, labels: DataFrame, default: str = OOD_LABEL) -> DataFrame:
    """Left join of category names onto ``label_id`` with a default."""
    return df.join(labels.select("label_id", "category"), "label_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(default))
    )


def attach_golden(neighbours: DataFrame, golden: DataFrame, *columns: str) -> DataFrame:
    """Metadata of each neighbour row, by ``golden_id``."""
    return neighbours.join(golden.select("golden_id", *columns), "golden_id")


#: What is shown of a retrieved record, and the columns it comes from.
RECORD_FIELDS = {
    "description": "tran_partclr", "amount": "tran_amt_in_ac", "dr_cr": "dr_cr_indctor",
    "mode": "tran_mode", "date": "tran_date", "category": "category",
}


#: Longest neighbour lists that meet their records in the row, by one broadcast join for each rank.
MOST_RANKS = 64


def with_similar(scored: DataFrame, golden: DataFrame, fields: dict[str, str] = RECORD_FIELDS) -> DataFrame:
    """Add ``similar``: the neighbours with their own record, in rank order.

    ``fields`` maps output names to golden columns; one the golden table lacks is null.  Records of a golden table of checked size join each
    rank of the scored row by a broadcast, so that no record and no scored row is shuffled; a larger table is joined by id.  Rows that share
    a ``query_id`` share their neighbours; a row without an id, or without a golden record among its neighbours, has no list.
    ``scored`` is read more than once, so it should be a stored table.
    """
    there = {name: F.col(c) if c in golden.columns else F.lit(None).cast("string") for name, c in fields.items()}
    known = golden.select("golden_id", F.struct(*[c.alias(name) for name, c in there.items()]).alias("record"))
    known = known.filter(F.col("golden_id").isNotNull()).groupBy("golden_id").agg(F.collect_list("record").alias("records"))
    known, _, small = stored_and_small(known)
    own, rows = F.when(F.col("query_id").isNotNull(), F.col("neighbours")), _id_first(scored)
    if small:
        repeated, n_repeated, few = stored_and_small(scored.groupBy("query_id").count().filter("count > 1 AND query_id IS NOT NULL").select("query_id"))
        if n_repeated:
            shared = scored.select("query_id", "neighbours").join(F.broadcast(repeated) if few else repeated, "query_id", "left_semi")
            shared = bounded(shared.groupBy("query_id").agg(F.flatten(F.collect_list("neighbours")).alias("_shared")))
            rows, own = rows.join(shared, "query_id", "left"), F.coalesce("_shared", own)
        rows = rows.withColumn("_near", own).drop("_shared")
        ranks = rows.agg(F.max(F.size("_near"))).first()[0] or 0
        if ranks <= MOST_RANKS:
            return _records_by_rank(rows, known, max(1, ranks))
    near = scored.select("query_id", F.explode("neighbours").alias("n")).join(known, F.col("n.golden_id") == F.col("golden_id"))
    lists = near.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(_with_records(F.col("n"), F.col("records"))))).alias("similar"))
    return scored.join(lists, "query_id", "left")


def _id_first(df: DataFrame) -> DataFrame:
    """Columns in the order a join by ``query_id`` gives."""
    return df.select("query_id", *[c for c in df.columns if c != "query_id"])


def _with_records(neighbour: Column, records: Column) -> Column:
    """The neighbour once for each record of its id."""
    parts = [neighbour[c].alias(c) for c in ("rk", "golden_id", "label_id", "d2")]
    return F.transform(records, lambda r: F.struct(*parts, r.alias("record")))


def _records_by_rank(rows: DataFrame, known: DataFrame, ranks: int) -> DataFrame:
    """``rows`` with the records of their column ``_near``, rank by rank."""
    columns = [c for c in rows.columns if c != "_near"]
    for j in range(ranks):
        one = known.toDF(f"_id{j}", f"_records{j}")
        rows = rows.join(F.broadcast(one), F.get("_near", F.lit(j)).golden_id == F.col(f"_id{j}"), "left")
    lists = [F.coalesce(_with_records(F.get("_near", F.lit(j)), F.col(f"_records{j}")), F.array()) for j in range(ranks)]
    found = rows.select(*columns, F.array_sort(F.flatten(F.array(*lists))).alias("_similar"))
    return found.select(*columns, F.when(F.size("_similar") > 0, F.col("_similar")).alias("similar"))
