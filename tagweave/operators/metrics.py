"""Evaluation: retrieval, classification, calibration and embedding losses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.order import value_counts, with_rows_before
from tagweave.functions.session import bounded, cut_lineage
from tagweave.operators.blocks import (
    MOST_MARKED,
    Block,
    Kernel,
    PackedCorpus,
    ScanLimits,
    block_scan,
    coarse_estimates,
    estimates,
    marked,
    matrix_of,
    own_positions,
    pack,
    squared_distances,
    strips,
    upwards,
)
from tagweave.operators.neighbours import TopK, nearest
from tagweave.operators.sampling import mine_triplets


def _order(queries: np.ndarray, own: np.ndarray, goal: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many other rows are surely nearer than each query's goal, and rows and columns of the pairs that may be as near."""
    near, slack = estimates(queries, block)
    here = np.flatnonzero(own >= 0)
    near[here, own[here]] = np.inf
    rows, cols = np.nonzero(np.abs(near - goal[:, None]) <= slack[:, None])
    return (near < (goal - slack)[:, None]).sum(axis=1), rows, cols


def _coarse_order(queries: np.ndarray, own: np.ndarray, goal: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``_order`` by single-precision estimates; None if these leave too many pairs."""
    held = coarse_estimates(queries, block)
    if held is None:
        return None
    near, q2, slack = held
    here = np.flatnonzero(own >= 0)
    near[here, own[here]] = np.inf
    below = near < -upwards(q2 + slack - goal)
    rows, cols = marked((near <= upwards(goal - q2 + slack)) ^ below)
    if len(rows) > max(8 * len(near), MOST_MARKED * near.size):
        return None
    return np.array([np.count_nonzero(row) for row in below], np.int64), rows, cols


class CountBefore(Kernel):
    """How many other rows come before ``(at_d2, at_id)`` in a query's ranking."""

    extras = ("at_d2", "at_id")

    def result_type(self, id_type):
        return T.LongType()

    def run(self, ids, queries, extras, block):
        at_d2 = extras[0].fill_null(-1.0).to_numpy(zero_copy_only=False)
        at_id = extras[1].to_numpy(zero_copy_only=False)
        block_ids = block.ids.to_numpy(zero_copy_only=False)
        own = own_positions(ids, block)
        counts = np.zeros(len(queries), np.int64)
        for s in strips(len(queries), len(block.ids)):
            below, rows, cols = _coarse_order(queries[s], own[s], at_d2[s], block) or _order(queries[s], own[s], at_d2[s], block)
            counts[s] += below
            exact = squared_distances(queries[s], rows, block.matrix, cols)
            goal, names = at_d2[s][rows], at_id[s][rows]
            first = (exact < goal) | ((exact == goal) & (block_ids[cols] < names))
            counts[s] += np.bincount(rows[first], minlength=len(counts[s]))
        return pa.array(counts)

    def merge(self, value: Column) -> Column:
        return F.sum(value)


class Profile(Kernel):
    """Count, least, greatest and summed plain distance to all other rows."""

    def result_type(self, id_type):
        names = ["least", "greatest", "total"]
        return T.StructType(
            [T.StructField("n", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in names]
        )

    def run(self, ids, queries, extras, block):
        own = own_positions(ids, block)
        out = {"n": [], "least": [], "greatest": [], "total": []}
        for s in strips(len(queries), len(block.ids)):
            near, _ = estimates(queries[s], block)
            far = np.sqrt(np.maximum(near, 0.0))
            other = np.ones(far.shape, bool)
            here = np.flatnonzero(own[s] >= 0)
            other[here, own[s][here]] = False
            out["n"].append(other.sum(axis=1))
            out["least"].append(np.where(other, far, np.inf).min(axis=1))
            out["greatest"].append(np.where(other, far, -np.inf).max(axis=1))
            out["total"].append(np.where(other, far, 0.0).sum(axis=1))
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0)) for v in out.values()]
        return pa.StructArray.from_arrays([arrays[0].cast(pa.int64()), *arrays[1:]], names=list(out))

    def merge(self, value: Column) -> Column:
        field = value.getField
        return F.struct(
            F.sum(field("n")).alias("n"),
            F.min(field("least")).alias("least"),
            F.max(field("greatest")).alias("greatest"),
            F.sum(field("total")).alias("total"),
        )


def as_queries(golden: DataFrame) -> DataFrame:
    """A corpus asked about itself."""
    return golden.select(F.col("golden_id").alias("query_id"), "label_id", "embedding")


def distance_profile(golden: DataFrame, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """Pairwise plain distances of a set, self excluded, reduced to one row each."""
    scanned = block_scan(as_queries(golden), golden, Profile(), "p", limits)
    return scanned.select("query_id", "p.n", "p.least", "p.greatest", (F.col("p.total") / F.col("p.n")).alias("mean"))


def loo_neighbours(
    golden: DataFrame, k: int, packed: DataFrame | PackedCorpus | None = None, limits: ScanLimits = ScanLimits()
) -> DataFrame:
    """Leave-one-out neighbours ``(query_id, label_id, neighbours)``."""
    found = nearest(as_queries(golden), golden if packed is None else packed, k, exclude_self=True, limits=limits)
    return found.select("query_id", "label_id", "neighbours")


def hits(found: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Add one 0/1 column ``hit_k`` per k: a neighbour of the same label within rank k."""
    for k in ks:
        match = F.exists(F.slice("neighbours", 1, k), lambda n: n.label_id == F.col("label_id"))
        found = found.withColumn(f"hit_{k}", match.cast("int"))
    return found


def recall_at_k(golden: DataFrame, ks: Sequence[int] = (1, 5, 10), found: DataFrame | None = None, **options) -> DataFrame:
    """Rows ``(k, recall)`` of leave-one-out retrieval."""
    found = loo_neighbours(golden, max(ks), **options) if found is None else found
    means = hits(found, ks).agg(*[F.avg(f"hit_{k}").alias(f"r{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])
    return means.select(F.explode(pairs).alias("m")).select("m.*")


def loo_predictions(golden: DataFrame, found: DataFrame | None = None, **options) -> DataFrame:
    """1-NN label of each row: ``(query_id, true_label, pred_label)``."""
    found = loo_neighbours(golden, 1, **options) if found is None else found
    first = F.try_element_at("neighbours", F.lit(1)).label_id
    return found.select("query_id", F.col("label_id").alias("true_label"), first.alias("pred_label"))


def loo_accuracy(golden: DataFrame, **options) -> DataFrame:
    return accuracy(loo_predictions(golden, **options))


def accuracy(predictions: DataFrame) -> DataFrame:
    same = F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False))
    return predictions.agg(F.avg(same.cast("int")).alias("accuracy"))


def first_match_rank(
    golden: DataFrame, packed: DataFrame | PackedCorpus | None = None, limits: ScanLimits = ScanLimits()
) -> DataFrame:
    """Rank of the nearest row of the same label in the full ranking, null if none.

    Nothing is sorted: find that row, then count the rows before it.
    """
    packed = pack(golden, limits) if packed is None else packed
    asked = block_scan(as_queries(golden), packed, TopK(1, exclude_self=True, same_label=True), "m", limits)
    best = F.try_element_at("m", F.lit(1))
    aimed = asked.withColumn("at_d2", best.sort_key).withColumn("at_id", best.golden_id).drop("m")
    counted = block_scan(aimed, packed, CountBefore(), "before", limits)
    rank = F.when(F.col("at_d2").isNotNull(), F.col("before") + 1)
    return counted.select("query_id", "label_id", rank.alias("first_rank"))


def mrr(golden: DataFrame, **options) -> DataFrame:
    return mean_reciprocal_rank(first_match_rank(golden, **options))


def mean_reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """One row ``mrr`` from ``first_rank``; no match counts as zero."""
    return ranked.agg(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


# --- Classification ------------------------------------------------------------


def class_report(predictions: DataFrame, worst_n: int | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per true or predicted label.

    Rows are reduced to one per pair of labels before anything else.  ``worst_n``
    keeps the labels with the lowest F1.
    """
    pairs = predictions.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    right = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(zero)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), zero.alias("claimed"), right.alias("tp")),
                F.struct(F.col("pred_label").alias("label"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.filter(F.col("label").isNotNull()).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "claimed", "support")]
    )
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    report = totals.select(
        "label",
        ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(F.lit(2.0) * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )
    return report if worst_n is None else report.orderBy("f1", "label").limit(worst_n)


def f1_scores(predictions: DataFrame) -> DataFrame:
    """One row: macro and support-weighted F1."""
    return class_report(predictions).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def report_averages(predictions: DataFrame) -> DataFrame:
    """The average rows of a classification report: ``(average, precision, recall, f1)``."""
    report = class_report(predictions)
    names = ("precision", "recall", "f1")
    sums = report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in names],
    )
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("average"), *[F.col(f"{kind}_{c}").alias(c) for c in names])
            for kind in ("macro", "weighted")
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


# --- Calibration and separation --------------------------------------------------


def ece_bins(df: DataFrame, confidence: str, correct: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins ``(lo, hi]``; rows at 0 go to bin 0 and only count in the total."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(n_bins)], F.lit(1.0))
    bin_no = F.size(F.filter(edges, lambda e: e < F.col(confidence)))
    return (
        df.filter(F.col(confidence).isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(confidence).alias("avg_confidence"),
            F.avg(F.col(correct).cast("double")).alias("avg_correct"),
        )
    )


def ece(df: DataFrame, confidence: str = "confidence", correct: str = "correct", n_bins: int = 10) -> DataFrame:
    """One row ``ece``: expected calibration error."""
    inside = (F.col("bin") >= 1) & (F.col("bin") <= n_bins)
    gap = F.when(inside, F.col("n") * F.abs(F.col("avg_confidence") - F.col("avg_correct"))).otherwise(F.lit(0.0))
    return ece_bins(df, confidence, correct, n_bins).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ood_auroc(in_d: DataFrame, ood_d: DataFrame, score: str = "d2") -> DataFrame:
    """One row ``auroc`` by the rank-sum rule, equal scores sharing their mean rank."""
    marked = in_d.select(F.col(score).cast("double").alias("s"), F.lit(0).alias("ood")).unionByName(
        ood_d.select(F.col(score).cast("double").alias("s"), F.lit(1).alias("ood"))
    )
    ranked = with_rows_before(value_counts(marked, "s", {"n_ood": F.sum("ood")}))
    sums = ranked.agg(
        F.sum(F.col("n_ood") * (F.col("before") + (F.col("n") + 1) / F.lit(2.0))).alias("ranks"),
        F.sum("n_ood").cast("double").alias("p"),
        (F.sum("n") - F.sum("n_ood")).cast("double").alias("q"),
    )
    area = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / F.lit(2.0)) / (F.col("p") * F.col("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), area).otherwise(F.lit(float("nan"))).alias("auroc"))


# --- Losses ------------------------------------------------------------------------


def triplet_loss(triplets: DataFrame, margin: float = 0.5) -> DataFrame:
    """One row ``loss``: mean over batches of the mean hinge of a batch; 0 if none."""
    hinge = F.greatest(F.lit(0.0), F.col("d_ap") - F.col("d_an") + F.lit(margin))
    per_batch = triplets.groupBy("batch_id").agg(F.avg(hinge).alias("loss"))
    return per_batch.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def supcon_loss(
    batched: DataFrame,
    temperature: float = 0.07,
    weights: DataFrame | None = None,
    temperatures: DataFrame | None = None,
) -> DataFrame:
    """Supervised contrastive loss ``(batch_id, anchors, loss)`` of each batch.

    ``weights (label_id, weight)`` and ``temperatures (label_id, temperature)`` are
    per-class tables.  ``anchors`` counts rows with a positive; without one the loss is 0.  A
    batch is compared strip by strip, so a task's memory grows with its rows, not their square.
    """
    rows = batched.select("batch_id", "seat", "label_id", "embedding")
    rows = rows.join(bounded(weights), "label_id", "left") if weights is not None else rows.withColumn("weight", F.lit(1.0))
    if temperatures is not None:
        rows = rows.join(bounded(temperatures), "label_id", "left")
    else:
        rows = rows.withColumn("temperature", F.lit(temperature))
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn(
        "temperature", F.coalesce("temperature", F.lit(temperature))
    )

    def loss(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seat", "ascending")]).combine_chunks()
        points = matrix_of(table["embedding"].combine_chunks())
        labels = table["label_id"].to_numpy()
        temperature, weight = table["temperature"].to_numpy(), table["weight"].to_numpy()
        losses = []
        for s in strips(len(points), len(points)):
            own = np.arange(len(points))[s]
            here = np.arange(len(own))
            sims = points[s] @ points.T / temperature[s][:, None]
            sims[here, own] = -np.inf
            positive = labels[s][:, None] == labels[None, :]
            positive[here, own] = False
            count = positive.sum(axis=1)
            valid = count > 0
            if valid.any():
                top = sims.max(axis=1, keepdims=True)
                denominator = top[:, 0] + np.log(np.exp(sims - top).sum(axis=1))
                drawn = np.where(positive, sims, 0.0).sum(axis=1)
                losses.append((denominator[valid] - drawn[valid] / count[valid]) * weight[s][valid])
        each = np.concatenate(losses) if losses else np.zeros(0)
        mean = float(each.mean()) if len(each) else 0.0
        return pa.table(
            {
                "batch_id": table["batch_id"].slice(0, 1),
                "anchors": pa.array([len(each)], pa.int32()),
                "loss": pa.array([mean]),
            }
        )

    return rows.groupBy("batch_id").applyInArrow(loss, "batch_id bigint, anchors int, loss double")


@dataclass(frozen=True)
class EvaluationSpec:
    ks: tuple[int, ...] = (1, 5, 10)
    margin: float = 0.5
    max_triplets: int = 64
    seed: int = 42


def evaluate(
    golden: DataFrame,
    batched: DataFrame,
    spec: EvaluationSpec = EvaluationSpec(),
    limits: ScanLimits = ScanLimits(),
    found: DataFrame | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """All headline metrics as rows ``(metric, value)``; neighbours are found once.

    ``found`` (leave-one-out neighbours) and ``ranked`` (first match ranks) may come from an index.
    """
    if found is None or ranked is None:
        packed = pack(golden, limits)
        found = cut_lineage(loo_neighbours(golden, max(spec.ks), packed, limits)) if found is None else found
        ranked = first_match_rank(golden, packed, limits) if ranked is None else ranked
    predictions = loo_predictions(golden, found)
    triplets = mine_triplets(batched, spec.margin, spec.max_triplets, spec.seed)

    def named(df: DataFrame, **metrics: str) -> DataFrame:
        pairs = [F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in metrics.items()]
        return df.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")

    recall = recall_at_k(golden, spec.ks, found)
    parts = [
        named(accuracy(predictions), accuracy="accuracy"),
        named(mean_reciprocal_rank(ranked), mrr="mrr"),
        named(f1_scores(predictions), macro_f1="macro_f1", weighted_f1="weighted_f1"),
        named(triplet_loss(triplets, spec.margin), val_loss="loss"),
        recall.select(F.concat(F.lit("recall@"), F.col("k").cast("string")).alias("metric"), F.col("recall").alias("value")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
