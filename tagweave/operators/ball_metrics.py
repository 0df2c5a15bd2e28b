"""Evaluation on a kept ball index: exact figures without comparing every row with every row.

``count_before`` is the full ranking reduced to a count.  A ball that lies wholly inside a query's distance is counted as a
whole, one wholly outside not at all, and only leaves that the distance cuts have their rows compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.session import cut_lineage
from tagweave.operators.balls import BallIndex, bounded_nearest, leaf_routes, measured_leaves, swept
from tagweave.operators.blocks import ScanLimits
from tagweave.operators.metrics import CountBefore, EvaluationSpec, as_queries, evaluate, mean_reciprocal_rank
from tagweave.operators.neighbours import opened, summed_cells


class CountAll(CountBefore):
    """Rows before a goal, the query itself among them."""

    def run(self, ids, queries, extras, block):
        return super().run(pa.nulls(len(ids), block.ids.type), queries, extras, block)


class SweptCount(CountAll):
    """Rows before a goal in a block of leaves, and how many rows were compared for it."""

    def result_type(self, id_type):
        return T.StructType([T.StructField(name, T.LongType()) for name in ("before", "opened")])


def _sweep_count(asked: pa.Table, corpus: pa.Table, kernel: SweptCount) -> pa.Array:
    """Leaves wholly inside a query's goal are counted as they are, and only those that the goal cuts have their rows compared."""
    block, ids, points, _, _, first, last, known, row = opened(asked, corpus)
    extras = [asked[e].combine_chunks() for e in kernel.extras]
    goal = np.sqrt(extras[0].to_numpy(zero_copy_only=False))
    before, compared = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for s, far, radius, slack in measured_leaves(block, points, first, last, known, row):
        inside = far + radius < goal[s][:, None] - slack
        cut = ~inside & ~(far - radius > goal[s][:, None] + slack)
        who, leaf = np.nonzero(cut)
        met = summed_cells(block, ids.slice(s.start, s.stop - s.start), points[s], [e.slice(s.start, s.stop - s.start) for e in extras], first, last, leaf, who, kernel)
        before[s], compared[s] = inside @ (last - first) + met, cut @ (last - first)
    return pa.StructArray.from_arrays([pa.array(before), pa.array(compared)], names=["before", "opened"])


def count_before(aimed: DataFrame, index: BallIndex, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """``(row, before, opened)`` of the rows of ``aimed(row, query_id, embedding, at_d2, at_id)`` that have a goal.

    ``before`` counts the corpus rows nearer than ``(at_d2, at_id)``, a query that is itself a corpus row included; ``opened`` counts the rows compared.
    """
    kernel = SweptCount()
    aims = aimed.filter(F.col("at_d2").isNotNull()).select(
        "row", F.col("query_id").alias("own_id"), "embedding", F.sqrt("at_d2").alias("goal"), F.array().cast("array<long>").alias("cells"), *kernel.extras
    )
    met = swept(aims, aims.count(), index, leaf_routes(index, limits), kernel, _sweep_count, limits)
    return met.groupBy("row").agg(F.sum("value.before").alias("before"), F.sum("value.opened").alias("opened"))


def first_match_rank_bounded(golden: DataFrame, index: BallIndex, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """``(query_id, label_id, first_rank, compared)``: rank of the nearest row of the same label, null if there is none.

    ``golden`` are the rows of ``index``, which is made ``by_label``.  ``compared`` counts the rows a query was compared with.
    """
    found = bounded_nearest(as_queries(golden), index, 1, exclude_self=True, same_label=True, limits=limits)
    best = F.try_element_at("neighbours", F.lit(1))
    aimed = cut_lineage(
        found.select(
            F.monotonically_increasing_id().alias("row"), "query_id", "label_id", "embedding", F.col("compared").alias("searched"),
            best.d2.alias("at_d2"), best.golden_id.alias("at_id"),
        )
    )
    counted = count_before(aimed, index, limits)
    itself = ((F.col("at_d2") > 0) | (F.col("query_id") < F.col("at_id"))).cast("long")
    rank = F.when(F.col("at_d2").isNotNull(), F.coalesce("before", F.lit(0)) - itself + 1)
    compared = F.col("searched") + F.coalesce("opened", F.lit(0))
    return aimed.join(counted, "row", "left").select("query_id", "label_id", rank.alias("first_rank"), compared.alias("compared"))


def mrr_bounded(golden: DataFrame, index: BallIndex, limits: ScanLimits = ScanLimits()) -> DataFrame:
    return mean_reciprocal_rank(first_match_rank_bounded(golden, index, limits))


def evaluate_indexed(golden: DataFrame, batched: DataFrame, index: BallIndex, spec: EvaluationSpec = EvaluationSpec(), limits: ScanLimits = ScanLimits()) -> DataFrame:
    """``evaluate`` with neighbours and ranks from ``index`` (made ``by_label`` of ``golden``); the same figures."""
    found = bounded_nearest(as_queries(golden), index, max(spec.ks), exclude_self=True, limits=limits)
    ranked = first_match_rank_bounded(golden, index, limits)
    return evaluate(golden, batched, spec, limits, cut_lineage(found.select("query_id", "label_id", "neighbours")), ranked)
