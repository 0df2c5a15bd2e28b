"""Exact nearest neighbours from an index, with a proof that no other row is nearer.

Rows lie in leaves of about ``leaf_rows`` rows inside at most 1,024 top cells.  Each leaf and each top cell knows
its centre, how many rows it has and its radius, the greatest distance of a row from that centre.  By the triangle
inequality no row of a ball is nearer to a query than ``distance to centre - radius``.  A query first asks its nearest leaves;
from then on only balls whose bound does not exceed its k-th distance are open.  It goes once to every block that holds an open top cell, and the
task compares it with the open leaves there, with the k-th distance it finds on the way as the goal of the next ones.  No open leaf is left
then, and the answer is exact.  With a bounded effort it asks the nearest bound first, in rounds that grow fourfold.

Centres of top cells are one small matrix.  Leaves are a table that is never sent anywhere whole: queries meet the leaves
of their open top cells, then the rows of their open leaves, each in tasks of bounded size.  Leaves are packed into blocks, and
a round sends a query at most once to each block; its open leaves are one list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.session import arrow_once, bounded, cut_lineage, stored_with_count
from tagweave.functions.vectors import as_double
from tagweave.operators.blocks import CELLS_AT_ONCE, ROW, Block, Kernel, ScanLimits, corpus_columns, matrix_of, strips
from tagweave.operators.neighbours import Routes, TopK, cell_routes, cells_sum, cells_top_k, fit_centres, nearest_cells, opened, ranked_cells, ranked_neighbours, routed, split_cells

LEAF_ROWS, MOST_TOPS = 1024, 1024
SEED_TOPS, SEED_LEAVES = 2, 4
#: Blocks of leaves, and chunks of queries, of a search, if they are not cut into more by their size.
PARTS = 6
#: Bounds and distances come from sums in different orders.
SLACK = 1e-7


@dataclass(frozen=True)
class BallIndex:
    """``leaves (cell, leaf, centre, radius, n)`` and ``rows (cell, leaf, golden_id, label_id, embedding)`` are stored tables.

    ``centres`` and ``radii`` are those of the top cells, ``counts`` their rows.  With ``by_label`` a leaf holds rows of one label,
    and ``leaves`` has its ``label_id``.
    """

    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    leaves: DataFrame
    rows: DataFrame
    by_label: bool = False


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Plain distances of all rows of two matrices."""
    squared = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (points @ centres.T)
    return np.sqrt(np.maximum(squared, 0.0))


def fit_balls(
    corpus: DataFrame, n_cells: int | None = None, leaf_rows: int = LEAF_ROWS, by_label: bool = False, seed: int = 42, limits: ScanLimits = ScanLimits()
) -> BallIndex:
    """Cut ``corpus(golden_id, label_id, embedding)`` into leaves and measure them.

    The centres of a cell's leaves are rows drawn by hash, moved once to the mean of the rows nearest to them.  Equal vectors
    share a leaf, so a leaf can be larger than ``leaf_rows``; the search splits it like any hot cell.
    """
    rows = corpus_columns(corpus)
    centres = fit_centres(rows, n_cells or max(1, min(MOST_TOPS, ceil(rows.count() / leaf_rows))), seed)
    placed = nearest_cells(rows, centres, 1).withColumn("draw", F.xxhash64(F.lit(seed), "golden_id"))
    placed = cut_lineage(placed.withColumn("far", _distance_to(centres)(F.col("embedding"), F.col("cell"))))
    tops = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min(F.struct("draw", "golden_id")).alias("first"))
    tops = cut_lineage(tops)  # a row for each top cell
    found = {r["cell"]: r for r in tops.collect()}
    cells = range(len(centres))
    radii = np.array([found[c]["radius"] if c in found else 0.0 for c in cells])
    counts = np.array([found[c]["n"] if c in found else 0 for c in cells], np.int64)
    # About n / leaf_rows rows of a cell have a small enough hash; the least one always does.
    share = F.ceil(F.col("n") / leaf_rows) / F.col("n")
    drawn = placed.join(F.broadcast(tops.select("cell", "n", "first")), "cell").filter(
        (F.col("golden_id") == F.col("first.golden_id")) | ((F.col("draw") / 2.0**64 + 0.5) < share)
    )
    number = F.row_number().over(W.partitionBy("cell").orderBy("draw", "golden_id"))
    drawn = drawn.select("cell", number.cast("long").alias("leaf"), as_double(F.col("embedding")).alias("centre"))
    first = cut_lineage(_assigned(placed, cut_lineage(drawn), limits))
    v = array_to_vector(as_double(F.col("embedding")))
    moved = first.select("cell", "leaf", v.alias("v")).groupBy("cell", "leaf").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centre"))
    moved = cut_lineage(moved)
    extra = ["label_id"] if by_label else []
    key = F.col("cell") * F.lit(1 << 32) + F.col("leaf")
    last = _assigned(placed, moved, limits)
    if by_label:  # one leaf for each label in it
        key = F.xxhash64("cell", "leaf", "label_id")
    stored = cut_lineage(last.withColumn("key", key))
    measured = stored.groupBy("cell", "leaf", "key", *extra).agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
    leaves = measured.join(moved, ["cell", "leaf"]).select("cell", F.col("key").alias("leaf"), "centre", "radius", "n", *extra)
    rows = stored.select("cell", F.col("key").alias("leaf"), "golden_id", "label_id", "embedding")
    return BallIndex(centres, radii, counts, cut_lineage(leaves), rows, by_label)


def _distance_to(centres: np.ndarray):
    @arrow_once(T.DoubleType())
    def far(embedding: pa.Array, cell: pa.Array) -> pa.Array:
        points, own = matrix_of(embedding), cell.to_numpy(zero_copy_only=False)
        return pa.array(np.sqrt(((points - centres[own]) ** 2).sum(axis=1))) if len(own) else pa.array([], pa.float64())

    return far


def _assigned(placed: DataFrame, centres: DataFrame, limits: ScanLimits) -> DataFrame:
    """``placed`` with the nearest centre of its cell, as ``leaf`` and ``reach``, its distance."""
    kept = ["cell", "golden_id", "label_id", "embedding"]
    chunks = bounded(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / limits.chunk_rows).cast("int").alias("chunks")))
    left = placed.select(*kept).join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("golden_id"), F.col("chunks")).cast("int"))
    right = centres.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    schema = T.StructType([left.schema[c] for c in kept] + [T.StructField("leaf", T.LongType()), T.StructField("reach", T.DoubleType())])

    def assign(rows: pa.Table, near: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if not len(rows):
            return rows.select(kept).append_column("leaf", pa.array([], pa.int64())).append_column("reach", pa.array([], pa.float64()))
        near = near.sort_by("leaf").combine_chunks()
        points, centre = matrix_of(rows["embedding"].combine_chunks()), matrix_of(near["centre"].combine_chunks())
        chosen = np.concatenate([distances(points[s], centre).argmin(axis=1) for s in strips(len(points), len(centre))])
        reach = np.sqrt(((points - centre[chosen]) ** 2).sum(axis=1))
        return rows.select(kept).append_column("leaf", near["leaf"].combine_chunks().take(pa.array(chosen))).append_column("reach", pa.array(reach))

    right = right.toDF(*right.columns)
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(assign, schema)


# --- the search ----------------------------------------------------------------------


def open_tops(asked: DataFrame, index: BallIndex, most: int | None = None) -> DataFrame:
    """``asked`` with a row for each top cell that may hold a row within ``goal`` (null: any distance); the nearest ``most``.

    Columns ``cell``, ``low`` and ``high``: no row of the cell is nearer than ``low`` or farther than ``high``.
    """
    centres, radii, counts = index.centres, index.radii, index.counts
    entry = T.StructType([T.StructField("cell", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    @arrow_once(T.ArrayType(entry))
    def tops(embedding: pa.Array, goal: pa.Array) -> pa.Array:
        points = matrix_of(embedding, centres.shape[1])
        far = distances(points, centres)
        low, high = np.maximum(far - radii, 0.0), far + radii
        limit = goal.fill_null(np.inf).to_numpy(zero_copy_only=False)
        wanted = (low <= limit[:, None] + SLACK) & (counts > 0)
        if most is not None and most < wanted.shape[1]:
            order = np.argsort(np.where(counts > 0, far, np.inf), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
            wanted &= rank < most
        row, cell = np.nonzero(wanted)
        offsets = np.append(0, np.cumsum(wanted.sum(axis=1))).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(cell.astype(np.int64)), pa.array(low[row, cell]), pa.array(high[row, cell])], names=["cell", "low", "high"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    rows = asked.withColumn("_tops", tops(F.col("embedding"), F.col("goal")))
    return rows.withColumn("_top", F.explode("_tops")).select(*asked.columns, "_top.*")


def leaf_bounds(asked: DataFrame, index: BallIndex, limits: ScanLimits, same_label: bool = False, most: int | None = None) -> DataFrame:
    """``(row, goal, leaves array<far, leaf, low, high, n>)`` of the leaves of the asked cells that may hold a row within ``goal``.

    A row has a list from each task that found some.  With ``most`` a task keeps that many for each row and cell, the nearest.
    """
    spread = split_cells(asked.select("cell", "row"), index.leaves.select("cell", "leaf"), limits)
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    label = ["label_id"] if same_label else []
    left = asked.join(spread, "cell").select("cell", "row", "embedding", "goal", *label, of("row", "chunks").alias("chunk"), every("blocks").alias("block"))
    right = index.leaves.join(spread, "cell").select("cell", "leaf", "centre", "radius", "n", *label, of("leaf", "blocks").alias("block"), every("chunks").alias("chunk"))
    schema = "row long, goal double, leaves array<struct<far: double, leaf: long, low: double, high: double, n: long>>"
    names = ["far", "leaf", "low", "high", "n"]

    def bound(rows: pa.Table, balls: pa.Table) -> pa.Table:
        counts: list[np.ndarray] = []
        found: list[list] = [[] for _ in names]
        rows = rows.combine_chunks()
        if len(rows) and len(balls):
            balls = balls.combine_chunks()
            points, centre = matrix_of(rows["embedding"].combine_chunks()), matrix_of(balls["centre"].combine_chunks())
            radius, leaf, n = balls["radius"].to_numpy(), balls["leaf"].to_numpy(), balls["n"].to_numpy()
            goal = rows["goal"].combine_chunks().fill_null(np.inf).to_numpy()
            for s in strips(len(points), len(centre)):
                far = distances(points[s], centre)
                low = np.maximum(far - radius, 0.0)
                wanted = low <= goal[s][:, None] + SLACK
                if same_label:
                    wanted &= rows["label_id"].to_numpy()[s][:, None] == balls["label_id"].to_numpy()[None, :]
                if most is not None and most < wanted.shape[1]:
                    near = np.where(wanted, far, np.inf)
                    wanted &= near <= np.partition(near, most - 1, axis=1)[:, most - 1 : most]
                r, c = np.nonzero(wanted)
                counts.append(np.bincount(r, minlength=len(far)))
                for k, column in enumerate((far[r, c], leaf[c], low[r, c], (far + radius)[r, c], n[c])):
                    found[k].append(column)
        sizes = np.concatenate(counts) if counts else np.zeros(0, int)
        some = np.flatnonzero(sizes)
        kinds = [pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(f) if f else [], kind) for f, kind in zip(found, kinds)], names=names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[some])), pa.int32()), values)
        kept = rows.select(["row", "goal"]).take(pa.array(some, pa.int64()))
        return kept.append_column("leaves", lists)

    right = right.toDF(*right.columns)
    return left.groupBy("cell", "block", "chunk").cogroup(right.groupBy("cell", "block", "chunk")).applyInArrow(bound, schema)


def leaf_routes(index: BallIndex, limits: ScanLimits) -> Routes:
    """Blocks of leaves, for ``meet_leaves``."""
    return cell_routes(_by_leaf(index), replace(limits, block_rows=_part_rows(int(index.counts.sum()), limits.block_rows)))


def _part_rows(rows: int, most: int) -> int:
    """Rows of a block or chunk: a few are cut up, too, so that many tasks share the work."""
    return min(most, max(LEAF_ROWS, ceil(rows / PARTS)))


def _by_leaf(index: BallIndex) -> DataFrame:
    return index.rows.select(F.col("leaf").alias("cell"), "golden_id", "label_id", "embedding")


def meet_leaves(asked: DataFrame, n: int, vectors: DataFrame, index: BallIndex, routes: Routes, kernel: Kernel, limits: ScanLimits) -> DataFrame:
    """``(row, value)`` for each block: the kernel over the rows of the leaves that ``asked(row, cells, ...)``, of ``n`` rows, names.

    ``vectors`` are ``(row, own_id, embedding, ...)``.  A vector goes once to each block of leaves, however many of them it asks.
    """
    queries = vectors.join(asked, "row").withColumnsRenamed({"row": ROW, "own_id": "query_id"})
    work = cells_top_k if isinstance(kernel, TopK) else cells_sum
    limits = replace(limits, chunk_rows=_part_rows(n, limits.chunk_rows))
    return routed(queries, n, _by_leaf(index), routes, kernel, work, limits).withColumnRenamed(ROW, "row")


def bounded_nearest(
    queries: DataFrame,
    index: BallIndex,
    k: int,
    exclude_self: bool = False,
    same_label: bool = False,
    effort: int | None = None,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """Add ``neighbours``, ``rounds``, ``compared`` and ``proved`` to each row of ``queries(query_id, embedding, ...)``.

    Without ``effort`` the answer is exact, ties by id.  ``effort`` is the most leaves a query asks in all; ``proved`` then says whether
    the proof was complete.  ``compared`` counts the corpus rows a query was compared with, ``rounds`` how often it asked.
    ``exclude_self`` leaves out the row whose ``golden_id`` is the ``query_id``; ``same_label`` (``label_id`` of the query) needs an
    index made ``by_label``.  Rows are told apart by a number of their own, so a ``query_id`` may repeat.
    """
    if same_label and not index.by_label:
        raise ValueError("same_label needs an index made by_label")
    kernel = LeafTopK(k, "l2", exclude_self)  # with same_label a query asks leaves of its label alone
    if not index.counts.sum():
        nothing = ranked_neighbours(F.from_json(F.lit("[]"), kernel.result_type(index.rows.schema["golden_id"].dataType)))
        return queries.select("*", nothing.alias("neighbours"), F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("compared"), F.lit(True).alias("proved"))
    numbered = cut_lineage(queries.withColumn("_row", F.monotonically_increasing_id()))
    label = ["label_id"] if same_label else []
    vectors = numbered.select(F.col("_row").alias("row"), F.col("query_id").alias("own_id"), "embedding", *label)
    routes = leaf_routes(index, limits)
    leaf_of, every = lambda x: x.leaf, F.flatten(F.collect_list("leaves"))
    counted = F.aggregate("leaves", F.lit(0).cast("long"), lambda n, x: n + x.n).alias("compared")

    def ask(state: DataFrame | None, pairs: DataFrame, n: int) -> DataFrame:
        cells = pairs.select("row", F.transform("leaves", leaf_of).alias("cells"))
        return _merged(state, meet_leaves(cells, n, vectors, index, routes, kernel, limits), kernel)

    anyhow = vectors.withColumn("goal", F.lit(None).cast("double"))
    # The nearest leaves give a first k-th distance.
    tops = cut_lineage(open_tops(anyhow, index, SEED_TOPS))
    near = leaf_bounds(tops, index, limits, same_label, SEED_LEAVES).groupBy("row").agg(F.array_sort(every).alias("leaves"))
    seeds, n = stored_with_count(near.withColumn("leaves", F.slice("leaves", 1, min(SEED_LEAVES, effort or SEED_LEAVES))))
    state = ask(None, seeds, n)
    asked_all = [seeds.select("row", counted, F.lit(1).alias("rounds"))]
    goal = state.select("row", _kth(k).alias("goal"))
    if effort is None:
        aims = vectors.join(goal, "row", "left").join(seeds.select("row", F.transform("leaves", leaf_of).alias("cells"), counted), "row", "left")
        aims, n = stored_with_count(aims.withColumn("cells", F.coalesce("cells", F.array().cast("array<long>"))))
        state = _all_open(state, aims, n, index, routes, SweptTopK(k, exclude_self, same_label), limits)
        met = F.coalesce("opened", F.lit(0))
        state = state.select("row", "found", met.alias("opened")).join(aims.select("row", F.coalesce("compared", F.lit(0)).alias("seeded")), "row")
        result = numbered.join(state.withColumnRenamed("row", "_row"), "_row", "left")
        seeded, met = F.coalesce("seeded", F.lit(0)), F.coalesce("opened", F.lit(0))
        return result.select(
            *queries.columns,
            ranked_neighbours(F.col("found")).alias("neighbours"),
            ((seeded > 0).cast("int") + (met > 0).cast("int")).alias("rounds"),
            (seeded + met).cast("long").alias("compared"),
            F.lit(True).alias("proved"),
        )
    # All other leaves that could hold a nearer row, the nearest bound first.
    goals = cut_lineage(vectors.join(goal, "row", "left"))
    bounds = leaf_bounds(cut_lineage(open_tops(goals, index)), index, limits, same_label)
    short = bounds.withColumn("leaves", F.transform("leaves", lambda x: F.struct(x.low.alias("low"), x.leaf.alias("leaf"), x.n.alias("n"))))
    fresh = short.groupBy("row").agg(every.alias("leaves")).join(seeds.select("row", F.transform("leaves", leaf_of).alias("had")), "row", "left")
    fresh = fresh.select("row", F.array_sort(F.filter("leaves", lambda x: ~F.array_contains(F.coalesce("had", F.array().cast("array<long>")), x.leaf))).alias("leaves"))
    frontier, left = stored_with_count(fresh.filter(F.size("leaves") > 0))
    at, step = 0, 4
    most = max(0, effort - SEED_LEAVES)
    while left and at < most:
        upto = min(at + step, most)
        still = frontier.select("row", F.slice("leaves", at + 1, upto - at).alias("leaves")).filter(F.size("leaves") > 0)
        still = still.join(state.select("row", _kth(k).alias("goal")), "row", "left")
        within = F.filter("leaves", lambda x: F.col("goal").isNull() | (x.low <= F.col("goal") + SLACK))
        pairs, n = stored_with_count(still.select("row", within.alias("leaves")).filter(F.size("leaves") > 0))
        if not n:  # bounds grow along a list, so nobody asks again
            break
        state = ask(state, pairs, n)
        asked_all.append(pairs.select("row", counted, F.lit(1).alias("rounds")))
        at, step = upto, step * 4
    counts = asked_all[0]
    for more in asked_all[1:]:
        counts = counts.unionByName(more)
    counts = counts.groupBy("row").agg(F.sum("compared").alias("compared"), F.sum("rounds").cast("int").alias("rounds"))
    result = numbered.join(state.withColumnRenamed("row", "_row"), "_row", "left").join(counts.withColumnRenamed("row", "_row"), "_row", "left")
    late = frontier.select("row", F.try_element_at("leaves", F.lit(at + 1))["low"].alias("next"))
    result = result.join(late.withColumnRenamed("row", "_row"), "_row", "left")
    proved = F.col("next").isNull() | F.coalesce(F.col("next") > _kth(k) + SLACK, F.lit(False))
    return result.select(
        *queries.columns,
        ranked_neighbours(F.col("found")).alias("neighbours"),
        F.coalesce("rounds", F.lit(0)).alias("rounds"),
        F.coalesce("compared", F.lit(0)).cast("long").alias("compared"),
        proved.alias("proved"),
    )


class LeafTopK(TopK):
    """Leaves share no row, and those of one label may be asked without those of another."""

    labels_apart = True


class SweptTopK(LeafTopK):
    """The k nearest of the leaves of a block that are open to a query, and how many rows these have."""

    def __init__(self, k: int, exclude_self: bool = False, own_label: bool = False):
        super().__init__(k, "l2", exclude_self)
        self.extras = ("goal", "label_id") if own_label else ("goal",)

    def result_type(self, id_type):
        return T.StructType([T.StructField("found", super().result_type(id_type)), T.StructField("opened", T.LongType())])


def _all_open(state: DataFrame, aims: DataFrame, n: int, index: BallIndex, routes: Routes, kernel: SweptTopK, limits: ScanLimits) -> DataFrame:
    """``(row, found, opened)``: ``state`` with what all other open leaves hold, and how many rows these have."""
    parts = swept(aims, n, index, routes, kernel, _sweep_top_k, limits).select("row", F.col("value.found").alias("value"), F.col("value.opened").alias("opened"))
    known = state.select("row", F.col("found").alias("value"), F.lit(0).cast("long").alias("opened"))
    return cut_lineage(parts.unionByName(known).groupBy("row").agg(kernel.merge(F.col("value")).alias("found"), F.sum("opened").alias("opened")))


def swept(aims: DataFrame, n: int, index: BallIndex, routes: Routes, kernel: Kernel, work: Callable, limits: ScanLimits) -> DataFrame:
    """``work`` over each block of leaves with a top cell that may hold a row within ``goal`` (null: any distance): ``(row, value)``.

    ``aims (row, own_id, embedding, goal, cells, ...)``, of ``n`` rows, name in ``cells`` the leaves to leave out.  A task measures the leaves of its block
    itself, so no list of open leaves is ever made.
    """
    centres, radii, counts = index.centres, index.radii, index.counts
    of_block = index.leaves.select(F.col("cell").alias("top"), F.col("leaf").alias("cell")).join(routes.placed, "cell")
    pairs = of_block.select("top", F.explode(F.sequence("low", "high")).alias("block")).distinct().collect()  # blocks by top cells
    numbers = np.unique([r["block"] for r in pairs]).astype(np.int64)
    holds = np.zeros((len(centres), len(numbers)), np.float32)
    holds[[r["top"] for r in pairs], np.searchsorted(numbers, [r["block"] for r in pairs])] = 1.0

    @arrow_once(T.ArrayType(T.LongType()))
    def blocks(embedding: pa.Array, goal: pa.Array) -> pa.Array:
        points = matrix_of(embedding, centres.shape[1])
        limit = goal.fill_null(np.inf).to_numpy(zero_copy_only=False) + _slack(points, centres)
        wanted = ~(distances(points, centres) - radii > limit[:, None]) & (counts > 0)
        row, at = np.nonzero(wanted.astype(np.float32) @ holds)
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(points)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[at]))

    queries = aims.withColumnsRenamed({"row": ROW, "own_id": "query_id"}).withColumn("blocks", blocks("embedding", "goal"))
    limits = replace(limits, chunk_rows=_part_rows(n, limits.chunk_rows))
    return routed(queries, n, _by_leaf(index), routes, kernel, work, limits).withColumnRenamed(ROW, "row")


def _slack(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far off a distance to a centre may be: products lose more on longer vectors."""
    return SLACK * (1.0 + np.sqrt((points * points).sum(1)) + np.sqrt((centres * centres).sum(1).max(initial=0.0)))


def measured_leaves(block: Block, points: np.ndarray, first: np.ndarray, last: np.ndarray, known: np.ndarray, row: np.ndarray):
    """Slices of the queries, few enough at once, with the plain distance to the centres of the block's leaves, their radii, and the slack of both.

    The distance to a leaf in ``known``, which the query in ``row`` leaves out, is infinite.
    """
    sizes = last - first
    centre = np.add.reduceat(block.matrix, first, axis=0) / sizes[:, None]
    radius = np.maximum.reduceat(np.sqrt(((block.matrix - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1)), first)
    order = np.argsort(row, kind="stable")
    known, row = known[order], row[order]
    step = max(1, CELLS_AT_ONCE // len(first))
    for start in range(0, len(points), step):
        s = slice(start, min(len(points), start + step))
        far = distances(points[s], centre)
        a, b = np.searchsorted(row, (s.start, s.stop))
        far[row[a:b] - s.start, known[a:b]] = np.inf
        yield s, far, radius, _slack(points[s], centre)[:, None]


def _sweep_top_k(asked: pa.Table, corpus: pa.Table, kernel: SweptTopK) -> pa.Array:
    """The kernel over the leaves of ``corpus`` that may hold a row within the ``goal`` of a query."""
    block, ids, points, _, cells, first, last, known, row = opened(asked, corpus)
    goal = asked["goal"].combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False)
    label = None
    if "label_id" in kernel.extras:
        label, of_leaf = asked["label_id"].to_numpy(), block.labels[first].astype(float)
        of_leaf[np.isin(cells, corpus.filter(pc.is_null(corpus["label_id"]))["cell"].to_numpy())] = np.nan
    found, compared = [], np.zeros(len(points), np.int64)
    for s, far, radius, slack in measured_leaves(block, points, first, last, known, row):
        wanted = ~(far - radius > goal[s][:, None] + slack) & (far != np.inf)
        if label is not None:
            wanted &= label[s][:, None] == of_leaf[None, :]
        who, leaf = np.nonzero(wanted)
        compared[s] = wanted @ (last - first)
        rows, at, keys = ranked_cells(block, ids.slice(s.start, s.stop - s.start), points[s], first, last, leaf, who, goal[s], kernel)
        found.append((rows + s.start, at, keys))
    rows, at, keys = (np.concatenate(c) for c in zip(*found))
    lists = kernel.lists(block, np.bincount(rows, minlength=len(points)), at, keys)
    return pa.StructArray.from_arrays([lists, pa.array(compared)], names=["found", "opened"])


def _kth(k: int) -> Column:
    """The k-th plain distance found so far; null if there are fewer."""
    return F.sqrt(F.try_element_at("found", F.lit(k))["d2"])


def _merged(state: DataFrame | None, parts: DataFrame, kernel: Kernel) -> DataFrame:
    """``(row, found)`` as a stored table: the k best of what was known and what came in."""
    values = parts.select("row", "value")
    if state is not None:
        values = values.unionByName(state.select("row", F.col("found").alias("value")))
    return cut_lineage(values.groupBy("row").agg(kernel.merge(F.col("value")).alias("found")))


def bounded_join(queries: DataFrame, index: BallIndex, k: int, **options) -> DataFrame:
    """``bounded_nearest`` as rows ``(query_id, rk, golden_id, label_id, d2)``."""
    found = bounded_nearest(queries.select("query_id", "embedding"), index, k, **options)
    return found.select("query_id", F.explode("neighbours").alias("n")).select("query_id", "n.rk", "n.golden_id", "n.label_id", "n.d2")
