"""k-nearest-neighbour joins: exact, by inner product, by cells and by hashing.

``nearest`` keeps the answer as one array per query, in rank order, so that the
scoring that follows needs no shuffle.  ``knn_join`` is the same answer as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from heapq import heapify, heappop, heappush
from math import ceil, erfc, exp, isqrt, log2, prod, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.hashing import seeded
from tagweave.functions.order import with_rows_before
from tagweave.functions.session import arrow_once, bounded, cut_lineage
from tagweave.operators.blocks import (
    MOST_MARKED,
    ROW,
    Block,
    Kernel,
    PackedCorpus,
    ScanLimits,
    arrow_type,
    block_scan,
    coarse_estimates,
    corpus_columns,
    corpus_shape,
    dot_products,
    estimates,
    kth_at_most,
    marked,
    matrix_of,
    merge_parts,
    numbered_queries,
    own_positions,
    projection,
    split_by,
    squared_distances,
    strips,
    upwards,
)

DEFAULT_PROBES = 8
#: The share of true neighbours that the fitted effort finds, and how many rows it is fitted on.
RECALL, EFFORT_SAMPLE = 0.95, 256
#: Hash cells a query may ask on average; codes are made shorter rather than asked for more.
MOST_PROBES = 64


class TopK(Kernel):
    """The k nearest corpus rows of each query, ties by id.

    ``sort_key`` is the squared distance, or minus the inner product; ``d2`` is
    always a squared distance (``2 - 2 dot`` of unit vectors for inner product).
    """

    distinct = False  # whether equal candidates of a query are one
    labels_apart = False  # whether copies of a vector are left out only beyond enough of their own label

    def __init__(self, k: int, metric: str = "l2", exclude_self: bool = False, same_label: bool = False):
        if k < 1 or metric not in ("l2", "ip"):
            raise ValueError("k must be positive and metric 'l2' or 'ip'")
        self.k, self.metric = k, metric
        self.exclude_self, self.same_label = exclude_self, same_label
        self.extras = ("label_id",) if same_label else ()

    def result_type(self, id_type):
        return T.ArrayType(
            T.StructType(
                [
                    T.StructField("sort_key", T.DoubleType()),
                    T.StructField("golden_id", id_type),
                    T.StructField("label_id", T.IntegerType()),
                    T.StructField("d2", T.DoubleType()),
                ]
            )
        )

    def run(self, ids, queries, extras, block):
        return self.lists(*self.pick(ids, queries, extras, block))

    def pick(self, ids, queries, extras, block, bound=None, open_to=None):
        """The block that was ranked; how many of its rows each query takes; which, in rank order; and their sort keys.

        ``bound`` is a squared distance for each query beyond which its rows may be left out.  ``open_to(slice, block)`` tells which cells the
        queries of a slice may take, as a mask, and the cell of each row of the block.
        """
        block = block.front(self.k + 1, self.same_label or self.labels_apart)  # more copies of a vector cannot be among the k
        own = own_positions(ids, block) if self.exclude_self else None
        if self.same_label:
            return block, *self._by_label(queries, own, extras[0].to_numpy(zero_copy_only=False), block)
        found = [
            self._strip(
                queries[s], own[s] if own is not None else None, block, bound[s] if bound is not None else None, open_to(s, block) if open_to else None
            )
            for s in strips(len(queries), len(block.ids))
        ]
        sizes = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        cols = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
        keys = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
        return block, sizes, cols, keys

    def _by_label(self, queries, own, labels, block: Block):
        """As ``pick``, each label's queries with the block's rows of that label alone."""
        sizes = np.zeros(len(queries), int)
        found = []
        block.coarse()  # the parts share it
        for label, asked in split_by(labels).items():
            places = block.of_labels().get(label)
            if places is None:
                continue
            part, inside = block.part(places), None
            if own is not None:
                at = np.searchsorted(places, own[asked])
                inside = np.where(places[np.minimum(at, len(places) - 1)] == own[asked], at, -1)
            for s in strips(len(asked), len(places)):
                n, cols, keys = self._strip(queries[asked[s]], None if inside is None else inside[s], part)
                sizes[asked[s]] = n
                found.append((np.repeat(asked[s], n), places[cols], keys))
        rows, cols, keys = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.argsort(rows, kind="stable")
        return sizes, cols[order], keys[order]

    def lists(self, block, sizes, cols, keys) -> pa.Array:
        d2 = keys if self.metric == "l2" else 2.0 + 2.0 * keys
        values = pa.StructArray.from_arrays(
            [pa.array(keys), block.ids.take(pa.array(cols)), pa.array(block.labels[cols], pa.int32()), pa.array(d2)],
            names=["sort_key", "golden_id", "label_id", "d2"],
        )
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def _strip(self, queries, own, block: Block, bound=None, opened=None):
        n, width = len(queries), len(block.ids)
        if width == 0:
            return np.zeros(n, int), np.zeros(0, int), np.zeros(0)
        k = min(self.k, width)
        found = self._coarse(queries, own, block, k, bound, opened) if self.metric == "l2" else None
        if found is None:
            near, slack = estimates(queries, block)
            if self.metric == "ip":
                near = -(queries @ block.matrix.T)
            if own is not None:
                here = np.flatnonzero(own >= 0)
                near[here, own[here]] = np.inf
            if opened is not None:
                near[~opened[0][:, opened[1]]] = np.inf
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
            found = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        rows, cols = found
        # The product above only picks candidates; rank them by the exact sum.
        if self.metric == "l2":
            keys = squared_distances(queries, rows, block.matrix, cols)
        else:
            keys = -dot_products(queries, rows, block.matrix, cols)
        order = np.lexsort((cols, keys, rows))
        rows, cols, keys = rows[order], cols[order], keys[order]
        firsts = np.searchsorted(rows, np.arange(n))
        keep = np.arange(len(rows)) - firsts[rows] < k
        return np.bincount(rows[keep], minlength=n), cols[keep], keys[keep]

    def _coarse(self, queries, own, block: Block, k: int, bound=None, opened=None):
        """Rows and columns of all pairs that may be among the k nearest by single-precision estimates; None if these leave too many.

        Where every query has a ``bound`` that leaves few pairs, no k-th estimate is looked for.
        """
        held = coarse_estimates(queries, block)
        if held is None:
            return None
        near, q2, slack = held
        if own is not None:
            here = np.flatnonzero(own >= 0)
            near[here, own[here]] = np.inf
        few = max(4 * k * len(near), MOST_MARKED * near.size)
        limit = np.full(len(near), np.inf) if bound is None else bound - q2 + slack
        mask = near <= upwards(limit) if np.isfinite(limit).all() else None
        if mask is None or np.count_nonzero(mask) > few:
            if opened is not None:
                near[~opened[0][:, opened[1]]] = np.inf
            mask = near <= upwards(np.minimum(limit, kth_at_most(near, k) + 2.0 * slack))
        rows, cols = marked(mask)
        if len(rows) > few:
            return None
        if opened is not None:
            allowed = opened[0][rows, opened[1][cols]]
            rows, cols = rows[allowed], cols[allowed]
        finite = np.isfinite(near[rows, cols])
        return rows[finite], cols[finite]

    def thin(self, corpus: DataFrame) -> DataFrame:
        """Of equal vectors only the first k (and oneself) can be among the k nearest.

        Spark limits each group before the shuffle, so a vector that a third of the
        rows share costs a few rows per task.
        """
        same = [F.xxhash64("embedding"), "embedding"] + (["label_id"] if self.same_label else [])
        copy_no = F.row_number().over(W.partitionBy(*same).orderBy("golden_id"))
        return corpus.withColumn("_copy", copy_no).filter(F.col("_copy") <= self.k + 1).drop("_copy")

    def merge(self, value: Column) -> Column:
        return F.slice(F.array_sort(F.flatten(F.collect_list(value))), 1, self.k)


def ranked_neighbours(neighbours: Column) -> Column:
    """Drop the sort key, number the entries from 1."""
    return F.transform(
        F.coalesce(neighbours, F.array()),
        lambda n, i: F.struct((i + 1).alias("rk"), n.golden_id.alias("golden_id"), n.label_id.alias("label_id"), n.d2.alias("d2")),
    )


def nearest(
    queries: DataFrame,
    corpus: DataFrame | PackedCorpus,
    k: int,
    metric: str = "l2",
    exclude_self: bool = False,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """Add ``neighbours array<struct<rk, golden_id, label_id, d2>>`` to each query."""
    found = block_scan(queries, corpus, TopK(k, metric, exclude_self), "_found", limits)
    return found.withColumn("neighbours", ranked_neighbours(F.col("_found"))).drop("_found")


def nearest_of_label(queries: DataFrame, corpus: DataFrame | PackedCorpus, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """``(query_id, label_id, golden_id, d2)``: the nearest corpus row of each query's own label, null if there is none."""
    found = block_scan(queries.select("query_id", "label_id", "embedding"), corpus, TopK(1, same_label=True), "_found", limits)
    first = F.try_element_at("_found", F.lit(1))
    return found.select("query_id", "label_id", first.golden_id.alias("golden_id"), first.d2.alias("d2"))


def explode_neighbours(scored: DataFrame, *carry: str) -> DataFrame:
    return scored.select("query_id", *carry, F.explode("neighbours").alias("n")).select(
        "query_id", *carry, "n.rk", "n.golden_id", "n.label_id", "n.d2"
    )


def knn_join(queries: DataFrame, corpus: DataFrame | PackedCorpus, k: int, **options) -> DataFrame:
    """Exact top-k join as rows ``(query_id, rk, golden_id, label_id, d2)``."""
    return explode_neighbours(nearest(queries.select("query_id", "embedding"), corpus, k, **options))


# --- Approximate joins: choose candidates by a key, rank them exactly ---------


def split_cells(queries: DataFrame, corpus: DataFrame, limits: ScanLimits) -> DataFrame:
    """``(cell, blocks, chunks)`` of the cells that have both corpus rows and queries."""

    def parts(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    return bounded(parts(corpus, limits.block_rows, "blocks").join(parts(queries, limits.chunk_rows, "chunks"), "cell"))


def place_cells(cells: DataFrame, rows: int, per_block: int) -> tuple[DataFrame, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Cells in the order of their numbers, dealt to blocks of about ``per_block`` rows.

    ``(cell, low, high)`` as a table, a cell larger than a block spread over several; and what finds the block of a cell: the first cell
    of each block, the block's number, and the spread cells.  All three are as short as there are blocks.
    """
    counted = cells.groupBy(F.col("cell").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    low, last = F.floor(F.col("before") / per_block), F.floor((F.col("before") + F.col("n") - 1) / per_block)
    placed = with_rows_before(counted).select(F.col("value").alias("cell"), low.alias("low"), F.when(F.col("n") > per_block, last).otherwise(low).alias("high"))
    placed = bounded(placed)
    firsts = sorted((r["cell"], r["low"]) for r in placed.groupBy("low").agg(F.min("cell").alias("cell")).collect())
    spread = [(r["cell"], r["low"], r["high"]) for r in placed.filter("high > low").collect()]
    return placed, np.array([c for c, _ in firsts], np.int64), np.array([b for _, b in firsts], np.int64), spread


@dataclass(frozen=True)
class Routes:
    """Where cells lie in blocks: ``place_cells`` of a corpus with ``dim`` components a row."""

    dim: int
    placed: DataFrame
    firsts: np.ndarray
    numbers: np.ndarray
    spread: list[tuple[int, int, int]]


def cell_routes(corpus: DataFrame, limits: ScanLimits = ScanLimits()) -> Routes:
    """Blocks of bounded size for the cells of ``corpus(cell, golden_id, label_id, embedding)``."""
    rows, dim = corpus_shape(corpus)
    return Routes(dim, *place_cells(corpus, rows, max(1, ceil(rows / limits.parts(rows, dim, limits.block_rows)))))


def routed_top_k(queries: DataFrame, n: int, corpus: DataFrame, kernel: DistinctTopK, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """Top-k among the corpus rows in one of the ``cells`` of a query, by the queries' own number."""
    return routed(queries, n, corpus, cell_routes(corpus, limits), kernel, cells_top_k, limits)


def routed(
    queries: DataFrame, n: int, corpus: DataFrame, routes: Routes, kernel: Kernel, work: Callable[[pa.Table, pa.Table, Kernel], pa.Array], limits: ScanLimits
) -> DataFrame:
    """``work`` over the corpus rows in one of the ``cells`` of a query: ``(row, value)`` for each block, by the queries' own number.

    Cells are packed into blocks, and a query goes once to each block with a cell it asks, together with those cells, however many
    they are.  Blocks and chunks of queries are of bounded size (``ScanLimits``), and no task holds more than one of each.
    Queries that name their ``blocks`` go to those, with all their ``cells``.
    """
    chunks = limits.parts(n, routes.dim, limits.chunk_rows)
    placed, firsts, numbers, spread = routes.placed, routes.firsts, routes.numbers, routes.spread

    @arrow_once(T.ArrayType(T.StructType([T.StructField("block", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])))
    def blocks_of(cells: pa.Array) -> pa.Array:
        sizes, flat = np.diff(cells.offsets.to_numpy()), cells.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        block = numbers[np.maximum(np.searchsorted(firsts, flat, "right") - 1, 0)] if len(numbers) else np.zeros(len(flat), np.int64)
        for cell, low, high in spread:  # also asked in the other blocks of a spread cell
            here = row[flat == cell]
            for other in range(low + 1, high + 1):
                row, flat, block = np.append(row, here), np.append(flat, np.full(len(here), cell)), np.append(block, np.full(len(here), other))
        order = np.lexsort((flat, block, row))
        row, flat, block = row[order], flat[order], block[order]
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))) if len(row) else np.zeros(0, int)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int64()))
        asked = pa.StructArray.from_arrays([pa.array(block[starts], pa.int64()), lists], names=["block", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[starts], minlength=len(sizes)))), pa.int32()), asked)

    spot = F.pmod(F.xxhash64("golden_id"), F.col("high") - F.col("low") + 1)
    if "blocks" in queries.columns:
        sent = queries.withColumn("block", F.explode("blocks"))
    else:
        sent = queries.withColumn("_asked", F.explode(blocks_of("cells"))).withColumns({"block": F.col("_asked.block"), "cells": F.col("_asked.cells")})
    left = sent.select("block", F.pmod(F.xxhash64(ROW), F.lit(chunks)).cast("int").alias("chunk"), ROW, "query_id", "embedding", *kernel.extras, "cells")
    right = corpus.join(placed, "cell").select(
        (F.col("low") + spot).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "cell", "golden_id", "label_id", "embedding"
    )
    result = kernel.result_type(corpus.schema["golden_id"].dataType)
    arrow_result = arrow_type(result)

    def one(asked: pa.Table, block: pa.Table) -> pa.Table:
        if len(asked) == 0 or len(block) == 0:
            return pa.table({ROW: pa.nulls(0, pa.int64()), "value": pa.nulls(0, arrow_result)})
        return pa.table({ROW: asked[ROW].combine_chunks(), "value": work(asked, block, kernel).cast(arrow_result)})

    schema = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("value", result)])
    right = right.toDF(*right.columns)  # fresh columns: both sides may come from one table
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(one, schema)


#: To ask a cell costs as much as so many products besides its own; rows of cells that may be met by one product.
RANKED_AS, TILE_ROWS = 300, 1024
#: Candidates a task holds before it ranks them.
HELD = 2_000_000


def opened(asked: pa.Table, corpus: pa.Table) -> tuple:
    """The block in the order of its cells, the queries, where each cell lies, and which cells of the block each query asks."""
    corpus = corpus.take(pc.sort_indices(corpus, sort_keys=[("cell", "ascending"), ("golden_id", "ascending")])).combine_chunks()
    asked = asked.combine_chunks()
    column = lambda table, name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
    ids, cell_of, query_ids = column(corpus, "golden_id"), column(corpus, "cell").to_numpy(), column(asked, "query_id")
    labels = column(corpus, "label_id").fill_null(-1).to_numpy(zero_copy_only=False)
    block = Block(ids, np.asarray(labels), matrix_of(column(corpus, "embedding")), np.arange(len(ids)))
    points, lists = matrix_of(column(asked, "embedding")), column(asked, "cells")
    wanted, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(points)), np.diff(lists.offsets.to_numpy()))
    cells, first = np.unique(cell_of, return_index=True)
    last = np.append(first[1:], len(cell_of))
    known = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    here = cells[known] == wanted
    return block, query_ids, points, cell_of, cells, first, last, known[here], row[here]


def cells_sum(asked: pa.Table, corpus: pa.Table, kernel: Kernel) -> pa.Array:
    """The kernel's numbers over the cells each query asks, added up; tables as in ``cells_top_k``."""
    block, query_ids, points, _, _, first, last, known, row = opened(asked, corpus)
    return pa.array(summed_cells(block, query_ids, points, [asked[e].combine_chunks() for e in kernel.extras], first, last, known, row, kernel))


def summed_cells(block: Block, query_ids: pa.Array, points: np.ndarray, extras: list[pa.Array], first, last, known, row, kernel: Kernel) -> np.ndarray:
    order = np.argsort(known, kind="stable")
    known, row = known[order], row[order]
    total = np.zeros(len(points), np.int64)
    for c in np.unique(known):
        who, s = row[slice(*np.searchsorted(known, (c, c + 1)))], slice(first[c], last[c])
        taken = pa.array(who)
        value = kernel.run(query_ids.take(taken), points[who], [e.take(taken) for e in extras], Block(block.ids[s], block.labels[s], block.matrix[s]))
        total[who] += value.to_numpy(zero_copy_only=False)  # a query asks a cell once
    return total


def cells_top_k(asked: pa.Table, corpus: pa.Table, kernel: TopK) -> pa.Array:
    """The kernel over the cells each query asks: ``asked(query_id, embedding, cells)``, ``corpus(cell, golden_id, label_id, embedding)``.

    Cells are compared one after the other, each with all queries that ask it; small ones that are asked by the same queries are met together.
    The k-th distance found so far bounds what a query takes from the next cells; it is looked up after 1, 2, 4, ... steps.  A query that
    comes with a ``goal``, a distance it knows, begins with that.
    """
    block, query_ids, points, _, _, first, last, known, row = opened(asked, corpus)
    goal = asked["goal"].combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False) if "goal" in asked.column_names else None
    rows, at, keys = ranked_cells(block, query_ids, points, first, last, known, row, goal, kernel)
    return kernel.lists(block, np.bincount(rows, minlength=len(points)), at, keys)


def ranked_cells(block: Block, query_ids: pa.Array, points: np.ndarray, first, last, known, row, goal: np.ndarray | None, kernel: TopK) -> tuple:
    """``(query, position in the block, sort key)`` of the answers of ``cells_top_k``, in order; ``first`` to ``row`` as ``opened`` gives them."""
    name = pc.rank(block.ids, tiebreaker="dense").to_numpy().astype(np.int64)
    bound = None
    if kernel.metric == "l2":
        bound = np.full(len(points), np.inf) if goal is None else np.square(goal)
    order = np.argsort(known, kind="stable")
    known, row = known[order], row[order]
    held, size, met, look = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0, 0, 1
    for part, who, open_to in _steps(block, name, first, last, known, row):
        front, sizes, cols, keys = kernel.pick(query_ids.take(pa.array(who)), points[who], [], part, None if bound is None else bound[who], open_to)
        held.append((np.repeat(who, sizes), front.at[cols], keys))
        size, met = size + len(cols), met + 1
        if size > HELD or met == look:
            held, size, look = [_best(held, block.labels, name, kernel)], 0, max(look, 2 * met)
            if bound is not None:
                bound = np.minimum(bound, _kth_keys(*held[0][::2], len(points), kernel.k))
    return _best(held, block.labels, name, kernel)


def _steps(block: Block, name: np.ndarray, first: np.ndarray, last: np.ndarray, known: np.ndarray, row: np.ndarray):
    """Parts of the block, the queries that ask them, and ``open_to`` (see ``TopK.pick``) of a part of several cells.

    ``known`` are the cells asked, in order, ``row`` the queries that ask them.
    """
    asked, sizes = np.unique(known), last - first
    apart = len(np.unique(name)) < len(name)  # rows that share an id are told apart by their cells
    cell_of = np.repeat(np.arange(len(sizes)), sizes)
    at = 0
    while at < len(asked):
        most = np.searchsorted(np.cumsum(sizes[asked[at:]][:TILE_ROWS]), TILE_ROWS, "right")
        tile = asked[at : at + (1 if apart else max(1, int(most)))]
        s = slice(*np.searchsorted(known, (tile[0], tile[-1] + 1)))
        asks, askers = known[s], row[s]
        at += len(tile)
        who = np.unique(askers) if len(tile) > 1 else askers
        if len(tile) > 1 and (sizes[asks] + RANKED_AS).sum() > len(who) * sizes[tile].sum():
            rows = np.concatenate([np.arange(first[c], last[c]) for c in tile])
            allowed = np.zeros((len(who), len(tile)), bool)
            allowed[np.searchsorted(who, askers), np.searchsorted(tile, asks)] = True
            open_to = None if allowed.all() else lambda s, front, a=allowed, t=tile: (a[s], np.searchsorted(t, cell_of[front.at]))
            yield block.part(rows[np.argsort(name[rows])]), who, open_to
            continue
        for c in tile:
            s, own = slice(first[c], last[c]), slice(*np.searchsorted(asks, (c, c + 1)))
            yield Block(block.ids[s], block.labels[s], block.matrix[s], block.at[s]), askers[own], None


def _kth_keys(rows: np.ndarray, keys: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th sort key of each of ``n`` queries whose keys are given in order; infinite for a query with fewer."""
    counts = np.bincount(rows, minlength=n)
    kth, full = np.full(n, np.inf), np.flatnonzero(counts >= k)
    kth[full] = keys[(np.cumsum(counts) - counts)[full] + k - 1]
    return kth


def _best(held: list[tuple], labels: np.ndarray, name: np.ndarray, kernel: TopK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates ``(query, position, sort key)`` the first ``k`` of each query, in order; different ones if the kernel says so."""
    rows, at, keys = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((labels[at], name[at], keys, rows))
    rows, at, keys = rows[order], at[order], keys[order]
    if kernel.distinct:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]) | (name[at[1:]] != name[at[:-1]]) | (labels[at[1:]] != labels[at[:-1]])
        rows, at, keys = rows[new], at[new], keys[new]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < kernel.k
    return rows[keep], at[keep], keys[keep]


class DistinctTopK(TopK):
    """Merge rule for candidates that may arrive through several cells."""

    distinct = True

    def merge(self, value):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(value)))), 1, self.k)


def default_cells(rows: int) -> int:
    return max(1, min(isqrt(rows), 1024))


def default_bits(rows: int, cell_rows: int = 64) -> int:
    """Sign bits that leave about ``cell_rows`` rows in a cell, however many rows there are."""
    return max(1, ceil(log2(max(rows, 1) / cell_rows))) if rows > cell_rows else 1


@dataclass(frozen=True)
class CellIndex:
    """Corpus rows by cell, as a stored table, and what finds the cells of a query.

    ``ivf``: ``centres`` is a matrix, and a query asks the nearest of its rows.  ``lsh``: ``planes`` is a matrix for each
    table, whose signs are the bits of the cell; a query asks its own cell and those one bit away, or the likeliest cells of all
    tables (``directed_cells``).  ``fit_index`` sets the effort that a recall takes.
    """

    kind: str
    cells: DataFrame  # (cell, golden_id, label_id, embedding)
    centres: np.ndarray | None = None
    planes: np.ndarray | None = None
    probes: int | None = None  # ivf: cells a query asks if nothing else is said
    shrink: float | None = None  # lsh: a neighbour's projection is about this part of the query's,
    noise: float | None = None  # give or take this much, in lengths of a plane over the root of its size
    miss: float = 0.05  # lsh: accepted chance that none of the probes has a neighbour

    def asked(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """``queries`` with a row for each ``cell`` they ask; by the fitted effort if ``probes`` is not given."""
        return one_row_a_cell(self.asked_lists(queries, probes))

    def asked_lists(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """``queries`` with all ``cells`` they ask."""
        if self.kind == "ivf":
            probes = self.probes if probes is None else probes
            return cell_order(queries, self.centres, min(probes or DEFAULT_PROBES, len(self.centres)))
        if probes is None and self.noise is not None:
            return directed_cells(queries, self.planes, self.shrink, self.noise, self.miss)
        return sign_lists(queries, self.planes, probes or DEFAULT_PROBES)


def fit_centres(corpus: DataFrame, n_cells: int | None = None, seed: int = 42) -> np.ndarray:
    """k-means centres of all corpus rows."""
    rows = corpus.count()
    cells = min(n_cells or default_cells(rows), max(1, rows))
    if cells == 1:
        row = corpus.select(F.transform(F.col("embedding"), lambda x: x * 0.0).alias("z")).first()
        return np.asarray([row["z"]] if row else [[0.0]], dtype=float)
    fit_on = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v", predictionCol="c").fit(fit_on)
    return np.vstack(model.clusterCenters())


def sign_planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Components are md5 of ``seed:table:bit:dimension``, so that SQL can make the same."""
    head = lambda *at: int(hashlib.md5(":".join(map(str, (seed, *at))).encode()).hexdigest()[:8], 16)
    return np.array([[[head(t, b, d) / 2.0**32 - 0.5 for d in range(dim)] for b in range(bits)] for t in range(tables)])


def one_row_a_cell(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "cells"], F.explode("cells").alias("cell"))


def signed_cells(df: DataFrame, planes: np.ndarray, probes: int = 1) -> DataFrame:
    """One row per input row, table and probed cell."""
    return one_row_a_cell(sign_lists(df, planes, probes))


def sign_lists(df: DataFrame, planes: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` with ``cells``, those of all tables that are probed; a cell is ``(table << 32) + bits``.

    The first probe is the row's own cell, the others turn one bit each, the least certain first.
    """
    probes = min(probes, planes.shape[1] + 1)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cells(embedding: pa.Array) -> pa.Array:
        points = matrix_of(embedding)
        out = []
        for table, own in enumerate(planes):
            values = points @ own.T
            code = (values >= 0) @ (1 << np.arange(len(own))) + (table << 32)
            out.append(code[:, None])
            if probes > 1:
                turned = np.argsort(np.abs(values), axis=1, kind="stable")[:, : probes - 1]
                out.append(code[:, None] ^ (1 << turned))
        flat = np.concatenate(out, axis=1).astype(np.int64)
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return df.withColumn("cells", cells("embedding"))


def likeliest_cells(values: np.ndarray, spread: np.ndarray, miss: float, most: int | None = None) -> list[int]:
    """Cells of all tables, the likeliest to hold a neighbour first, until the chance to have missed it is at most ``miss``.

    ``most`` ends the list earlier, for asking whether so many are enough.

    ``values (tables, bits)`` are what to expect of a neighbour's projections, with a normal error of deviation ``spread``.  So a
    bit is turned with the chance of an error beyond its margin, bits and tables turn independently, and a cell's chance
    is the product over its bits.  Sets of turned bits come from one heap for all tables, in falling chance: the cheapest bit that is
    not yet in a set either joins it or takes the place of the last one.
    """
    margins = (np.abs(values) / (spread * sqrt(2.0))).tolist()
    turned = np.clip([[0.5 * erfc(m) for m in table] for table in margins], 1e-12, 0.5)
    stays = np.log1p(-turned)
    cost = stays - np.log(turned)  # of turning a bit: what it takes off the logarithm of the chance
    order = np.argsort(cost, axis=1, kind="stable")
    cost = np.take_along_axis(cost, order, axis=1).tolist()
    base, flips = stays.sum(axis=1).tolist(), (1 << order).tolist()
    own = ((values >= 0) @ (1 << np.arange(values.shape[1]))).tolist()
    missed = [1.0] * len(own)
    heap = [(-base[t], t, -1, own[t]) for t in range(len(own))]
    heapify(heap)
    cells = []
    while heap:
        less, t, last, code = heappop(heap)
        cells.append(code + (t << 32))
        missed[t] -= exp(-less)
        if prod(max(m, 0.0) for m in missed) <= miss or len(cells) == most:
            break
        if last + 1 < len(cost[t]):
            joined = code ^ flips[t][last + 1]
            heappush(heap, (less + cost[t][last + 1], t, last + 1, joined))
            if last >= 0:
                heappush(heap, (less + cost[t][last + 1] - cost[t][last], t, last + 1, joined ^ flips[t][last]))
    return cells


def directed_cells(df: DataFrame, planes: np.ndarray, shrink: float, noise: float, miss: float) -> DataFrame:
    """``df`` with ``cells``, those of any table that are probed: as many as its own margins ask for."""
    spread = np.linalg.norm(planes, axis=2) * max(noise, 1e-12) / sqrt(planes.shape[2])
    shrink = max(shrink, 1e-12)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cells(embedding: pa.Array) -> pa.Array:
        values = shrink * np.einsum("nd,tbd->ntb", matrix_of(embedding, planes.shape[2]), planes)
        return pa.array([likeliest_cells(v, spread, miss) for v in values], pa.list_(pa.int64()))

    return df.withColumn("cells", cells("embedding"))


def cell_order(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``df`` with ``cells``, the numbers of the nearest centres in their order."""
    ids = pa.array(np.arange(len(centres), dtype=np.int64))
    block = Block(ids, np.zeros(len(centres), np.int32), centres)
    packed = PackedCorpus.send(df.sparkSession, block, T.LongType())
    probed = projection(packed, TopK(probes), F.lit(-1).cast("bigint"))
    return df.withColumn("_cells", probed).select(*df.columns, F.col("_cells.golden_id").alias("cells"))


def nearest_cells(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """One row per input row and probed cell, as column ``cell``."""
    return one_row_a_cell(cell_order(df, centres, probes))


def fit_index(
    corpus: DataFrame,
    kind: str = "ivf",
    n_cells: int | None = None,
    centres: np.ndarray | None = None,
    tables: int = 4,
    bits: int | None = None,
    seed: int = 42,
    recall: float | None = RECALL,
) -> CellIndex:
    """Assign every corpus row to its cell, once.

    ``ivf`` takes given ``centres`` or fits ``n_cells``; ``lsh`` takes ``bits`` or as many as keep cells small.  With ``recall``
    the effort is fitted that finds this share of the true neighbours of sampled rows.
    """
    rows = corpus_columns(corpus).filter(F.col("embedding").isNotNull())
    if kind == "ivf":
        centres = fit_centres(rows, n_cells, seed) if centres is None else np.asarray(centres, dtype=float)
        index = CellIndex(kind, cut_lineage(nearest_cells(rows, centres, 1)), centres=centres)
        return fit_effort(index, rows, recall, seed=seed) if recall else index
    if kind != "lsh":
        raise ValueError("an index is 'ivf' or 'lsh'")
    first = rows.select(F.size("embedding").alias("dim")).first()
    planes = sign_planes(tables, bits or default_bits(rows.count()), first["dim"] if first else 1, seed)
    model = fit_projections(rows, planes, seed=seed) if recall else None
    if model is None:
        return CellIndex(kind, cut_lineage(signed_cells(rows, planes)), planes=planes)
    shrink, noise, asked = model
    if bits is None:
        planes = planes[:, : affordable_bits(asked, planes, shrink, noise, 1.0 - recall)]
    return CellIndex(kind, cut_lineage(signed_cells(rows, planes)), planes=planes, shrink=shrink, noise=noise, miss=1.0 - recall)


def _true_neighbours(rows: DataFrame, k: int, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``sample`` rows as queries, and their ``k`` nearest among all rows: both stored, and small."""
    drawn = rows.orderBy(seeded(seed, F.lit("effort"), F.col("golden_id")), "golden_id").limit(sample)
    drawn = cut_lineage(drawn.select(F.col("golden_id").alias("query_id"), "embedding"))
    return drawn, cut_lineage(explode_neighbours(nearest(drawn, rows, k, exclude_self=True)))


def fit_projections(rows: DataFrame, planes: np.ndarray, k: int = 10, sample: int = EFFORT_SAMPLE, seed: int = 42) -> tuple[float, float, np.ndarray] | None:
    """How the projections of true neighbours follow those of their queries: as a part of them, with an error; and the sampled queries.

    ``sample`` rows (a bounded fit) are compared with the whole corpus.
    """
    drawn, near = _true_neighbours(rows, k, sample, seed)
    pairs = rows.select("golden_id", F.col("embedding").alias("found")).join(F.broadcast(near.select("query_id", "golden_id")), "golden_id")
    pairs = pairs.join(F.broadcast(drawn), "query_id").select("embedding", "found").toArrow().combine_chunks()
    if not len(pairs):
        return None
    scale = np.linalg.norm(planes, axis=2) / sqrt(planes.shape[2])
    asked, found = (np.einsum("nd,tbd->ntb", matrix_of(pairs[c].combine_chunks()), planes) / scale for c in ("embedding", "found"))
    shrink = float((asked * found).sum() / max((asked * asked).sum(), 1e-300))
    return shrink, float(np.sqrt(((found - shrink * asked) ** 2).mean())), matrix_of(pairs["embedding"].combine_chunks())[:: max(1, k)]


def affordable_bits(asked: np.ndarray, planes: np.ndarray, shrink: float, noise: float, miss: float) -> int:
    """The most bits with which sampled queries need no more than ``MOST_PROBES`` cells on average."""
    spread = np.linalg.norm(planes, axis=2) * max(noise, 1e-12) / sqrt(planes.shape[2])
    values = max(shrink, 1e-12) * np.einsum("nd,tbd->ntb", asked[:64], planes)
    for bits in range(planes.shape[1], 1, -1):
        if np.mean([len(likeliest_cells(v[:, :bits], spread[:, :bits], miss, 2 * MOST_PROBES)) for v in values]) <= MOST_PROBES:
            return bits
    return 1


def fit_effort(index: CellIndex, corpus: DataFrame, recall: float = RECALL, k: int = 10, sample: int = EFFORT_SAMPLE, seed: int = 42) -> CellIndex:
    """An ``ivf`` index with the number of probes at which sampled rows find ``recall`` of their ``k`` true neighbours.

    ``sample`` rows (a bounded fit) are compared with the whole corpus.  The rank of the cell of each true neighbour in its query's order of
    cells is counted, and the first rank that covers enough of them is the number of probes.
    """
    drawn, near = _true_neighbours(corpus_columns(corpus), k, sample, seed)
    wanted = index.cells.join(F.broadcast(near.select("query_id", "golden_id")), "golden_id").select("query_id", F.col("cell").alias("wanted"))
    place = cell_order(drawn, index.centres, len(index.centres)).drop("embedding")
    ranks = F.broadcast(wanted).join(place, "query_id").groupBy(F.array_position("cells", F.col("wanted")).alias("rank")).count()
    counts = np.zeros(len(index.centres) + 1, np.int64)
    for r in ranks.collect():  # a row for each rank
        counts[r["rank"]] = r["count"]
    covered = np.cumsum(counts)
    return replace(index, probes=int(np.searchsorted(covered, recall * covered[-1])) or 1)


def index_join(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    n_probe: int | None = None,
    metric: str = "l2",
    exclude_self: bool = False,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """Approximate ``nearest``: only corpus rows in one of the ``n_probe`` cells a query asks (of each table).

    Without ``n_probe`` a query asks with the effort fitted to the index's recall.
    """
    kernel = DistinctTopK(k, metric, exclude_self)
    rows, n = numbered_queries(queries)
    asked = index.asked_lists(rows.select(ROW, "query_id", "embedding"), n_probe)
    found = merge_parts(rows, routed_top_k(asked, n, index.cells, kernel, limits), kernel, "_found")
    return found.withColumn("neighbours", ranked_neighbours(F.col("_found"))).drop("_found")


def ivf_join(
    queries: DataFrame, corpus: DataFrame, k: int, n_cells: int | None = None, n_probe: int | None = None, seed: int = 42,
    centres: np.ndarray | None = None, **options,
) -> DataFrame:
    """``index_join`` over k-means cells made for this call; keep the index where it is used again."""
    recall = RECALL if n_probe is None else None
    return index_join(queries, fit_index(corpus, "ivf", n_cells, centres, seed=seed, recall=recall), k, n_probe, **options)


def lsh_join(
    queries: DataFrame, corpus: DataFrame, k: int, tables: int = 4, bits: int | None = None, n_probe: int | None = None, seed: int = 42, **options
) -> DataFrame:
    """``index_join`` over cells of sign bits made for this call."""
    recall = RECALL if n_probe is None else None
    return index_join(queries, fit_index(corpus, "lsh", tables=tables, bits=bits, seed=seed, recall=recall), k, n_probe, **options)
