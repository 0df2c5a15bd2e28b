"""Compare every query vector with every corpus vector, block by block.

Pairs are never rows.  A kernel meets a batch of queries and one block of the
corpus inside a task, does the distance work as one matrix product and hands back
one value per query.  A corpus of checked size is broadcast and the scan is a
plain projection with no shuffle.  A larger corpus is cut into blocks of bounded
size, each meets bounded chunks of queries in a co-group, and the per-block values
are merged per query.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.session import arrow_once, stored_with_count

#: Distances a task holds at once; where that leaves ``STRIP_ROWS`` queries, rather fewer, which stay nearer to the processor.
CELLS_AT_ONCE, CELLS_NEAR, STRIP_ROWS = 4_000_000, 1_000_000, 64
#: Squared lengths from here on are not left to single precision, whose products are off by at most ``ROUNDING`` of their terms' sum for each term.
LONGEST, ROUNDING = 1e30, 1.05 * 2.0**-24
#: Columns in whose least value the search for the k-th value looks; marked pairs of a strip, of which more are not looked at one by one.
GROUP, MOST_MARKED = 64, 1 / 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Number of a query row inside the plan that meets blocks.
ROW = "_query_row"


@dataclass(frozen=True)
class ScanLimits:
    """Sizes the scan checks before it picks a plan.

    Every block meets every chunk, so what is shuffled grows with their number.  Blocks and chunks therefore grow beyond their rows until
    a row is sent at most ``copies`` times, as long as one is no larger than ``grown_bytes`` of vectors; ``None`` keeps their rows.
    """

    broadcast_bytes: int = 128 << 20
    block_rows: int = 32_768
    chunk_rows: int = 32_768
    copies: int | None = 16
    grown_bytes: int = 64 << 20

    def parts(self, rows: int, dim: int, part_rows: int) -> int:
        """How many blocks or chunks of at least ``part_rows`` a side is cut into."""
        grown = 0 if self.copies is None else min(ceil(rows / self.copies), self.grown_bytes // max(1, 8 * dim))
        return max(1, ceil(rows / max(part_rows, grown)))


@dataclass
class Block:
    """Some corpus rows in id order."""

    ids: pa.Array
    labels: np.ndarray
    matrix: np.ndarray
    at: np.ndarray | None = None  # where the rows are in a larger block
    _front: dict = field(default_factory=dict, repr=False)

    def front(self, copies: int, by_label: bool = False) -> Block:
        """The block with at most ``copies`` rows of each vector (and label), the first by id."""
        key = copies, by_label
        if key not in self._front:
            self._front[key] = self._first_copies(*key)
        return self._front[key]

    def _first_copies(self, copies: int, by_label: bool) -> Block:
        """Rows are told apart by their bytes, but only those that share a checksum with more than ``copies`` rows."""
        if len(self.ids) <= copies:
            return self
        sums = self.labels.astype(np.uint64) if by_label else np.zeros(len(self.ids), np.uint64)
        for d in range(self.matrix.shape[1]):
            sums *= MIX
            sums ^= sums >> np.uint64(29)
            sums += self.matrix[:, d].view(np.uint64)
        _, group, count = np.unique(sums, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[group] > copies)
        if not len(many):
            return self
        rows = np.hstack([self.matrix[many], self.labels[many, None]]) if by_label else np.ascontiguousarray(self.matrix[many])
        _, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        copy_no = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        kept = np.ones(len(self.ids), bool)
        kept[many[order]] = copy_no < copies
        return self if kept.all() else self.part(np.flatnonzero(kept))

    def part(self, rows: np.ndarray) -> Block:
        """The block of some of the rows."""
        part = Block(self.ids.take(pa.array(rows)), self.labels[rows], self.matrix[rows], None if self.at is None else self.at[rows])
        if held := self._front.get("coarse"):
            part._front["coarse"] = np.ascontiguousarray(held[0][:, rows]), held[1]
        return part

    def of_labels(self) -> dict[int, np.ndarray]:
        """Where the rows of each label are."""
        if "labels" not in self._front:
            self._front["labels"] = split_by(self.labels)
        return self._front["labels"]

    def coarse(self) -> tuple[np.ndarray, float] | None:
        """A single-precision matrix whose product with ``(q, 1)`` is ``|g|^2 - 2 q.g`` for each row g, and the greatest ``|g|^2``.

        None where the rows are not finite or too long for single precision.
        """
        if "coarse" not in self._front:
            lengths = np.einsum("ij,ij->i", self.matrix, self.matrix)
            longest = float(lengths.max()) if len(lengths) else 0.0
            fits = longest < LONGEST and bool(np.isfinite(lengths).all())
            self._front["coarse"] = (self._single(lengths), longest) if fits else None
        return self._front["coarse"]

    def _single(self, lengths: np.ndarray) -> np.ndarray:
        """Rounded as it is written, so that no further matrix of doubles is held."""
        single = np.empty((self.matrix.shape[1] + 1, len(lengths)), np.float32)
        np.multiply(self.matrix.T, -2.0, out=single[:-1], casting="same_kind")
        single[-1] = lengths
        return single

    @staticmethod
    def of(table: pa.Table) -> Block:
        order = pc.sort_indices(table, sort_keys=[("golden_id", "ascending")])
        table = table.take(order).combine_chunks()
        return Block(
            _whole(table["golden_id"]),
            np.asarray(_whole(table["label_id"]).fill_null(-1).to_numpy(zero_copy_only=False)),
            matrix_of(_whole(table["embedding"])),
        )


def split_by(values: np.ndarray) -> dict:
    """Where each value stands, in order; a value that is not one (NaN) stands nowhere."""
    places = np.flatnonzero(values == values)
    order = places[np.argsort(values[places], kind="stable")]
    names, first = np.unique(values[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, first[1:])))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix_of(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix; a null or odd-sized row is an error."""
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return flat.reshape(0, width or 0)
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or not (sizes == sizes[0]).all() or (width and sizes[0] != width):
        raise ValueError("every vector must be present and of one length")
    return flat.reshape(rows, int(sizes[0]))


def squared_distances(left: np.ndarray, rows: np.ndarray, right: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distance of each ``left[row], right[col]``, added up in position order as SQL does."""
    total = np.zeros(len(rows))
    for d in range(left.shape[1]):
        step = left[rows, d] - right[cols, d]
        total += step * step
    return total


def all_squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``squared_distances`` of all rows of two small matrices."""
    total = np.zeros((len(left), len(right)))
    for d in range(left.shape[1]):
        step = left[:, d, None] - right[None, :, d]
        total += step * step
    return total


def dot_products(left: np.ndarray, rows: np.ndarray, right: np.ndarray, cols: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    for d in range(left.shape[1]):
        total += left[rows, d] * right[cols, d]
    return total


def own_positions(ids: pa.Array, block: Block) -> np.ndarray:
    """Where each query itself sits in the block, -1 if it does not."""
    found = pc.index_in(ids.cast(block.ids.type), value_set=block.ids)
    return found.fill_null(-1).to_numpy(zero_copy_only=False)


def strips(rows: int, width: int):
    """Row slices whose distance matrix stays small."""
    width = max(1, width)
    step = max(1, min(STRIP_ROWS, CELLS_AT_ONCE // width), CELLS_NEAR // width)
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def estimates(queries: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by matrix product, and how far off each row may be."""
    q2 = np.einsum("ij,ij->i", queries, queries)
    g2 = np.einsum("ij,ij->i", block.matrix, block.matrix)
    d2 = q2[:, None] + g2[None, :] - 2.0 * (queries @ block.matrix.T)
    return d2, 1e-10 * (1.0 + q2 + (g2.max() if len(g2) else 0.0))


def coarse_estimates(queries: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``|g|^2 - 2 q.g`` in single precision, ``|q|^2``, and how far off each row of estimates may be; None where that does not reach."""
    q2 = np.einsum("ij,ij->i", queries, queries)
    held = block.coarse()
    if held is None or not (q2 < LONGEST).all():
        return None
    matrix, longest = held
    asked = np.ones((len(queries), len(matrix)), np.float32)
    asked[:, :-1] = queries
    return asked @ matrix, q2, 1e-10 * (1.0 + q2 + longest) + ROUNDING * (queries.shape[1] + 8) * (q2 + 2.0 * longest)


def upwards(values: np.ndarray) -> np.ndarray:
    """Single-precision numbers not below ``values``, as a column."""
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))[:, None]


def kth_at_most(near: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k entries do not exceed: the k-th least of the least values of groups, or the k-th itself."""
    groups = near.shape[1] // GROUP
    if groups >= 2 * k:
        near = near[:, : groups * GROUP].reshape(len(near), GROUP, groups).min(axis=1)
    return np.partition(near, k - 1, axis=1)[:, k - 1]


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a mask with few marks."""
    flat = mask.ravel()
    if len(flat) % 8 == 0:  # eight marks are looked at as one number
        eight = np.flatnonzero(flat.view(np.uint64))
        part, at = np.nonzero(flat.reshape(-1, 8)[eight])
        found = eight[part] * 8 + at
    else:
        found = np.flatnonzero(flat)
    return np.divmod(found, mask.shape[1])


class Kernel:
    """Work of one query batch on one block: one value per query."""

    extras: tuple[str, ...] = ()

    def result_type(self, id_type: T.DataType) -> T.DataType:
        raise NotImplementedError

    def run(self, ids: pa.Array, queries: np.ndarray, extras: list[pa.Array], block: Block) -> pa.Array:
        raise NotImplementedError

    def thin(self, corpus: DataFrame) -> DataFrame:
        """Drop corpus rows that cannot change the answer."""
        return corpus

    def merge(self, value: Column) -> Column:
        """Aggregate the values of one query over all blocks."""
        raise NotImplementedError


@dataclass
class PackedCorpus:
    """A corpus broadcast to the executors after its size was checked."""

    handle: object
    id_type: T.DataType
    rows: int
    dim: int

    @staticmethod
    def send(spark: SparkSession, block: Block, id_type: T.DataType) -> PackedCorpus:
        # Plain arrays only: a class of ours would have to be importable on every worker.
        handle = spark.sparkContext.broadcast((block.ids, block.labels, block.matrix))
        return PackedCorpus(handle, id_type, *block.matrix.shape)


def corpus_columns(corpus: DataFrame) -> DataFrame:
    label = F.col("label_id") if "label_id" in corpus.columns else F.lit(-1)
    return corpus.filter(F.col("embedding").isNotNull()).select(
        "golden_id", label.cast("int").alias("label_id"), "embedding"
    )


def corpus_shape(corpus: DataFrame) -> tuple[int, int]:
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return row["n"], row["d"] or 0


def pack(corpus: DataFrame, limits: ScanLimits = ScanLimits()) -> PackedCorpus | DataFrame:
    """Broadcast ``corpus(golden_id, label_id, embedding)`` if it is small enough."""
    corpus = corpus_columns(corpus)
    rows, dim = corpus_shape(corpus)
    if rows * dim * 8 > limits.broadcast_bytes:
        return corpus
    return PackedCorpus.send(corpus.sparkSession, Block.of(corpus.toArrow()), corpus.schema["golden_id"].dataType)


def block_scan(
    queries: DataFrame,
    corpus: DataFrame | PackedCorpus,
    kernel: Kernel,
    out: str,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """Add ``out``, the kernel's value over the whole corpus, to each query row.

    Queries have a ``query_id``, which may repeat, and an ``embedding``.  Both plans answer each row by itself.
    """
    if isinstance(corpus, DataFrame):
        corpus = pack(corpus, limits)
    if isinstance(corpus, PackedCorpus):
        return queries.withColumn(out, projection(corpus, kernel, F.col("query_id")))
    rows, n = numbered_queries(queries)
    parts = _grid(rows, n, kernel.thin(corpus_columns(corpus)), kernel, limits)
    return merge_parts(rows, parts, kernel, out)


def numbered_queries(queries: DataFrame) -> tuple[DataFrame, int]:
    """The queries as a written table with a number of their own, and how many there are: what makes them runs once."""
    return stored_with_count(queries.withColumn(ROW, F.monotonically_increasing_id()))


def projection(corpus: PackedCorpus, kernel: Kernel, query_id: Column) -> Column:
    handle, dim = corpus.handle, corpus.dim
    opened: list[Block] = []  # one per task

    @arrow_once(kernel.result_type(corpus.id_type))
    def scan(*columns: pa.Array) -> pa.Array:
        ids, vectors, *extras = columns
        if not opened:
            opened.append(Block(*handle.value))
        return kernel.run(ids, matrix_of(vectors, dim), list(extras), opened[0])

    return scan(query_id, F.col("embedding"), *[F.col(c) for c in kernel.extras])


def _grid(queries: DataFrame, n: int, corpus: DataFrame, kernel: Kernel, limits: ScanLimits) -> DataFrame:
    n_corpus, dim = corpus_shape(corpus)
    blocks = limits.parts(n_corpus, dim, limits.block_rows)
    chunks = limits.parts(n, dim, limits.chunk_rows)

    def spread(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(
        ROW, "query_id", "embedding", *kernel.extras, spread(ROW, chunks).alias("chunk"), all_of(blocks).alias("block")
    )
    right = corpus.select("*", spread("golden_id", blocks).alias("block"), all_of(chunks).alias("chunk"))
    return meet(left, right, ["block", "chunk"], kernel)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], kernel: Kernel) -> DataFrame:
    """Run the kernel once per key, the queries and the block that share it: ``(row, value)``, by the queries' own number."""
    result = kernel.result_type(right.schema["golden_id"].dataType)
    extras = kernel.extras

    def one(asked: pa.Table, block: pa.Table) -> pa.Table:
        if len(asked) == 0 or len(block) == 0:
            return pa.table({ROW: pa.nulls(0, pa.int64()), "value": pa.nulls(0, arrow_result)})
        value = kernel.run(
            _whole(asked["query_id"]), matrix_of(_whole(asked["embedding"])), [_whole(asked[c]) for c in extras], Block.of(block)
        )
        return pa.table({ROW: _whole(asked[ROW]), "value": value.cast(arrow_result)})

    schema = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("value", result)])
    arrow_result = arrow_type(result)
    right = right.toDF(*right.columns)  # fresh columns: both sides may come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(one, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    }[kind.simpleString()]


def merge_parts(rows: DataFrame, parts: DataFrame, kernel: Kernel, out: str) -> DataFrame:
    """``rows``, from ``numbered_queries``, with the merged value of their parts, without their number."""
    merged = parts.groupBy(ROW).agg(kernel.merge(F.col("value")).alias(out))
    return rows.join(merged, ROW, "left").drop(ROW)
