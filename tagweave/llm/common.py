"""Small helpers that several operators of this subpackage share."""

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A worker's step gets no more than this at once, unless one row is larger.
STEP_BYTES = 8 << 20


def kept(key: tuple, make: Callable):
    """What a Python worker keeps from one task to the next."""
    home = sys.modules.setdefault("_tagweave_kept", types.ModuleType("_tagweave_kept")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def give_back() -> None:
    """Return freed memory to the system: workers are used again by stages that need theirs elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def in_steps(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` and ``STEP_BYTES`` at once."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > STEP_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema, rows: int = 500) -> Callable:
    """A function for ``mapInArrow``: ``make()`` runs once in a task, its result once for every few rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in in_steps(batches, rows):
            yield pa.RecordBatch.from_pydict(step(part), schema=schema)
        del step
        give_back()

    return run


def by_group(
    keys: tuple[str, ...], step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], rows: int = 1
) -> Callable:
    """A function for ``mapInArrow`` over partitions sorted by ``keys``.

    ``step`` gets whole runs of equal keys: as many as fit in ``rows`` rows, or one.
    The caller keeps a run within a task's memory.
    """

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Rows that start a new key."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for key in keys:
            column = batch.column(key)
            new[1:] |= np.asarray(column.slice(1).to_numpy(zero_copy_only=False) != column.slice(0, n - 1).to_numpy(zero_copy_only=False))
        return np.flatnonzero(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            starts = changes(whole)
            at, last = 0, int(starts[-1])
            while at < last:
                k = int(np.searchsorted(starts, at + rows, "right")) - 1
                upto = int(starts[k] if starts[k] > at else starts[k + 1])
                yield from step(whole.slice(at, upto - at))
                at = upto
            held, size = [whole.slice(last)], whole.num_rows - last
        if size:
            yield from step(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        held.clear()
        give_back()

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a number of its own for each row, and the name of that column."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls and with lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vector: str):
    """Vectors that can have a direction: not null, not empty, every part finite, not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(
        F.col(vector).isNotNull() & F.forall(F.col(vector), good) & F.exists(F.col(vector), lambda x: x != 0), F.lit(False)
    )
