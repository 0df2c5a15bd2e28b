"""What the library needs from the running session."""

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast up to so many rows and bytes of (compressed) files.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    One of our own is made only where the session names none, as in local tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not named and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagweave-"))
    return context.getCheckpointDir()


_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


def scratch_path(spark: SparkSession) -> str:
    """A new path under the shared folder, for tables written and read back."""
    return f"{shared_folder(spark)}/{_scope.get()}{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; what is to outlive them has a path from outside."""
    name = f"{_scope.get()}scope-{uuid.uuid4().hex}/"
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_with_count(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` as a table in the shared folder; the table read back and its row count.

    The table outlives the executors that wrote it.  ``checkpoint()`` would compute the
    plan twice and keep whole rows; a parquet table is written once and read by column.
    """
    return _stored(df)[:2]


def _stored(df: DataFrame) -> tuple[DataFrame, int, str]:
    spark = df.sparkSession
    path = scratch_path(spark)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"], path


def file_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a written table, without the plan that made it."""
    return stored_with_count(df)[0]


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Compute a small table once; hint a broadcast only if its rows and its files are few and small enough.

    Beyond the bounds the join is left to Spark, which splits skewed partitions.
    """
    stored, _, small = stored_and_small(df, max_rows, max_bytes)
    return F.broadcast(stored) if small else stored


def stored_and_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int, bool]:
    """The written table, its row count, and whether its rows and its files are few and small enough to be sent to every task."""
    stored, rows, path = _stored(df)
    return stored, rows, rows <= max_rows and file_bytes(df.sparkSession, path) <= max_bytes


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], columns: str) -> DataFrame:
    """A table of fixed values that stays inside the plan."""
    names = [c.split()[0] for c in columns.split(",")]
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(entries).alias("r")).select("r.*").to(T.StructType.fromDDL(columns))


def arrow_once(result: T.DataType) -> Callable:
    """An Arrow function the optimizer evaluates once per row.

    A filter on the result (``explode`` adds one by itself) would otherwise be moved below
    the projection with a second copy of the call.
    """
    return lambda fn: F.arrow_udf(fn, returnType=result).asNondeterministic()
