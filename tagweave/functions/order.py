"""Exact ranks and percentiles of a column no single task could hold.

Equal values are counted first, so one value held by a third of all rows is one
row afterwards.  The distinct values are cut into slices, each slice is ranked on
its own, and the slice totals supply the offsets.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_bucket, seeded
from tagweave.functions.session import bounded, stored_with_count

SLICES = 256
ONE_TASK_ROWS = 50_000


def value_counts(df: DataFrame, value: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with ``n`` (and named conditional counts)."""
    named = [c.alias(name) for name, c in (counts or {}).items()]
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), *named)
    )


def with_rows_before(
    counted: DataFrame, slices: int = SLICES, one_task_rows: int = ONE_TASK_ROWS, stored: bool = False
) -> DataFrame:
    """Add ``before``: how many rows have a smaller value, and ``total``.

    The counts are stored first (unless they are already).  A checked few are ordered
    at once; more are cut at a seeded draw of the distinct values, of any orderable type.
    """
    counted, rows = (counted, counted.count()) if stored else stored_with_count(counted)
    if rows <= one_task_rows:
        return counted.select(
            "*",
            (F.sum("n").over(W.orderBy("value")) - F.col("n")).alias("before"),
            F.sum("n").over(W.partitionBy()).alias("total"),
        )
    drawn = counted.select("value").orderBy(seeded(slices, F.col("value")), "value").limit(slices - 1)
    edges = drawn.agg(F.array_sort(F.collect_list("value"))).scalar()
    sliced = counted.withColumn("edges", edges).select(
        *counted.columns,
        F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("slice"),
    )
    totals = sliced.groupBy("slice").agg(F.sum("n").alias("slice_n"))
    # At most `slices` rows, so one task may order them.
    offsets = totals.select(
        "slice",
        (F.sum("slice_n").over(W.orderBy("slice")) - F.col("slice_n")).alias("offset"),
        F.sum("slice_n").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("slice").orderBy("value")
    return (
        sliced.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        .join(F.broadcast(offsets), "slice")
        .select(*counted.columns, (F.col("offset") + F.col("inside")).alias("before"), "total")
    )


def percentiles(counted: DataFrame, fractions: Sequence[float], **options) -> DataFrame:
    """Linear-interpolated percentiles as rows ``(pos, fraction, value)``."""
    ranked = with_rows_before(counted, **options)
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(float(f)).alias("fraction"),
                ((F.col("total") - 1) * F.lit(float(f))).alias("at"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    # A value row answers a request if it covers the row below or above the target.
    hits = ranked.select(
        "value",
        "before",
        "n",
        F.explode(
            F.filter(wanted, lambda w: (F.ceil(w.at) >= first) & (F.floor(w.at) <= last))
        ).alias("w"),
    )
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    low = F.max(F.when((F.floor("w.at") >= first) & (F.floor("w.at") <= last), F.col("value")))
    high = F.max(F.when((F.ceil("w.at") >= first) & (F.ceil("w.at") <= last), F.col("value")))
    return (
        hits.groupBy("w.pos", "w.fraction")
        .agg(low.alias("low"), high.alias("high"), F.max(F.col("w.at") - F.floor("w.at")).alias("part"))
        .select("pos", "fraction", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))
    )


def with_hash_rank(
    df: DataFrame, by: Sequence[str], id_col: str, seed: int, rank: str = "pos", buckets: int = 1024
) -> DataFrame:
    """Number the rows of each group from 0 in seeded order, and add ``group_n``.

    Rows without a group key are dropped.  A group is spread over ``buckets`` equal slices of the hash range, so a hot
    group never sorts in one task.
    """
    labelled = df.na.drop(subset=list(by)) if by else df
    keyed = labelled.withColumn("_md5", seeded(seed, F.col(id_col))).withColumn(
        "_bucket", hash_bucket(F.col("_md5"), buckets)
    )
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # <= `buckets` rows each
    offsets = sizes.select(
        *by,
        "_bucket",
        (F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(group).alias("group_n"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_md5", id_col)
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*by, "_bucket"]).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).alias(rank), "group_n"
    )


def below_cut(
    df: DataFrame, by: Sequence[str], id_col: str, seed: int, quota: Callable[[Column], Column], buckets: int = 4096
) -> DataFrame:
    """Add ``_below``: whether a row is among the first ``quota(group size)`` of its group in seeded order.

    Rows are counted by group and hash slice, only the slice that holds a group's cut is ranked, and every
    row is then compared with its group's cut: rows themselves are not shuffled.  Rows that share an id with the cut
    share its side.
    """
    keyed = df.select(*by, id_col).withColumn("_md5", seeded(seed, F.col(id_col)))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_md5"), buckets))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)  # at most `buckets` rows each
    sizes = sizes.select(
        *by, "_bucket", "_n",
        F.sum("_n").over(group.orderBy("_bucket")).alias("_upto"), quota(F.sum("_n").over(group)).alias("_quota"),
    )
    edge = (F.col("_quota") > F.col("_upto") - F.col("_n")) & (F.col("_quota") <= F.col("_upto"))
    last = F.greatest(F.col("_quota") - F.col("_upto") + F.col("_n"), F.lit(0))
    edges = bounded(sizes.filter(edge).select(*by, "_bucket", last.alias("_last")))
    order = W.partitionBy(*by).orderBy("_md5", id_col)
    ranked = keyed.join(edges, [*by, "_bucket"]).withColumn("_rank", F.row_number().over(order))
    cuts = ranked.filter(F.col("_rank") <= F.col("_last")).groupBy(*by).agg(F.max(F.struct("_md5", F.col(id_col).alias("_id"))).alias("_cut"))
    here = F.struct(seeded(seed, F.col(id_col)).alias("_md5"), F.col(id_col).alias("_id"))
    joined = df.join(bounded(cuts), list(by), "left")
    return joined.select(*df.columns, F.coalesce(here <= F.col("_cut"), F.lit(False)).alias("_below"))
