"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every step is a
group-wise minimum and a join, so no node's links have to fit one task: minima are
pre-aggregated and a hub's join is split by Spark's skew handling.  Each round is written to
the shared folder, which cuts the lineage and outlives executors.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import stored_with_count


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node but the roots of ``links(a, b)``; root is the smallest id reachable.

    Links to itself and links with a null end say nothing.  Without links the result is empty.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    now = now.filter("_a <> _b").select("u", "v").distinct()
    now, before = _stored(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        now, after = _stored(small.distinct())
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stored(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs as a written table, and what changes if a pair does."""
    stored, rows = stored_with_count(pairs)
    if not rows:
        return stored, (0, None)
    return stored, (rows, stored.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
