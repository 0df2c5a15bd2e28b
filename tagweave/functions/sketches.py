"""Percentiles from mergeable sketches: one pass, a few kilobytes a group, whatever the number of rows.

Spark's KLL sketches are partial aggregates, so a hot group is reduced in each task before the shuffle.  A stored
sketch is merged with those of later rows without reading the old ones.  The exact form is ``functions.order.percentiles``.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """How far the rank of a returned value may be from the asked one, as a share of all rows, with 99 % confidence."""
    return 2.446 / size**0.9433


def sketched(df: DataFrame, value: str, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``(*by, sketch, n)`` of the values that are not null (nor NaN)."""
    number = F.col(value).cast("double")
    held = df.filter(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("value"))
    grouped = held.groupBy(*by).agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("n > 0")


def merged_sketches(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several parts, such as days or an old state and new rows, as one for each group."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")).filter("n > 0")


def sketch_percentiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, pos, value)``: the value at each share of the rows, up to ``rank_error`` of the sketch."""
    found = F.array(*[F.struct(F.lit(k).alias("pos"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for k, s in enumerate(shares)])
    return sketches.select(*by, F.explode(found).alias("p")).select(*by, "p.pos", "p.value")
