"""Seeded pseudo-random choice that survives repartitioning and re-runs.

``rand()`` depends on row order inside a partition, so a lost executor could
change a sample half-way through a job.  Everything "random" here is the md5 of
the seed and the row's own id.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_head(md5: Column, digits: int = 8) -> Column:
    """Leading hex digits of an md5 string as a number."""
    return F.conv(F.substring(md5, 1, digits), 16, 10).cast("bigint")


def hash_bucket(md5: Column, buckets: int) -> Column:
    """Bucket number that grows with the md5 string: equal slices of its range."""
    return F.floor(hex_head(md5) * F.lit(buckets) / F.lit(2.0**32)).cast("int")
