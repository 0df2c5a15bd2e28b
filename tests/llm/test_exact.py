import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import exact
from tests.llm.brute import digest

TEXTS = [None, "", " ", "a b", "a  b", "a\t\nb", " a b", "a b ", "a\xa0b", "ä ß c", "x" * 50_000, "x " * 20_000, "x  " * 20_000]


def expected(given: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, text in given:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    rows = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        rows += [(i, ids[0], len(ids), k == 0, digest(text.encode())) for k, i in enumerate(ids)]
    return sorted(rows, key=repr)


def found(docs, *args, **options) -> list[tuple]:
    return sorted(map(tuple, exact.exact_duplicates(docs, *args, **options).collect()), key=repr)


def drawn(spark, n: int, seed: int):
    rng = random.Random(seed)
    given = [(rng.choice([None, *range(n)]), rng.choice(TEXTS + ["hot"] * 8 + [f"t{rng.randrange(n)}"] * 8)) for _ in range(n)]
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in given]
    return given, spark.createDataFrame(rows, "doc_id long, text string, digest int, row int, old int, shard int, size int").repartition(5)


@pytest.mark.parametrize("shard_digests", [7, 1000])
def test_any_history_gives_the_same(spark, shard_digests):
    """Repeated and null ids, ties, a hot text, long and odd texts, clashing columns."""
    given, docs = drawn(spark, 400, 1)
    want = expected(given)
    for history in (False, True, F.col("doc_id") % 2 == 0, F.length("text") > 2, exact.earlier_half(docs)):
        assert found(docs, history, shard_digests=shard_digests) == want


def test_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (None, "a")], "doc_id long, text string")
    assert found(docs, exact.earlier_half(docs)) == expected([(None, None), (None, ""), (None, "a")])
    assert found(docs.limit(0), exact.earlier_half(docs.limit(0))) == []


@pytest.mark.parametrize("n", [0, 1, 2, 300, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (n, 4), np.uint64)
    places = exact.PerfectHash.unpacked(*exact.PerfectHash.of(keys).packed())
    assert sorted(places(keys).tolist()) == list(range(n))
    others = places(keys ^ np.uint64(1))
    assert others.max(initial=-1) < n and others.min(initial=-1) >= -1
    assert sum(map(len, places.levels)) <= 8 * len(places.levels) + 5 * n


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        exact.PerfectHash.of(np.ones((2, 4), np.uint64))


def test_members_are_repeats_and_the_rest_become_slots(spark):
    """An index kept over two arrivals; a digest that shares a slot but not its bytes is not a hit."""
    rows = lambda *texts: spark.createDataFrame([(k, 10 * k, digest(t.encode())) for k, t in enumerate(texts)], "row long, doc_id long, h string").withColumn("digest", F.unhex("h"))
    index = exact.build_index(exact.grouped(rows("a", "b", "b", "c")), 2)
    index = exact.absorb(index, exact.grouped(rows("d", "b", "e", "e")))
    index = exact.absorb(index, exact.grouped(rows("z", "d")))
    got = {bytes(r["digest"]).hex(): (r["doc_id"], r["size"]) for r in index.groups().collect()}
    assert got == {digest(t.encode()): v for t, v in {"a": (0, 1), "b": (10, 3), "c": (30, 1), "d": (0, 2), "e": (20, 2), "z": (0, 1)}.items()}
    assert index.groups(2).count() == 3


def test_a_hot_group_never_meets_in_one_task(spark):
    """Groups over a share of the rows are joined by broadcast, so their rows do not move by digest."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    result = exact.exact_duplicates(docs, F.col("doc_id") < 500)
    spread = result.filter("group_size > 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1 and result.filter("kept").count() == 2000 - 667 + 1
