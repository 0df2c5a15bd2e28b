import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import collisions


def brute(rows: list[tuple], asks: set, k: int) -> list[tuple]:
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q in asks:
            scored = sorted({(-float(v @ w / np.sqrt((v @ v) * (w @ w))), i) for i, w in good if i != q})
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_recall_and_scores_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asks = F.col("vec_id") % 50 == 0
    got = collisions.search(vectors, asks, 5, block_rows=700, query_rows=15)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got.collect()}
    assert len(found) == len(want)
    hits = [(q, i) for q, _, i, _ in want if (q, i) in found]
    assert len(hits) >= 0.95 * len(want)
    assert all(abs(found[q, i] - s) < 1e-12 for q, _, i, s in want if (q, i) in found)
    truth = collisions.exact(vectors, asks, 5)
    assert collisions.recall(got, truth) == len(hits) / len(want)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in truth.collect()) == sorted(w[:3] for w in want)


def test_windows_leave_rows_out():
    """On close groups a query verifies little of its block."""
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(60, 64))
    vectors = np.repeat(heads, 20, axis=0) + 0.1 * rng.normal(size=(1200, 64))
    directions = rng.normal(size=(64, collisions.PROJECTIONS))
    arrays = collisions.Arrays(vectors, directions)
    ends = arrays.windows(arrays.vectors[:20] @ directions, collisions.WIDTH)
    for q in range(20):
        rows, _ = arrays.near(arrays.vectors[q], ends[q], 5, collisions.needed(), q)
        assert 5 <= len(rows) < 100 and q not in rows


def test_ties_nulls_few_candidates_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0]), (50, [0.0, -3.0]), (100, None), (150, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, block int")
    got = [tuple(r) for r in collisions.search(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 9), (50, 1, 0), (50, 2, 2), (50, 3, 3)]
    assert [g[3] for g in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert len(collisions.search(df, F.col("vec_id") % 50 == 0, 9).collect()) == 8
    assert collisions.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert collisions.search(df, F.lit(False)).count() == 0


def test_vectors_of_other_lengths_are_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [1.0]), (50, [2.0])] + [(i, rng.normal(size=8).tolist()) for i in range(1, 200) if i != 50] + [(300 + i, rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in collisions.search(df, F.col("vec_id") % 50 == 0, 5, miss=0.0, projections=1).collect())
    want = []
    for size in (1, 3, 8):
        own = [(i, v) for i, v in rows if len(v) == size]
        want += [w[:3] for w in brute(own, {i for i, _ in own if i % 50 == 0}, 5)]
    assert got == sorted(want) and (0, 1, 50) in got and len(got) > 15
