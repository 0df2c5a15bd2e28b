from itertools import product
from math import erfc, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage
from tagweave.operators import ball_metrics as bm
from tagweave.operators import balls, metrics
from tagweave.operators.blocks import ScanLimits
from tagweave.operators.neighbours import fit_index, index_join, knn_join, likeliest_cells
from tests.test_neighbours import as_queries, brute, corpus, found



def same(got: dict, want: dict) -> bool:
    """Equal neighbours at equal distances, these up to rounding."""
    return got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


SMALL = ScanLimits(broadcast_bytes=0, block_rows=7, chunk_rows=5)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    clusters = np.repeat(rng.normal(size=(6, 5)) * 5, 15, axis=0) + rng.normal(size=(90, 5)) * 0.3
    clusters[20:50] = clusters[20]  # a third of the rows are copies of one
    return clusters


@pytest.fixture(scope="module")
def golden(spark, points):
    return cut_lineage(corpus(spark, [(i, i % 3, p.tolist()) for i, p in enumerate(points)]))


@pytest.mark.parametrize(("leaf_rows", "limits"), [(4, ScanLimits()), (1000, ScanLimits()), (6, SMALL)])
def test_a_proved_answer_is_exact(golden, points, leaf_rows, limits):
    index = balls.fit_balls(golden, n_cells=5, leaf_rows=leaf_rows, limits=limits)
    assert index.counts.sum() == len(points)
    assert same(found(balls.bounded_join(as_queries(golden), index, 4, exclude_self=True, limits=limits)), brute(points, 4))
    assert same(found(balls.bounded_join(as_queries(golden), index, 120, limits=limits)), brute(points, 120, False))


def test_balls_hold_their_rows(golden):
    index = balls.fit_balls(golden, n_cells=4, leaf_rows=5, by_label=True)
    rows = index.rows.join(index.leaves.drop("cell"), ["leaf", "label_id"]).collect()
    assert len(rows) == 90 and index.leaves.agg(F.sum("n")).first()[0] == 90
    for r in rows:
        assert np.linalg.norm(np.array(r["embedding"]) - np.array(r["centre"])) <= r["radius"] + 1e-9
        assert np.linalg.norm(np.array(r["embedding"]) - index.centres[r["cell"]]) <= index.radii[r["cell"]] + 1e-9


def test_a_query_goes_once_to_a_block_however_many_leaves_it_asks(golden, points):
    index, limits = balls.fit_balls(golden, n_cells=4, leaf_rows=4), ScanLimits()
    leaves = index.leaves.agg(F.collect_list("leaf").alias("cells"))
    vectors = golden.select(F.col("golden_id").alias("row"), F.col("golden_id").alias("own_id"), "embedding")
    kernel = balls.LeafTopK(3, "l2", exclude_self=True)
    met = balls.meet_leaves(vectors.select("row").join(leaves, how="cross"), 90, vectors, index, balls.leaf_routes(index, limits), kernel, limits).collect()
    assert index.leaves.count() > 10 and len(met) == 90  # one value a query, not one a leaf
    assert same({(r["row"], k): (n["golden_id"], n["d2"]) for r in met for k, n in enumerate(r["value"], 1)}, brute(points, 3))


def test_rows_that_share_an_id_stay_rows_of_their_own(spark):
    rows = [(1, 0, [0.0, 1.0]), (1, 0, [0.0, 1.0]), (2, 1, [0.0, 2.0]), (3, 1, [5.0, 5.0])]
    g = corpus(spark, rows)
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, embedding array<double>")
    for leaf_rows in (1, 100):
        got = balls.bounded_nearest(asked, balls.fit_balls(g, 2, leaf_rows), 3).first()["neighbours"]
        assert [(n["golden_id"], n["d2"]) for n in got] == [(1, 0.0), (1, 0.0), (2, 1.0)]


def test_repeated_query_ids_are_answered_one_by_one(spark, golden, points):
    index = balls.fit_balls(golden, n_cells=4, leaf_rows=5)
    asked = spark.createDataFrame([(7, points[3].tolist(), "a"), (7, points[80].tolist(), "b")], "query_id long, embedding array<double>, note string")
    got = {r["note"]: [n["golden_id"] for n in r["neighbours"]] for r in balls.bounded_nearest(asked, index, 1).collect()}
    assert got == {"a": [3], "b": [80]}


def test_effort_bounds_the_search_and_says_if_the_proof_is_whole(golden):
    index = balls.fit_balls(golden, n_cells=3, leaf_rows=2)
    few = balls.bounded_nearest(as_queries(golden), index, 40, effort=1).collect()
    assert not any(r["proved"] for r in few) and max(r["rounds"] for r in few) == 1
    whole = balls.bounded_nearest(as_queries(golden), index, 40, effort=1000).collect()
    assert all(r["proved"] for r in whole) and max(r["rounds"] for r in whole) > 1
    assert all(a["compared"] <= b["compared"] for a, b in zip(few, whole))


def test_a_proof_on_vectors_without_structure_takes_one_more_round(spark):
    points = np.random.default_rng(7).normal(size=(400, 12))
    golden = cut_lineage(corpus(spark, [(i, 0, p.tolist()) for i, p in enumerate(points)]))
    index = balls.fit_balls(golden, n_cells=5, leaf_rows=8)
    asked = balls.bounded_nearest(as_queries(golden), index, 4, exclude_self=True, limits=ScanLimits(0, 60, 60)).collect()
    assert index.leaves.count() > 24 and max(r["rounds"] for r in asked) == 2 and min(r["compared"] for r in asked) > 0
    assert all(r["compared"] <= 400 for r in asked)  # no leaf is compared twice
    got = {(r["query_id"], n["rk"]): (n["golden_id"], n["d2"]) for r in asked for n in r["neighbours"]}
    assert same(got, brute(points, 4))


def test_an_empty_corpus_and_no_queries(spark, golden):
    index = balls.fit_balls(golden.limit(0))
    got = balls.bounded_nearest(as_queries(golden), index, 3).collect()
    assert len(got) == 90 and all(r["neighbours"] == [] and r["proved"] for r in got)
    assert balls.bounded_nearest(as_queries(golden).limit(0), balls.fit_balls(golden, 3, 5), 3).count() == 0


def test_string_ids(spark):
    g = corpus(spark, [("b", 1, [0.0, 1.0]), ("a", 0, [0.0, 1.0]), ("c", 1, [1.0, 0.0])], "string")
    rows = found(balls.bounded_join(as_queries(g), balls.fit_balls(g, 2, 1), 10, exclude_self=True))
    assert rows["a", 1] == ("b", 0.0) and rows["c", 1][0] == "a" and rows["c", 2][0] == "b" and len(rows) == 6


def test_ranks_by_whole_balls_equal_the_full_ranking(spark, golden):
    lonely = golden.unionByName(corpus(spark, [(500, 77, [1.0] * 5)]))  # no other row of its label
    index = balls.fit_balls(lonely, n_cells=4, leaf_rows=3, by_label=True)
    got = bm.first_match_rank_bounded(lonely, index).collect()
    want = {r["query_id"]: r["first_rank"] for r in metrics.first_match_rank(lonely).collect()}
    assert {r["query_id"]: r["first_rank"] for r in got} == want and want[500] is None
    assert bm.mrr_bounded(lonely, index).first()[0] == pytest.approx(metrics.mrr(lonely).first()[0])
    with pytest.raises(ValueError):
        bm.first_match_rank_bounded(lonely, balls.fit_balls(lonely, 4, 3))


def test_a_count_sends_no_list_of_leaves(golden, points, monkeypatch):
    index = balls.fit_balls(golden, n_cells=4, leaf_rows=3, by_label=True)
    aims = golden.select(F.col("golden_id").alias("row"), F.col("golden_id").alias("query_id"), "embedding", F.lit(0.9).alias("at_d2"), F.lit(0).cast("long").alias("at_id"))
    sent = []
    send = balls.routed
    monkeypatch.setattr(balls, "routed", lambda queries, *rest: sent.append(queries) or send(queries, *rest))
    counted = {r["row"]: (r["before"], r["opened"]) for r in bm.count_before(aims, index).collect()}
    assert sum(len(r["cells"]) for q in sent for r in q.select("cells").collect()) == 0
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    assert {i: n for i, (n, _) in counted.items()} == {i: int((row < 0.9).sum()) for i, row in enumerate(d2)}
    assert 0 < sum(o for _, o in counted.values()) < 90 * 90  # balls wholly inside or outside are not opened


def test_few_pairs_are_opened_on_vectors_in_groups(spark):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(20, 8)) * 10
    rows = [(i, int(rng.integers(4)), (heads[i % 20] + rng.normal(size=8) * 0.2).tolist()) for i in range(600)]
    golden = cut_lineage(corpus(spark, rows))
    index = balls.fit_balls(golden, n_cells=20, leaf_rows=8, by_label=True)
    ranked = bm.first_match_rank_bounded(golden, index).collect()
    assert sum(r["compared"] for r in ranked) < 0.25 * 600 * 600
    assert {r["query_id"]: r["first_rank"] for r in ranked} == {r["query_id"]: r["first_rank"] for r in metrics.first_match_rank(golden).collect()}


# --- probing with a stated recall ---------------------------------------------------


def test_likeliest_cells_come_in_falling_chance_until_the_miss_is_small():
    rng = np.random.default_rng(2)
    for bits in (1, 4, 6):
        values, spread = rng.normal(size=(3, bits)), np.abs(rng.normal(size=(3, bits))) + 0.1
        turned = 0.5 * np.vectorize(erfc)(np.abs(values) / spread / sqrt(2))
        chance = {}
        for t in range(3):
            for flips in product((0, 1), repeat=bits):
                code = sum((int(v >= 0) ^ f) << b for b, (v, f) in enumerate(zip(values[t], flips)))
                chance[code + (t << 32)] = np.prod(np.where(flips, turned[t], 1 - turned[t]))
        every = likeliest_cells(values, spread, -1.0)
        assert sorted(every) == sorted(chance)
        assert (np.diff([chance[c] for c in every]) < 1e-12).all()
        some = likeliest_cells(values, spread, 0.2)
        assert some == every[: len(some)]
        miss = lambda cells: np.prod([1 - sum(chance[c] for c in cells if c >> 32 == t) for t in range(3)])
        assert miss(some) <= 0.2 + 1e-9 and (len(some) == 1 or miss(some[:-1]) > 0.2 - 1e-9)


@pytest.mark.parametrize("kind", ["ivf", "lsh"])
@pytest.mark.parametrize("tight", [0.1, 1.0])
def test_default_effort_finds_its_recall(spark, kind, tight):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 16))
    rows = [(i, 0, (heads[i % 12] + tight * rng.normal(size=16)).tolist()) for i in range(900)]
    golden = cut_lineage(corpus(spark, rows))
    index = fit_index(golden, kind)
    exact = knn_join(as_queries(golden), golden, 10, exclude_self=True)
    near = index_join(as_queries(golden), index, 10, exclude_self=True).select("query_id", F.explode("neighbours.golden_id").alias("golden_id"))
    assert exact.join(near, ["query_id", "golden_id"]).count() >= 0.9 * exact.count()
    met = index.asked(as_queries(golden)).join(index.cells.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    if tight == 0.1 and kind == "ivf":
        assert met < 0.5 * 900 * 900


def test_a_kept_index_keeps_its_options(golden, spark):
    from tagweave.plans.tagging import Corpus, predict

    names = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "label_id int, category string")
    kept = Corpus(golden, golden.groupBy("label_id").agg(F.first("embedding").alias("proto")), names)
    asked = as_queries(golden)
    want = {r["query_id"]: r["predicted_category"] for r in predict(asked, kept, 5, exclude_self=True).collect()}
    options = {"n_cells": 4, "leaf_rows": 5}
    got = predict(asked, kept, 5, exclude_self=True, index="ball", index_options=options)
    assert {r["query_id"]: r["predicted_category"] for r in got.collect()} == want
    assert kept.index("ball") is kept.index("ball", **options)
    with pytest.raises(ValueError, match="kept"):
        predict(asked, kept, 5, index="ball", index_options={"n_cells": 9})
