import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagweave.functions.session import cut_lineage
from tagweave.operators import corpus as co
from tagweave.operators import scoring as sc
from tagweave.operators.blocks import ScanLimits
from tagweave.plans.tagging import BuildSpec, build_corpus, predict

NEAR = "query_id bigint, neighbours array<struct<rk:int,golden_id:bigint,label_id:int,d2:double>>"


def near(spark, *lists):
    rows = [(i, [(r, 100 + r, label, d2) for r, (label, d2) in enumerate(ns, 1)]) for i, ns in enumerate(lists)]
    return spark.createDataFrame(rows, NEAR)


def test_vote_at_distance_zero_and_in_a_tie(spark):
    rows = sc.distance_vote(near(spark, [(4, 0.0), (2, 1.0)], [(3, 0.5), (1, 0.5)])).collect()
    share = {(r.query_id, r.label_id): r.share for r in rows}
    assert share[0, 4] == pytest.approx(1e6 / (1e6 + 1 / (1 + 1e-6)))
    assert share[1, 1] == share[1, 3] == 0.5


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.floats(0, 4)), min_size=1, max_size=12), min_size=1, max_size=5))
def test_vote_shares_sum_to_one(spark, lists):
    sums = sc.distance_vote(near(spark, *lists)).groupBy("query_id").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == len(lists) and all(r.s == pytest.approx(1.0) for r in sums)


def blended(spark, vote, protos, alpha=0.6):
    df = spark.createDataFrame(
        [(1, vote, protos)],
        "query_id bigint, vote array<struct<label_id:int,share:double>>, proto_scores array<struct<label_id:int,sim:double>>",
    )
    return sc.with_blend(df, alpha).first()


def test_blend_counts_labels_of_one_side_and_breaks_ties_low(spark):
    row = blended(spark, [(7, 0.5), (2, 0.5)], [(2, 0.1), (5, 0.9), (7, 0.1)])
    scores = {b.label_id: b.score for b in row.blend}
    assert scores[2] == scores[7] == pytest.approx(0.3) and scores[5] == pytest.approx(0.4)
    assert row.predicted_label_id == 5 and row.confidence == pytest.approx(0.4)
    tie = blended(spark, [(7, 0.5), (2, 0.5)], [(2, 0.3), (7, 0.3)])
    assert tie.predicted_label_id == 2


def test_single_class_and_no_neighbours(spark):
    assert blended(spark, [(3, 1.0)], [(3, 0.4)]).confidence == pytest.approx(1.0)
    row = blended(spark, [], [(0, 0.2), (1, 0.4)])
    assert row.predicted_label_id == 1 and row.confidence == pytest.approx(1.0)


def test_no_threshold_flags_nothing_and_routing_rules(spark):
    df = near(spark, [(1, 5.0)])
    assert sc.with_ood(df, None).first().is_ood is False
    assert sc.with_ood(df, 4.9).first().is_ood is True
    assert sc.with_ood(df, 5.0).first().is_ood is False
    rows = spark.createDataFrame(
        [(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.75)], "is_ood boolean, confidence double"
    ).withColumn("predicted_category", F.lit("Rent"))
    out = [(r.predicted_category, r.confidence, r.needs_llm) for r in sc.with_routing(rows).collect()]
    assert out == [("Rent", 0.9, True), ("other", 0.0, True), ("Rent", 0.5, True), ("Rent", 0.75, False)]


def vectors(spark, n=60, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        [(i, i % labels, rng.normal(size=4).tolist()) for i in range(n)],
        "golden_id bigint, label_id int, embedding array<double>",
    )


def test_farthest_point_keeps_the_cap_over_several_rounds(spark):
    g = vectors(spark, 200, labels=1)
    kept = co.stratify(g, 5, leaves=16, fan_in=4).collect()
    assert len(kept) == 5 and len({r.golden_id for r in kept}) == 5
    copies = g.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    assert co.stratify(copies, 5, leaves=16, fan_in=4).count() == 5


@pytest.mark.parametrize("k", [3, 40, 90, 199, 300])
def test_farthest_point_ends_for_any_cap(spark, k):
    """Also where a node has fewer rows than the cap, or half as many again."""
    g = vectors(spark, 200, labels=1)
    assert co.farthest_point(g, k, leaves=5, fan_in=2).count() == min(k, 200)


def test_small_classes_pass_the_cap_whole(spark):
    g = vectors(spark, 10, labels=3)
    assert co.stratify(g, 4).count() == 10 == co.stratify(g, 4, "hash").count()


def test_large_hash_cap_keeps_the_same_rows(spark, monkeypatch):
    g = vectors(spark, 90, labels=2)
    plain = {r.golden_id for r in co.stratify(g, 20, "hash").collect()}
    monkeypatch.setattr(co, "GROUP_LIMIT", 10)
    assert {r.golden_id for r in co.stratify(g, 20, "hash").collect()} == plain and len(plain) == 40


def test_threshold_without_ood_rows_is_the_percentile(spark):
    g = vectors(spark)
    d = [r.d2 for r in co.nn_distance(g).collect()]
    assert co.calibrate_ood(g) == pytest.approx(np.percentile(d, 95))
    empty = g.filter("golden_id < 0").withColumnRenamed("golden_id", "query_id")
    assert co.calibrate_ood(g, empty) == pytest.approx(np.percentile(d, 95))


def brute_sweep(inside, outside):
    every, marks = np.r_[inside, outside], np.r_[np.zeros(len(inside)), np.ones(len(outside))]
    best, at = 0.0, float(np.median(every))
    for limit in np.percentile(every, np.arange(10, 96, 2)):
        flagged = every > limit
        tp, fp, fn = (flagged & (marks == 1)).sum(), (flagged & (marks == 0)).sum(), (~flagged & (marks == 1)).sum()
        if tp + fp and tp + fn:
            p, r = tp / (tp + fp), tp / (tp + fn)
            f1 = 2 * p * r / (p + r + 1e-9)
            if f1 > best:
                best, at = f1, float(limit)
    return at, best


@pytest.mark.parametrize("case", ["mixed", "ties", "inverted"])
def test_sweep_equals_brute_force(spark, case):
    rng = np.random.default_rng(1)
    inside, outside = rng.gamma(2, 1, 80), rng.gamma(4, 1, 30)
    if case == "ties":
        inside, outside = np.round(inside), np.round(outside)
    if case == "inverted":
        inside, outside = np.full(80, 5.0), np.full(30, 1.0)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "d2 double")
    row = co.ood_threshold_f1(frame(inside), frame(outside)).first()
    at, best = brute_sweep(inside, outside)
    assert row.threshold == pytest.approx(at) and row.f1 == pytest.approx(best)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder of embeddings with more golden rows than a fit was once cut to, and the nearest distances of golden and of other rows."""
    folder = str(tmp_path_factory.mktemp("many"))
    at = np.random.default_rng(3).gamma(1.5, 1.0, 5_700).cumsum()
    ood = np.random.default_rng(4).uniform(0.0, at[-1], 300)
    rows = [(i, 9 if i >= len(at) else i % 9, [float(x)]) for i, x in enumerate(np.r_[at, ood])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    gap = np.diff(at) ** 2
    inside = np.minimum(np.r_[np.inf, gap], np.r_[gap, np.inf])
    return folder, inside, (np.abs(ood[:, None] - at[None, :]).min(axis=1)) ** 2


def test_a_swept_threshold_counts_all_golden_rows(spark, many):
    folder, inside, outside = many
    row = entry.queries()["ood_threshold_f1"](spark, folder).first()
    at, best = brute_sweep(inside, outside)
    assert row.threshold == pytest.approx(at, abs=1e-6) and row.f1 == pytest.approx(best, abs=1e-6)


def test_a_calibrated_threshold_counts_all_golden_rows(spark, many):
    folder, inside, outside = many
    got = {r.method: r.threshold for r in entry.queries()["calibrate_ood"](spark, folder).collect()}
    assert got["known ood"] == pytest.approx(brute_sweep(inside, outside)[0], abs=1e-6)
    assert got["percentile"] == pytest.approx(np.percentile(inside, 95), abs=1e-6)


def test_predict_is_the_same_through_blocks_and_ignores_row_order(spark):
    g = vectors(spark, 90)
    labels = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "label_id int, category string")
    q = g.selectExpr("golden_id as query_id", "embedding")
    spec = BuildSpec(max_per_class=20)
    small = build_corpus(g, labels, spec=spec)
    large = build_corpus(g.repartition(7), labels, spec=spec, limits=ScanLimits(0, 16, 16))
    pick = lambda c: sorted(
        (r.query_id, r.predicted_category, round(r.confidence, 9), r.is_ood, r.needs_llm)
        for r in predict(q, c, 5, exclude_self=True).collect()
    )
    assert small.ood_threshold == pytest.approx(large.ood_threshold)
    assert pick(small) == pick(large)


def test_records_of_neighbours_are_not_shuffled(spark):
    rows = [(1, "a", [(1, 10, 0, 0.1), (2, 11, 1, 0.2)]), (2, "b", [(1, 11, 1, 0.3)]), (2, "c", [(1, 12, 0, 0.4)]), (3, "d", []), (4, "e", [(1, 99, 0, 0.5)]), (None, "f", [(1, 10, 0, 0.6)])]
    kind = "query_id long, own string, neighbours array<struct<rk: int, golden_id: long, label_id: int, d2: double>>"
    scored = cut_lineage(spark.createDataFrame(rows, kind))
    golden = spark.createDataFrame([(10, "ten"), (11, "eleven"), (11, "again"), (12, None), (None, "none")], "golden_id long, text string")
    found = sc.with_similar(scored, golden, {"description": "text", "date": "there_is_none"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    lists = {r["own"]: r["similar"] and [(s["rk"], s["golden_id"], s["record"]["description"], s["record"]["date"]) for s in r["similar"]] for r in found.collect()}
    twice = [(1, 11, "again", None), (1, 11, "eleven", None), (1, 12, None, None)]  # rows of one id share their neighbours
    assert lists == {"a": [(1, 10, "ten", None), (2, 11, "again", None), (2, 11, "eleven", None)], "b": twice, "c": twice, "d": None, "e": None, "f": None}
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert found.columns == ["query_id", "own", "neighbours", "similar"]
