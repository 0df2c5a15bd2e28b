import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import metrics as me
from tagweave.operators.blocks import ScanLimits


def graded(spark, rows):
    return spark.createDataFrame(rows, "confidence double, correct int")


def test_ece_bins_include_their_upper_edge(spark):
    rows = [(0.0, 0), (0.1 * 3, 1), (0.1 * 6, 1), (0.1 * 7, 0), (1.0, 1), (0.25, 0)]
    edges = np.linspace(0, 1, 11)
    confidence, correct = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    expected = 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = (confidence > lo) & (confidence <= hi)
        if inside.any():
            expected += inside.sum() / len(rows) * abs(confidence[inside].mean() - correct[inside].mean())
    assert me.ece(graded(spark, rows)).first().ece == pytest.approx(expected)


def test_auroc_with_ties_and_an_empty_side(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "d2 double")
    inside, outside = [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0]
    pairs = [(o > i) + 0.5 * (o == i) for o in outside for i in inside]
    assert me.ood_auroc(frame(*inside), frame(*outside)).first().auroc == pytest.approx(np.mean(pairs))
    assert math.isnan(me.ood_auroc(frame(1.0), frame(1.0).limit(0)).first().auroc)


def test_report_of_labels_never_predicted_or_never_true(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (1, 3)]
    df = spark.createDataFrame(pairs, "true_label int, pred_label int")
    rows = {r.label: r for r in me.class_report(df).collect()}
    assert rows[0].precision == 1.0 and rows[0].recall == 0.5 and rows[0].f1 == pytest.approx(2 / 3)
    assert rows[1].precision == pytest.approx(1 / 3) and rows[1].recall == 0.5 and rows[1].support == 2
    assert rows[2].f1 == 0.0 and rows[2].precision == 0.0 and rows[3].recall == 0.0 and rows[3].support == 0
    f1 = me.f1_scores(df).first()
    assert f1.macro_f1 == pytest.approx(np.mean([rows[i].f1 for i in range(4)]))
    assert [r.label for r in me.class_report(df, 2).collect()] == [2, 3]


def points(spark, n=50, copies=True):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(n, 3)), 1)
    if copies:
        x[: n // 3] = x[0]
    labels = np.arange(n) % 4
    labels[-1] = 9  # no partner
    rows = [(i, int(labels[i]), x[i].tolist()) for i in range(n)]
    return x, labels, spark.createDataFrame(rows, "golden_id bigint, label_id int, embedding array<double>")


@pytest.mark.parametrize("limits", [ScanLimits(), ScanLimits(0, 9, 11)])
def test_full_ranking_metrics_equal_a_full_sort(spark, limits):
    x, labels, df = points(spark)
    d2 = np.zeros((len(x), len(x)))
    for d in range(x.shape[1]):
        d2 += (x[:, None, d] - x[None, :, d]) ** 2
    ranks, recall = [], {1: [], 5: []}
    for i in range(len(x)):
        order = [j for j in sorted(range(len(x)), key=lambda j: (d2[i, j], j)) if j != i]
        same = [labels[j] == labels[i] for j in order]
        ranks.append(same.index(True) + 1 if True in same else None)
        for k in recall:
            recall[k].append(any(same[:k]))
    got = {r.query_id: r.first_rank for r in me.first_match_rank(df, limits=limits).collect()}
    assert [got[i] for i in range(len(x))] == ranks
    assert me.mrr(df, limits=limits).first().mrr == pytest.approx(np.mean([1 / r if r else 0 for r in ranks]))
    got = {r.k: r.recall for r in me.recall_at_k(df, (1, 5), limits=limits).collect()}
    assert got == {k: pytest.approx(np.mean(v)) for k, v in recall.items()}


@pytest.mark.parametrize("limits", [ScanLimits(), ScanLimits(0, 9, 11)])
def test_distance_profile(spark, limits):
    x, _, df = points(spark, copies=False)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for r in me.distance_profile(df, limits).collect():
        others = np.delete(dist[r.query_id], r.query_id)
        assert (r.n, r.least, r.greatest, r.mean) == (
            49, pytest.approx(others.min(), abs=1e-6), pytest.approx(others.max()), pytest.approx(others.mean())
        )


def test_supcon_without_a_positive_is_zero(spark):
    _, _, df = points(spark, 6)
    batch = df.withColumn("batch_id", F.lit(1).cast("bigint")).withColumn("seat", F.col("golden_id").cast("int"))
    alone = batch.withColumn("label_id", F.col("golden_id").cast("int"))
    row = me.supcon_loss(alone).first()
    assert row.loss == 0.0 and row.anchors == 0
    together = me.supcon_loss(batch.withColumn("label_id", F.lit(1)), temperature=1.0).first()
    assert together.anchors == 6 and together.loss > 0


def test_triplet_loss_averages_batches(spark):
    rows = [(1, 1.0, 1.2), (1, 1.0, 9.0), (2, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "batch_id bigint, d_ap double, d_an double")
    assert me.triplet_loss(df, 0.5).first().loss == pytest.approx((0.15 + 1.5) / 2)
    assert me.triplet_loss(df.limit(0)).first().loss == 0.0
