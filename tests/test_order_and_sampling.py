import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions.hashing import seeded
from tagweave.functions.order import percentiles, value_counts, with_hash_rank, with_rows_before
from tagweave.operators import sampling as sa


@pytest.mark.parametrize("one_task_rows", [0, 10_000])
def test_percentiles_equal_numpy_with_a_hot_value(spark, one_task_rows):
    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(size=300), np.full(150, 0.25)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    wanted = [0.0, 0.1, 0.5, 0.77, 0.95, 1.0]
    rows = percentiles(value_counts(df, "x"), wanted, slices=16, one_task_rows=one_task_rows).orderBy("pos").collect()
    assert [r.value for r in rows] == pytest.approx(list(np.quantile(values, wanted)))


def test_rows_before_of_strings_in_slices(spark):
    df = spark.createDataFrame([(f"v{i:03d}", 1 + i % 3) for i in range(100)], "value string, n bigint")
    rows = with_rows_before(df, slices=8, one_task_rows=0).orderBy("value").collect()
    assert [r.before for r in rows] == list(np.cumsum([0] + [1 + i % 3 for i in range(99)]))
    assert {r.total for r in rows} == {sum(1 + i % 3 for i in range(100))}


def test_hash_rank_is_the_rank_in_seeded_order(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("g"))
    rows = with_hash_rank(df.withColumn("key", seeded(7, F.col("id"))), ["g"], "id", 7, buckets=16).collect()
    for g in ("hot", "rest"):
        group = sorted((r.key, r.pos, r.group_n) for r in rows if r.g == g)
        assert [pos for _, pos, _ in group] == list(range(len(group))) and {n for *_, n in group} == {len(group)}


def test_large_sample_equals_the_sorted_one(spark, monkeypatch):
    df = spark.range(5000)
    plain = {r.id for r in sa.sample_n(df, 700, 1, "id").collect()}
    monkeypatch.setattr(sa, "SORTED_SAMPLE", 10)
    assert {r.id for r in sa.sample_n(df, 700, 1, "id").collect()} == plain and len(plain) == 700
    assert sa.sample_n(df, 9000, 1, "id").count() == 5000


def labelled(spark, sizes):
    rows = [(f"{c}{i}", ord(c) - 97, [float(i), float(ord(c))]) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "golden_id string, label_id int, embedding array<double>")


def test_split_sizes_per_class(spark):
    rows = sa.stratified_split(labelled(spark, {"a": 100, "b": 7, "c": 1}), "label_id", "golden_id").collect()
    held = {k: sum(r.split == "validation" for r in rows if r.label_id == k) for k in (0, 1, 2)}
    assert len(rows) == 108 and held == {0: 15, 1: 1, 2: 0}


@pytest.mark.parametrize("stretch", [10_000, 4])
def test_balanced_batches_repeat_small_classes(spark, monkeypatch, stretch):
    monkeypatch.setattr(sa, "REPEATS_AT_ONCE", stretch)
    rows = sa.balanced_batches(labelled(spark, {"a": 40, "b": 7, "c": 1}), "label_id", "golden_id", 12).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert len(batches) == 10
    for batch in batches.values():
        assert sorted(r.seat for r in batch) == list(range(1, 13))
        assert [sum(r.label_id == k for r in batch) for k in (0, 1, 2)] == [4, 4, 4]
    uses = {}
    for r in rows:
        uses[r.golden_id] = uses.get(r.golden_id, 0) + 1
    assert uses["c0"] == 40 and {uses[f"b{i}"] for i in range(7)} <= {5, 6} and {uses[f"a{i}"] for i in range(40)} == {1}


def test_batches_never_exceed_their_size(spark):
    many = labelled(spark, {chr(97 + i): 3 for i in range(10)})
    sizes = sa.balanced_batches(many, "label_id", "golden_id", 8).groupBy("batch_id").count().collect()
    assert all(r["count"] == 8 for r in sizes)


def test_triplets_need_a_positive_and_a_negative(spark):
    lone = labelled(spark, {"a": 1, "b": 1}).withColumn("batch_id", F.lit(0).cast("bigint"))
    lone = lone.withColumn("seat", F.col("label_id") + 1)
    assert sa.mine_triplets(lone).count() == 0


def test_contrastive_loss_is_the_same_strip_by_strip(spark, monkeypatch):
    """A batch of any size is allowed: strips of two rows give what the whole square gives."""
    from tagweave.operators import metrics

    rng = np.random.default_rng(1)
    rows = [(i // 11, i % 11, i % 3, rng.normal(size=5).tolist()) for i in range(33)]
    df = spark.createDataFrame(rows, "batch_id bigint, seat int, label_id int, embedding array<double>")
    whole = sorted(tuple(r) for r in metrics.supcon_loss(df).collect())
    monkeypatch.setattr(metrics, "strips", lambda n, width: [slice(i, i + 2) for i in range(0, n, 2)])
    for a, b in zip(whole, sorted(tuple(r) for r in metrics.supcon_loss(df).collect())):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-12)


def test_cut_without_a_shuffle_keeps_what_ranking_keeps(spark):
    from tagweave.functions.order import below_cut, with_hash_rank

    df = labelled(spark, {"a": 50, "b": 7, "c": 1})
    for share in (0.0, 0.15, 0.5, 1.0):
        ranked = with_hash_rank(df, ["label_id"], "golden_id", 3, "pos")
        want = {r.golden_id for r in ranked.filter(F.col("pos") < F.round(F.lit(share) * F.col("group_n"))).collect()}
        for buckets in (1, 4, 4096):
            cut = below_cut(df, ["label_id"], "golden_id", 3, lambda n: F.round(F.lit(share) * n), buckets)
            assert {r.golden_id for r in cut.filter("_below").collect()} == want


def test_split_moves_no_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sa.stratified_split(df, "lang", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "text" in plan


def test_random_triplets_are_valid(spark):
    df = labelled(spark, {"a": 9, "b": 2, "c": 1})
    rows = sa.random_triplets(df, "label_id", "golden_id", 200).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.anchor_id[0] == r.positive_id[0] != r.negative_id[0] and r.anchor_id != r.positive_id
        assert r.anchor_id[0] != "c"
