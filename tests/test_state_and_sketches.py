import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import sketches as sk
from tagweave.functions.session import scratch_path
from tagweave.operators import corpus as co
from tagweave.operators import features as fe
from tagweave.operators import state as st
from tagweave.spec import RoleSpec

ROLES = RoleSpec("text", ("mode",), ("amount", "flat"), "category", "id")


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, mode string, amount double, flat double, category string")


def drawn(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, "t", f"m{rng.integers(9) + seed}", None if i % 11 == 0 else 1e9 + float(rng.normal()), 5.0, f"c{rng.integers(4) + seed}") for i in range(n)]


def test_merged_state_is_the_state_of_all_rows_and_ids_stay(spark, tmp_path):
    one, two, three = (batch(spark, drawn(seed, 60)) for seed in (3, 5, 1))
    first = st.fit_state(one, ROLES, {"mode": ["UPI"]})
    merged = st.merge_states(st.merge_states(first, st.fit_state(two, ROLES, {"mode": ["UPI"]})), st.fit_state(three, ROLES, {"mode": ["UPI"]}))
    whole = fe.fit(one.unionByName(two).unionByName(three), ROLES, {"mode": ["UPI"]})
    made = merged.artifacts()
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(made.vocab, "col", "value") == rows(whole.vocab, "col", "value")
    assert rows(made.counts, "category", "n") == rows(whole.counts, "category", "n")
    assert rows(made.labels, "category") == rows(whole.labels, "category")
    for name, table in (("id", made.vocab), ("label_id", made.labels)):
        assert sorted(r[0] for r in table.select(name).collect()) == list(range(table.count()))
    assert set(rows(first.vocab, "col", "value", "id")) <= set(rows(made.vocab, "col", "value", "id"))
    assert set(rows(first.labels, "label_id", "category")) <= set(rows(made.labels, "label_id", "category"))
    want = {r["col"]: (r["mean"], r["std"]) for r in whole.scaler.collect()}
    for r in made.scaler.collect():  # values around 1e9 lose nothing
        assert (r["mean"], r["std"]) == pytest.approx(want[r["col"]], rel=1e-6)
    folder = scratch_path(spark)
    st.save_state(merged, folder)
    again = st.load_state(spark, folder, ROLES)
    assert rows(again.vocab, "col", "value", "id") == rows(made.vocab, "col", "value", "id")
    assert fe.transform(two, made).filter(F.col("embedding").isNull() | F.col("label_id").isNull()).count() == 0


def test_an_empty_batch_changes_nothing(spark):
    rows = batch(spark, drawn(2, 20))
    state, empty = st.fit_state(rows, ROLES, {}), st.fit_state(rows.limit(0), ROLES, {})
    for merged in (st.merge_states(state, empty), st.merge_states(empty, state)):
        assert {r["category"]: r["n"] for r in merged.counts.collect()} == {r["category"]: r["n"] for r in state.counts.collect()}
        assert sorted(r["value"] for r in merged.vocab.collect()) == sorted(r["value"] for r in state.vocab.collect())
        assert {r["col"]: pytest.approx(r["mean"]) for r in merged.moments.collect()} == {r["col"]: r["mean"] for r in state.moments.collect()}
    with pytest.raises(ValueError):
        st.merge_states(state, st.fit_state(rows, RoleSpec("text", ("mode",), ("amount",), "category", "id"), {}))


def test_prototypes_of_merged_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, rng.normal(size=5).tolist()) for i in range(50)] + [(50, 7, [1.0] * 5), (51, 7, None)]
    golden = spark.createDataFrame(rows, "golden_id long, label_id int, embedding array<double>")
    parts = st.class_sums(golden.filter("golden_id < 20")).unionByName(st.class_sums(golden.filter("golden_id >= 20")))
    merged = st.merged_sums(parts)
    assert {r["label_id"]: r["n"] for r in merged.collect()} == {0: 17, 1: 17, 2: 16, 7: 1}
    want = {r["label_id"]: r["proto"] for r in co.class_prototypes(golden).collect()}
    for r in st.prototypes_of(merged).collect():
        assert r["proto"] == pytest.approx(want[r["label_id"]])


def test_sketches_keep_their_rank_error_however_they_are_cut(spark):
    values = np.random.default_rng(3).permutation(np.concatenate([np.full(5000, 2.5), np.random.default_rng(4).gamma(2.0, size=15_000)]))
    rows = [(float(v), k % 5, "ab"[k % 2]) for k, v in enumerate(values)] + [(None, 0, "a"), (float("nan"), 1, "b"), (None, 0, "none")]
    df = spark.createDataFrame(rows, "v double, part int, g string").repartition(6)
    whole, merged = sk.sketched(df, "v", ["g"]), sk.merged_sketches(sk.sketched(df, "v", ["g", "part"]), ["g"])
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    for sketches in (whole, merged):
        assert {r["g"]: r["n"] for r in sketches.collect()} == {"a": 10_000, "b": 10_000}
        for r in sk.sketch_percentiles(sketches, shares, ["g"]).collect():
            own = np.array([v for v, _, g in rows if g == r["g"] and v is not None and v == v])
            low, high, allowed = (own < r["value"]).mean(), (own <= r["value"]).mean(), 2 * sk.rank_error()
            assert low - allowed <= shares[r["pos"]] <= high + allowed
        assert max(len(r["sketch"]) for r in sketches.collect()) < 20_000
    assert sk.sketched(df.limit(0), "v").count() == 0


def test_threshold_from_a_sketch(spark):
    distances = spark.range(20_000).select((F.col("id") / 20_000).alias("d2"))
    exact, near = (co.ood_threshold_percentile(distances, 95.0, size).first()["threshold"] for size in (None, 200))
    assert abs(exact - near) <= 2 * sk.rank_error(200)
