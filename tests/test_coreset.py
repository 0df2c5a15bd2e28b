import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import coreset
from tagweave.operators.corpus import spread_out, stratify
from tests.test_neighbours import corpus


def drawn(seed: int, n: int, d: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(5, d))[rng.integers(5, size=n)] * 6 + rng.normal(size=(n, d)) * 0.4
    points[n // 2 :] = points[n // 3]  # a hot vector
    return points[rng.permutation(n)]


def reached(points: np.ndarray, centres: np.ndarray) -> float:
    return float(np.sqrt(((points[:, None] - centres[None]) ** 2).sum(2)).min(1).max())


@pytest.mark.parametrize("k", [1, 3, 7, 40])
def test_radius_is_certified_from_both_sides(k):
    for seed in range(20):
        points = drawn(seed, 200)
        state = coreset.Cover(k)
        for at in range(0, 200, 37):
            state.add(list(range(at, min(200, at + 37))), points[at : at + 37], np.zeros(len(points[at : at + 37])), block=11)
        assert len(state.ids) <= k and len(set(state.ids)) == len(state.ids)
        greedy = points[spread_out(points, min(k, 200), 0)]
        best_at_least = reached(points, greedy) / 2  # the greedy choice is within a factor of two
        assert reached(points, points[state.ids]) <= state.radius + 1e-9
        assert state.least <= reached(points, greedy) + 1e-9
        assert state.radius <= 8 * max(state.least, best_at_least) + 1e-9


def test_merged_states_cover_all_rows():
    points = drawn(1, 300)
    whole = coreset.Cover(6)
    for at in range(0, 300, 50):
        part = coreset.Cover(6)
        part.add(list(range(at, at + 50)), points[at : at + 50], np.zeros(50))
        whole.add(part.ids, part.points, np.full(len(part.ids), part.radius))
    assert len(whole.ids) <= 6 and reached(points, points[whole.ids]) <= whole.radius + 1e-9


def test_every_class_size_by_one_rule(spark):
    """Large, small, hot and one-row classes; no partitioning changes the choice, no task gets more than its slice."""
    sizes = {0: 400, 1: 30, 2: 1, 3: 5}
    rows, all_points, n = [], {}, 0
    for label, size in sizes.items():
        all_points[label] = drawn(label, size) if size > 5 else np.random.default_rng(label).normal(size=(size, 4))
        for p in all_points[label]:
            rows.append((n, label, p.tolist()))
            n += 1
    golden = corpus(spark, [*rows, (n, None, [0.0] * 4), (n + 1, 1, None)])
    got = coreset.core_set(golden.repartition(7), 8, slice_rows=25, fan_in=2).collect()
    again = coreset.core_set(golden.coalesce(1), 8, slice_rows=25, fan_in=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    vectors = {i: np.array(v) for i, _, v in rows}
    for label, size in sizes.items():
        own = [r for r in got if r["label_id"] == label]
        assert 1 <= len(own) <= min(8, size)
        assert reached(all_points[label], np.array([vectors[r["golden_id"]] for r in own])) <= own[0]["radius"] + 1e-9
        if size <= 5:
            assert len(own) == size and own[0]["radius"] == 0
    assert coreset.core_set(golden.limit(0), 3).count() == 0
    kept = stratify(golden, 8, "core_set")
    assert kept.columns == golden.columns and kept.groupBy("label_id").count().agg(F.max("count")).first()[0] <= 8


def test_a_node_holds_a_slice_or_a_few_states(spark, monkeypatch):
    seen = []
    cover = coreset._covered
    monkeypatch.setattr(coreset, "_covered", lambda placed, k: seen.append(placed.groupBy("label_id", "node").count().agg(F.max("count")).first()[0]) or cover(placed, k))
    rows = [(i, 0, [float(i % 97), float(i % 89)]) for i in range(3000)]
    coreset.core_set(corpus(spark, rows), 5, slice_rows=100, fan_in=4).collect()
    assert len(seen) == 4 and seen[0] < 200 and max(seen[1:]) <= 4 * 5
