import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.operators import neighbours as nb
from tagweave.operators.blocks import ScanLimits


def tables(repeated: bool):
    rng = np.random.default_rng(3)
    matrix, cells = np.round(rng.normal(size=(60, 3)), 1), rng.integers(0, 7, 60)
    ids = np.arange(60) // 2 if repeated else np.arange(60)
    if repeated:
        matrix = matrix[ids]
    lists = [sorted(rng.choice(9, size=n, replace=False).tolist()) for n in rng.integers(0, 9, 25)]
    points = rng.normal(size=(25, 3))
    corpus = pa.table({"cell": cells, "golden_id": ids, "label_id": pa.array(ids % 4, pa.int32()), "embedding": pa.array(matrix.tolist())})
    asked = pa.table({"query_id": np.arange(25), "embedding": pa.array(points.tolist()), "cells": pa.array(lists, pa.list_(pa.int64()))})
    return asked, corpus, points, lists, matrix, cells, ids


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("held", [2_000_000, 3])
def test_cells_are_ranked_alike_by_one_product_and_one_by_one(monkeypatch, whole, held):
    monkeypatch.setattr(nb, "RANKED_AS", 10**9 if whole else -(10**9))
    monkeypatch.setattr(nb, "HELD", held)
    asked, corpus, points, lists, matrix, cells, ids = tables(False)
    found = nb.cells_top_k(asked, corpus, nb.DistinctTopK(4, exclude_self=True)).to_pylist()
    for q, (point, wanted) in enumerate(zip(points, lists)):
        rows = [i for i in range(60) if cells[i] in wanted and ids[i] != q]
        best = sorted((((matrix[i] - point) ** 2).sum(), ids[i]) for i in rows)[:4]
        assert [n["golden_id"] for n in found[q]] == [i for _, i in best]
        assert np.allclose([n["d2"] for n in found[q]], [d for d, _ in best])


def test_rows_of_several_cells_are_taken_once():
    asked, corpus, points, lists, matrix, cells, ids = tables(True)
    found = nb.cells_top_k(asked, corpus, nb.DistinctTopK(60)).to_pylist()
    assert [sorted(n["golden_id"] for n in f) for f in found] == [sorted({ids[i] for i in range(60) if cells[i] in w}) for w in lists]


def test_a_query_goes_once_to_a_block_however_many_cells_it_asks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, 0, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    golden = spark.createDataFrame(rows, "golden_id long, label_id int, embedding array<double>")
    asked = golden.select(F.col("golden_id").alias("query_id"), "embedding")
    index = nb.fit_index(golden, n_cells=60, recall=None)
    limits = ScanLimits(broadcast_bytes=0, block_rows=100, chunk_rows=100)
    placed, firsts, numbers, spread = nb.place_cells(index.cells, 300, 100)
    assert len(firsts) <= 4 and placed.agg(F.max("high")).first()[0] <= 2 and not spread
    found = nb.explode_neighbours(nb.index_join(asked, index, 5, n_probe=60, exclude_self=True, limits=limits))
    exact = nb.knn_join(asked, golden, 5, exclude_self=True)
    assert found.exceptAll(exact).count() == 0 and exact.count() == found.count()


@pytest.mark.parametrize("cell_rows", [50, 2_000])
def test_cells_take_little_beyond_what_is_known_to_be_nearer(monkeypatch, cell_rows):
    rng = np.random.default_rng(9)
    points, queries, n_cells = rng.normal(size=(20_000, 8)), rng.normal(size=(60, 8)), 20_000 // cell_rows
    kind = pa.list_(pa.float64())
    corpus = pa.table({"cell": np.arange(20_000) // cell_rows, "golden_id": np.arange(20_000), "label_id": pa.array(np.zeros(20_000), pa.int32()), "embedding": pa.array(points.tolist(), kind)})
    lists = [np.sort(rng.permutation(n_cells)[: 1 + n_cells // 2]) for _ in queries]
    asked = pa.table({"query_id": np.arange(60) + 50_000, "embedding": pa.array(queries.tolist(), kind), "cells": pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))})
    pairs, exact = [], nb.squared_distances
    monkeypatch.setattr(nb, "squared_distances", lambda left, rows, *rest: pairs.append(len(rows)) or exact(left, rows, *rest))
    found = nb.cells_top_k(asked, corpus, nb.DistinctTopK(10)).to_pylist()
    for q, query in enumerate(queries):
        rows = np.flatnonzero(np.isin(np.arange(20_000) // cell_rows, lists[q]))
        best = rows[np.argsort(((points[rows] - query) ** 2).sum(1), kind="stable")[:10]]
        assert [n["golden_id"] for n in found[q]] == best.tolist()
    assert sum(pairs) < 60 * 150  # ten of each cell or block would be far more where cells are many


def test_a_goal_bounds_what_cells_give():
    from tagweave.operators.balls import SweptTopK, _sweep_top_k

    asked, corpus, points, _, matrix, cells, ids = tables(False)
    far = np.sqrt(((matrix[None] - points[:, None]) ** 2).sum(2))
    goal = np.sort(far, axis=1)[:, 3]
    kind = pa.list_(pa.int64())
    aims = asked.set_column(2, "cells", pa.array([[0]] * 25, kind)).append_column("goal", pa.array([*goal[:24], None], pa.float64()))
    got = _sweep_top_k(aims, corpus, SweptTopK(4)).to_pylist()
    for q in range(25):  # cell 0 was asked before
        rows = sorted((far[q, i] ** 2, ids[i]) for i in range(60) if cells[i] != 0)[:4]
        want = [i for d, i in rows if q == 24 or d <= goal[q] ** 2 + 1e-9]
        assert [n["golden_id"] for n in got[q]["found"]][: len(want)] == want
        assert got[q]["opened"] <= (cells != 0).sum()
