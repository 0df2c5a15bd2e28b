import numpy as np
import pyarrow as pa
import pytest

from tagweave.operators import blocks as bl
from tagweave.operators import metrics as me
from tagweave.operators import neighbours as nb
from tagweave.operators.blocks import ScanLimits, strips


def test_a_row_is_sent_to_a_bounded_number_of_blocks():
    small = ScanLimits(broadcast_bytes=0, block_rows=200, chunk_rows=200)
    assert [small.parts(n, 64, 200) for n in (0, 199, 1_000, 5_000, 500_000)] == [1, 1, 5, 16, 16]  # 2,500 blocks before
    assert ScanLimits().parts(460_000, 64, 32_768) == 15
    assert ScanLimits().parts(4_000_000, 64, 32_768) == 31  # a block holds 64 MB of vectors at most
    assert ScanLimits(copies=None).parts(5_000, 64, 200) == 25


def test_strips_hold_few_distances_and_enough_queries():
    longest = lambda width: max(s.stop - s.start for s in strips(20_000, width))
    assert [longest(width) for width in (1_000, 51_000, 1_000_000, 10_000_000)] == [1_000, 64, 4, 1]  # 4,000 rows of 1,000 before
    assert [s.stop - s.start for s in strips(2_500, 1_000)] == [1_000, 1_000, 500]


def _block(matrix, labels):
    return bl.Block(pa.array(np.arange(len(matrix))), np.asarray(labels), matrix)


def _ranked(matrix, labels, label=None):
    """All other rows of each row by exact distance and id, of one label if asked."""
    out = []
    for q in range(len(matrix)):
        d2 = bl.squared_distances(matrix, np.full(len(matrix), q), matrix, np.arange(len(matrix)))
        out.append(sorted((d2[j], j) for j in range(len(matrix)) if j != q and (label is None or labels[j] == label[q])))
    return out


def _cases():
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(700, 12))
    close = np.vstack([plain[:200], plain[:200] + rng.normal(size=(200, 12)) * 1e-9, plain[:50]])
    return {"plain": plain, "close": close, "long": plain * 1e3 + 1e5, "short": plain * 1e-25, "too long": plain * 1e20}


@pytest.mark.parametrize("name", list(_cases()))
def test_single_precision_candidates_lose_no_neighbour_and_no_count(name):
    matrix = _cases()[name]
    labels = np.arange(len(matrix)) % 3
    ids, block = pa.array(np.arange(len(matrix))), _block(matrix, labels)
    every, own = _ranked(matrix, labels), _ranked(matrix, labels, labels)
    for k, same, truth in ((1, True, own), (7, False, every)):
        extras = [pa.array(labels.astype(np.int32))] if same else []
        found = nb.TopK(k, exclude_self=True, same_label=same).run(ids, matrix, extras, block).to_pylist()
        assert [[(n["sort_key"], n["golden_id"]) for n in row] for row in found] == [row[:k] for row in truth]
    at = [row[0] for row in own]
    counts = me.CountBefore().run(ids, matrix, [pa.array([d for d, _ in at]), pa.array([j for _, j in at])], block)
    assert counts.to_pylist() == [row.index(a) for row, a in zip(every, at)]


def test_ordinary_vectors_need_no_double_precision_matrix(monkeypatch):
    def never(*_):
        raise AssertionError("a matrix of all distances in double precision")

    monkeypatch.setattr(nb, "estimates", never)
    monkeypatch.setattr(me, "estimates", never)
    matrix, labels = _cases()["plain"], np.arange(700) % 3
    ids, block = pa.array(np.arange(700)), _block(matrix, labels)
    nb.TopK(5).run(ids, matrix, [], block)
    nb.TopK(1, exclude_self=True, same_label=True).run(ids, matrix, [pa.array(labels.astype(np.int32))], block)
    me.CountBefore().run(ids, matrix, [pa.array(np.full(700, 3.0)), ids], block)


def test_a_label_that_is_null_or_unknown_matches_nothing():
    matrix = np.eye(4)
    found = nb.TopK(1, same_label=True).run(pa.array(range(3)), matrix[:3], [pa.array([None, 9, 1], pa.int32())], _block(matrix, [0, 0, 1, 1]))
    assert [[n["golden_id"] for n in row] for row in found.to_pylist()] == [[], [], [2]]


def test_copies_are_told_apart_by_their_bytes_not_by_checksums(monkeypatch):
    monkeypatch.setattr(bl, "MIX", np.uint64(0))  # all checksums of one last component are equal
    matrix = np.array([[1.0, 2.0], [3.0, 2.0], [1.0, 2.0], [1.0, 2.0], [-0.0, 2.0], [0.0, 2.0]])
    assert _block(matrix, [0] * 6).front(2).ids.to_pylist() == [0, 1, 2, 4, 5]
    assert _block(matrix, [0, 0, 0, 1, 0, 0]).front(1, True).ids.to_pylist() == [0, 1, 3, 4, 5]
