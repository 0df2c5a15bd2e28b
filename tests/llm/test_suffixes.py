import random

import numpy as np
import pytest

from tagweave.llm import suffixes
from tests.llm import brute


def made(rng: random.Random, parts: int, n: int) -> list[bytes]:
    base = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 120))) for _ in range(parts)]
    texts = [b"".join(rng.choice(base)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 4))) for _ in range(n)]
    return texts + [b"a" * 50, b"abc" * 30, b"", b"x"]


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms_find_the_repeated_windows(seed):
    texts, length = made(random.Random(seed), 4, 12), 20
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    for shard in (60, 10_000):  # many shards, one shard
        found = suffixes.repeated_windows(data, starts, length, 5, shard)
        for t, a, b, (_, removed, _, _) in zip(texts, starts, starts[1:], brute.cut_repeats(texts, length)):
            covered = np.zeros(len(t), bool)
            for i in np.flatnonzero(found[a:b]):
                assert i + length <= len(t)
                covered[i : i + length] = True
            assert covered.sum() == removed


def test_pieces_hold_each_window_once_and_equal_windows_share_a_key():
    texts, length = made(random.Random(5), 4, 12), 20
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    data = b"".join(texts)
    first, windows, key, _ = suffixes.pieces_of(np.frombuffer(data, np.uint8), starts, length, 8)
    met: dict[bytes, int] = {}
    count = 0
    for f, w, k in zip(first.tolist(), windows.tolist(), key.tolist()):
        inside = [data[f + i : f + i + length] for i in range(w)]
        assert len(set(inside)) == w
        count += w
        for x in inside:
            assert met.setdefault(x, k) == k
    assert count == sum(max(0, len(t) - length + 1) for t in texts)


ROWS = 60


def rows() -> list[tuple]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeä") for _ in range(rng.randint(1, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = [None, "", "kürz", "ab" * 400, passage[0], passage[0]]
    while len(texts) < ROWS:
        own = [word() for _ in range(rng.randint(1, 80))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + [rng.choice(passage)[rng.randint(0, 3) :]] + own[at:]) if rng.random() < 0.6 else " ".join(own))
    return [(i if i else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, "another text of the same id")]


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 1])
def test_whole_operator_equals_brute_force(spark, crowd):
    given = rows()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in given], "doc_id long, text string, sum string, key int, start int").repartition(3)
    got = suffixes.remove_repeats(docs, length=100, block=25, anchor=16, crowd=crowd).drop("sum").collect()
    want = [(i, *w) for (i, _), w in zip(given, brute.cut_repeats([(t or "").encode() for _, t in given], 100))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=order) == sorted(
        [(i, n, gone, spans, brute.digest(kept)) for i, n, gone, spans, kept in want], key=order
    )
    assert sum(r["n_removed"] > 0 for r in got) > 10
    assert {(r["doc_id"], r["kept"]) for r in got} == {(i, kept.decode(errors="ignore")) for i, _, _, _, kept in want}


def test_crowds_of_several_levels_are_split_into_few_rows(spark, monkeypatch):
    """One passage in all texts, with own words around it, copies of whole texts, and lines that many share."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, lines = word(90), [word(40) for _ in range(3)]
    texts = [word(rng.randint(0, 120)) + (passage if i % 3 else rng.choice(lines) + passage[:70]) + word(rng.randint(0, 120)) for i in range(300)]
    texts += [texts[5]] * 20 + [passage * 3] * 2 + [passage + lines[0] + passage, "ab" * 300]
    made: list[int] = []
    halves = suffixes.halves

    def counted(pieces, *args):
        part = suffixes.cut_lineage(halves(pieces, *args))
        made.append(part.count())
        return part

    monkeypatch.setattr(suffixes, "halves", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(docs, length=100, block=25, anchor=16, crowd=4).collect()
    want = brute.cut_repeats([t.encode() for t in texts], 100)
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept"]) for r in got) == [(i, gone, spans, kept.decode()) for i, (_, gone, spans, kept) in enumerate(want)]
    assert len(made) > 3 and max(made) < 8 * len(texts)  # a few pieces a text and round, never one a window


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
