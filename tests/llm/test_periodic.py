import random

import numpy as np
import pytest

from tagweave.llm import periodic
from tagweave.llm.queries import planted_period
from tests.llm.brute import digest


def runs(words: list, least: int = 6, times: int = 4) -> list[tuple]:
    """Every lag over every place."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if j > i and length >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple]) -> list:
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def drawn(rng: random.Random) -> list[str]:
    """Few different words, with repeats of stretches that run into each other."""
    words: list[str] = []
    while len(words) < rng.choice([0, 5, 40, 150]):
        unit = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 40)]
        if rng.random() < 0.3:
            words.append(f"r{len(words)}")
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (3, 3), (10, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    docs = [drawn(rng) for _ in range(400)]
    codes = np.array([sum(map(ord, w)) for d in docs for w in d], np.int64)
    lengths = np.array([len(d) for d in docs])
    start, length, period = periodic.runs_of(codes, lengths, least, times)
    begins = np.append(0, np.cumsum(lengths))
    of = np.searchsorted(begins, start, "right") - 1
    stays = periodic.collapse(codes, (start, length, period))
    some = 0
    for k, words in enumerate(docs):
        want = runs(words, least, times)
        some += len(want)
        got = [(int(a - begins[k]), int(n), int(q)) for a, n, q in zip(start[of == k], length[of == k], period[of == k])]
        assert got == want
        assert [w for w, s in zip(words, stays[begins[k] : begins[k + 1]]) if s] == collapsed(words, want)
    assert some > 50


def test_splitting_ends_early_without_losing_runs(monkeypatch):
    rng = random.Random(9)
    words = [w for _ in range(30) for w in drawn(rng)]
    codes, lengths = np.array([sum(map(ord, w)) for w in words]), np.array([len(words)])
    whole = np.stack(periodic.runs_of(codes, lengths))
    places, _ = periodic.surviving(codes, lengths)
    assert 0 < len(places) < len(words)
    monkeypatch.setattr(periodic, "ROUNDS", 1)
    assert (np.stack(periodic.runs_of(codes, lengths)) == whole).all()


def test_a_long_text_takes_no_step_for_each_lag():
    words = np.tile(np.arange(50_000), 6)
    start, length, period = periodic.runs_of(words, np.array([len(words)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [50_000])


def test_times_must_let_a_window_recur():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(5, np.int64), np.array([5]), 2, 2)


def test_operator(spark):
    rng = random.Random(4)
    given = [(i, "  ".join(drawn(rng))) for i in range(300)]
    given += [(None, "a\x0bb " * 9), (7, "\n"), (7, None), (8, ""), (9, "é\xa0é " * 8), (10, "x " * 30_000), (11, " ".join(f"w{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in given], "doc_id long, text string, runs int, period int").repartition(3)
    for places in (None, planted_period):
        want = []
        for i, text in given:
            words = (text or "").encode().split()
            moved = places(i, len(words)) if places and words else None
            words = words if moved is None else [words[k] for k in moved]
            found = runs(words) if len(set(words)) < 30_000 else []
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
            milli = None if best[0] is None else 1000 * best[1] // best[2]
            want.append((i, len(found), *best, milli, digest(listed.encode()), digest(b" ".join(collapsed(words, found)))))
        got = periodic.digests(periodic.collapse_runs(docs, places=places)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_planted_words_are_those_of_the_rule():
    import zlib

    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        for n in (1, 2, 57):
            moved = planted_period(doc_id, n)
            if h % 10:
                assert moved is None
                continue
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            assert moved.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
