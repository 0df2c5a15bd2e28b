import hashlib
import random

import numpy as np
import pytest

from tagweave.llm import infill

ODD = [None, "", "a", "日本語テスト 🙂🙂 🏳️‍🌈" * 40, "é" * 5000, "x" * 20_000, "<P>", "a<S>b", "<M", "<", "<P<S", ">M>" * 30, "P>" * 50, "ab\ncd\n" * 900]


def expected(i, text) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    one, two, three, four = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if four % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def drawn(n: int) -> list[tuple]:
    rng = random.Random(n)
    shared = ["".join(rng.choice("aé日🙂 <PSM>\n") for _ in range(900)).replace("<P>", "").replace("<S>", "").replace("<M>", "") for _ in range(5)]
    given = [(rng.choice([None, *range(n)]), rng.choice(ODD)) for _ in range(n)]
    return given + [(k, "".join(rng.choice(shared)[rng.choice([0, 0, 7]) :] for _ in range(rng.randint(1, 6)))) for k in range(n)]


def test_operator_and_its_way_back(spark):
    given = drawn(150)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in given], "doc_id long, text string, n int, output string").repartition(3)
    made = infill.fill_in_middle(docs)
    want = sorted((expected(i, t) for i, t in given), key=repr)
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored(made["output"], made["form"]).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in given), key=repr)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_chunks_cover_the_text_and_follow_its_content():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 256, 20_000).astype(np.uint8)
    both = []
    for front in (0, 333):
        data = np.concatenate([rng.integers(0, 256, front).astype(np.uint8), shared])
        cuts = (np.flatnonzero(infill.rolling(data) >> np.uint32(32 - infill.CUT_BITS) == 0) + 1).tolist()
        ends = infill.chunks_of(len(data), cuts)
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(data) and sizes.max() <= infill.LARGEST and sizes[:-1].min() >= infill.SMALLEST
        both.append({e - front for e in ends})
    assert len(both[0] & both[1]) > 0.8 * len(both[0])


@pytest.mark.parametrize("text", ["日本é🙂a" * 300, "a" * 999, "🙂" * 500])
def test_cuts_from_any_chunks(text):
    """Chunks that end inside a code point, too."""
    data = text.encode()
    rng = random.Random(1)
    for _ in range(20):
        ends = sorted({rng.randrange(1, len(data)) for _ in range(30)}) + [len(data)]
        units = infill.Units(data, ends, [0] * len(ends), infill.Summaries())
        assert units.n == len(text)
        for k in [0, 1, units.n - 1, units.n, *(rng.randrange(units.n) for _ in range(40))]:
            assert units.end(k) == len(text[:k].encode())


def test_equal_marks_are_told_apart_by_their_bytes_and_the_cache_stays_bounded():
    summaries = infill.Summaries(2000)
    for k in range(200):
        chunk = ("é" * (k % 7) + "x" * (100 - 2 * (k % 7))).encode()
        assert summaries(5, chunk) == summaries(5, chunk) == infill.summary(chunk)
        assert summaries(k, chunk) == infill.summary(chunk)
        assert sum(len(c) for c, _ in [*summaries.young.values(), *summaries.old.values()]) <= 2000
