import re
from collections import Counter, defaultdict

import pytest

from tagweave.llm import mixing
from tests.llm import brute

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(given: list[tuple], got: list) -> dict:
    """Holds a mixture to its contract; relative misses by source."""
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, size(t)) for i, _, t in given)
    sizes = defaultdict(int)
    for _, s, t in given:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = brute.targets([(s, sizes[s]) for s in order])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return {s: abs(taken[s] / want[s] - 1) for s in sizes if want[s]}


def test_given_documents_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(DOCUMENTS)
    given = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    got = mixing.mix(docs, slice_rows=3).collect()
    checked(given, got)
    again = mixing.mix(docs.repartition(5), slice_rows=3).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_many_documents_come_close(spark):
    given = [(i, ["a", "b", "c", None][i % 4 if i % 3 else 0], "w " * (1 + i * i % 97)) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(given, "doc_id long, source string, text string").repartition(4)).collect()
    assert max(checked(given, got).values()) < 0.01


def test_rates_are_exponential_in_size(spark):
    import math

    # Three quarters of the words are in the first source, so neither target is at its cap.
    given = [(i, "b" if i % 4 == 0 else "a", "w " * (1 + i * 7 % 50)) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(given, "doc_id long, source string, text string")).collect()
    assert all(r["target"] < 1.9 * r["source_size"] for r in got)
    for source in "ab":
        tilts = [math.log(r["rate"]) / r["size"] for r in got if r["source"] == source and r["rate"] < 2 - 1e-9]
        assert max(tilts) - min(tilts) < 1e-9


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    given = [(1, None, "a b"), (2, "x", None), (3, "x", ""), (3, "x", ""), (None, "y", "c d e"), (4, "", "ä\x0bß\x1cc"), (5, "y", "w " * 5000), (5, "y", "w")]
    rows = [(i, s, t, 1, 2, 3) for i, s, t in given]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, rate int, target int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(given)
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, _, t in given)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("text is null")).collect()[0]["taken"] == 0
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert repeated.filter("doc_id = 4").count() == next(r["copies"] for r in got if r["doc_id"] == 4)
    want = Counter()
    for row in got:
        want[row["doc_id"], row["source"], row["size"]] += row["copies"]
    assert Counter((r["doc_id"], r["source"], size(r["text"])) for r in repeated.collect()) == +want


def test_rows_without_id_are_each_taken_as_the_mix_says(spark):
    given = [(None if i % 3 else 5, "ab"[i % 4 == 0], "w " * (1 + i % 7) + f"t{i % 50}") for i in range(600)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in given], "doc_id long, source string, text string, copies int, document int").repartition(3)
    repeated = mixing.repeat_documents(docs, slice_rows=20)
    assert repeated.columns == docs.columns
    got, taken = repeated.collect(), mixing.mix(docs, slice_rows=20).collect()
    for source in "ab":
        want = next(r["target"] for r in taken if r["source"] == source)
        assert abs(sum(size(r["text"]) for r in got if r["source"] == source) - want) <= 8
