import random

import pytest

from tagweave.llm import simhash
from tests.llm import brute


@pytest.mark.parametrize("text", ["", " \n", "One", "one Two", "A b c", "A  b\tc\nd e f", "ÄÖ ß a Äx" * 50, "x y " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute.simhash(text)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(50)}
    values |= {v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in list(values) for _ in range(4)}
    tree = simhash.Tree(3)
    for v in values:
        tree.add(v, v)
    for v in values:
        assert set(tree.near(v)) == {w for w in values if (v ^ w).bit_count() <= 3}


@pytest.mark.parametrize("shard_rows", [simhash.SHARD_ROWS, 4])
def test_links_connect_what_all_pairs_connect(spark, shard_rows):
    """With four rows to a tree, crowded shards are many trees."""
    rng = random.Random(4)
    heads = [rng.getrandbits(64) for _ in range(5)]
    values = list({h ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for h in heads for _ in range(30)} | {rng.getrandbits(64) for _ in range(50)})
    groups = brute.Groups(range(len(values)))
    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= 3:
                groups.join(i, j)
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(signed, "name long, fp long").repartition(3)
    links = simhash.fingerprint_links(nodes, 3, shard_rows)
    got = brute.Groups(range(len(values)))
    for row in links.collect():
        assert (values[row["a"]] ^ values[row["b"]]).bit_count() <= 64
        got.join(row["a"], row["b"])
    assert [got.top(i) for i in range(len(values))] == [groups.top(i) for i in range(len(values))]
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(values))] == [groups.top(i) for i in range(len(values))]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    given = [(5, None), (2, ""), (9, " \t"), (7, "a b c d"), (3, "A B c D"), (3, "A B c D"), (4, "quite another text here"), (None, "a b c d"), (11, long), (12, long + " end")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in given], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(given)
    want = brute.near_copies([(i, t) for i, t in given if i is not None])
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["fingerprint"] == f"{brute.simhash('a b c d'):016x}"
        else:
            assert (row["fingerprint"], row["component_id"]) == (f"{want[row['doc_id']][0]:016x}", want[row["doc_id"]][1])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute.near_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
