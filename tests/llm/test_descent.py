import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import descent
from tests.llm import brute


def rows() -> list[tuple]:
    """Lone vectors, pairs, a crowd of near-copies, exact copies, and rows that link with nothing."""
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=16) for _ in range(250)]
    vectors += [vectors[i] + 0.03 * rng.normal(size=16) for i in range(40)]
    vectors += [vectors[100] + 0.1 * rng.normal(size=16) for _ in range(60)]
    vectors += [vectors[200]] * 30 + [-vectors[5], 3 * vectors[6]]
    out = [(i, v.tolist(), int(i % 2) if i < 40 else 1 if i >= 290 else int(i % 3)) for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, 0), ([], 0), ([0.0] * 16, 0), ([nan] + [1.0] * 15, 0), ([inf] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), (vectors[0].tolist(), None), (vectors[0].tolist()[:8], 0)]
    return out + [(1000 + i, v, l) for i, (v, l) in enumerate(odd)]


@pytest.mark.parametrize("block", [descent.BLOCK, 16])
def test_links_and_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(descent.class_counts, "__defaults__", (block,))
    given = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in given], "vec_id long, embedding array<double>, label int, node int, root int").repartition(3)
    got = {r["vec_id"]: r for r in descent.near_duplicates(df, k=5, rounds=4).collect()}
    want = brute.vector_links(given, 0.93)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sum(n for n, _ in want.values()) > 1000


def test_no_vectors_and_no_ids(spark):
    df = spark.createDataFrame([(1, None, 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(df).collect()}
    assert got == {1: (0, 1, True), None: (0, None, False), 2: (0, 2, True)}
    assert descent.near_duplicates(df.limit(0)).count() == 0


def test_refining_finds_what_the_first_orders_missed(spark):
    """From one order only, rounds raise the share of true neighbours that lists hold."""
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(40, 12)), 15, axis=0) + 0.6 * rng.normal(size=(600, 12))
    nodes = spark.createDataFrame([(0, v, i, 1) for i, v in enumerate(vectors.tolist())], "label long, vec array<double>, node long, copies long")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T - 2 * np.eye(600)
    true = {(i, int(j)) for i in range(600) for j in np.argsort(-sims[i])[:8]}
    first = descent.first_pairs(nodes, 12, 600, 2, 8, 1)
    graph = descent.cut_lineage(descent._lists(first.union(first.select("v", "u", "sim")).withColumn("fresh", F.lit(True)), 8))
    share = lambda g: len(true & {(r["u"], r["v"]) for r in g.collect()}) / len(true)
    before = share(graph)
    for _ in range(3):
        graph = descent.cut_lineage(descent.refine(graph, nodes, 8))
    assert share(graph) > max(0.9, before + 0.1)


def tight_groups(groups: int, each: int, others: int, size: int = 64) -> np.ndarray:
    """Pairs of groups: cosines of about 0.99 inside one, of just above 0.93 between the two; and lone vectors."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    first = unit(rng.normal(size=(groups, size)))
    aside = rng.normal(size=(groups, size))
    aside = unit(aside - (aside * first).sum(1, keepdims=True) * first)
    second = 0.9465 * first + np.sqrt(1 - 0.9465**2) * aside
    centres = np.repeat(np.stack([first, second], 1).reshape(2 * groups, size), each, axis=0)
    members = np.sqrt(0.99) * centres + 0.1 * unit(rng.normal(size=centres.shape))
    return np.concatenate([members, rng.normal(size=(others, size))])


def test_tight_groups_that_fill_their_own_lists_are_one_class(spark):
    groups, each = 5, 24
    vectors = tight_groups(groups, each, 300)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in descent.near_duplicates(df, tables=1, few=0.0, passes=1).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    assert [got[i]["n_links"] for i in range(len(vectors))] == links.tolist()
    pairs = 2 * each * groups
    assert [got[i]["component_id"] for i in range(len(vectors))] == [i // (2 * each) * 2 * each if i < pairs else i for i in range(len(vectors))]


def test_lone_pairs_beside_a_crowd_are_not_lost(spark):
    """A crowd whose links outnumber all others, lone pairs and a few pairs among many: the audit notices what one weak search lost, and blocks are compared."""
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    head = unit(rng.normal(size=32))
    crowd = unit(head + 0.3 * unit(rng.normal(size=(400, 32))))
    lone = unit(rng.normal(size=(150, 32)))
    near = unit(lone + 0.34 * unit(rng.normal(size=(150, 32))))
    vectors = np.concatenate([crowd, lone, near])
    given = [(i, v, 1) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in descent.near_duplicates(df, k=4, tables=1, rounds=1, passes=1).collect()}
    want = brute.vector_links(given, 0.93)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["audit_recall"] == 1.0 for r in got.values())
    weak = spark.createDataFrame([(0, 1)], "node long, root long").limit(0)
    nodes = df.select(F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"), F.col("vec_id").alias("node"))
    assert descent.audit(nodes, weak, 0.93, 1000, 1) == 0.0
    right = spark.createDataFrame([(i, r) for i, (_, r) in want.items() if i != r and i < 400], "node long, root long")
    assert descent.audit(nodes, right, 0.93, 1000, 1) < 0.5  # the crowd is whole, the pairs are not
