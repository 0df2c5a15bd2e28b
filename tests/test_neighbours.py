import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.operators.blocks import Block, PackedCorpus, ScanLimits, pack
from tagweave.operators.neighbours import explode_neighbours, fit_index, ivf_join, knn_join, lsh_join, nearest

BLOCKS = ScanLimits(broadcast_bytes=0, block_rows=7, chunk_rows=5)


def corpus(spark, rows, id_type="bigint"):
    return spark.createDataFrame(rows, f"golden_id {id_type}, label_id int, embedding array<double>")


def as_queries(df):
    return df.selectExpr("golden_id as query_id", "embedding")


def found(df):
    return {(r.query_id, r.rk): (r.golden_id, round(r.d2, 9)) for r in df.collect()}


def brute(points, k, exclude_self=True):
    out = {}
    for i, p in enumerate(points):
        d = [(round(float(((p - q) ** 2).sum()), 12), j) for j, q in enumerate(points) if not (exclude_self and i == j)]
        for rk, (d2, j) in enumerate(sorted(d)[:k], 1):
            out[i, rk] = (j, round(d2, 9))
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    clusters = np.repeat(rng.normal(size=(4, 6)) * 4, 10, axis=0) + rng.normal(size=(40, 6)) * 0.2
    clusters[10:24] = clusters[10]  # a third of the rows are copies of one
    return clusters


def test_both_plans_equal_brute_force_with_a_hot_group_of_copies(spark, points):
    g = corpus(spark, [(i, i % 3, p.tolist()) for i, p in enumerate(points)])
    expected = brute(points, 5)
    assert isinstance(pack(g), PackedCorpus)
    assert found(knn_join(as_queries(g), g, 5, exclude_self=True)) == expected
    assert found(knn_join(as_queries(g), g, 5, exclude_self=True, limits=BLOCKS)) == expected


def test_result_does_not_depend_on_partitioning(spark, points):
    g = corpus(spark, [(i, 0, p.tolist()) for i, p in enumerate(points)])
    once = found(knn_join(as_queries(g).repartition(3), g.repartition(5), 4))
    assert once == found(knn_join(as_queries(g).coalesce(1), g.coalesce(1), 4)) == brute(points, 4, False)


@pytest.mark.parametrize("limits", [ScanLimits(), BLOCKS])
def test_fewer_rows_than_k_and_string_ids(spark, limits):
    g = corpus(spark, [("b", 1, [0.0, 1.0]), ("a", 0, [0.0, 1.0]), ("c", 1, [1.0, 0.0])], "string")
    rows = found(knn_join(as_queries(g), g, 10, exclude_self=True, limits=limits))
    assert rows["a", 1] == ("b", 0.0) and rows["b", 1] == ("a", 0.0)
    assert rows["c", 1][0] == "a" and rows["c", 2][0] == "b"  # tie by id
    assert len(rows) == 6


@pytest.mark.parametrize("limits", [ScanLimits(), BLOCKS])
def test_an_empty_corpus_leaves_empty_lists(spark, limits):
    q = corpus(spark, [(1, 0, [1.0, 0.0])])
    out = nearest(as_queries(q), q.filter("golden_id < 0"), 3, limits=limits).collect()
    assert [r.neighbours for r in out] == [[]]


def test_vectors_of_odd_length_are_refused(spark):
    g = corpus(spark, [(1, 0, [1.0, 0.0]), (2, 0, [1.0])])
    with pytest.raises(Exception, match="one length"):
        knn_join(as_queries(g), g, 1).collect()


def test_inner_product_ranks_by_dot(spark):
    g = corpus(spark, [(1, 0, [1.0, 0.0]), (2, 0, [0.6, 0.8]), (3, 0, [-1.0, 0.0])])
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    rows = knn_join(q, g, 3, metric="ip").orderBy("rk").collect()
    assert [(r.golden_id, round(r.d2, 9)) for r in rows] == [(1, 0.0), (2, 0.8), (3, 4.0)]


@pytest.mark.parametrize("join", [ivf_join, lsh_join])
def test_approximate_joins_find_planted_neighbours(spark, points, join):
    g = corpus(spark, [(i, 0, p.tolist()) for i, p in enumerate(points)])
    options = {"n_cells": 4, "n_probe": 2} if join is ivf_join else {"tables": 6, "bits": 3, "n_probe": 4}
    limits = ScanLimits(block_rows=4, chunk_rows=3)  # every cell is hot
    out = found(explode_neighbours(join(as_queries(g), g, 5, exclude_self=True, limits=limits, **options)))
    expected = brute(points, 5)
    assert sum(out.get(key) == value for key, value in expected.items()) / len(expected) > 0.9


def test_kept_index_is_made_once_saved_and_loaded(spark, points):
    from tagweave.functions.session import scratch_path
    from tagweave.plans.tagging import BuildSpec, build_corpus, predict
    from tagweave.sources.artifacts import load_corpus, save_corpus

    g = corpus(spark, [(i, i % 3, p.tolist()) for i, p in enumerate(points)])
    names = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "label_id int, category string")
    built = build_corpus(g, names, spec=BuildSpec(cap_method="hash"))
    asked = as_queries(g).select("query_id", "embedding")
    shown = ["query_id", "predicted_category", "confidence", "neighbours"]
    answers = {k: sorted(map(str, predict(asked, built, 3, index=k, n_probe=3).select(shown).collect())) for k in ("ivf", "lsh")}
    assert built.index("ivf") is built.index("ivf") and set(built.indexes) == {"ivf", "lsh"}
    folder = scratch_path(spark)
    save_corpus(built, folder)
    loaded = load_corpus(spark, folder, ("ivf", "lsh"))
    for kind, want in answers.items():
        assert sorted(map(str, predict(asked, loaded, 3, index=kind, n_probe=3).select(shown).collect())) == want


def test_index_asks_far_fewer_rows_than_there_are(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("golden_id"), F.col("label").alias("label_id"), "embedding"
    )
    n = vectors.count()
    for kind, probes in (("ivf", 4), ("lsh", 2)):
        index = fit_index(vectors, kind)
        sizes = index.cells.groupBy("cell").count()
        asked = index.asked(vectors.withColumnRenamed("golden_id", "query_id").select("query_id", "embedding"), probes)
        met = asked.join(sizes, "cell").agg(F.sum("count")).first()[0]
        assert met / n < 0.4 * n


@pytest.mark.parametrize("search", ["broadcast", "blocks", "ivf", "lsh"])
def test_rows_that_share_a_query_id_are_answered_one_by_one(spark, points, search):
    from tagweave.operators.neighbours import index_join

    g = corpus(spark, [(i, 0, p.tolist()) for i, p in enumerate(points)])
    rows = [(5, points[3].tolist(), "a"), (5, points[35].tolist(), "b"), (None, points[0].tolist(), "c"), (None, points[30].tolist(), "d"), (5, points[3].tolist(), "e")]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>, note string")
    if search in ("broadcast", "blocks"):
        out = nearest(asked, g, 1, limits=ScanLimits() if search == "broadcast" else BLOCKS)
    else:
        out = index_join(asked, fit_index(g, search, **({"n_cells": 4} if search == "ivf" else {"bits": 2})), 1, n_probe=4)
    got = {r["note"]: r["neighbours"][0]["d2"] for r in out.collect()}
    assert sorted(got) == list("abcde") and all(abs(d) < 1e-12 for d in got.values())
    assert out.columns == ["query_id", "embedding", "note", "neighbours"]


def test_queries_are_encoded_once_in_the_block_plan(spark, points):
    from tagweave.operators.scoring import with_prototype_scores

    calls = spark.sparkContext.accumulator(0)
    g = corpus(spark, [(i, i % 3, p.tolist()) for i, p in enumerate(points)])

    def encoder(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    asked = as_queries(g).repartition(3).mapInArrow(encoder, "query_id long, embedding array<double>")
    nearest(asked, g, 3, limits=BLOCKS).collect()
    assert calls.value == len(points)
    protos = g.limit(9).select(F.col("golden_id").cast("int").alias("label_id"), F.col("embedding").alias("proto"))
    scored = {r["query_id"]: r["proto_scores"] for r in with_prototype_scores(as_queries(g), protos, BLOCKS).collect()}
    whole = {r["query_id"]: r["proto_scores"] for r in with_prototype_scores(as_queries(g), protos).collect()}
    for i, scores in scored.items():
        assert [s["label_id"] for s in scores] == [s["label_id"] for s in whole[i]]
        assert np.allclose([s["sim"] for s in scores], [s["sim"] for s in whole[i]])


def test_the_single_precision_matrix_takes_no_second_one_of_doubles():
    matrix = np.random.default_rng(4).normal(size=(50_000, 32)) * 10.0
    block = Block(pa.array(np.arange(len(matrix))), np.zeros(len(matrix), np.int32), matrix)
    want = np.vstack([-2.0 * matrix.T, np.einsum("ij,ij->i", matrix, matrix)]).astype(np.float32)
    tracemalloc.start()
    try:
        got = block.coarse()[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got, want) and peak < matrix.nbytes
