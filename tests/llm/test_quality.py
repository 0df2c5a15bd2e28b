import zlib

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import quality

FOLDER = "/root/testdata/sf0.01"


def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").withColumnRenamed("quality", "label")


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels(spark)).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    known = [(got[r["doc_id"]], r["label"]) for r in labels(spark).collect()]
    held = [(r["predicted"], y) for r, y in known if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert np.mean([p for p, y in held if y == 1]) > 0.97  # clean documents stay


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    turned = labels(spark).withColumn("label", F.when(quality.held_out(), 1 - F.col("label")).otherwise(F.col("label")))
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in quality.score_documents(docs, l).collect()) for l in (labels(spark), turned)]
    assert scores[0] == scores[1]


def test_moments_and_scores_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + y[:, None]
    featured = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, x array<double>").repartition(4)
    model = quality.fit(featured, spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, label int"), shrink=0.3, ridge=0.1)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        s = 0.7 * np.cov(x[y == k].T, bias=True) + 0.3 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        delta = x - x[y == k].mean(0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", delta, np.linalg.inv(s), delta))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-8)


def test_nulls_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (4, "Wörter " * 30_000, 0), (4, "x", 0)], "doc_id long, text string, score int")
    some = spark.createDataFrame([(1, 1), (2, None), (4, 7), (None, 0), (99, 0)], "doc_id long, label int")
    got = quality.score_documents(docs, some).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.score_documents(docs.limit(0), some).count() == 0
