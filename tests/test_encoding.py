import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.functions.text import token_buckets, tokens
from tagweave.operators import features as fe


def test_words_are_hashed_as_their_column_expression_does(spark):
    texts = [(1, "ein Haus, zwei häuser – 3 Häuser"), (2, ""), (3, None), (4, "the the THE"), (5, "語 語 x1")]
    rows = spark.createDataFrame(texts, "id long, t string").withColumn("w", tokens(F.col("t"))).select("id", "w", token_buckets(F.col("w"), 64).alias("b"))
    hashed = fe.WordBuckets(64, most=2)  # the few kept words are let go between batches
    for r in rows.collect():
        sizes, buckets = hashed(pa.array([r["w"] or []], pa.list_(pa.string())))
        assert buckets.tolist() == (r["b"] or []) and sizes.tolist() == [len(r["b"] or [])]


def test_an_encoder_holds_a_bounded_number_of_rows(monkeypatch):
    monkeypatch.setattr(fe, "STEP_ROWS", 3)
    seen = []

    def lengths(words):
        seen.append(len(words))
        return np.diff(words.offsets.to_numpy())[:, None].astype(float)

    words = pa.array([["w"] * n for n in range(8)], pa.list_(pa.string()))
    assert fe._in_steps(lengths, words).to_pylist() == [[float(n)] for n in range(8)] and max(seen) == 3
