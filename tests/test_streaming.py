import numpy as np

from tagweave.functions.session import scratch_path
from tagweave.plans.tagging import BuildSpec, build_corpus, predict
from tagweave.streaming.scoring import score_stream


def rows_of(df):
    return sorted((r.query_id, r.predicted_category, round(r.confidence, 9), r.needs_llm) for r in df.collect())


def test_stream_equals_batch_as_a_projection_and_through_the_sinks(spark):
    rng = np.random.default_rng(4)
    g = spark.createDataFrame(
        [(i, i % 3, rng.normal(size=4).tolist()) for i in range(60)],
        "golden_id bigint, label_id int, embedding array<double>",
    )
    labels = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "label_id int, category string")
    corpus = build_corpus(g, labels, spec=BuildSpec(max_per_class=15))
    path = scratch_path(spark)
    g.selectExpr("golden_id as query_id", "embedding").repartition(3).write.parquet(f"{path}/in")
    batch = rows_of(predict(spark.read.parquet(f"{path}/in"), corpus, 5))

    def stream():
        reader = spark.readStream.schema("query_id bigint, embedding array<double>")
        return reader.option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    plain = predict(stream(), corpus, 5).writeStream.format("memory").queryName("plain").trigger(availableNow=True)
    plain.option("checkpointLocation", f"{path}/plain").start().awaitTermination()
    assert rows_of(spark.table("plain")) == batch

    for _ in range(2):  # a restart finds nothing new and writes nothing twice
        query = score_stream(stream(), corpus, f"{path}/auto", f"{path}/review", f"{path}/state", k=5)
        query.awaitTermination()
    auto, review = (spark.read.parquet(f"{path}/{side}") for side in ("auto", "review"))
    assert rows_of(auto.unionByName(review)) == batch
    assert not any(r.needs_llm for r in auto.collect()) and all(r.needs_llm for r in review.collect())
