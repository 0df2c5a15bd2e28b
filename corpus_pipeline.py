"""From raw documents to token ids: the stages of a training corpus, each one operator over all that the one before kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and returns the columns of ``documents``, but for the last.
``run`` writes each stage's result as Parquet in the shared folder, drops what the stage wrote on its way, and reads the result back
for the next stage.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, scratch_path, scratch_scope, stored_with_count
from tagweave.llm import bpe, mixing, quality, simhash, suffixes
from tagweave.llm.common import table
from tagweave.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier accepts; it learns from the labelled documents that are not held out.

    Each row is judged by its own text, also where an id is null or repeated.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return _without(docs, quality.rejected(docs, labels, suffixes.text_sum(F.col("text"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies: that of the smallest ``doc_id``, rows without id last.

    Of rows that share id and text one stays, too.
    """
    gone, repeated = simhash.surplus(docs, suffixes.text_sum(F.col("text")), words=3, max_bits=3)
    left = _without(docs, gone)
    repeated, some = stored_with_count(repeated)
    if not some:
        return left
    marked = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *_own(left))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sum") == F.col("mark"))
    first = W.partitionBy("own_id", "own_sum").orderBy(F.xxhash64("document"))  # Spark cuts each task's rows to one
    one = marked.join(repeated, same, "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    whole = marked.join(repeated, same, "left_anti").unionByName(one.drop("nth"))
    return whole.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def _own(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("own_id"), suffixes.text_sum(F.col("text")).alias("own_sum")]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and checksum are not among ``gone(doc_id, mark)``."""
    gone = cut_lineage(gone.select(F.col("doc_id").alias("gone_id"), "mark"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *_own(docs))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_sum") == F.col("mark"))
    return marked.join(gone, same, "left_anti").select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; what a cut leaves of a character goes too.

    What is left of a text depends on the text alone, so rows that share id and text are cut alike.
    """
    cut = suffixes.remove_repeats(docs).filter("n_removed > 0")
    cut = cut_lineage(cut.select(F.col("doc_id").alias("cut_id"), F.col("sum").alias("cut_sum"), F.col("kept").alias("left")).dropDuplicates(["cut_id", "cut_sum"]))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").cast("long").alias("whole_id"), suffixes.text_sum(F.col("text")).alias("whole_sum"))
    joined = whole.join(cut, F.col("whole_id").eqNullSafe(F.col("cut_id")) & (F.col("whole_sum") == F.col("cut_sum")), "left")
    was_cut = F.col("cut_sum").isNotNull()
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    old = {c: F.col("document").getField(c) for c in docs.columns}
    return joined.select(*[(F.when(was_cut, new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeat_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document with the digests of ids and decoded text."""
    return bpe.digests(bpe.round_trip(docs, VOCABULARY), "ids")


STAGES = [
    ("quality", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The classifier, the tilted rates and the encoder have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        result = scratch_path(spark)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(result)
        docs = spark.read.parquet(result)
    return docs
