"""The operators of this subpackage as queries over whole tables."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import Catalog
from tagweave.llm import bpe, collisions, descent, exact, infill, licences, mixing, pages, periodic, quality, simhash, suffixes, token_files
from tagweave.llm.common import table

C = Catalog()
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@C.add("op1_suffixes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"), with_text=False).drop("sum", "kept")


@C.add("op2_collisions")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@C.add("op3_descent")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return descent.near_duplicates(table(spark, folder, "embeddings"), threshold=0.93)


@C.add("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score_documents(table(spark, folder, "documents"), labels)


@C.add("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@C.add("op6_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), VOCABULARY))


@C.add("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = VOCABULARY
    return token_files.tokens_on_disk(table(spark, folder, "documents"), lambda: bpe.library_pieces(path))


@C.add("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3, max_bits=3)


@C.add("op9_licences", licences.scan_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@C.add("op10_pages")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@C.add("op11_exact", exact.duplicates_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier half of the ids is history, the later half is looked up in it."""
    docs = table(spark, folder, "documents")
    return exact.exact_duplicates(docs, exact.earlier_half(docs))


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """In one of ten documents the words from ``a`` on repeat with a period; a null id counts as empty."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places, period = np.arange(n), 1 + (n - a) // (3 + g % 8)
    return np.where(places < a, places, a + (places - a) % period)


@C.add("op12_periodic")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(table(spark, folder, "documents"), places=planted_period))


@C.add("op13_infill", infill.fill_in_middle_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, folder, "documents")))
