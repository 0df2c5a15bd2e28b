import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tagweave.functions.session import cut_lineage
from tagweave.llm.queries import VOCABULARY
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against brute force on what the one before gave it; ``run`` gives the same rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    library = Tokenizer.from_file(VOCABULARY)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = cut_lineage(stage(spark, docs, FOLDER))
        rows = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            got = [(r["doc_id"], r["text"], r["source"]) for r in rows]
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality":
            assert set(got) <= set(given)
            kept = {i for i, _, _ in got}
            right = [(i in kept) == bool(labels[i]) for i, _, _ in given if i in labels]
            assert np.mean(right) > 0.95
        elif name == "simhash near-dedup":
            want = brute.near_copies([(i, t) for i, t, _ in given])
            assert sorted(got) == sorted(g for g in given if want[g[0]][1] == g[0])
        elif name == "suffix dedup":
            want = brute.cut_repeats([(t or "").encode() for _, t, _ in given], 400)
            assert sorted(got) == sorted((i, kept.decode(errors="ignore"), s) for (i, _, s), (_, _, _, kept) in zip(given, want))
        elif name == "mixing":
            count = {i: sum(r[0] == i for r in got) for i, _, _ in given}
            assert set(got) <= set(given) and max(count.values()) <= 2
            taken = {}
            for i, t, s in given:
                taken[s] = taken.get(s, 0) + count[i] * len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes = {}
            for _, t, s in given:
                sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            want = brute.targets([(s, sizes[s]) for s in sorted(sizes)])
            biggest = max(len((t or "").split()) for _, t, _ in given)
            assert all(abs(taken[s] - want[s]) <= biggest for s in want)
        else:
            want = sorted((i, brute.digest(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes())) for i, t, _ in given)
            assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == want
            last = sorted((r["doc_id"], r["ids_sha256"]) for r in rows)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()) == last


def test_repeated_and_null_ids_and_clashing_columns(spark, tmp_path):
    """A table loaded twice, rows without id, and columns that operators use as names."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = given.filter("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    other = given.filter("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("another text under the same id "), F.reverse("text")))
    docs = given.unionByName(given).unionByName(odd).unionByName(other)
    for k, name in enumerate(("sum", "kept", "label", "_row", "row", "copies", "document", "left", "gone", "fp")):
        docs = docs.withColumn(name, F.lit(k))
    docs = cut_lineage(docs)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").withColumn("label", F.lit(3))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept, distinct = {}, lambda df: {(r["text"] or "") for r in df.select("text").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.count()
        if name == "quality":  # by text alone
            assert not distinct(docs) & distinct(before.subtract(docs))
            before_counts = {(r["text"], r["doc_id"]): r["count"] for r in before.groupBy("text", "doc_id").count().collect()}
            assert all(before_counts[r["text"], r["doc_id"]] == r["count"] for r in docs.groupBy("text", "doc_id").count().collect())
        elif name == "simhash near-dedup":
            texts = [r["text"] for r in before.select("text").collect()]
            groups = brute.near_copies(list(enumerate(texts)))
            assert kept[name] == len({g for _, g in groups.values()}) < len(texts)
        elif name == "suffix dedup":
            assert kept[name] == before.count() and docs.columns == before.columns
        elif name == "mixing":
            assert docs.columns == before.columns and distinct(docs) <= distinct(before)
    assert kept["bpe"] == kept["mixing"] > 0


def test_registered():
    queries = entry.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
