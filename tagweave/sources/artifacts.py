"""Save and load fitted state and the golden corpus as tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.balls import BallIndex
from tagweave.operators.features import Artifacts, EncoderSpec, vocab_sizes
from tagweave.operators.neighbours import CellIndex
from tagweave.plans.tagging import Corpus
from tagweave.spec import RoleSpec

ARTIFACT_TABLES = ("vocab", "scaler", "labels", "counts")


def save_artifacts(artifacts: Artifacts, folder: str, mode: str = "errorifexists") -> None:
    """One parquet table per part and a one-row JSON table with the configuration."""
    for name in ARTIFACT_TABLES:
        getattr(artifacts, name).write.mode(mode).parquet(f"{folder}/{name}")
    sizes = vocab_sizes(artifacts.vocab).agg(F.map_from_entries(F.collect_list(F.struct("col", "size"))).alias("s"))
    roles = asdict(artifacts.roles)
    encoder = F.struct(*[F.lit(v).alias(k) for k, v in asdict(artifacts.encoder).items() if v is not None])
    config = sizes.select(
        *[
            (F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)).alias(k)
            for k, v in roles.items()
        ],
        F.col("s").alias("categorical_dims"),
        encoder.alias("encoder"),
        artifacts.labels.agg(F.count(F.lit(1))).scalar().alias("num_categories"),
    )
    config.write.mode(mode).json(f"{folder}/config")


def load_artifacts(spark: SparkSession, folder: str) -> Artifacts:
    config = spark.read.json(f"{folder}/config").first()
    roles = RoleSpec(config["text"], tuple(config["categorical"]), tuple(config["numeric"]), config["label"], config["id"])
    tables = [spark.read.parquet(f"{folder}/{name}") for name in ARTIFACT_TABLES]
    return Artifacts(roles, *tables, EncoderSpec(**config["encoder"].asDict())).stored()


# --- A corpus in whole versions -------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def corpus_versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole versions in a folder, oldest first."""
    files, at = _files(spark, f"{folder}/manifests")
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def _write_manifest(spark: SparkSession, folder: str, version: str, content: dict) -> None:
    """One small file, under its name only when it is whole."""
    files, final = _files(spark, f"{folder}/manifests/{version}.json")
    _, unfinished = _files(spark, f"{folder}/manifests/.{version}.tmp")
    out = files.create(unfinished, True)
    try:
        out.write(bytearray(json.dumps(content), "utf-8"))
    finally:
        out.close()
    if not files.rename(unfinished, final):
        raise OSError(f"the manifest {final} could not be written")


def save_corpus(corpus: Corpus, folder: str, mode: str = "errorifexists") -> str:
    """Write a new version of a corpus and return its name.

    The tables of a version have a folder of their own, and a manifest written last names them.  Whoever reads sees a version
    as a whole or not at all, also while it is written or if the writer dies; older versions stay until ``prune_corpus``.
    ``overwrite`` puts a version after those there are, ``errorifexists`` and ``ignore`` only write the first.
    """
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError("mode must be errorifexists, overwrite or ignore")
    spark = corpus.labels.sparkSession
    known = corpus_versions(spark, folder)
    if known and mode == "ignore":
        return known[-1]
    if known and mode == "errorifexists":
        raise FileExistsError(f"{folder} holds the corpus version {known[-1]}")
    files, at = _files(spark, f"{folder}/versions")
    begun = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []  # also by dead writers
    number = 1 + max((int(name.split("-")[0]) for name in [*known, *begun]), default=0)
    version = f"{number:09d}-{uuid.uuid4().hex[:12]}"
    base = f"{folder}/versions/{version}"
    golden = corpus.golden.hint("rebalance", "label_id")  # by label, skewed labels split
    golden.write.partitionBy("label_id").parquet(f"{base}/golden")
    corpus.prototypes.write.parquet(f"{base}/prototypes")
    corpus.labels.write.parquet(f"{base}/labels")
    indexes = {kind: _save_index(index, f"{base}/index_{kind}") for kind, index in corpus.indexes.items()}
    _write_manifest(spark, folder, version, {"ood_threshold": corpus.ood_threshold, "indexes": indexes})
    return version


def _save_index(index: CellIndex | BallIndex, base: str) -> dict:
    """Write the tables of an index; its settings for the manifest."""
    if isinstance(index, BallIndex):
        index.rows.repartition("leaf").sortWithinPartitions("leaf").write.parquet(f"{base}/rows")
        index.leaves.write.parquet(f"{base}/leaves")
        numbers, settings = index.centres[None], {"radii": index.radii.tolist(), "counts": index.counts.tolist(), "by_label": index.by_label}
        spark = index.rows.sparkSession
    else:
        index.cells.repartition("cell").sortWithinPartitions("cell").write.parquet(f"{base}/cells")
        numbers = index.centres[None] if index.kind == "ivf" else index.planes
        settings = {"probes": index.probes, "shrink": index.shrink, "noise": index.noise, "miss": index.miss}
        spark = index.cells.sparkSession
    rows = [(t, b, row.tolist()) for t, table in enumerate(numbers) for b, row in enumerate(table)]
    spark.createDataFrame(rows, "t int, b int, v array<double>").write.parquet(f"{base}/numbers")
    return settings


def _load_index(spark: SparkSession, kind: str, base: str, settings: dict) -> CellIndex | BallIndex:
    rows = sorted(_table(spark, f"{base}/numbers").collect(), key=lambda r: (r["t"], r["b"]))  # centres or planes, as when they were made
    tables = 1 + max(r["t"] for r in rows)
    numbers = np.array([r["v"] for r in rows]).reshape(tables, len(rows) // tables, -1)
    if kind == "ball":
        radii, counts = np.array(settings["radii"]), np.array(settings["counts"], np.int64)
        return BallIndex(numbers[0], radii, counts, _table(spark, f"{base}/leaves"), _table(spark, f"{base}/rows"), settings["by_label"])
    return CellIndex(kind, _table(spark, f"{base}/cells"), numbers[0] if kind == "ivf" else None, numbers if kind == "lsh" else None, **settings)


def _table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        raise FileNotFoundError(f"the corpus has no readable table at {path}") from error


def load_corpus(spark: SparkSession, folder: str, indexes: tuple[str, ...] = (), version: str | None = None) -> Corpus:
    """Read a version of a saved corpus, the latest if none is named, and the named ones of its kept indexes.

    A missing part is an error.
    """
    known = corpus_versions(spark, folder)
    if not known or (version or known[-1]) not in known:
        raise FileNotFoundError(f"{folder} holds no whole corpus{f' version {version}' if version else ''}")
    version = version or known[-1]
    manifest = json.loads(spark.read.text(f"{folder}/manifests/{version}.json", wholetext=True).first()["value"])
    base = f"{folder}/versions/{version}"
    golden = _table(spark, f"{base}/golden").withColumn("label_id", F.col("label_id").cast("int"))
    corpus = Corpus(golden, _table(spark, f"{base}/prototypes"), _table(spark, f"{base}/labels"), manifest["ood_threshold"])
    for kind in indexes:
        if kind not in manifest["indexes"]:
            raise FileNotFoundError(f"version {version} was saved without its {kind} index")
        corpus.indexes[kind] = _load_index(spark, kind, f"{base}/index_{kind}", manifest["indexes"][kind])
    return corpus


def latest_corpus(spark: SparkSession, folder: str, indexes: tuple[str, ...] = ()) -> Callable[[], Corpus]:
    """A function that gives the latest whole version, read anew only when there is a newer one."""
    held: dict[str, Corpus] = {}

    def current() -> Corpus:
        version = (corpus_versions(spark, folder) or [None])[-1]
        if version is None or version not in held:
            corpus = load_corpus(spark, folder, indexes, version)
            held.clear()
            held[version] = corpus
        return held[version]

    return current


def prune_corpus(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove all but the latest ``keep`` versions, and what dead writers before them left; the names removed."""
    if keep < 1:
        raise ValueError("the latest version stays")
    known = corpus_versions(spark, folder)
    gone, stay = known[:-keep], known[-keep:]
    for version in gone:  # first unnamed, then removed
        files, at = _files(spark, f"{folder}/manifests/{version}.json")
        files.delete(at, False)
    files, at = _files(spark, f"{folder}/versions")
    if stay and files.exists(at):
        for found in files.listStatus(at):
            if found.getPath().getName() < stay[0]:  # a writer begun after that version has a higher number
                files.delete(found.getPath(), True)
    return gone
