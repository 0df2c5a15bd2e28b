import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from tagweave.functions.session import scratch_path
from tagweave.plans.tagging import BuildSpec, build_corpus, predict
from tagweave.sources import artifacts as ar
from tagweave.sources.records import read_records_checked
from tagweave.streaming.scoring import score_stream
from tests.test_neighbours import as_queries, corpus


def built(spark, seed: int, n: int = 40):
    rng = np.random.default_rng(seed)
    g = corpus(spark, [(i, i % 3, rng.normal(size=4).tolist()) for i in range(n)])
    names = spark.createDataFrame([(i, f"seed{seed} c{i}") for i in range(3)], "label_id int, category string")
    return build_corpus(g, names, spec=BuildSpec(cap_method="hash"))


def labels(corpus) -> set:
    return {r["category"] for r in corpus.labels.collect()}


def test_a_save_that_dies_between_tables_leaves_the_old_version(spark, monkeypatch):
    folder = scratch_path(spark)
    first = ar.save_corpus(built(spark, 1), folder)
    write = DataFrameWriter.parquet

    def dies(self, path, *args, **options):
        if path.endswith("/labels"):
            raise OSError("the writer is gone")
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(OSError, match="gone"):
        ar.save_corpus(built(spark, 2), folder, "overwrite")
    monkeypatch.undo()
    assert ar.corpus_versions(spark, folder) == [first]
    assert labels(ar.load_corpus(spark, folder)) == {f"seed1 c{i}" for i in range(3)}
    third = ar.save_corpus(built(spark, 3), folder, "overwrite")
    assert third > first and labels(ar.load_corpus(spark, folder)) == {f"seed3 c{i}" for i in range(3)}
    assert labels(ar.load_corpus(spark, folder, version=first)) == {f"seed1 c{i}" for i in range(3)}
    assert ar.prune_corpus(spark, folder, 1) == [first]
    files, at = ar._files(spark, f"{folder}/versions")
    assert [f.getPath().getName() for f in files.listStatus(at)] == [third]  # the dead writer's tables are gone, too


def test_modes(spark):
    folder = scratch_path(spark)
    with pytest.raises(FileNotFoundError):
        ar.load_corpus(spark, folder)
    first = ar.save_corpus(built(spark, 1), folder)
    with pytest.raises(FileExistsError):
        ar.save_corpus(built(spark, 2), folder)
    assert ar.save_corpus(built(spark, 2), folder, "ignore") == first
    with pytest.raises(ValueError):
        ar.save_corpus(built(spark, 2), folder, "append")
    with pytest.raises(FileNotFoundError, match="ball"):
        ar.load_corpus(spark, folder, ("ball",))


def test_every_index_is_saved_with_its_effort(spark):
    folder, kept = scratch_path(spark), built(spark, 5, 120)
    kept.index("ivf", n_cells=6), kept.index("lsh"), kept.index("ball", n_cells=5, leaf_rows=4)
    ar.save_corpus(kept, folder)
    loaded = ar.load_corpus(spark, folder, ("ivf", "lsh", "ball"))
    assert loaded.index("ivf").probes == kept.index("ivf").probes and loaded.index("lsh").noise == kept.index("lsh").noise
    asked = as_queries(kept.golden)
    for kind in ("ivf", "lsh", "ball"):
        answers = [sorted((r["query_id"], r["predicted_category"], str(r["neighbours"])) for r in predict(asked, c, 4, index=kind).collect()) for c in (kept, loaded)]
        assert answers[0] == answers[1]


def test_a_running_stream_takes_up_a_new_version_as_a_whole(spark):
    folder, path = scratch_path(spark), scratch_path(spark)
    ar.save_corpus(built(spark, 1), folder)
    current = ar.latest_corpus(spark, folder)
    asked = as_queries(built(spark, 1).golden)

    def batch(seed: int) -> set:
        asked.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(asked.schema).parquet(f"{path}/in")
        score_stream(stream, current, f"{path}/auto", f"{path}/review", f"{path}/state", k=3).awaitTermination()
        rows = spark.read.parquet(f"{path}/auto").unionByName(spark.read.parquet(f"{path}/review"), allowMissingColumns=True)
        return {r["predicted_category"].split()[0] for r in rows.filter(f"batch = {seed - 1}").collect() if r["predicted_category"] != "other"}

    assert batch(1) == {"seed1"}
    held = current()
    assert current() is held
    ar.save_corpus(built(spark, 2), folder, "overwrite")
    assert batch(2) == {"seed2"} and current() is not held


# --- bad rows -------------------------------------------------------------------------

SCHEMA = "id long not null, amount double, day date, note string"


def csv(spark, *lines: str) -> str:
    path = scratch_path(spark)
    spark.createDataFrame([("\n".join(["id,amount,day,note,extra", *lines]),)], "value string").coalesce(1).write.text(path)
    return path


def test_bad_rows_are_set_aside_with_every_reason(spark):
    path = csv(spark, "1,2.5,2024-01-31,fine,x", "2,NULL,,,", "3,abc,2024-13-01,two reasons,x", ",1,2024-01-01,no id,x", "5,1", '6,1e3,2024-02-29,"a, ""b""",x', "7,1,2024-01-01,n,x,y")
    found = read_records_checked(spark, path, SCHEMA, most_bad=0.9)
    assert (found.n_rows, found.n_bad) == (7, 4)
    good = {r["id"]: r for r in found.good.collect()}
    assert set(good) == {1, 2, 6} and good[2]["amount"] is None and good[6]["note"] == 'a, "b"' and good[1]["extra"] == "x"
    assert dict(found.good.dtypes)["day"] == "date"
    bad = {r["cells"]["note"]: r["reasons"] for r in found.bad.collect()}
    assert bad["two reasons"] == ["amount is no double: abc", "day is no date: 2024-13-01"]
    assert bad["no id"] == ["id is missing"]
    assert bad[None] == ["the line has another number of cells"] and bad["n"] == ["the line has another number of cells"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_too_many_bad_rows_stop_the_job_in_any_session(spark, ansi):
    path = csv(spark, *[f"{i},{'x' if i % 4 == 0 else i},2024-01-01,n,x" for i in range(1, 41)])
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(ValueError, match=r"10 of 40 rows .*amount is no double \(10\)"):
            read_records_checked(spark, path, SCHEMA)
        assert read_records_checked(spark, path, SCHEMA, most_bad=0.25).good.count() == 30
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_a_missing_column_is_an_error_and_an_empty_file_is_empty(spark):
    with pytest.raises(ValueError, match="other"):
        read_records_checked(spark, csv(spark, "1,1,,,"), SCHEMA + ", other int")
    found = read_records_checked(spark, csv(spark), SCHEMA)
    assert (found.good.count(), found.bad.count(), found.n_rows) == (0, 0, 0)


def test_a_broadcast_is_hinted_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from tagweave.functions.session import bounded

    wide = spark.range(200).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string"))))).alias("text"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(bounded(wide)) and not hinted(bounded(wide, max_rows=199)) and not hinted(bounded(wide, max_bytes=100_000))
