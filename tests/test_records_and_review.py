import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, scratch_path
from tagweave.operators import clean as cl
from tagweave.operators import features as fe
from tagweave.operators import reports as re
from tagweave.operators import review as rv
from tagweave.operators import scoring as sc
from tagweave.operators import taxonomy as tx
from tagweave.sources import artifacts as ar
from tagweave.sources import records as so
from tagweave.sources import sinks
from tagweave.spec import RoleSpec


def test_csv_reads_missing_spellings_as_null_and_casts(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('tran_partclr,tran_type,tran_amt_in_ac\n"tea, ""hot""",NULL,12.5\nn/a,UPI,\nNone,nan,7\n', encoding="utf8")
    df = so.read_records(spark, str(path), "tran_amt_in_ac double")
    rows = [tuple(r) for r in cl.normalise_columns(df).collect()]
    assert cl.normalise_columns(df).columns == ["tran_partclr", "tran_mode", "tran_amt_in_ac"]
    assert rows == [('tea, "hot"', None, 12.5), (None, "UPI", None), (None, None, 7.0)]


def test_an_alias_never_makes_a_second_column(spark):
    df = spark.createDataFrame([("a", "b")], "tran_type string, tran_mode string")
    assert cl.normalise_columns(df).columns == ["tran_type", "tran_mode"]


def test_checks_raise(spark):
    df = spark.createDataFrame([("a", 1)], "category string, x int")
    with pytest.raises(ValueError, match="tran_amt_in_ac"):
        cl.require_columns(df, ["tran_amt_in_ac"])
    with pytest.raises(ValueError, match="no rows"):
        cl.require_rows(df.filter("x > 1"))
    with pytest.raises(ValueError, match="unknown categories.*a"):
        cl.require_known_categories(df, spark.createDataFrame([("b",)], "category string"))
    assert cl.require_known_categories(df, df) is df
    with pytest.raises(FileNotFoundError):
        ar.load_corpus(spark, scratch_path(spark))


def test_constant_and_missing_numbers(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "a double, b double")
    scaler = fe.fit_scaler(df, ["a", "b"])
    rows = fe.scale_numeric(df, scaler, ["a", "b"]).collect()
    assert [r.a_scaled for r in rows] == [0.0, 0.0, 0.0]
    assert [r.b_scaled for r in rows] == [-1.0, -2.0, 1.0]


def test_encoding_is_unit_length_and_whole_text(spark):
    roles = RoleSpec("t", ("m",), ("x",), "category", "id")
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame(
        [(1, "tea", "UPI", 1.0, "a"), (2, "", None, 2.0, "b"), (3, None, "new", 3.0, "a"), (4, long, "UPI", 4.0, "a"), (5, long + " end", "UPI", 4.0, "a")],
        "id bigint, t string, m string, x double, category string",
    )
    made = fe.transform(df, fe.fit(df, roles, {"m": ["UPI", "NULL"]})).orderBy("id").collect()
    assert all(sum(v * v for v in r.embedding) == pytest.approx(1.0, abs=1e-4) for r in made)
    assert made[3].embedding != made[4].embedding  # the last word of 5,001 counts
    assert [r.label_id for r in made] == [0, 1, 0, 0, 0]


RESPONSES = {
    "Rent": "Rent", "  rent.  ": "Rent", "thinking\nCategory: 'Education'": "Education",
    "CATEGORY - p2p\n\n": "P2P", "": "other", "   \n": "other", "food": "Food_restaurants",
    "it is surely Salary or Rent": "Rent", "no idea": "other", "Other": "other", "category:": "other",
}


def test_parse_rules(spark):
    df = spark.createDataFrame([(i, 1, r) for i, r in enumerate(RESPONSES)], "query_id bigint, run int, response string")
    rows = rv.parse_responses(df, tx.description_table(spark)).orderBy("query_id").collect()
    assert {r.response: r.label for r in rows} == RESPONSES


def by_scan(said: str, names: list[str]) -> str:
    """Every name against the answer."""
    exact = [n for n in names if n.lower() == said]
    partial = [n for n in names if n.lower() in said or said in n.lower()]
    return "other" if said in ("", "other") else exact[-1] if exact else partial[0] if partial else "other"


@pytest.mark.parametrize("n", [300, 100_000])
def test_answers_meet_only_names_that_share_a_rare_piece(spark, n):
    rng = np.random.default_rng(n)
    made = {"".join(rng.choice(list("abcdeé "), int(rng.integers(1, 12)))).strip() for _ in range(n if n < 1000 else 300)} - {""}
    made |= {f"Class {k:06d}" for k in range(n if n > 1000 else 0)} | {"A", "a", "Ab", "🙂x", "x🙂yz"}
    names = sorted(made)
    answers = [made_of for _ in range(60 if n < 1000 else 8) for made_of in (
        names[int(rng.integers(len(names)))], "so " + names[int(rng.integers(len(names)))] + " it is", names[int(rng.integers(len(names)))][1:4], "".join(rng.choice(list("abé "), 5)))]
    answers += ["class 000123", "000123", "lass 0999", "zzz", "🙂", "a" * 5000, "hot"] + ["hot"] * 300
    rows = spark.createDataFrame([(k, 1, a) for k, a in enumerate(answers)], "query_id long, run int, response string")
    table = spark.createDataFrame([(c,) for c in names], "category string")
    got = {r["query_id"]: r["label"] for r in rv.parse_responses(rows, table).collect()}
    clean = {r["query_id"]: r["said"] for r in rows.select("query_id", F.lower(rv.answer_line(F.col("response"))).alias("said")).collect()}
    known = {}
    for k in got:
        said = clean[k] or ""
        if said not in known:
            known[said] = by_scan(said, names)
        assert got[k] == known[said], (said, got[k])
    few = spark.createDataFrame([(c,) for c in names[:200]], "category string")
    one, two = ({r["query_id"]: r["label"] for r in rv.parse_responses(rows, few, most).collect()} for most in (0, 200))
    assert one == two and len(set(one.values())) > 1
    plan = rv.parse_responses(rows, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan


def test_a_failed_call_says_why(spark):
    def make():
        def provider(prompt: str, temperature: float) -> str:
            if prompt == "bad":
                raise TimeoutError("no answer in time")
            return "Rent"

        return provider

    asked = spark.createDataFrame([(1, 1, "good", 0.0), (2, 1, "bad", 0.0)], "query_id long, run int, prompt string, temperature double")
    got = {r["query_id"]: (r["response"], r["error"]) for r in rv.respond(asked, make).collect()}
    assert got == {1: ("Rent", None), 2: (None, "TimeoutError: no answer in time")}


def test_prompts_of_a_batch_become_strings_part_by_part(spark):
    def make():
        return lambda prompt, temperature: str(len(prompt)) if temperature else None

    n = 2 * rv.ASKED_ROWS + 3
    asked = spark.range(n).coalesce(1).selectExpr("if(id = 5, null, id) AS query_id", "cast(id % 3 AS int) AS run", "repeat('é', cast(id AS int)) AS prompt", "cast(id % 2 AS double) AS temperature")
    answers = rv.respond(asked, make)
    got = [(r["query_id"], r["run"], r["response"], r["error"]) for r in answers.collect()]
    assert got == [(None if i == 5 else i, i % 3, str(i) if i % 2 else None, None) for i in range(n)]
    assert "MapInArrow" in answers._jdf.queryExecution().executedPlan().toString()


def test_from_stored_rows_to_answers_nothing_is_shuffled(spark):
    """Neither the rows to review nor the records shown in their prompts; rows that share an id are no exception."""
    near = lambda *ids: [(k, i, 0, 0.1 * k) for k, i in enumerate(ids, 1)]
    kind = "tran_partclr string, tran_amt_in_ac double, dr_cr_indctor string, tran_mode string, category string"
    rows = [(q, "a", c, near(*ids), f"own {q}", 1.0, "D", None, "a") for q, c, ids in ((1, 0.3, (10, 11)), (2, 0.5, (11,)), (2, 0.5, (12,)), (3, 0.5, ()), (4, 0.5, (99,)))]
    scored = cut_lineage(spark.createDataFrame(rows, f"query_id long, predicted_category string, confidence double, neighbours array<struct<rk: int, golden_id: long, label_id: int, d2: double>>, {kind}"))
    golden = spark.createDataFrame([(i, f"shown {i}", 2.0, "C", "UPI", "a") for i in (10, 11, 12)], f"golden_id long, {kind}")
    made = sc.with_similar(scored, golden, {"description": "tran_partclr", "amount": "tran_amt_in_ac", "dr_cr": "dr_cr_indctor", "mode": "tran_mode", "category": "category"})
    asked = rv.run_policy(rv.build_prompts(made, spark.createDataFrame([("a",)], "category string")), high_value=1e12)
    shown = lambda: lambda prompt, temperature: " ".join(w for w in ("10", "11", "12", "99") if f"shown {w}" in prompt)
    answers = rv.respond(asked, shown)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["run"], r["response"], r["error"]) for r in answers.collect()) == [
        (1, 1, "10 11", None), (2, 1, "11 12", None), (2, 1, "11 12", None), (3, 1, "", None), (4, 1, "", None),
    ]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_majority_and_merge(spark):
    runs = spark.createDataFrame(
        [(1, 1, "x", "A"), (1, 2, "y", "B"), (1, 3, "z", "B"), (2, 1, "x", "B"), (2, 2, "y", "A"), (3, 1, None, "other"), (4, 1, "o", "other")],
        "query_id bigint, run int, response string, label string",
    )
    voted = rv.majority_vote(runs)
    assert {r.query_id: (r.label, r.responses) for r in voted.collect()} == {
        1: ("B", ["x", "y", "z"]), 2: ("B", ["x", "y"]), 4: ("other", ["o"])
    }
    kept = spark.createDataFrame([(i, "K", 0.3) for i in range(1, 6)], "query_id bigint, predicted_category string, confidence double")
    out = {r.query_id: (r.predicted_category, r.confidence, r.llm_overridden) for r in rv.merge_review(kept, voted).collect()}
    assert out == {1: ("B", 1.0, True), 2: ("B", 1.0, True), 3: ("K", 0.3, False), 4: ("other", 0.0, True), 5: ("K", 0.3, False)}


def test_high_value_needs_more_than_the_limit(spark):
    df = spark.createDataFrame([(1, 50_000.0, 0.39), (2, 50_000.01, 0.4)], "query_id bigint, tran_amt_in_ac double, confidence double")
    rows = [(r.query_id, r.run, r.n_runs, r.temperature, r.use_steps) for r in rv.run_policy(df).collect()]
    assert rows == [(1, 1, 1, 0.0, True)] + [(2, i, 3, 0.3, False) for i in (1, 2, 3)]


def test_taxonomy_layers_and_new_category(spark):
    table = tx.taxonomy(tx.description_table(spark, {"A": "tea", "B": "bus"}), tx.description_table(spark, {"B": "train"}))
    assert {r.category: r.description for r in table.collect()} == {"A": "tea", "B": "train"}
    spec = fe.EncoderSpec(text_dim=64)
    more = tx.add_category(tx.embed_taxonomy(table, spec), "C", "coffee beans", spec)
    q = spark.createDataFrame([(1, "coffee beans")], "query_id bigint, t string")
    scored = tx.with_taxonomy_scores(fe.text_vector(q, "t", spec, "embedding"), more)
    assert tx.taxonomy_predict(scored).first().category == "C"


def test_routes_cover_every_row_once(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "query_id bigint, needs_llm boolean")
    auto, review = sinks.route(df)
    assert [r.query_id for r in auto.collect()] == [2]
    assert sorted(r.query_id for r in review.collect()) == [1, 3]


def test_bars_and_last_suspicious_hit(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 3), ("c", 0)], "category string, n bigint")
    assert [len(r.bar) for r in re.class_bars(counts, "category").collect()] == [40, 1, 0]
    rows = [(1, "X", "Y", 1, 7, "Y", 0.1), (2, "X", "Y", 2, 7, "Y", 0.2), (2, "X", "Y", 1, 8, "X", 0.1), (3, "X", "X", 1, 7, "Y", 0.3)]
    df = spark.createDataFrame(rows, "query_id bigint, expected string, predicted string, rk int, golden_id bigint, label string, d2 double")
    out = [tuple(r) for r in re.suspicious_golden(df).collect()]
    assert out == [(7, "Y", 2, "X", 0.2, 2)]


@pytest.mark.parametrize("reader", ["read_examples", "read_ood_examples", "read_descriptions"])
def test_broken_json_stops_the_job(spark, tmp_path, reader):
    from tagweave.sources import records as rec

    (tmp_path / "broken.json").write_text('{"Rent": [{"tran_partclr": "a"')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        getattr(rec, reader)(spark, str(tmp_path / "broken.json")).collect()


def test_encoder_settings_are_saved_and_categories_keep_apart(spark):
    from tagweave.operators import features as fe
    from tagweave.sources import artifacts as ar
    from tagweave.spec import RoleSpec

    roles = RoleSpec("text", ("mode",), ("amount",), "category", "id")
    rows = [(i, f"word{i}", f"mode{i:02d}", float(i), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, mode string, amount double, category string")
    fitted = fe.fit(df, roles, {}, fe.EncoderSpec(text_dim=8, numeric_weight=0.0, prompt="p "))
    folder = scratch_path(spark)
    ar.save_artifacts(fitted, folder)
    loaded = ar.load_artifacts(spark, folder)
    assert loaded.encoder == fitted.encoder
    same = df.withColumn("text", F.lit("x"))
    for state in (fitted, loaded):
        vectors = {tuple(r.embedding) for r in fe.transform(same, state).collect()}
        assert len(vectors) == 40  # 41 ids with the unknown one, each with its own place


def test_where_reaches_the_scan_and_the_encoder_runs_once(spark):
    from tagweave.operators import features as fe
    from tagweave.plans.tagging import BuildSpec, build_corpus, predict

    path = "/root/testdata/sf0.001/embeddings.parquet"
    vectors = spark.read.parquet(path).select(F.col("vec_id").alias("golden_id"), F.col("label").alias("label_id"), "embedding")
    names = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "label_id int, category string")
    built = build_corpus(vectors, names, spec=BuildSpec(cap_method="hash"))
    asked = spark.read.parquet(path).withColumnRenamed("vec_id", "query_id")
    plan = predict(asked, built, where=F.col("query_id") == 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vec_id,5)" in plan
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n", F.lit(1.0))
    from tagweave.spec import RoleSpec

    roles = RoleSpec("text", ("source",), ("n",), "lang", "doc_id")
    fitted = fe.fit(docs, roles, {})
    coded = fe.encode(docs, roles, fitted.vocab, fitted.scaler, stored=True, where=F.col("doc_id") == 5)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and plan.count("ArrowEvalPython") == 1


def test_names_of_a_label_table_too_large_for_a_map(spark, monkeypatch):
    from tagweave.operators import scoring as sc

    rows = [(1, 2, [(2, 0.75), (3, 0.25)], [(3, 0.5), (2, 0.7)]), (2, None, [], [])]
    df = spark.createDataFrame(rows, "query_id bigint, predicted_label_id int, vote array<struct<label_id:int,share:double>>, neighbours array<struct<label_id:int,d2:double>>")
    labels = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "label_id int, category string")
    shown = ["query_id", "predicted_category", "vote_distribution", "top_k_labels"]
    want = sorted(map(str, sc.with_names(df, labels).select(shown).collect()))
    monkeypatch.setattr(sc, "MAX_LABELS", 2)
    assert sorted(map(str, sc.with_names(df, labels).select(shown).collect())) == want
