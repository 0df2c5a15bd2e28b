"""Encoding, tagging, reports, review queue and taxonomy over the documents table."""

from pyspark.sql import functions as F

from catalog import Catalog
from catalog import tables as t
from tagweave import fixed_values as fixed
from tagweave.functions.session import cut_lineage, scratch_path
from tagweave.functions.text import token_buckets, tokens
from tagweave.operators.blocks import ScanLimits
from tagweave.operators import features as fe
from tagweave.operators import neighbours as nb
from tagweave.operators import reports as re
from tagweave.operators import review as rv
from tagweave.operators import scoring as sc
from tagweave.operators import taxonomy as tx
from tagweave.plans.tagging import BuildSpec, build_from_records, predict
from tagweave.sources import records as so
from tagweave.sources import sinks
from tagweave.spec import RoleSpec

C = Catalog()

ROLES = RoleSpec("tran_partclr", ("tran_mode",), ("tran_amt_in_ac",), "category", "record_id")


def documents(spark, folder):
    """Documents in the columns of a transaction; French plays the OOD label."""
    docs = so.widen(t.table(spark, folder, "documents"))
    return docs.select(
        F.col("doc_id").alias("record_id"),
        F.concat(F.lit("c"), (F.col("doc_id") % 97).cast("string")).alias("cust_id"),
        F.col("lang").alias("tran_date"),
        F.col("text").alias("tran_partclr"),
        F.when(F.col("n_chars") % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("tran_mode"),
        F.when(F.col("n_chars") % 2 == 0, "D").otherwise("C").alias("dr_cr_indctor"),
        F.col("n_chars").cast("double").alias("tran_amt_in_ac"),
        F.when(F.col("lang") == "fr", fixed.OOD_LABEL).otherwise(F.col("lang")).alias("category"),
    )


D = """
r AS MATERIALIZED (
  SELECT doc_id AS record_id, 'c' || (doc_id % 97) AS cust_id, lang AS tran_date, text AS tran_partclr,
    CASE WHEN n_chars % 7 = 0 THEN NULL ELSE source END AS tran_mode,
    CASE WHEN n_chars % 2 = 0 THEN 'D' ELSE 'C' END AS dr_cr_indctor,
    n_chars::DOUBLE AS tran_amt_in_ac, CASE WHEN lang = 'fr' THEN 'other' ELSE lang END AS category FROM documents)"""


def words(text: str, source: str = "r", id_col: str = "record_id") -> str:
    return f"""
words AS MATERIALIZED (
  SELECT {id_col}, unnest(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w
  FROM {source})"""


def dense(dim: int, source: str = "r", id_col: str = "record_id") -> str:
    return f"""
hashed AS MATERIALIZED (
  SELECT {id_col}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS n FROM words GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT {id_col}, list(coalesce(n, 0)::DOUBLE ORDER BY bucket) AS c
  FROM (SELECT {id_col}, range AS bucket FROM {source} CROSS JOIN range({dim})) LEFT JOIN hashed USING ({id_col}, bucket)
  GROUP BY {id_col}),
total AS MATERIALIZED (SELECT {id_col}, c, greatest(list_sum(c), 1) AS total FROM dense),
mean AS MATERIALIZED (SELECT {id_col}, {t.scaled('c', 'total')} AS p FROM total),
pooled AS MATERIALIZED (SELECT {id_col}, p, {t.length('p')} AS len FROM mean)"""


FUSED = f"""
known AS MATERIALIZED (SELECT * FROM r WHERE category <> 'other'),
fresh AS (
  SELECT tran_mode, row_number() OVER (ORDER BY tran_mode) + 13 AS id
  FROM (SELECT DISTINCT tran_mode FROM known WHERE tran_mode IS NOT NULL)),
scaler AS (SELECT avg(tran_amt_in_ac) AS mean, stddev_pop(tran_amt_in_ac) AS std FROM known),
coded AS MATERIALIZED (
  SELECT record_id, CASE WHEN tran_mode IS NULL THEN 13 ELSE coalesce(id, 0) END AS mode_id,
    (tran_amt_in_ac - mean) / std AS scaled, width
  FROM r CROSS JOIN scaler CROSS JOIN (SELECT greatest(16, coalesce(max(id), 13) + 1) AS width FROM fresh) LEFT JOIN fresh USING (tran_mode)),
fused AS MATERIALIZED (
  SELECT record_id, {t.scaled('p', 'len')} || [CASE WHEN i = mode_id THEN 0.25 ELSE 0.0 END FOR i IN range(width)]
    || [scaled * 0.1] AS f
  FROM pooled JOIN coded USING (record_id)),
sized AS MATERIALIZED (SELECT record_id, f, {t.length('f')} AS len FROM fused),
v AS MATERIALIZED (
  SELECT record_id AS id, category, ({t.scaled('f', 'len')})::FLOAT[]::DOUBLE[] AS v FROM sized JOIN r USING (record_id))"""
ENCODED = (D, words("tran_partclr"), dense(256), FUSED)


def fitted(spark, folder):
    rows = documents(spark, folder)
    return rows, fe.fit(rows.filter(F.col("category") != fixed.OOD_LABEL), ROLES)


@C.add(
    "tokenise",
    t.with_(
        D, words("tran_partclr"),
        select="""SELECT record_id, count(w) AS n, count(DISTINCT w) AS distinct_n, coalesce(max(w), '') AS last
FROM r LEFT JOIN words USING (record_id) GROUP BY record_id""",
    ),
)
def tokenise(spark, folder):
    rows = fe.tokenise(documents(spark, folder), "tran_partclr")
    return rows.select(
        "record_id",
        F.size("tokens").cast("bigint").alias("n"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("distinct_n"),
        F.coalesce(F.array_max("tokens"), F.lit("")).alias("last"),
    )


@C.add(
    "token_buckets",
    t.with_(D, words("tran_partclr"), dense(256), select="SELECT bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM hashed GROUP BY bucket"),
)
def token_bucket_counts(spark, folder):
    hashed = documents(spark, folder).select(F.explode(token_buckets(tokens(F.col("tran_partclr")), 256)).alias("bucket"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@C.add(
    "prompt_text",
    t.with_(D, select=f"SELECT record_id, md5('{fixed.TEXT_PROMPT}' || tran_partclr) AS digest FROM r"),
)
def prompt_text(spark, folder):
    return documents(spark, folder).select("record_id", F.md5(fe.prompt_text(F.col("tran_partclr"))).alias("digest"))


def entries(df, column):
    rows = df.select("record_id", F.posexplode(column).alias("pos", "value")).filter(F.col("value") != 0)
    return rows.select("record_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


@C.add(
    "pool_tokens",
    t.with_(
        D, words("tran_partclr"), dense(256),
        select="""SELECT record_id, (pos - 1)::INTEGER AS pos, round(value, 5) AS value
FROM (SELECT record_id, unnest(p) AS value, generate_subscripts(p, 1) AS pos FROM pooled) WHERE value <> 0""",
    ),
)
def pool_tokens(spark, folder):
    rows = documents(spark, folder)
    return entries(rows.withColumn("p", fe.pool_tokens(tokens(F.col("tran_partclr")), 256)), "p")


@C.add(
    "encode",
    t.with_(
        *ENCODED,
        select="""SELECT id AS record_id, (pos - 1)::INTEGER AS pos, round(value, 5) AS value
FROM (SELECT id, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM v) WHERE value <> 0""",
    ),
)
def encode(spark, folder):
    rows, artifacts = fitted(spark, folder)
    return entries(fe.encode(rows, ROLES, artifacts.vocab, artifacts.scaler, stored=True), "embedding")


@C.add(
    "encode_with_model",
    t.with_(D, select="""SELECT record_id, length(tran_partclr)::DOUBLE AS a, tran_amt_in_ac AS b FROM r"""),
)
def encode_with_model(spark, folder):
    """The plug point for a user's encoder: here text length and amount."""

    def load():
        import numpy as np

        def model(text, amount):
            return np.stack([[len(x) for x in text], amount], axis=1).astype("float32")

        return model

    coded = fe.encode_with(documents(spark, folder), load, [F.col("tran_partclr"), F.col("tran_amt_in_ac")])
    return coded.select(
        "record_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b")
    )


# --- Tagging: every document against the capped corpus of all others -----------------------

WIDTH = 256 + 64 + 1  # zeros beyond the vector's own width change no distance
CAP = 150
LABELS = "labels_d AS (SELECT category, (row_number() OVER (ORDER BY category) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT category FROM known))"


def near(k: int, asked: str, corpus: str, name: str) -> str:
    """Top-k: candidates by the array function, ranked by the sum in position order."""
    return f"""
{name}_c AS MATERIALIZED (
  SELECT q.id AS query_id, g.id AS golden_id, g.label_id, array_distance(q.a, g.a) AS about
  FROM {asked} q JOIN {corpus} g ON q.id <> g.id
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY about) <= {k + 20}),
{name}_e AS MATERIALIZED (
  SELECT query_id, golden_id, c.label_id, {t.d2('q.v', 'g.v')} AS d2
  FROM {name}_c c JOIN vectors q ON q.id = query_id JOIN vectors g ON g.id = golden_id),
{name} AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY d2, golden_id))::INTEGER AS rk FROM {name}_e QUALIFY rk <= {k})"""


TAGGED = (
    *ENCODED,
    "\n" + LABELS,
    f"""
vectors AS MATERIALIZED (SELECT v.id, label_id, v, list_resize(v, {WIDTH}, 0.0)::DOUBLE[{WIDTH}] AS a FROM v LEFT JOIN labels_d USING (category)),
every AS MATERIALIZED (SELECT id, label_id, v FROM vectors WHERE label_id IS NOT NULL),
capped AS MATERIALIZED (
  SELECT * FROM vectors WHERE label_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || id), id) <= {CAP})""",
    near(10, "vectors", "capped", "nn"),
    near(1, "capped", "capped", "inner_nn"),
    near(1, "(SELECT * FROM vectors WHERE label_id IS NULL)", "capped", "outer_nn"),
    "\nall_d AS MATERIALIZED (SELECT d2, 0 AS ood FROM inner_nn UNION ALL SELECT d2, 1 FROM outer_nn)",
    t.SWEEP,
    t.VOTE,
    t.PROTO.replace("FROM g)", "FROM every)"),
    t.SIMS.replace("FROM e q", "FROM vectors q"),
    t.BLEND,
    """
flagged AS MATERIALIZED (
  SELECT query_id, best.label_id, confidence, d2 AS ood_distance, threshold, d2 > threshold AS is_ood
  FROM best JOIN nn USING (query_id) CROSS JOIN threshold WHERE rk = 1),
p AS MATERIALIZED (
  SELECT r.*, query_id, f.label_id, CASE WHEN is_ood AND confidence < 0.75 THEN 'other' ELSE l.category END AS predicted_category,
    CASE WHEN is_ood AND confidence < 0.75 THEN 0.0 ELSE confidence END AS confidence,
    is_ood, ood_distance, threshold AS ood_threshold, is_ood OR confidence < 0.75 AS needs_llm
  FROM flagged f JOIN labels_d l USING (label_id) JOIN r ON record_id = query_id)""",
    """
alike AS MATERIALIZED (
  SELECT nn.query_id, rk, golden_id, d2, r.tran_partclr AS description, r.tran_amt_in_ac AS amount,
    r.dr_cr_indctor AS dr_cr, r.tran_mode AS mode, r.category
  FROM nn JOIN r ON golden_id = record_id)""",
)


def corpus(spark, folder):
    rows, artifacts = fitted(spark, folder)
    build = BuildSpec(max_per_class=CAP, cap_method="hash")
    return artifacts, build_from_records(rows.filter(F.col("category") != fixed.OOD_LABEL), artifacts, rows, build)


SIMILAR = {
    "description": "tran_partclr", "amount": "tran_amt_in_ac", "dr_cr": "dr_cr_indctor",
    "mode": "tran_mode", "category": "category",
}


def queries_of(rows, artifacts):
    coded = fe.encode(rows, ROLES, artifacts.vocab, artifacts.scaler, stored=True)
    return coded.withColumn("query_id", F.col("record_id"))


def tagged(spark, folder):
    """All documents, scored against the corpus (oneself excluded)."""
    artifacts, built = corpus(spark, folder)
    scored = predict(queries_of(documents(spark, folder), artifacts), built, exclude_self=True)
    return scored.drop("embedding"), built


_STORED: dict = {}


def once(spark, folder, name, make):
    """A table derived from the given ones, written once per session and state of their files, and shared by reports."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, folder, state, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def predictions(spark, folder):
    """The stored result of ``tagged`` and its corpus."""

    def make():
        scored, built = tagged(spark, folder)
        return cut_lineage(scored), built

    return once(spark, folder, "predictions", make)


def with_records(spark, folder):
    scored, built = predictions(spark, folder)
    return sc.with_similar(scored, built.golden, SIMILAR)


def answer(select: str) -> str:
    return t.with_(*TAGGED, select=select)


PREDICTION = """SELECT query_id, predicted_category, round(confidence, 5) AS confidence, is_ood,
  round(ood_distance, 5) AS ood_distance, round(ood_threshold, 5) AS ood_threshold, needs_llm FROM p"""


def prediction(scored):
    rows = scored.select(
        "query_id", "predicted_category", "confidence", "is_ood", "ood_distance", "ood_threshold", "needs_llm"
    )
    return rows.withColumns({c: F.round(c, 5) for c in ("confidence", "ood_distance", "ood_threshold")})


@C.add("tag_documents", answer(PREDICTION))
def tag_documents(spark, folder):
    """Fit, encode, cap, calibrate, search, vote, blend and route whole texts."""
    return prediction(tagged(spark, folder)[0])


@C.add("saved_corpus", answer(PREDICTION))
def saved_corpus(spark, folder):
    """The same with artifacts and corpus saved and loaded in between."""
    from tagweave.sources.artifacts import load_artifacts, load_corpus, save_artifacts, save_corpus

    path = scratch_path(spark)
    artifacts, built = corpus(spark, folder)
    save_artifacts(artifacts, f"{path}/artifacts")
    save_corpus(built, f"{path}/corpus")
    artifacts, built = load_artifacts(spark, f"{path}/artifacts"), load_corpus(spark, f"{path}/corpus")
    return prediction(predict(queries_of(documents(spark, folder), artifacts), built, exclude_self=True))


@C.add("score_stream", answer(PREDICTION))
def score_stream(spark, folder):
    """The documents as a file stream, tagged in micro-batches into two sinks."""
    from tagweave.streaming.scoring import score_stream as start

    path = scratch_path(spark)
    artifacts, built = corpus(spark, folder)
    rows = documents(spark, folder)
    rows.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    query = start(
        stream, built, f"{path}/auto", f"{path}/review", f"{path}/state",
        encoder=lambda batch: queries_of(batch, artifacts), exclude_self=True,
    )
    query.awaitTermination()
    read = lambda side: spark.read.parquet(f"{path}/{side}")
    return prediction(read("auto").unionByName(read("review")))


# --- Reports over the tagged documents -------------------------------------------------------


@C.add("low_confidence", answer("SELECT query_id, round(confidence, 5) AS confidence FROM p WHERE confidence < 0.6"))
def low_confidence(spark, folder):
    rows = re.low_confidence(predictions(spark, folder)[0])
    return rows.select("query_id", F.round("confidence", 5).alias("confidence"))


@C.add(
    "summary",
    answer("""SELECT count(*) AS total, count(*) FILTER (is_ood) AS ood, round(count(*) FILTER (is_ood) / count(*), 6) AS ood_share,
  count(*) FILTER (needs_llm) AS needs_llm, round(count(*) FILTER (needs_llm) / count(*), 6) AS needs_llm_share,
  0::BIGINT AS llm_overrides, round(avg(confidence), 5) AS avg_confidence FROM p"""),
)
def summary(spark, folder):
    out = re.summary(predictions(spark, folder)[0])
    return t.rounded(out, "ood_share", "needs_llm_share").withColumn("avg_confidence", F.round("avg_confidence", 5))


@C.add(
    "confidence_stats",
    answer("""SELECT round(avg(confidence), 5) AS mean, round(min(confidence), 5) AS min,
  round(max(confidence), 5) AS max, round(median(confidence), 5) AS median FROM p"""),
)
def confidence_stats(spark, folder):
    out = re.confidence_stats(predictions(spark, folder)[0])
    return out.withColumns({c: F.round(c, 5) for c in out.columns})


@C.add(
    "category_distribution",
    answer("""SELECT predicted_category AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM p GROUP BY predicted_category"""),
)
def category_distribution(spark, folder):
    return t.rounded(re.category_distribution(predictions(spark, folder)[0].select("predicted_category")), "share")


@C.add("accuracy", answer("SELECT round(avg((category = predicted_category)::INTEGER), 6) AS accuracy FROM p"))
def accuracy(spark, folder):
    from tagweave.operators.metrics import accuracy as share

    pairs = predictions(spark, folder)[0].select(
        F.col("category").alias("true_label"), F.col("predicted_category").alias("pred_label")
    )
    return t.rounded(share(pairs), "accuracy")


@C.add(
    "suspicious_golden",
    answer("""SELECT golden_id, golden_label, query_id, expected_label, round(d2, 5) AS d2, hits FROM (
  SELECT golden_id, s.category AS golden_label, s.query_id, p.category AS expected_label, d2,
    count(*) OVER (PARTITION BY golden_id) AS hits
  FROM alike s JOIN p USING (query_id) WHERE p.category <> predicted_category AND s.category <> p.category
  QUALIFY row_number() OVER (PARTITION BY golden_id ORDER BY query_id DESC, rk DESC) = 1)"""),
)
def suspicious_golden(spark, folder):
    scored, built = predictions(spark, folder)
    carried = scored.select(
        "query_id", "neighbours", F.col("category").alias("expected"), F.col("predicted_category").alias("predicted")
    )
    rows = nb.explode_neighbours(carried, "expected", "predicted")
    found = sc.label_names(rows, built.labels).withColumnRenamed("category", "label")
    return re.suspicious_golden(found).withColumn("d2", F.round("d2", 5))


@C.add(
    "summary_table",
    answer("""SELECT query_id, CASE WHEN length(tran_partclr) > 50 THEN substr(tran_partclr, 1, 50) || '...' ELSE tran_partclr END AS description,
  tran_amt_in_ac AS amount, predicted_category, round(confidence, 4) AS confidence,
  floor(confidence * 10)::BIGINT || '/10' AS votes FROM p"""),
)
def summary_table(spark, folder):
    return re.summary_table(predictions(spark, folder)[0])


@C.add(
    "present",
    answer("""SELECT query_id, CASE WHEN length(tran_partclr) > 39 THEN substr(tran_partclr, 1, 39) || '…' ELSE tran_partclr END AS description,
  substr(predicted_category, 1, 23) AS category, round(confidence * 100)::INTEGER || '%' AS confidence,
  CASE WHEN is_ood THEN 'Y' ELSE '-' END AS ood, CASE WHEN needs_llm THEN '-' ELSE ' ' END AS llm FROM p"""),
)
def present(spark, folder):
    return re.present(predictions(spark, folder)[0])


EXPORT = """
near3 AS (
  SELECT query_id, string_agg(substr(description, 1, 30), ' | ' ORDER BY rk) AS descs,
    string_agg(category, ' | ' ORDER BY rk) AS cats FROM alike WHERE rk <= 3 GROUP BY query_id)"""


@C.add(
    "export_rows",
    t.with_(
        *TAGGED, EXPORT,
        select="""SELECT cust_id, tran_date, tran_partclr AS description, tran_amt_in_ac AS amount, tran_mode AS mode,
  dr_cr_indctor AS dr_cr, predicted_category, round(confidence, 4) AS confidence, is_ood,
  round(ood_distance, 4) AS ood_distance, needs_llm, false AS llm_overridden,
  descs AS top3_retrieved_desc, cats AS top3_retrieved_cats FROM p JOIN near3 USING (query_id)""",
    ),
)
def export_rows(spark, folder):
    return re.export_rows(with_records(spark, folder))


@C.add(
    "write_results",
    t.with_(
        *TAGGED, EXPORT,
        select="""SELECT cust_id, predicted_category, round(confidence, 4) AS confidence, needs_llm, count(*) AS n
FROM p JOIN near3 USING (query_id) GROUP BY ALL""",
    ),
)
def write_results(spark, folder):
    """Written as CSV and read back."""
    path = scratch_path(spark)
    sinks.write_results(with_records(spark, folder), path)
    schema = "confidence double, needs_llm boolean"
    back = so.read_records(spark, path, schema, line_breaks_in_cells=True)
    return back.groupBy("cust_id", "predicted_category", "confidence", "needs_llm").agg(F.count(F.lit(1)).alias("n"))


@C.add(
    "write_routed",
    answer("""SELECT CASE WHEN needs_llm THEN 'review' ELSE 'auto' END AS sink, query_id, predicted_category FROM p"""),
)
def write_routed(spark, folder):
    path = scratch_path(spark)
    sinks.write_routed(predictions(spark, folder)[0], f"{path}/auto", f"{path}/review")
    return fe.union_all(
        [
            spark.read.parquet(f"{path}/{side}").select(F.lit(side).alias("sink"), "query_id", "predicted_category")
            for side in ("auto", "review")
        ]
    )


@C.add(
    "export_wide",
    answer("""SELECT query_id AS transaction_index, md5(tran_partclr) AS description, tran_amt_in_ac AS amount, tran_mode AS mode,
  dr_cr_indctor AS dr_cr, predicted_category, round(confidence, 5) AS confidence, p.category AS ground_truth,
  p.category = predicted_category AS correct, """ + ", ".join(
        f"max(golden_id) FILTER (rk = {j}) AS similar_{j}_index, md5(max(description) FILTER (rk = {j})) AS similar_{j}_description, "
        f"max(s.category) FILTER (rk = {j}) AS similar_{j}_label, round(max(d2) FILTER (rk = {j}), 5) AS similar_{j}_distance"
        for j in (1, 2, 3)
    ) + " FROM p JOIN alike s USING (query_id) GROUP BY ALL"),
)
def export_wide(spark, folder):
    wide = re.export_wide(with_records(spark, folder)).drop("vote_distribution")
    texts = {c: F.md5(c) for c in wide.columns if c.endswith("description")}
    numbers = {c: F.round(c, 5) for c in wide.columns if c == "confidence" or c.endswith("distance")}
    return wide.withColumns({**texts, **numbers})


@C.add(
    "explain_votes",
    answer("""SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY share DESC, label_id))::INTEGER AS place,
  category, round(share, 4) AS share FROM vote JOIN labels_d USING (label_id) QUALIFY place <= 5"""),
)
def explain_votes(spark, folder):
    return re.explain_votes(predictions(spark, folder)[0])


@C.add(
    "explain_neighbours",
    answer("""SELECT query_id, rk, golden_id, round(d2, 5) AS d2, md5(description) AS description, amount, dr_cr, mode, category
FROM alike"""),
)
def explain_neighbours(spark, folder):
    rows = re.explain_neighbours(with_records(spark, folder))
    return rows.withColumns({"d2": F.round("d2", 5), "description": F.md5("description")})


@C.add(
    "similar_records",
    answer("""SELECT query_id, rk, golden_id, md5(description) AS description, amount, dr_cr, mode, tran_date AS date, alike.category
FROM alike JOIN (SELECT record_id, tran_date FROM r) d ON golden_id = record_id"""),
)
def similar_records(spark, folder):
    """All fields of the retrieved records, their dates among them."""
    scored, built = predictions(spark, folder)
    rows = re.explain_neighbours(sc.with_similar(scored, built.golden))
    return rows.drop("d2").withColumn("description", F.md5("description"))


@C.add("head", answer("SELECT query_id, predicted_category FROM p ORDER BY query_id LIMIT 20"))
def head(spark, folder):
    return re.head(predictions(spark, folder)[0].select("query_id", "predicted_category"), 20)


# --- Review queue ------------------------------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_example(description: str, amount: str, side: str, mode: str, label: str) -> str:
    shape = sql_text(fixed.EXAMPLE_FORMAT)
    return (
        f"printf({shape}, coalesce({description}, ''), {amount}, "
        f"CASE WHEN {side} = 'D' THEN 'Debit' ELSE 'Credit' END, coalesce({mode}, 'N/A'), {label})"
    )


CANONICAL = f"""
stored AS MATERIALIZED (
  SELECT category, (row_number() OVER (PARTITION BY category ORDER BY record_id) - 1)::INTEGER AS pos, * EXCLUDE (category)
  FROM r QUALIFY pos < 3),
canon AS MATERIALIZED (
  SELECT category, string_agg({sql_example("tran_partclr", "tran_amt_in_ac", "dr_cr_indctor", "coalesce(tran_mode, 'NULL')", "category")}, '' ORDER BY pos) AS shots
  FROM stored WHERE pos < 2 GROUP BY category)"""
PROMPTS = f"""
shots AS (
  SELECT query_id, string_agg({sql_example("description", "amount", "dr_cr", "mode", "category")}, '' ORDER BY rk) AS shots
  FROM alike WHERE rk <= 4 GROUP BY query_id),
prompts AS MATERIALIZED (
  SELECT query_id, {sql_text(fixed.PROMPT_ROLE)} || (SELECT string_agg(category, ', ' ORDER BY category) FROM labels_d)
    || {sql_text(fixed.PROMPT_OTHER_RULE)} || {sql_text(fixed.PROMPT_NOTES)} || {sql_text(fixed.PROMPT_EXAMPLES_HEAD)}
    || coalesce(c.shots, '') || s.shots || o.shots || {sql_text(fixed.PROMPT_RECORD_HEAD)}
    || printf({sql_text(fixed.RECORD_FORMAT)}, tran_partclr, tran_amt_in_ac,
       CASE WHEN dr_cr_indctor = 'D' THEN 'Debit' ELSE 'Credit' END, coalesce(tran_mode, 'N/A'))
    || CASE WHEN confidence < 0.4 THEN {sql_text(fixed.PROMPT_STEPS)} ELSE {sql_text(fixed.PROMPT_DIRECT)} END AS prompt
  FROM p JOIN shots s USING (query_id) LEFT JOIN canon c ON c.category = predicted_category
    CROSS JOIN (SELECT shots FROM canon WHERE category = 'other') o WHERE needs_llm)"""


def stored_examples(spark, folder):
    """The first three documents of each category, as a table of canonical examples."""
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy("record_id")
    rows = documents(spark, folder).withColumn("tran_mode", F.coalesce("tran_mode", F.lit("NULL")))
    picked = rows.withColumn("nth", F.row_number().over(order)).filter("nth <= 3").withColumn("pos", F.col("nth") - 1).drop("nth")
    fields = ("tran_partclr", "tran_amt_in_ac", "dr_cr_indctor", "tran_mode")
    return picked.select("category", "pos", F.struct(*fields, "category").alias("example"))


def prompts(spark, folder):
    scored, built = predictions(spark, folder)
    routed = sinks.route(scored)[1]
    examples = cut_lineage(stored_examples(spark, folder))
    ood = examples.filter(F.col("category") == fixed.OOD_LABEL)
    return rv.build_prompts(sc.with_similar(routed, built.golden, SIMILAR), built.labels, examples, ood)


@C.add("build_prompts", t.with_(*TAGGED, CANONICAL, PROMPTS, select="SELECT query_id, length(prompt)::INTEGER AS length, md5(prompt) AS digest FROM prompts"))
def build_prompts(spark, folder):
    rows = prompts(spark, folder)
    return rows.select("query_id", F.length("prompt").alias("length"), F.md5("prompt").alias("digest"))


@C.add(
    "canonical_shots",
    t.with_(D, CANONICAL, select="SELECT category, md5(shots) AS digest FROM canon"),
)
def canonical_shots(spark, folder):
    shots = rv.canonical_shots(stored_examples(spark, folder))
    return shots.select("category", F.md5("canonical").alias("digest"))


@C.add(
    "format_example",
    t.with_(D, select=f"SELECT record_id, md5({sql_example('tran_partclr', 'tran_amt_in_ac', 'dr_cr_indctor', 'tran_mode', 'category')}) AS digest FROM r"),
)
def format_example(spark, folder):
    text = rv.format_example(*[F.col(c) for c in ("tran_partclr", "tran_amt_in_ac", "dr_cr_indctor", "tran_mode", "category")])
    return documents(spark, folder).select("record_id", F.md5(text).alias("digest"))


@C.add(
    "run_policy",
    answer("""SELECT query_id, confidence < 0.4 AS use_steps, CASE WHEN tran_amt_in_ac > 5000 THEN 3 ELSE 1 END AS n_runs,
  CASE WHEN tran_amt_in_ac > 5000 THEN 0.3 ELSE 0.0 END::DOUBLE AS temperature,
  unnest(range(1, CASE WHEN tran_amt_in_ac > 5000 THEN 4 ELSE 2 END))::INTEGER AS run FROM p WHERE needs_llm"""),
)
def run_policy(spark, folder):
    routed = sinks.route(predictions(spark, folder)[0])[1]
    return rv.run_policy(routed, high_value=5000.0).select("query_id", "use_steps", "n_runs", "temperature", "run")


# Answers built from real turns, one form per parse rule.
SAID = """
said AS MATERIALIZED (
  SELECT conv_id AS query_id, (turn + 1)::INTEGER AS run, CASE turn % 6
    WHEN 0 THEN text || chr(10) || 'Category: "' || (['Rent', 'p2p', 'EDUCATION', 'other'])[1 + conv_id % 4] || '".' || chr(10)
    WHEN 1 THEN text || chr(10) || chr(10) || ' I think this is healthcare costs '
    WHEN 2 THEN ''
    WHEN 3 THEN 'Food'
    WHEN 4 THEN 'category - ' || (['Salary', 'Mobility', 'Rent'])[1 + conv_id % 3]
    ELSE text END AS response
  FROM conversations)"""
NAMES = "names AS MATERIALIZED (SELECT unnest([" + ", ".join(sql_text(c) for c in sorted(fixed.CATEGORY_DESCRIPTIONS)) + "]) AS category)"
PARSED = f"""
clean AS MATERIALIZED (
  SELECT query_id, run, response, lower(trim(regexp_replace(coalesce(list_filter(
    list_transform(string_split_regex(response, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, ' ' || chr(9))),
    lambda x: x <> '')[-1], ''), '^category\\s*[:\\-]?\\s*', '', 'i'), '"'' .,')) AS said FROM said),
{NAMES},
parsed AS MATERIALIZED (
  SELECT query_id, run, response, CASE WHEN said = '' OR said = 'other' THEN 'other' ELSE coalesce(
    (SELECT max(category) FROM names WHERE lower(category) = said),
    (SELECT min(category) FROM names WHERE contains(said, lower(category)) OR contains(lower(category), said)), 'other') END AS label
  FROM clean)"""


def said(spark, folder):
    turns = t.table(spark, folder, "conversations")
    form, text = F.col("turn") % 6, F.col("text")
    pick = lambda names: F.try_element_at(F.array(*[F.lit(n) for n in names]), (F.col("conv_id") % len(names) + 1).cast("int"))
    response = (
        F.when(form == 0, F.concat(text, F.lit('\nCategory: "'), pick(["Rent", "p2p", "EDUCATION", "other"]), F.lit('".\n')))
        .when(form == 1, F.concat(text, F.lit("\n\n I think this is healthcare costs ")))
        .when(form == 2, F.lit(""))
        .when(form == 3, F.lit("Food"))
        .when(form == 4, F.concat(F.lit("category - "), pick(["Salary", "Mobility", "Rent"])))
        .otherwise(text)
    )
    return turns.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("run"), response.alias("response"))


def parsed(spark, folder):
    return rv.parse_responses(said(spark, folder), tx.description_table(spark))


@C.add("parse_responses", t.with_(SAID, PARSED, select="SELECT query_id, run, label FROM parsed"))
def parse_responses(spark, folder):
    return parsed(spark, folder).select("query_id", "run", "label")


MAJORITY = """
voted AS MATERIALIZED (
  SELECT query_id, label, count(*) AS votes, min(run) AS first FROM parsed GROUP BY query_id, label
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1)"""


@C.add("majority_vote", t.with_(SAID, PARSED, MAJORITY, select="SELECT query_id, label, votes FROM voted"))
def majority_vote(spark, folder):
    return rv.majority_vote(parsed(spark, folder)).select("query_id", "label", "votes")


@C.add(
    "merge_review",
    t.with_(
        *TAGGED, SAID, PARSED, MAJORITY,
        select="""SELECT p.query_id, coalesce(label, predicted_category) AS predicted_category,
  round(CASE WHEN label IS NULL THEN confidence WHEN label = 'other' THEN 0 ELSE 1 END, 5) AS confidence, label IS NOT NULL AS llm_overridden
FROM p LEFT JOIN voted ON voted.query_id = p.query_id AND needs_llm""",
    ),
)
def merge_review(spark, folder):
    """Answers (one conversation per record id) for the records routed to review."""
    scored = predictions(spark, folder)[0]
    routed = sinks.route(scored)[1].select("query_id")
    voted = rv.majority_vote(parsed(spark, folder)).join(routed, "query_id", "left_semi")
    merged = rv.merge_review(scored, voted)
    return merged.select("query_id", "predicted_category", F.round("confidence", 5).alias("confidence"), "llm_overridden")


@C.add(
    "summary_overrides",
    t.with_(
        *TAGGED, SAID, PARSED, MAJORITY,
        """
reviewed AS MATERIALIZED (
  SELECT p.query_id, p.is_ood, p.needs_llm, label IS NOT NULL AS llm_overridden,
    CASE WHEN label IS NULL THEN confidence WHEN label = 'other' THEN 0 ELSE 1 END AS confidence
  FROM p LEFT JOIN voted ON voted.query_id = p.query_id AND needs_llm)""",
        select="""SELECT count(*) AS total, count(*) FILTER (is_ood) AS ood, round(count(*) FILTER (is_ood) / count(*), 6) AS ood_share,
  count(*) FILTER (needs_llm) AS needs_llm, round(count(*) FILTER (needs_llm) / count(*), 6) AS needs_llm_share,
  count(*) FILTER (llm_overridden) AS llm_overrides, round(avg(confidence), 5) AS avg_confidence FROM reviewed""",
    ),
)
def summary_overrides(spark, folder):
    """The summary after review, where answers of the queue's rows do override."""
    scored = predictions(spark, folder)[0]
    voted = rv.majority_vote(parsed(spark, folder)).join(sinks.route(scored)[1].select("query_id"), "query_id", "left_semi")
    out = re.summary(rv.merge_review(scored, voted))
    return t.rounded(out, "ood_share", "needs_llm_share").withColumn("avg_confidence", F.round("avg_confidence", 5))


@C.add(
    "respond",
    t.with_(
        *TAGGED, CANONICAL, PROMPTS,
        select="""SELECT query_id, 1 AS run, CASE WHEN length(prompt) % 5 = 0 THEN NULL ELSE length(prompt)::VARCHAR END AS response,
  CASE WHEN length(prompt) % 5 = 0 THEN 'ValueError: no answer' END AS error FROM prompts""",
    ),
)
def respond(spark, folder):
    """The plug point for a language model: here a pure function that sometimes fails."""

    def make():
        def provider(prompt: str, temperature: float) -> str:
            if len(prompt) % 5 == 0:
                raise ValueError("no answer")
            return str(len(prompt))

        return provider

    asked = rv.run_policy(prompts(spark, folder), high_value=1e12)
    return rv.respond(asked, make)


# --- Taxonomy --------------------------------------------------------------------------------------

DEFAULTS = "(VALUES " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in fixed.CATEGORY_DESCRIPTIONS.items()) + ")"
LAYERS = f"""
layers AS (
  SELECT col0 AS category, col1 AS description, 0 AS layer FROM {DEFAULTS}
  UNION ALL SELECT DISTINCT p_type, 'goods of type ' || lower(p_type), 1 FROM part
  UNION ALL SELECT 'Rent', 'der die das und ein zu', 2),
taxo AS MATERIALIZED (SELECT category, arg_max(description, layer) AS description FROM layers GROUP BY category)"""


def layered(spark, folder):
    types = t.table(spark, folder, "part").select("p_type").distinct()
    argument = types.select(
        F.col("p_type").alias("category"), F.concat(F.lit("goods of type "), F.lower("p_type")).alias("description")
    )
    override = tx.description_table(spark, {"Rent": "der die das und ein zu"})
    return tx.taxonomy(tx.description_table(spark), argument, override)


@C.add("taxonomy", t.with_(LAYERS, select="SELECT category, description FROM taxo"))
def taxonomy(spark, folder):
    return layered(spark, folder)


def text_unit(name: str, text: str, source: str, id_col: str) -> str:
    """Unit text vectors of a table, as CTEs under their own names."""
    prompt = sql_text(fixed.TEXT_PROMPT)
    body = words(f"{prompt} || {text}", source, id_col) + "," + dense(256, source, id_col)
    for cte in ("words", "hashed", "dense", "total", "mean", "pooled"):
        body = body.replace(f"\n{cte} AS", f"\n{name}_{cte} AS").replace(f"FROM {cte}", f"FROM {name}_{cte}")
        body = body.replace(f"JOIN {cte} ", f"JOIN {name}_{cte} ")
    return body + f""",
{name} AS MATERIALIZED (SELECT {id_col}, ({t.scaled('p', 'len')})::FLOAT[]::DOUBLE[] AS v FROM {name}_pooled)"""


TAXO = (
    D, LAYERS, text_unit("doc_v", "tran_partclr", "r", "record_id"), text_unit("taxo_v", "description", "taxo", "category"),
    """
taxo_s AS MATERIALIZED (
  SELECT record_id AS query_id, category, list_inner_product(d.v, c.v) AS sim FROM doc_v d CROSS JOIN taxo_v c)""",
)


def text_queries(spark, folder):
    rows = documents(spark, folder).withColumn("query_id", F.col("record_id"))
    return fe.text_vector(rows, "tran_partclr", tx.TEXT_SPEC, "embedding").select("query_id", "embedding")


@C.add("embed_taxonomy", t.with_(LAYERS, text_unit("taxo_v", "description", "taxo", "category"), select="""
SELECT category, (pos - 1)::INTEGER AS pos, round(value, 5) AS value
FROM (SELECT category, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM taxo_v) WHERE value <> 0"""))
def embed_taxonomy(spark, folder):
    vectors = tx.embed_taxonomy(layered(spark, folder))
    rows = vectors.select("category", F.posexplode("embedding").alias("pos", "value")).filter(F.col("value") != 0)
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 5))


@C.add("taxonomy_scores", t.with_(*TAXO, select="SELECT query_id, category, round(sim, 5) AS sim FROM taxo_s"))
def taxonomy_scores(spark, folder):
    scores = tx.taxonomy_scores(text_queries(spark, folder), tx.embed_taxonomy(layered(spark, folder)))
    return scores.withColumn("sim", F.round("sim", 5))


@C.add(
    "taxonomy_predict",
    t.with_(*TAXO, select="""SELECT query_id, category, round(sim, 5) AS sim FROM taxo_s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, category) = 1"""),
)
def taxonomy_predict(spark, folder):
    scored = tx.with_taxonomy_scores(text_queries(spark, folder), tx.embed_taxonomy(layered(spark, folder)))
    return tx.taxonomy_predict(scored).select("query_id", "category", F.round("sim", 5).alias("sim"))


@C.add("taxonomy_nearest", C.sql["taxonomy_predict"])
def taxonomy_nearest(spark, folder):
    """The best description alone, also where descriptions are met block by block."""
    limits = ScanLimits(broadcast_bytes=0, block_rows=5, chunk_rows=300)
    found = tx.taxonomy_nearest(text_queries(spark, folder), tx.embed_taxonomy(layered(spark, folder)), limits)
    return found.select("query_id", "category", F.round("sim", 5).alias("sim"))


@C.add(
    "taxonomy_blend",
    t.with_(
        *TAXO,
        """
votes AS (
  SELECT record_id AS query_id, s.category, share FROM r CROSS JOIN (VALUES ('Rent', 0.75), ('unlisted', 0.25)) s(category, share)
  WHERE record_id % 3 <> 0),
mixed AS MATERIALIZED (
  SELECT query_id, category, 0.7 * coalesce(share, 0) + 0.3 * coalesce((sim - lo) / (hi - lo + 1e-9), 0) AS score
  FROM votes FULL JOIN (
    SELECT *, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM taxo_s) s
  USING (query_id, category))""",
        select="SELECT query_id, category, round(score / (sum(score) OVER (PARTITION BY query_id) + 1e-9), 5) AS score FROM mixed",
    ),
)
def taxonomy_blend(spark, folder):
    """Votes with one category the descriptions know and one they do not; a third have none."""
    share = lambda name, value: F.struct(F.lit(name).alias("category"), F.lit(value).alias("share"))
    votes = F.array(share("Rent", 0.75), share("unlisted", 0.25))
    scored = tx.with_taxonomy_scores(text_queries(spark, folder), tx.embed_taxonomy(layered(spark, folder)))
    voted = scored.withColumn("named_vote", F.when(F.col("query_id") % 3 != 0, votes).otherwise(F.slice(votes, 1, 0)))
    return tx.taxonomy_blend(voted).withColumn("score", F.round("score", 5))


@C.add(
    "add_category",
    t.with_(
        LAYERS.replace("GROUP BY category)", "GROUP BY category UNION ALL SELECT 'Deutsch', 'der die das und nicht')"),
        D, *TAXO[2:],
        select="SELECT query_id, round(sim, 5) AS sim FROM taxo_s WHERE category = 'Deutsch'",
    ),
)
def add_category(spark, folder):
    table = tx.add_category(tx.embed_taxonomy(layered(spark, folder)), "Deutsch", "der die das und nicht")
    scores = tx.taxonomy_scores(text_queries(spark, folder), table)
    return scores.filter(F.col("category") == "Deutsch").select("query_id", F.round("sim", 5).alias("sim"))
