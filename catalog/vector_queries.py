"""Neighbour joins, scoring, corpus and calibration over the embeddings table."""

from pyspark.sql import functions as F

from catalog import Catalog
from catalog import tables as t
from tagweave.functions.hashing import seeded
from tagweave.functions.session import cut_lineage
from tagweave.operators import balls
from tagweave.operators import coreset as cs
from tagweave.operators import corpus as co
from tagweave.operators import neighbours as nb
from tagweave.operators import scoring as sc
from tagweave.operators import state as st
from tagweave.plans.tagging import BuildSpec, build_corpus, predict

C = Catalog()

NN = (t.E, t.PAIRS, t.top(10))
NN_SELECT = "SELECT query_id, rk, golden_id, label_id, round(d2, 6) AS d2 FROM nn"


def _long(df):
    return t.rounded(nb.explode_neighbours(df), "d2")


@C.add("knn_join", t.with_(*NN, select=NN_SELECT))
def knn_join(spark, folder):
    return t.rounded(nb.knn_join(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True), "d2")


@C.add("knn_join_blocks", t.with_(*NN, select=NN_SELECT))
def knn_join_blocks(spark, folder):
    """The plan for a corpus too large to broadcast, forced by its size limits."""
    limits = nb.ScanLimits(broadcast_bytes=0, block_rows=200, chunk_rows=200)
    return t.rounded(
        nb.knn_join(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True, limits=limits), "d2"
    )


@C.add(
    "knn_join_ip",
    t.with_(
        t.E,
        f"""
pairs AS (
  SELECT q.id AS query_id, g.id AS golden_id, g.label_id, {t.dot('q.v', 'g.v')} AS ip FROM e q JOIN g ON q.id <> g.id)""",
        t.top(10, order="ip DESC, golden_id"),
        select="SELECT query_id, rk, golden_id, label_id, round(2 - 2 * ip, 6) AS d2 FROM nn",
    ),
)
def knn_join_ip(spark, folder):
    return t.rounded(
        nb.knn_join(t.asked(spark, folder), t.golden(spark, folder), 10, metric="ip", exclude_self=True), "d2"
    )


CENTRES = f"""
centres AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY m, id) - 1 AS cell FROM (SELECT id, v, md5('7:' || id) AS m FROM g) ORDER BY m, id LIMIT 16),
routes AS (
  SELECT e.id, e.label_id, e.v, c.cell, row_number() OVER (PARTITION BY e.id ORDER BY {t.d2('e.v', 'c.v')}, c.cell) AS nth FROM e CROSS JOIN centres c),
pairs AS (
  SELECT q.id AS query_id, q.label_id AS true_label, r.id AS golden_id, r.label_id, {t.d2('q.v', 'r.v')} AS d2
  FROM routes q JOIN routes r ON q.cell = r.cell AND q.nth <= 4 AND r.nth = 1 AND r.label_id <> {t.OOD_ID} AND q.id <> r.id)"""


@C.add("ivf_join", t.with_(t.E, CENTRES, t.top(10), select=NN_SELECT))
def ivf_join(spark, folder):
    """Cells around 16 drawn golden rows, the four nearest asked."""
    drawn = t.golden(spark, folder).orderBy(seeded(7, F.col("golden_id")), "golden_id").limit(16)
    centres = [r["embedding"] for r in drawn.collect()]  # 16 rows
    return _long(nb.ivf_join(t.asked(spark, folder), t.golden(spark, folder), 10, n_probe=4, centres=centres, exclude_self=True))


@C.add("ivf_recall", "SELECT true AS recall_ok")
def ivf_recall(spark, folder):
    """Fitted cells, three quarters of them asked: these vectors have no structure, and 0.9 of the exact neighbours are found."""
    golden, asked = t.golden(spark, folder), t.asked(spark, folder)
    index = nb.fit_index(golden, "ivf")
    found = nb.explode_neighbours(nb.index_join(asked, index, 10, n_probe=3 * len(index.centres) // 4, exclude_self=True))
    exact = nb.knn_join(asked, golden, 10, exclude_self=True)
    hits = exact.join(found, ["query_id", "golden_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return exact.agg(F.count(F.lit(1)).alias("all")).join(hits, how="cross").select((F.col("hits") >= 0.9 * F.col("all")).alias("recall_ok"))


@C.add("ivf_join_all_cells", t.with_(*NN, select=NN_SELECT))
def ivf_join_all_cells(spark, folder):
    """Probing every cell is exact."""
    return _long(nb.ivf_join(t.asked(spark, folder), t.golden(spark, folder), 10, n_cells=8, n_probe=8, exclude_self=True))


@C.add("core_set", "SELECT label AS label_id, count(*) AS n_rows, true AS few, true AS covered FROM embeddings GROUP BY label")
def core_set(spark, folder):
    """Twenty centres of each class: is each row within the certified radius of one?"""
    rows = cut_lineage(t.vectors(spark, folder))
    centres = cut_lineage(cs.core_set(rows, 20, slice_rows=16, fan_in=3))
    near = nb.nearest_of_label(rows.withColumnRenamed("golden_id", "query_id"), centres.join(rows.select("golden_id", "embedding"), "golden_id"))
    bounds = centres.groupBy("label_id").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("centres"))
    return near.join(F.broadcast(bounds), "label_id").groupBy("label_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("centres") <= 20).alias("few"), F.bool_and(F.sqrt("d2") <= F.col("radius") + 1e-9).alias("covered")
    )


@C.add("ivf_bounded", t.with_(*NN, select=NN_SELECT))
def ivf_bounded(spark, folder):
    """A search that stops on a proof is exact; sixteen cells make it take several rounds."""
    index = balls.fit_balls(t.golden(spark, folder), n_cells=16)
    return t.rounded(balls.bounded_join(t.asked(spark, folder), index, 10, exclude_self=True), "d2")


CLUSTERS, PER_CLUSTER = 8, 0.05


def clustered(spark, folder):
    """The golden vectors drawn towards one of eight of them, chosen by id: tight groups with the same ids and labels."""
    golden = t.golden(spark, folder)
    heads = golden.orderBy("golden_id").limit(CLUSTERS).select(F.col("golden_id").alias("head_id"), F.col("embedding").alias("head"))
    order = heads.agg(F.array_sort(F.collect_list(F.struct("head_id", "head"))).alias("heads"))  # eight vectors
    head = F.get("heads", F.pmod(F.col("golden_id"), F.lit(CLUSTERS)).cast("int"))["head"]
    drawn = golden.join(F.broadcast(order), how="cross").withColumn("head", head)
    mixed = F.zip_with("head", "embedding", lambda a, b: a.cast("double") + F.lit(PER_CLUSTER) * b.cast("double"))
    return drawn.select("golden_id", "label_id", mixed.alias("embedding"))


def _effort(spark, folder, vectors, name):
    """For each kind of index, at its defaults: are 0.9 of the exact ten neighbours found?"""
    asked = vectors.select(F.col("golden_id").alias("query_id"), "embedding")
    exact = cut_lineage(nb.knn_join(asked, vectors, 10, exclude_self=True))
    total = exact.agg(F.count(F.lit(1)).alias("all"))
    rows = []
    for kind in ("ivf", "lsh", "ball"):
        if kind == "ball":
            found = balls.bounded_join(asked, balls.fit_balls(vectors, n_cells=16), 10, exclude_self=True)
        else:
            found = nb.explode_neighbours(nb.index_join(asked, nb.fit_index(vectors, kind), 10, exclude_self=True))
        hits = exact.join(found, ["query_id", "golden_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
        least = 1.0 if kind == "ball" else 0.9
        rows.append(total.join(hits, how="cross").select(F.lit(name).alias("vectors"), F.lit(kind).alias("kind"), (F.col("hits") >= least * F.col("all")).alias("recall_ok")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _effort_sql(name):
    return " UNION ALL ".join(f"SELECT '{name}' AS vectors, '{kind}' AS kind, true AS recall_ok" for kind in ("ivf", "lsh", "ball"))


@C.add("search_effort", _effort_sql("given"))
def search_effort(spark, folder):
    return _effort(spark, folder, t.golden(spark, folder), "given")


@C.add("search_effort_clustered", _effort_sql("clustered"))
def search_effort_clustered(spark, folder):
    return _effort(spark, folder, cut_lineage(clustered(spark, folder)), "clustered")


@C.add(
    "search_share",
    "SELECT (SELECT count(*) FROM embeddings WHERE label <> 9) AS queries, true AS all_proved, true AS under_a_third, true AS several_rounds",
)
def search_share(spark, folder):
    """On vectors in groups a proved search compares a small share of the rows."""
    vectors = cut_lineage(clustered(spark, folder))
    index = balls.fit_balls(vectors, n_cells=4 * CLUSTERS)
    asked = vectors.select(F.col("golden_id").alias("query_id"), "embedding")
    n = F.count(F.lit(1))
    return balls.bounded_nearest(asked, index, 10, exclude_self=True).agg(
        n.alias("queries"), F.bool_and("proved").alias("all_proved"),
        (F.sum("compared") < n * n / 3).alias("under_a_third"), (F.max("rounds") > 1).alias("several_rounds"),
    )


TABLES, BITS = 4, 3
SIGNS = f"""
plane AS MATERIALIZED (
  SELECT t, b, list(('0x' || substring(md5('42:' || t || ':' || b || ':' || d), 1, 8))::BIGINT / 4294967296.0 - 0.5 ORDER BY d) AS p
  FROM range({TABLES}) r(t), range({BITS}) s(b), range((SELECT len(v) FROM e LIMIT 1)) u(d) GROUP BY ALL),
bit AS MATERIALIZED (SELECT id, label_id, v, t, b, {t.dot('v', 'p')} AS x FROM e CROSS JOIN plane),
own AS MATERIALIZED (SELECT id, label_id, v, t, sum(CASE WHEN x >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM bit GROUP BY ALL),
least AS (SELECT id, t, b FROM bit QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY abs(x), b) <= 2),
ask AS (SELECT id, t, code FROM own UNION ALL SELECT o.id, o.t, xor(o.code, (1 << l.b)::BIGINT) FROM own o JOIN least l USING (id, t)),
met AS (SELECT DISTINCT a.id AS qid, o.id AS gid FROM ask a JOIN own o ON a.t = o.t AND a.code = o.code AND a.id <> o.id AND o.label_id <> {t.OOD_ID}),
pairs AS (
  SELECT q.id AS query_id, q.label_id AS true_label, g.id AS golden_id, g.label_id, {t.d2('q.v', 'g.v')} AS d2
  FROM met JOIN e q ON q.id = qid JOIN g ON g.id = gid)"""


@C.add("lsh_join", t.with_(t.E, SIGNS, t.top(10), select=NN_SELECT))
def lsh_join(spark, folder):
    """Four tables of three sign bits, two further cells asked in each."""
    return _long(nb.lsh_join(t.asked(spark, folder), t.golden(spark, folder), 10, tables=TABLES, bits=BITS, n_probe=3, exclude_self=True))


@C.add(
    "neighbour_metadata",
    t.with_(
        *NN,
        select="""SELECT query_id, rk, golden_id, label_id, round(d2, 6) AS d2, lang, n_chars
FROM nn JOIN documents ON golden_id = doc_id""",
    ),
)
def neighbour_metadata(spark, folder):
    """Records of the neighbours: documents keyed like the vectors."""
    near = nb.knn_join(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    docs = t.table(spark, folder, "documents").withColumnRenamed("doc_id", "golden_id")
    return t.rounded(sc.attach_golden(near, docs, "lang", "n_chars"), "d2")


@C.add(
    "label_names",
    t.with_(
        t.E,
        "names AS (SELECT DISTINCT label_id, 'class ' || label_id AS category FROM g)",
        select="SELECT id AS query_id, label_id, coalesce(category, 'other') AS category FROM e LEFT JOIN names USING (label_id)",
    ),
)
def label_names(spark, folder):
    rows = t.vectors(spark, folder).select(F.col("golden_id").alias("query_id"), "label_id")
    return sc.label_names(rows, t.names(spark, folder)).select("query_id", "label_id", "category")


@C.add("distance_vote", t.with_(*NN, t.VOTE, select="SELECT query_id, label_id, round(share, 6) AS share FROM vote"))
def distance_vote(spark, folder):
    near = nb.nearest(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    return t.rounded(sc.distance_vote(near), "share")


@C.add(
    "class_prototypes",
    t.with_(
        t.E,
        t.PROTO,
        select="SELECT label_id, generate_subscripts(p, 1) AS pos, round(unnest(p), 6) AS value FROM proto",
    ),
)
def class_prototypes(spark, folder):
    protos = co.class_prototypes(t.golden(spark, folder))
    rows = protos.select("label_id", F.posexplode("proto").alias("pos", "value"))
    return rows.select("label_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@C.add(
    "prototype_scores",
    t.with_(t.E, t.PROTO, t.SIMS, select="SELECT query_id, label_id, round(sim, 6) AS sim FROM sims"),
)
def prototype_scores(spark, folder):
    protos = co.class_prototypes(t.golden(spark, folder))
    return t.rounded(sc.prototype_scores(t.asked(spark, folder), protos), "sim")


SCORED = (*NN, t.VOTE, t.PROTO, t.SIMS, t.BLEND)


def _blended(spark, folder):
    near = nb.nearest(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    protos = co.class_prototypes(t.golden(spark, folder))
    return sc.with_blend(sc.with_vote(sc.with_prototype_scores(near, protos)))


@C.add(
    "score_blend",
    t.with_(*SCORED, select="SELECT query_id, label_id, round(score, 6) AS score FROM blended"),
)
def score_blend(spark, folder):
    rows = _blended(spark, folder).select("query_id", F.explode("blend").alias("b")).select("query_id", "b.*")
    return t.rounded(rows, "score")


@C.add(
    "blend_prediction",
    t.with_(*SCORED, select="SELECT query_id, label_id, round(confidence, 6) AS confidence FROM best"),
)
def blend_prediction(spark, folder):
    best = _blended(spark, folder).select("query_id", F.col("predicted_label_id").alias("label_id"), "confidence")
    return t.rounded(best, "confidence")


@C.add(
    "ood_flag",
    t.with_(
        *NN,
        select="""SELECT query_id, round(min(d2), 6) AS ood_distance, min(d2) > 1.25 AS is_ood FROM nn GROUP BY query_id""",
    ),
)
def ood_flag(spark, folder):
    near = nb.nearest(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    return t.rounded(sc.with_ood(near, 1.25).select("query_id", "ood_distance", "is_ood"), "ood_distance")


@C.add(
    "vote_distribution",
    t.with_(
        *NN,
        t.VOTE,
        select="""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, label_id) AS place,
  'class ' || label_id AS category, round(share, 4) AS share FROM vote""",
    ),
)
def vote_distribution(spark, folder):
    near = nb.nearest(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    voted = sc.with_vote(near).withColumn("predicted_label_id", F.lit(0))
    named = sc.with_categories(voted, sc.label_map(t.names(spark, folder)))
    rows = named.select("query_id", F.posexplode("vote_distribution").alias("place", "v"))
    return rows.select("query_id", (F.col("place") + 1).cast("bigint").alias("place"), "v.category", "v.share")


@C.add(
    "neighbour_lists",
    t.with_(
        *NN,
        select="""SELECT query_id, string_agg('class ' || label_id, ',' ORDER BY rk) AS labels,
  string_agg(golden_id, ',' ORDER BY rk) AS ids, round(list_sum(list(d2 ORDER BY rk)), 6) AS total FROM nn GROUP BY query_id""",
    ),
)
def neighbour_lists(spark, folder):
    near = nb.nearest(t.asked(spark, folder), t.golden(spark, folder), 10, exclude_self=True)
    named = sc.with_categories(
        sc.with_vote(near).withColumn("predicted_label_id", F.lit(0)), sc.label_map(t.names(spark, folder))
    )
    total = F.aggregate("distances", F.lit(0.0), lambda a, x: a + x)
    return named.select(
        "query_id",
        F.array_join("top_k_labels", ",").alias("labels"),
        F.array_join(F.transform("neighbours", lambda n: n.golden_id.cast("string")), ",").alias("ids"),
        F.round(total, 6).alias("total"),
    )


# The whole path with a threshold swept on the OOD rows. Labels of these vectors are
# random, so confidence stays near 0.2-0.3; 0.22 sends rows both ways.
FLAGS = """
flagged AS MATERIALIZED (
  SELECT query_id, best.label_id, confidence, d2 AS ood_distance, threshold, d2 > threshold AS is_ood
  FROM best JOIN nn USING (query_id) CROSS JOIN threshold WHERE rk = 1),
routed AS MATERIALIZED (
  SELECT query_id,
    CASE WHEN is_ood AND confidence < 0.22 THEN 'other' ELSE 'class ' || label_id END AS predicted_category,
    CASE WHEN is_ood AND confidence < 0.22 THEN 0.0 ELSE confidence END AS confidence,
    is_ood, ood_distance, threshold AS ood_threshold, is_ood OR confidence < 0.22 AS needs_llm
  FROM flagged)"""
PREDICTED = (*SCORED, t.DISTANCES, t.SWEEP, FLAGS)
PREDICT_SELECT = """SELECT query_id, predicted_category, round(confidence, 6) AS confidence, is_ood,
  round(ood_distance, 6) AS ood_distance, round(ood_threshold, 6) AS ood_threshold, needs_llm FROM routed"""


def vector_corpus(spark, folder):
    ood = t.outside(spark, folder)
    return build_corpus(t.golden(spark, folder), t.names(spark, folder), ood, BuildSpec(max_per_class=1000))


def predicted(spark, folder):
    return predict(t.asked(spark, folder), vector_corpus(spark, folder), confidence_threshold=0.22, exclude_self=True)


@C.add("predict", t.with_(*PREDICTED, select=PREDICT_SELECT))
def predict_vectors(spark, folder):
    scored = predicted(spark, folder).select(
        "query_id", "predicted_category", "confidence", "is_ood", "ood_distance", "ood_threshold", "needs_llm"
    )
    return t.rounded(scored, "confidence", "ood_distance", "ood_threshold")


# --- Corpus -------------------------------------------------------------------------


@C.add(
    "stratify_hash",
    t.with_(
        t.E,
        select="""SELECT id AS golden_id, label_id FROM g
QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || id), id) <= 20""",
    ),
)
def stratify_hash(spark, folder):
    return co.stratify(t.golden(spark, folder), 20, "hash").select("golden_id", "label_id")


FARTHEST = f"""
walk AS (
  SELECT 1 AS pick, id, label_id, v, {{start}} AS chosen, CAST('inf' AS DOUBLE) AS gap FROM g
  UNION ALL
  SELECT pick + 1, id, label_id, v,
    arg_max(id, new_gap) OVER (PARTITION BY label_id) AS chosen, new_gap
  FROM (
    SELECT w.pick, w.id, w.label_id, w.v,
      CASE WHEN w.id = w.chosen THEN -1 ELSE least(w.gap, {t.d2('w.v', 'c.v')}) END AS new_gap
    FROM walk w JOIN g c ON c.id = w.chosen WHERE w.pick < {{k}}) s)"""


def farthest(k: int) -> str:
    start = "first_value(id) OVER (PARTITION BY label_id ORDER BY md5('42:' || id), id)"
    walk = FARTHEST.format(start=start, k=k)
    return "WITH RECURSIVE " + ",".join((t.E, walk))


@C.add("farthest_point", farthest(12) + "\nSELECT DISTINCT label_id, chosen AS golden_id, pick FROM walk")
def farthest_point(spark, folder):
    return co.farthest_point(t.golden(spark, folder), 12, leaves=1)


def farthest_tree(k: int, leaves: int, fan_in: int) -> str:
    """Two levels: greedy in each leaf, then greedy over what the leaves kept."""
    leaf = f"floor(('0x' || substring(md5('42:leaf:' || id), 1, 8))::BIGINT * {leaves} / 4294967296.0)::INTEGER"

    def level(name: str, source: str, key: str) -> str:
        start = f"first_value(id) OVER (PARTITION BY {key} ORDER BY md5('42:' || id), id)"
        walk = FARTHEST.format(start=start, k=k).replace("FROM g\n", f"FROM {source}\n").replace("JOIN g c", f"JOIN {source} c")
        return walk.replace("walk", name).replace("PARTITION BY label_id", f"PARTITION BY {key}").replace("id, label_id, v", "id, label_id, v, node").replace("w.id, w.label_id, w.v", "w.id, w.label_id, w.v, w.node")

    return "WITH RECURSIVE " + ",".join((
        t.E,
        f"leaf AS MATERIALIZED (SELECT id, label_id, v, {leaf} AS node FROM g)",
        level("low", "leaf", "label_id, node"),
        "upper AS MATERIALIZED (SELECT DISTINCT g.id, g.label_id, g.v, 0 AS node FROM low JOIN g ON g.id = low.chosen)",
        level("high", "upper", "label_id"),
    )) + "\nSELECT DISTINCT label_id, chosen AS golden_id, pick FROM high"


@C.add("farthest_point_tree", farthest_tree(5, 4, 4))
def farthest_point_tree(spark, folder):
    """Four leaves, each of fewer than four times the cap."""
    return co.farthest_point(t.golden(spark, folder), 5, leaves=4, fan_in=4)


@C.add("stratify_farthest", farthest(12) + "\nSELECT DISTINCT chosen AS golden_id, label_id FROM walk")
def stratify_farthest(spark, folder):
    return co.stratify(t.golden(spark, folder), 12, leaves=1).select("golden_id", "label_id")


@C.add(
    "unknown_categories",
    t.with_(
        t.E,
        select="""SELECT DISTINCT 'class ' || label_id AS category FROM e
WHERE 'class ' || label_id NOT IN (SELECT 'class ' || label_id FROM g)""",
    ),
)
def unknown_categories(spark, folder):
    from tagweave.operators.clean import unknown_categories as unknown

    every = t.vectors(spark, folder).select(F.concat(F.lit("class "), F.col("label_id").cast("string")).alias("category"))
    return unknown(every, t.names(spark, folder))


@C.add(
    "missing_categories",
    "SELECT DISTINCT 'class ' || label AS category FROM embeddings WHERE label NOT IN (SELECT quality FROM labels)",
)
def missing_categories(spark, folder):
    """Vector classes without a row among the quality labels."""
    from tagweave.operators.clean import missing_categories as missing

    def named(df, column):
        return df.select(F.concat(F.lit("class "), F.col(column).cast("string")).alias("category"))

    return missing(named(t.table(spark, folder, "labels"), "quality"), named(t.table(spark, folder, "embeddings"), "label"))


# --- Calibration ----------------------------------------------------------------------


@C.add("nn_distance", t.with_(t.E, t.DISTANCES, select="SELECT golden_id, round(d2, 6) AS d2 FROM in_d"))
def nn_distance(spark, folder):
    return t.rounded(co.nn_distance(t.golden(spark, folder)), "d2")


@C.add(
    "prototypes_merged",
    t.with_(
        t.E,
        t.PROTO,
        select="SELECT label_id, generate_subscripts(p, 1) AS pos, round(unnest(p), 6) AS value FROM proto",
    ),
)
def prototypes_merged(spark, folder):
    """Class means of three batches, merged without their rows."""
    golden = t.golden(spark, folder)
    batches = [st.class_sums(golden.filter(F.pmod(F.xxhash64("golden_id"), F.lit(3)) == k)) for k in range(3)]
    merged = st.merged_sums(batches[0].unionByName(batches[1]))
    protos = st.prototypes_of(st.merged_sums(merged.unionByName(batches[2])))
    rows = protos.select("label_id", F.posexplode("proto").alias("pos", "value"))
    return rows.select("label_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@C.add(
    "ood_threshold_percentile",
    t.with_(t.E, t.DISTANCES, select="SELECT round(quantile_cont(d2, 0.95), 6) AS threshold FROM in_d"),
)
def ood_threshold_percentile(spark, folder):
    return t.rounded(co.ood_threshold_percentile(co.nn_distance(t.golden(spark, folder))), "threshold")


@C.add(
    "ood_threshold_f1",
    t.with_(t.E, t.DISTANCES, t.SWEEP, select="SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM threshold"),
)
def ood_threshold_f1(spark, folder):
    found = co.ood_threshold_f1(
        co.nn_distance(t.golden(spark, folder)), co.ood_distance(t.outside(spark, folder), t.golden(spark, folder))
    )
    return t.rounded(found, "threshold", "f1")


@C.add(
    "calibrate_ood",
    t.with_(t.E, t.DISTANCES, t.SWEEP, select="SELECT 'known ood' AS method, round(threshold, 6) AS threshold FROM threshold UNION ALL SELECT 'percentile', round(quantile_cont(d2, 0.95), 6) FROM in_d"),
)
def calibrate_ood(spark, folder):
    """Both branches: with OOD rows and without."""
    golden = t.golden(spark, folder)
    row = lambda name, value: spark.range(1).select(F.lit(name).alias("method"), F.round(F.lit(value), 6).alias("threshold"))
    swept = row("known ood", co.calibrate_ood(golden, t.outside(spark, folder)))
    return swept.unionByName(row("percentile", co.calibrate_ood(golden)))
