"""Sampling, batches, triplets and evaluation over the embeddings and labels tables."""

from pyspark.sql import functions as F

from catalog import Catalog
from catalog import tables as t
from tagweave.operators import ball_metrics as bm
from tagweave.operators import metrics as me
from tagweave.operators import sampling as sa
from tagweave.operators.balls import fit_balls

C = Catalog()

LOO = f"""
loo AS MATERIALIZED (
  SELECT a.id AS query_id, a.label_id AS true_label, b.id AS golden_id, b.label_id, {t.d2('a.v', 'b.v')} AS d2
  FROM e a JOIN e b ON a.id <> b.id)"""
LOO_NN = (t.E, LOO, t.top(10, "loo"))

RECALL = """
recall AS (
  SELECT k, avg(hit) AS recall FROM (
    SELECT query_id, k, max(CASE WHEN rk <= k AND label_id = true_label THEN 1 ELSE 0 END) AS hit
    FROM nn CROSS JOIN (VALUES (1), (5), (10)) ks(k) GROUP BY query_id, k) GROUP BY k)"""
PREDS = """
preds AS MATERIALIZED (SELECT query_id, true_label, label_id AS pred_label FROM nn WHERE rk = 1)"""
FULL = """
ranked AS MATERIALIZED (
  SELECT query_id, true_label, min(rk) FILTER (label_id = true_label) AS first_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, golden_id) AS rk FROM loo)
  GROUP BY query_id, true_label)"""
REPORT = """
report AS MATERIALIZED (
  SELECT label, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, 2 * tp / (claimed + support) AS f1, support
  FROM (
    SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp,
      count(*) FILTER (pred_label = label) AS claimed, count(*) FILTER (true_label = label) AS support
    FROM preds JOIN (SELECT true_label AS label FROM preds UNION SELECT pred_label FROM preds) l
      ON true_label = label OR pred_label = label GROUP BY label))"""


@C.add("recall_at_k", t.with_(*LOO_NN, RECALL, select="SELECT k, round(recall, 6) AS recall FROM recall"))
def recall_at_k(spark, folder):
    return t.rounded(me.recall_at_k(t.vectors(spark, folder)), "recall")


@C.add("first_match_rank", t.with_(t.E, LOO, FULL, select="SELECT query_id, true_label AS label_id, first_rank FROM ranked"))
def first_match_rank(spark, folder):
    return me.first_match_rank(t.vectors(spark, folder))


@C.add("mrr", t.with_(t.E, LOO, FULL, select="SELECT round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM ranked"))
def mrr(spark, folder):
    return t.rounded(me.mrr(t.vectors(spark, folder)), "mrr")


@C.add("mrr_bounded", t.with_(t.E, LOO, FULL, select="SELECT round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM ranked"))
def mrr_bounded(spark, folder):
    """Ranks counted by whole balls, their rows compared only where a distance cuts a ball."""
    golden = t.vectors(spark, folder)
    return t.rounded(bm.mrr_bounded(golden, fit_balls(golden, n_cells=4, leaf_rows=1 << 14, by_label=True)), "mrr")


@C.add("mrr_blocks", t.with_(t.E, LOO, FULL, select="SELECT round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM ranked"))
def mrr_blocks(spark, folder):
    """The same through bounded blocks, as for a set too large to broadcast."""
    limits = me.ScanLimits(broadcast_bytes=0, block_rows=200, chunk_rows=200)
    return t.rounded(me.mrr(t.vectors(spark, folder), limits=limits), "mrr")


@C.add(
    "loo_accuracy",
    t.with_(*LOO_NN, PREDS, select="SELECT round(avg((true_label = pred_label)::INTEGER), 6) AS accuracy FROM preds"),
)
def loo_accuracy(spark, folder):
    return t.rounded(me.loo_accuracy(t.vectors(spark, folder)), "accuracy")


@C.add(
    "distance_profile",
    t.with_(
        t.E,
        LOO,
        select="""SELECT query_id, count(*) AS n, round(min(sqrt(d2)), 6) AS least,
  round(max(sqrt(d2)), 6) AS greatest, round(avg(sqrt(d2)), 6) AS mean FROM loo GROUP BY query_id""",
    ),
)
def distance_profile(spark, folder):
    return t.rounded(me.distance_profile(t.vectors(spark, folder)), "least", "greatest", "mean")


@C.add(
    "class_report",
    t.with_(
        *LOO_NN, PREDS, REPORT,
        select="""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM report""",
    ),
)
def class_report(spark, folder):
    return t.rounded(me.class_report(me.loo_predictions(t.vectors(spark, folder))), "precision", "recall", "f1")


@C.add(
    "worst_classes",
    t.with_(
        *LOO_NN, PREDS, REPORT,
        select="SELECT label, round(f1, 6) AS f1, support FROM report ORDER BY report.f1, label LIMIT 3",
    ),
)
def worst_classes(spark, folder):
    worst = me.class_report(me.loo_predictions(t.vectors(spark, folder)), worst_n=3)
    return t.rounded(worst.select("label", "f1", "support"), "f1")


F1 = """
f1 AS (SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM report)"""


@C.add(
    "f1_scores",
    t.with_(
        *LOO_NN, PREDS, REPORT, F1,
        select="SELECT round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM f1",
    ),
)
def f1_scores(spark, folder):
    return t.rounded(me.f1_scores(me.loo_predictions(t.vectors(spark, folder))), "macro_f1", "weighted_f1")


@C.add(
    "report_averages",
    t.with_(
        *LOO_NN, PREDS, REPORT,
        select="""SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(f1), 6) AS f1 FROM report
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM report""",
    ),
)
def report_averages(spark, folder):
    return t.rounded(me.report_averages(me.loo_predictions(t.vectors(spark, folder))), "precision", "recall", "f1")


# --- Calibration of the quality labels -----------------------------------------------

GRADED = """
graded AS MATERIALIZED (
  SELECT (n_chars % 101) / 100 AS confidence, quality AS correct FROM labels JOIN documents USING (doc_id))"""


def graded(spark, folder):
    docs = t.table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = t.table(spark, folder, "labels").join(docs, "doc_id")
    return rows.select((F.col("n_chars") % 101 / F.lit(100)).alias("confidence"), F.col("quality").alias("correct"))


BINNED = """
binned AS (
  SELECT confidence, correct,
    len(list_filter([i * (1 / 10) FOR i IN range(10)] || [1.0], lambda x: x < confidence)) AS bin FROM graded)"""


@C.add(
    "ece_bins",
    t.with_(
        GRADED, BINNED,
        select="""SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(confidence), 6) AS avg_confidence,
  round(avg(correct), 6) AS avg_correct FROM binned GROUP BY bin""",
    ),
)
def ece_bins(spark, folder):
    return t.rounded(me.ece_bins(graded(spark, folder), "confidence", "correct"), "avg_confidence", "avg_correct")


@C.add(
    "ece",
    t.with_(
        GRADED, BINNED,
        select="""SELECT round(sum(CASE WHEN bin BETWEEN 1 AND 10 THEN n * abs(c - a) ELSE 0 END) / sum(n), 6) AS ece
FROM (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM binned GROUP BY bin)""",
    ),
)
def ece(spark, folder):
    return t.rounded(me.ece(graded(spark, folder)), "ece")


AUROC = """
ranks AS (
  SELECT ood, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM scores),
auroc AS (
  SELECT (sum(r) FILTER (ood = 1) - p * (p + 1) / 2) / (p * q) AS auroc
  FROM ranks CROSS JOIN (SELECT sum(ood) AS p, count(*) - sum(ood) AS q FROM scores) GROUP BY p, q)"""


@C.add(
    "ood_auroc",
    t.with_(
        GRADED, "\nscores AS (SELECT confidence AS s, 1 - correct AS ood FROM graded)", AUROC,
        select="SELECT round(auroc, 6) AS auroc FROM auroc",
    ),
)
def ood_auroc(spark, folder):
    """Scores with many ties: low quality counts as out of distribution."""
    rows = graded(spark, folder)
    return t.rounded(
        me.ood_auroc(rows.filter("correct = 1"), rows.filter("correct = 0"), "confidence"), "auroc"
    )


@C.add(
    "ood_auroc_distances",
    t.with_(
        t.E, t.DISTANCES, "\nscores AS (SELECT d2 AS s, ood FROM all_d)", AUROC,
        select="SELECT round(auroc, 6) AS auroc FROM auroc",
    ),
)
def ood_auroc_distances(spark, folder):
    from tagweave.operators.corpus import nn_distance, ood_distance

    golden = t.golden(spark, folder)
    return t.rounded(me.ood_auroc(nn_distance(golden), ood_distance(t.outside(spark, folder), golden)), "auroc")


# --- Samples, splits, batches -----------------------------------------------------------


@C.add(
    "sample_n",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300",
)
def sample_n(spark, folder):
    docs = t.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return sa.sample_n(docs, 300, 42, "doc_id")


LINE_KEY = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"


@C.add(
    "stratified_split",
    f"""WITH l AS (SELECT {LINE_KEY} AS line, l_returnflag FROM lineitem),
r AS (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || line), line) - 1 AS pos,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM l)
SELECT line, l_returnflag, CASE WHEN pos < round(0.15 * n) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, folder):
    lines = t.table(spark, folder, "lineitem")
    keys = F.concat_ws("-", *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    rows = lines.select(keys.alias("line"), "l_returnflag")
    return sa.stratified_split(rows, "l_returnflag", "line")


def batches(size: int) -> str:
    return f"""
sizes AS (SELECT label_id, count(*) AS n FROM e GROUP BY label_id),
shape AS (
  SELECT per, greatest(1, m // per) AS batches
  FROM (SELECT greatest(2, {size} // count(*)) AS per, max(n) AS m FROM sizes)),
lined AS (
  SELECT id, label_id, n,
    row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || id), id) - 1 AS pos FROM e JOIN sizes USING (label_id)),
placed AS (
  SELECT id, label_id, per, unnest(range(pos, per * batches, n)) AS place FROM lined CROSS JOIN shape),
batched AS MATERIALIZED (
  SELECT id, label_id, place // per AS batch_id,
    (row_number() OVER (PARTITION BY place // per ORDER BY md5('42:' || (place // per) || ':' || label_id || ':' || place)))::INTEGER AS seat
  FROM placed QUALIFY seat <= {size})"""


@C.add(
    "balanced_batches",
    t.with_(t.E, batches(64), select="SELECT batch_id, seat, id AS golden_id, label_id FROM batched"),
)
def balanced_batches(spark, folder):
    rows = t.vectors(spark, folder).select("golden_id", "label_id")
    return sa.balanced_batches(rows, "label_id", "golden_id", 64)


@C.add(
    "balanced_batches_cut",
    t.with_(t.E, batches(16), select="SELECT batch_id, seat, id AS golden_id, label_id FROM batched"),
)
def balanced_batches_cut(spark, folder):
    """More classes than half a batch: two rows of each, then cut to the batch size."""
    rows = t.vectors(spark, folder).select("golden_id", "label_id")
    return sa.balanced_batches(rows, "label_id", "golden_id", 16)


TRIPLETS = f"""
b AS MATERIALIZED (SELECT batched.*, e.v FROM batched JOIN e USING (id)),
pos AS MATERIALIZED (
  SELECT a.batch_id, a.seat, arg_min(p.seat, md5('42:' || a.batch_id || ':p:' || a.seat || ':' || p.seat)) AS p_seat
  FROM b a JOIN b p ON a.batch_id = p.batch_id AND a.label_id = p.label_id AND a.seat <> p.seat GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a.batch_id, a.seat, a.id AS anchor_id, a.label_id, a.v, p.id AS positive_id, sqrt({t.d2('a.v', 'p.v')}) AS d_ap
  FROM pos JOIN b a USING (batch_id, seat) JOIN b p ON p.batch_id = pos.batch_id AND p.seat = pos.p_seat),
negs AS MATERIALIZED (
  SELECT near.batch_id, near.seat, n.id AS negative_id, n.seat AS n_seat, d_ap, sqrt({t.d2('near.v', 'n.v')}) AS d_an
  FROM near JOIN b n ON n.batch_id = near.batch_id AND n.label_id <> near.label_id),
chosen AS (
  SELECT batch_id, seat, negative_id, d_an FROM (
    SELECT *, d_an > d_ap AND d_an < d_ap + 0.5 AS fits FROM negs)
  QUALIFY row_number() OVER (
    PARTITION BY batch_id, seat
    ORDER BY fits DESC, CASE WHEN fits THEN md5('42:' || batch_id || ':n:' || seat || ':' || n_seat) END, d_an, n_seat) = 1),
triplets AS MATERIALIZED (
  SELECT batch_id, seat AS anchor_seat, anchor_id, positive_id, negative_id, d_ap, d_an
  FROM near JOIN chosen USING (batch_id, seat)
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY seat) <= 40),
loss AS (
  SELECT avg(l) AS loss FROM (
    SELECT batch_id, avg(greatest(0, d_ap - d_an + 0.5)) AS l FROM triplets GROUP BY batch_id))"""


def batched(spark, folder):
    return sa.balanced_batches(t.vectors(spark, folder), "label_id", "golden_id", 64)


@C.add(
    "mine_triplets",
    t.with_(
        t.E, batches(64), TRIPLETS,
        select="""SELECT batch_id, anchor_seat, anchor_id, positive_id, negative_id,
  round(d_ap, 6) AS d_ap, round(d_an, 6) AS d_an FROM triplets""",
    ),
)
def mine_triplets(spark, folder):
    return t.rounded(sa.mine_triplets(batched(spark, folder), 0.5, 40), "d_ap", "d_an")


@C.add("triplet_loss", t.with_(t.E, batches(64), TRIPLETS, select="SELECT round(loss, 6) AS loss FROM loss"))
def triplet_loss(spark, folder):
    return t.rounded(me.triplet_loss(sa.mine_triplets(batched(spark, folder), 0.5, 40), 0.5), "loss")


def supcon(temperature: str, weight: str) -> str:
    return f"""
b AS MATERIALIZED (
  SELECT batched.*, e.v, {temperature} AS temp, {weight} AS weight
  FROM batched JOIN e USING (id) JOIN sizes ON sizes.label_id = batched.label_id
    CROSS JOIN (SELECT count(*) AS total FROM e)),
sims AS MATERIALIZED (
  SELECT a.batch_id, a.seat, a.weight, a.label_id = o.label_id AS same, {t.dot('a.v', 'o.v')} / a.temp AS s
  FROM b a JOIN b o ON a.batch_id = o.batch_id AND a.seat <> o.seat),
anchors AS (
  SELECT batch_id, seat, weight, max(s) AS top, count(*) FILTER (same) AS positives, avg(s) FILTER (same) AS mean
  FROM sims GROUP BY ALL),
each AS (
  SELECT batch_id, seat, any_value(a.weight) * (top + ln(sum(exp(s - top))) - mean) AS loss
  FROM sims JOIN anchors a USING (batch_id, seat) WHERE positives > 0 GROUP BY batch_id, seat, top, mean)"""


SUPCON_SELECT = "SELECT batch_id, count(*)::INTEGER AS anchors, round(avg(loss), 6) AS loss FROM each GROUP BY batch_id"


@C.add("supcon_loss", t.with_(t.E, batches(64), supcon("0.07", "1"), select=SUPCON_SELECT))
def supcon_loss(spark, folder):
    return t.rounded(me.supcon_loss(batched(spark, folder)), "loss")


@C.add(
    "supcon_loss_weighted",
    t.with_(t.E, batches(64), supcon("0.07 * pow(n / total, 0.3)", "pow(total / n, 0.5)"), select=SUPCON_SELECT),
)
def supcon_loss_weighted(spark, folder):
    from tagweave.operators.features import class_temperatures, class_weights

    rows = t.vectors(spark, folder)
    weights, temperatures = class_weights(rows, "label_id"), class_temperatures(rows, "label_id")
    return t.rounded(me.supcon_loss(batched(spark, folder), 0.07, weights, temperatures), "loss")


ROLL = "('0x' || substr(md5('42:' || draw || ':{role}'), 1, 8))::BIGINT"


def roll(role: str) -> str:
    return ROLL.format(role=role)


@C.add(
    "random_triplets",
    t.with_(
        t.E,
        f"""
sizes AS (SELECT label_id, count(*) AS n FROM e GROUP BY label_id),
classes AS (SELECT list({{'l': label_id, 'n': n}} ORDER BY label_id) AS c FROM sizes),
ranked AS (SELECT id, label_id, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || id), id) - 1 AS pos FROM e),
d1 AS (SELECT range AS draw, c, list_filter(c, lambda x: x.n >= 2) AS ok FROM range(1000) CROSS JOIN classes),
d2 AS (SELECT draw, c, ok[1 + {roll('class')} % len(ok)] AS a FROM d1),
d3 AS (SELECT draw, a, list_filter(c, lambda x: x.l <> a.l) AS rest FROM d2),
d4 AS (SELECT draw, a, rest[1 + {roll('other')} % len(rest)] AS o, {roll('anchor')} % a.n AS a_pos FROM d3),
d5 AS (
  SELECT draw, a.l AS al, o.l AS ol, a_pos, (a_pos + 1 + {roll('positive')} % (a.n - 1)) % a.n AS p_pos,
    {roll('negative')} % o.n AS n_pos FROM d4)""",
        select="""SELECT draw, a.id AS anchor_id, p.id AS positive_id, n.id AS negative_id FROM d5
JOIN ranked a ON a.label_id = al AND a.pos = a_pos JOIN ranked p ON p.label_id = al AND p.pos = p_pos
JOIN ranked n ON n.label_id = ol AND n.pos = n_pos""",
    ),
)
def random_triplets(spark, folder):
    rows = t.vectors(spark, folder).select("golden_id", "label_id")
    return sa.random_triplets(rows, "label_id", "golden_id", 1000)


@C.add(
    "evaluate",
    t.with_(
        *LOO_NN, RECALL, PREDS, FULL, REPORT, F1, batches(64), TRIPLETS,
        select="""SELECT metric, round(value, 6) AS value FROM (
SELECT 'accuracy' AS metric, avg((true_label = pred_label)::INTEGER) AS value FROM preds
UNION ALL SELECT 'mrr', avg(coalesce(1 / first_rank, 0)) FROM ranked
UNION ALL SELECT 'macro_f1', macro_f1 FROM f1 UNION ALL SELECT 'weighted_f1', weighted_f1 FROM f1
UNION ALL SELECT 'val_loss', loss FROM loss UNION ALL SELECT 'recall@' || k, recall FROM recall)""",
    ),
)
def evaluate(spark, folder):
    spec = me.EvaluationSpec(max_triplets=40)
    return t.rounded(me.evaluate(t.vectors(spark, folder), batched(spark, folder), spec), "value")


@C.add("evaluate_indexed", C.sql["evaluate"])
def evaluate_indexed(spark, folder):
    """The same figures from a kept index, without a scan of all rows for each."""
    golden = t.vectors(spark, folder)
    index = fit_balls(golden, n_cells=4, leaf_rows=1 << 14, by_label=True)
    return t.rounded(bm.evaluate_indexed(golden, batched(spark, folder), index, me.EvaluationSpec(max_triplets=40)), "value")
