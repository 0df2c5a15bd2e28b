"""Sources, cleaning and fitting over line items seen as financial records."""

from pyspark.sql import functions as F

from catalog import Catalog
from catalog import tables as t
from tagweave import fixed_values as fixed
from tagweave.functions import sketches as sk
from tagweave.functions.session import scratch_path
from tagweave.operators import clean as cl
from tagweave.operators import features as fe
from tagweave.operators import reports as re
from tagweave.operators import state as st
from tagweave.sources import records as so
from tagweave.spec import RoleSpec

C = Catalog()

MODES = {"1-URGENT": "UPI", "2-HIGH": "IMPS", "3-MEDIUM": "NEFT", "5-LOW": "POS"}
KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

R = """
r AS MATERIALIZED (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS record_id,
    o_custkey AS cust_id, l_shipdate::DATE AS tran_date, p_name || ' ' || p_brand AS tran_partclr,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'UPI'
      WHEN o_orderpriority = '2-HIGH' THEN 'IMPS' WHEN o_orderpriority = '3-MEDIUM' THEN 'NEFT'
      WHEN o_orderpriority = '5-LOW' THEN 'POS' ELSE o_orderpriority END AS tran_mode,
    CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'C' END AS dr_cr_indctor,
    CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'N' THEN 'N' END AS sal_flag,
    l_extendedprice AS tran_amt_in_ac, CASE WHEN p_type = 'ECONOMY' THEN 'other' ELSE p_type END AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def records(spark, folder):
    """Line items with their order and part, in the columns of a transaction."""
    lines = t.table(spark, folder, "lineitem")
    orders = t.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = t.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    mode = F.when(F.col("l_orderkey") % 17 == 0, F.lit(None))
    for priority, name in MODES.items():
        mode = mode.when(F.col("o_orderpriority") == priority, F.lit(name))
    return joined.select(
        F.concat_ws("-", *[F.col(c) for c in KEY]).alias("record_id"),
        F.col("o_custkey").alias("cust_id"),
        F.col("l_shipdate").cast("date").alias("tran_date"),
        F.concat_ws(" ", "p_name", "p_brand").alias("tran_partclr"),
        mode.otherwise(F.col("o_orderpriority")).alias("tran_mode"),
        F.when(F.col("l_linestatus") == "O", "D").otherwise("C").alias("dr_cr_indctor"),
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "N", "N").alias("sal_flag"),
        F.col("l_extendedprice").alias("tran_amt_in_ac"),
        F.when(F.col("p_type") == "ECONOMY", "other").otherwise(F.col("p_type")).alias("category"),
    )


COLUMNS = "record_id, cust_id, tran_date, tran_partclr, tran_mode, dr_cr_indctor, sal_flag, tran_amt_in_ac, category"


@C.add("read_records_csv", t.with_(R, select=f"SELECT {COLUMNS} FROM r"))
def read_records_csv(spark, folder):
    """Written as CSV with ``NULL`` cells, read back with its types."""
    rows = records(spark, folder)
    path = scratch_path(spark)
    rows.write.option("header", True).option("nullValue", "NULL").csv(path)
    return so.read_records(spark, path, rows.schema)


#: Where a record's key ends so, its CSV cell is spoilt.
SPOILT = """
s AS (
  SELECT *, CASE WHEN record_id LIKE '%7-1' THEN 'n/a!' WHEN record_id LIKE '%3-2' THEN '12,50' ELSE tran_amt_in_ac::VARCHAR END AS amount_cell,
    CASE WHEN record_id LIKE '%37-_' THEN 'yesterday' ELSE tran_date::VARCHAR END AS date_cell FROM r),
u AS (SELECT *, list_filter([
    CASE WHEN date_cell = 'yesterday' THEN 'tran_date is no date: yesterday' END,
    CASE WHEN amount_cell IN ('n/a!', '12,50') THEN 'tran_amt_in_ac is no double: ' || amount_cell END], lambda x: x IS NOT NULL) AS why FROM s)"""


def spoilt_csv(spark, folder):
    rows = records(spark, folder)
    path = scratch_path(spark)
    amount = F.when(F.col("record_id").like("%7-1"), "n/a!").when(F.col("record_id").like("%3-2"), "12,50").otherwise(F.col("tran_amt_in_ac").cast("string"))
    date = F.when(F.col("record_id").like("%37-_"), "yesterday").otherwise(F.col("tran_date").cast("string"))
    rows.withColumns({"tran_amt_in_ac": amount, "tran_date": date}).write.option("header", True).option("nullValue", "NULL").csv(path)
    return path, rows.schema


@C.add("read_records_quarantine", t.with_(R, SPOILT, select="SELECT record_id, array_to_string(why, '; ') AS why FROM u WHERE len(why) > 0"))
def read_records_quarantine(spark, folder):
    """Rows with cells that are no amount or date, set aside with their reasons."""
    path, schema = spoilt_csv(spark, folder)
    found = so.read_records_checked(spark, path, schema, most_bad=0.2)
    return found.bad.select(F.col("cells")["record_id"].alias("record_id"), F.array_join("reasons", "; ").alias("why"))


@C.add("read_records_good", t.with_(R, SPOILT, select=f"SELECT {COLUMNS} FROM u WHERE len(why) = 0"))
def read_records_good(spark, folder):
    path, schema = spoilt_csv(spark, folder)
    return so.read_records_checked(spark, path, schema, most_bad=0.2).good


@C.add("read_ood", t.with_(R, select="SELECT record_id, tran_amt_in_ac, category FROM r WHERE category = 'other'"))
def read_ood(spark, folder):
    return so.read_ood(records(spark, folder)).select("record_id", "tran_amt_in_ac", "category")


@C.add("normalise_columns", t.with_(R, select="SELECT record_id, tran_mode, category, tran_partclr FROM r"))
def normalise_columns(spark, folder):
    variant = records(spark, folder).select(
        "record_id",
        F.col("tran_mode").alias("tran_type"),
        F.col("category").alias("category_of_txn"),
        F.col("tran_partclr").alias("tran_partlcr"),
    )
    return cl.normalise_columns(variant)


@C.add(
    "fill_null_strings",
    t.with_(
        R,
        select="""SELECT record_id, coalesce(tran_mode, 'NULL') AS tran_mode, dr_cr_indctor,
  coalesce(sal_flag, 'NULL') AS sal_flag, tran_amt_in_ac FROM r""",
    ),
)
def fill_null_strings(spark, folder):
    rows = records(spark, folder).select("record_id", "tran_mode", "dr_cr_indctor", "sal_flag", "tran_amt_in_ac")
    return cl.fill_null_strings(rows)


@C.add(
    "with_defaults",
    t.with_(
        R,
        select="""SELECT record_id, tran_amt_in_ac, tran_partclr, '' AS cust_id, '' AS tran_date, 'NULL' AS tran_mode,
  'NULL' AS dr_cr_indctor, 'NULL' AS sal_flag FROM r""",
    ),
)
def with_defaults(spark, folder):
    rows = records(spark, folder).select("record_id", F.col("tran_amt_in_ac").cast("string"), "tran_partclr")
    return cl.with_defaults(rows)


@C.add("checked_records", t.with_(R, select="SELECT record_id, tran_amt_in_ac FROM r"))
def checked_records(spark, folder):
    """Required columns and rows are there, so the table passes unchanged."""
    rows = records(spark, folder).select("record_id", "tran_amt_in_ac")
    return cl.require_rows(cl.require_columns(rows, ["tran_amt_in_ac"]))


@C.add("in_distribution", t.with_(R, select="SELECT record_id, category FROM r WHERE category <> 'other'"))
def in_distribution(spark, folder):
    return cl.in_distribution(records(spark, folder)).select("record_id", "category")


@C.add("unlabelled", t.with_(R, select="SELECT count(*) FILTER (sal_flag IS NULL) AS n FROM r"))
def unlabelled(spark, folder):
    """The salary flag as label: returned items have none."""
    return cl.unlabelled(records(spark, folder), "sal_flag")


# --- Fit -------------------------------------------------------------------------------


def seeds(col: str) -> str:
    values = [fixed.UNKNOWN_TOKEN, *fixed.KNOWN_VALUES[col]]
    return ", ".join(f"('{col}', '{v}', {i})" for i, v in enumerate(values))


CATEGORICAL = RoleSpec().categorical
SEEN = " UNION ".join(f"SELECT '{c}' AS col, coalesce({c}, 'NULL') AS value FROM r" for c in CATEGORICAL)
VOCAB = f"""
seeds(col, value, id) AS (VALUES {", ".join(seeds(c) for c in CATEGORICAL)}),
fresh AS (SELECT * FROM ({SEEN}) s WHERE (col, value) NOT IN (SELECT (col, value) FROM seeds)),
vocab AS MATERIALIZED (
  SELECT col, value, id::INTEGER AS id FROM seeds
  UNION ALL
  SELECT col, value, (row_number() OVER (PARTITION BY col ORDER BY value)
    + (SELECT max(id) FROM seeds s WHERE s.col = fresh.col))::INTEGER FROM fresh)"""


@C.add("fit_vocab", t.with_(R, VOCAB, select="SELECT col, value, id FROM vocab"))
def fit_vocab(spark, folder):
    return fe.fit_vocab(records(spark, folder), CATEGORICAL)


@C.add("vocab_sizes", t.with_(R, VOCAB, select="SELECT col, count(*) AS size FROM vocab GROUP BY col"))
def vocab_sizes(spark, folder):
    return fe.vocab_sizes(fe.fit_vocab(records(spark, folder), CATEGORICAL))


@C.add(
    "encode_categoricals",
    t.with_(
        R, VOCAB,
        select="SELECT record_id, " + ", ".join(
            f"coalesce((SELECT id FROM vocab WHERE col = '{c}' AND value = coalesce(r.{c}, 'NULL')), 0) AS {c}_id"
            for c in CATEGORICAL
        ) + " FROM r",
    ),
)
def encode_categoricals(spark, folder):
    rows = records(spark, folder)
    coded = fe.encode_categoricals(rows, fe.fit_vocab(rows, CATEGORICAL), CATEGORICAL)
    return coded.select("record_id", *[f"{c}_id" for c in CATEGORICAL])


@C.add(
    "encode_unseen",
    t.with_(
        R,
        select="""SELECT record_id, CASE tran_mode WHEN 'UPI' THEN 1 WHEN 'IMPS' THEN 2 WHEN 'NEFT' THEN 3
  WHEN 'POS' THEN 7 ELSE CASE WHEN tran_mode IS NULL THEN 13 ELSE 0 END END AS tran_mode_id FROM r""",
    ),
)
def encode_unseen(spark, folder):
    """A vocabulary of known values only: what the data adds to it is unknown (0)."""
    rows = records(spark, folder)
    known_only = fe.fit_vocab(rows.filter(F.lit(False)), ["tran_mode"])
    return fe.encode_categoricals(rows, known_only, ["tran_mode"]).select("record_id", "tran_mode_id")


SCALER = """
scaler AS MATERIALIZED (
  SELECT avg(tran_amt_in_ac) AS mean, stddev_pop(tran_amt_in_ac) AS std FROM r)"""


@C.add(
    "fit_scaler",
    t.with_(R, SCALER, select="""SELECT 'tran_amt_in_ac' AS col, round(mean, 4) AS mean, round(std, 4) AS std FROM scaler
UNION ALL SELECT 'one', 1.0, 1.0"""),
)
def fit_scaler(spark, folder):
    rows = records(spark, folder).withColumn("one", F.lit(1.0))
    fitted = fe.fit_scaler(rows, ["tran_amt_in_ac", "one"])
    return fitted.select("col", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@C.add(
    "scale_numeric",
    t.with_(R, SCALER, select="SELECT record_id, round((tran_amt_in_ac - mean) / std, 6) AS scaled FROM r CROSS JOIN scaler"),
)
def scale_numeric(spark, folder):
    rows = records(spark, folder)
    scaled = fe.scale_numeric(rows, fe.fit_scaler(rows, ["tran_amt_in_ac"]), ["tran_amt_in_ac"])
    return scaled.select("record_id", F.round("tran_amt_in_ac_scaled", 6).alias("scaled"))


@C.add(
    "fit_labels",
    t.with_(R, select="""SELECT (row_number() OVER (ORDER BY category) - 1)::INTEGER AS label_id, category
FROM (SELECT DISTINCT category FROM r)"""),
)
def fit_labels(spark, folder):
    return fe.fit_labels(records(spark, folder), "category")


COUNTS = """
c AS MATERIALIZED (SELECT category, count(*) AS n FROM r GROUP BY category)"""


@C.add("class_counts", t.with_(R, COUNTS, select="SELECT category, n FROM c"))
def class_counts(spark, folder):
    return fe.class_counts(records(spark, folder), "category")


@C.add(
    "class_weights",
    t.with_(R, COUNTS, select="SELECT category, round(pow((SELECT sum(n) FROM c) / n, 0.5), 6) AS weight FROM c"),
)
def class_weights(spark, folder):
    return t.rounded(fe.class_weights(records(spark, folder), "category"), "weight")


@C.add(
    "class_temperatures",
    t.with_(R, COUNTS, select="SELECT category, round(0.07 * pow(n / (SELECT sum(n) FROM c), 0.3), 6) AS temperature FROM c"),
)
def class_temperatures(spark, folder):
    return t.rounded(fe.class_temperatures(records(spark, folder), "category"), "temperature")


@C.add(
    "minority_classes",
    "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) <= 2400",
)
def minority_classes(spark, folder):
    parts = t.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = t.table(spark, folder, "lineitem").select("l_partkey").join(parts, "l_partkey")
    return fe.minority_classes(fe.class_counts(rows, "p_brand"), 2400)


@C.add(
    "class_bars",
    t.with_(
        R, COUNTS,
        select="""SELECT category, n, repeat('#', least(40, n // greatest(1, (SELECT max(n) FROM c) // 40))) AS bar FROM c""",
    ),
)
def class_bars(spark, folder):
    return re.class_bars(fe.class_counts(records(spark, folder), "category"), "category")


@C.add(
    "record_metadata",
    t.with_(
        R,
        select="""SELECT record_id, tran_partclr, tran_amt_in_ac, tran_mode, dr_cr_indctor, sal_flag, category AS label FROM r""",
    ),
)
def record_metadata(spark, folder):
    return fe.with_metadata(records(spark, folder), RoleSpec()).select("record_id", "metadata.*")


# --- JSON side tables --------------------------------------------------------------------


FIRST3 = """
firsts AS MATERIALIZED (
  SELECT category, (row_number() OVER (PARTITION BY category ORDER BY record_id) - 1)::INTEGER AS pos,
    tran_partclr, tran_amt_in_ac, dr_cr_indctor, coalesce(tran_mode, 'NULL') AS tran_mode
  FROM r QUALIFY pos < 3)"""


def example_rows(spark, folder):
    """The first three records of each category, as stored examples are picked."""
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy("record_id")
    rows = cl.fill_null_strings(records(spark, folder)).withColumn("nth", F.row_number().over(order))
    fields = ("tran_partclr", "tran_amt_in_ac", "dr_cr_indctor", "tran_mode")
    rows = rows.filter("nth <= 3").withColumn("pos", F.col("nth") - 1)  # cut before the shuffle
    return rows.select("category", "pos", F.struct(*fields).alias("example"))


def write_json(value, df, path):
    """One JSON document of a small table."""
    df.agg(F.to_json(value).alias("value")).coalesce(1).write.text(path)
    return path


def canonical_file(spark, folder):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "example"))), lambda s: s.example)
    by_category = example_rows(spark, folder).groupBy("category").agg(listed.alias("examples"))
    entries = F.map_from_entries(F.collect_list(F.struct("category", "examples")))
    return write_json(entries, by_category, scratch_path(spark))


@C.add("read_examples", t.with_(R, FIRST3, select="SELECT category, pos, tran_partclr, tran_amt_in_ac, dr_cr_indctor, tran_mode FROM firsts"))
def read_examples(spark, folder):
    examples = so.read_examples(spark, canonical_file(spark, folder))
    return examples.select(
        "category", "pos", "example.tran_partclr", "example.tran_amt_in_ac", "example.dr_cr_indctor", "example.tran_mode"
    )


@C.add(
    "read_ood_examples",
    t.with_(R, FIRST3, select="SELECT pos, tran_partclr, tran_amt_in_ac FROM firsts WHERE category = 'other'"),
)
def read_ood_examples(spark, folder):
    outside = example_rows(spark, folder).filter(F.col("category") == fixed.OOD_LABEL)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "example"))), lambda s: s.example)
    path = write_json(listed, outside, scratch_path(spark))
    return so.read_ood_examples(spark, path).select("pos", "example.tran_partclr", "example.tran_amt_in_ac")


@C.add(
    "read_descriptions",
    "SELECT n_name AS category, 'shops of ' || r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def read_descriptions(spark, folder):
    nations = t.table(spark, folder, "nation").join(
        t.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    texts = nations.select("n_name", F.concat(F.lit("shops of "), F.col("r_name")).alias("text"))
    path = write_json(F.map_from_entries(F.collect_list(F.struct("n_name", "text"))), texts, scratch_path(spark))
    return so.read_descriptions(spark, path)


@C.add("saved_artifacts", t.with_(R, VOCAB, SCALER, COUNTS, select="""SELECT 'vocab' AS part, col || '/' || value AS name, id::DOUBLE AS value FROM vocab
UNION ALL SELECT 'mean', 'tran_amt_in_ac', round(mean, 4) FROM scaler
UNION ALL SELECT 'std', 'tran_amt_in_ac', round(std, 4) FROM scaler
UNION ALL SELECT 'label', category, row_number() OVER (ORDER BY category) - 1 FROM c
UNION ALL SELECT 'count', category, n FROM c"""))
def saved_artifacts(spark, folder):
    """Fitted, saved, loaded: every value of the loaded state."""
    from tagweave.sources.artifacts import load_artifacts, save_artifacts

    path = scratch_path(spark)
    save_artifacts(fe.fit(records(spark, folder), RoleSpec()), path)
    loaded = load_artifacts(spark, path)

    def part(df, kind, name, value):
        return df.select(F.lit(kind).alias("part"), name.alias("name"), F.col(value).cast("double").alias("value"))

    scaler = t.rounded(loaded.scaler, "mean", "std").withColumns({c: F.round(c, 4) for c in ("mean", "std")})
    return fe.union_all(
        [
            part(loaded.vocab, "vocab", F.concat_ws("/", "col", "value"), "id"),
            part(scaler, "mean", F.col("col"), "mean"),
            part(scaler, "std", F.col("col"), "std"),
            part(loaded.labels, "label", F.col("category"), "label_id"),
            part(loaded.counts, "count", F.col("category"), "n"),
        ]
    )


@C.add(
    "fit_merged",
    t.with_(R, VOCAB, SCALER, COUNTS, select="""SELECT 'value' AS kind, col || '=' || value AS name, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM vocab
UNION ALL SELECT 'moments', 'tran_amt_in_ac', round(mean, 4), round(std, 4) FROM scaler
UNION ALL SELECT 'count', category, n, NULL FROM c"""),
)
def fit_merged(spark, folder):
    """Two batches fitted apart and merged are the fit of all rows."""
    rows, roles = records(spark, folder), RoleSpec()
    early = F.xxhash64("record_id") % 2 == 0
    merged = st.merge_states(st.fit_state(rows.filter(early), roles), st.fit_state(rows.filter(~early), roles)).artifacts()
    nothing = F.lit(None).cast("double")
    values = merged.vocab.select(F.lit("value").alias("kind"), F.concat("col", F.lit("="), "value").alias("name"), nothing.alias("a"), nothing.alias("b"))
    numbers = merged.scaler.select(F.lit("moments"), "col", F.round("mean", 4), F.round("std", 4))
    return values.union(numbers).union(merged.counts.select(F.lit("count"), "category", F.col("n").cast("double"), nothing))


@C.add(
    "sketch_percentiles",
    """SELECT l_returnflag, p.pos, true AS within_error FROM lineitem CROSS JOIN (SELECT unnest(range(5))::INTEGER AS pos) p GROUP BY ALL""",
)
def sketch_percentiles(spark, folder):
    """Five percentiles of each flag's prices, from sketches of seven parts: is the true rank of each within the stated error?"""
    lines = t.table(spark, folder, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_orderkey") % 7).alias("part"))
    shares = [0.05, 0.25, 0.5, 0.9, 0.99]
    parts = sk.sketched(lines, "price", ["l_returnflag", "part"])
    found = sk.sketch_percentiles(sk.merged_sketches(parts, ["l_returnflag"]), shares, ["l_returnflag"])
    ranks = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "pos").agg(
        F.avg((F.col("price") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("price") <= F.col("value")).cast("int")).alias("upto")
    )
    share, error = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("pos") + 1), 2 * sk.rank_error()
    return ranks.select("l_returnflag", "pos", ((F.col("below") <= share + error) & (F.col("upto") >= share - error)).alias("within_error"))
