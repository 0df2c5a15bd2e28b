"""Mixing sources to token targets by entropy balancing.

Hainmueller (2012): of all document rates that meet a token constraint for each source, those
closest in entropy to taking every document once are exponential in the constrained quantity,
``rate = min(most, exp(tilt * size / mean size of the source))``.  The tilts are the solution of the convex dual.  A Newton
step is one grouped sum over the table of distinct ``(source, size)`` counts, so documents are read
once and a hot source is pre-aggregated.  All sums are decimals, which gives the same tilts
whatever order the rows come in.

Rates become whole copies by systematic rounding: documents of a source stand in the order of
size and of a seeded hash, and one more copy is taken each time the running sum of the rates'
fractions passes a whole number.  What that misses of a target, a few documents' words, is made good by rounding the smallest
documents the other way.  The running sums are cut into slices of bounded
size, whose offsets are prefix sums.

Nulls: a null text has size 0, and a null source is a source of its own, last in the order.  Documents of
size 0 are taken no times.  Repeated rows are documents of their own; a row without id counts too.
An empty table gives an empty one.  Other columns are not read.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.session import bounded, cut_lineage, stored_with_count
from tagweave.llm.common import numbered

WORD = r"[^\x20\x09-\x0D]+"
UNITS = 1 << 20
SLICE_ROWS = 20_000
EXACT = "decimal(38,12)"


def word_count(text: Column) -> Column:
    """Words between ASCII white space, without a list of them."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)``: shares by repeating weights, capped at ``most`` sizes.

    ``sizes(source, source_size)`` has a row for each source.  What a capped source leaves is shared
    among the others by weight, again and again; each round is one sum over the sources.
    """
    rows = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighed = sizes.withColumn("at", F.row_number().over(rows) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    )
    weighed, n = stored_with_count(weighed)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, rate = share * total, 0.0
    if n and total:
        closed = F.lit(False)
        while True:
            open_weight, taken = weighed.agg(
                F.sum(F.when(~closed, F.col("weight"))), F.sum(F.when(closed, most * F.col("source_size")))
            ).first()
            if not open_weight:
                rate = float("inf")
                break
            rate = (budget - (taken or 0.0)) / open_weight
            above = F.col("weight") * F.lit(rate) > most * F.col("source_size")
            if not weighed.filter(above & ~closed).limit(1).count():
                break
            closed = closed | above
    cap = most * F.col("source_size").cast("double")
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def rate_of(tilt: Column, scaled: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(tilt * scaled, F.lit(math.log(most) + 1))))


def tilts(counts: DataFrame, targets: DataFrame, most: float = 2.0, rounds: int = 60, near: float = 1e-7) -> DataFrame:
    """``targets`` with ``tilt``: the root of the dual's gradient for each source, by guarded Newton steps.

    A target of nothing or of the most a source can give has no finite root and needs none.

    ``counts(source, size, n)``.  The gradient grows with the tilt, so every step also narrows a
    bracket; a step that leaves it is halved instead.  One round is one grouped sum for all sources.
    """
    state = targets.join(
        counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")),
        targets["source"].eqNullSafe(counts["source"]),
        "inner",
    ).select(targets["source"], "source_size", "target", "mean")
    start = F.lit(0.0)
    state = cut_lineage(
        state.select("*", start.alias("tilt"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), ((F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"))
    )
    few = _few(state)
    for _ in range(rounds):
        if not state.filter("not done").limit(1).count():
            break
        open_ = state.filter("not done")
        open_ = F.broadcast(open_) if few else open_
        scaled = F.col("size") / F.col("mean")
        rate = rate_of(F.col("tilt"), scaled, most)
        words = F.col("n") * F.col("size")
        slope = F.when(rate < most, words * rate * scaled).otherwise(0.0)
        moved = (
            counts.join(open_, counts["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"])
            .agg(F.sum((words * rate).cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        )
        moved = moved.select(F.col("source").alias("_source"), "got", "slope")
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        wish = F.col("tilt") - (F.log("got") - F.log("target")) * F.col("got") / F.col("slope")  # Newton in logarithms
        step = F.when((F.col("slope") > 0) & (wish > low) & (wish < high), wish).otherwise((low + high) / 2)
        settled = F.col("done") | (F.abs(miss) <= near * F.col("target")) | (high - low < 1e-12)
        joined = state.join(moved, state["source"].eqNullSafe(moved["_source"]), "left")
        state = cut_lineage(
            joined.select(
                "source", "source_size", "target", "mean",
                F.when(settled, F.col("tilt")).otherwise(step).alias("tilt"),
                F.when(settled, F.col("low")).otherwise(low).alias("low"),
                F.when(settled, F.col("high")).otherwise(high).alias("high"),
                settled.alias("done"),
            )
        )
    return state.select("source", "source_size", "target", "mean", "tilt")


def _few(state: DataFrame, most_rows: int = 100_000) -> bool:
    return state.limit(most_rows + 1).count() <= most_rows


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
    id_col: str = "doc_id", source: str = "source", text: str = "text", slice_rows: int = SLICE_ROWS, row_col: str | None = None,
) -> DataFrame:
    """``(doc_id, size, source_size, target, rate, copies, taken)`` of every row; ``taken = copies * size``.

    Rows are dealt by a hash of id and text.  ``row_col`` names a number that tells rows apart; it comes back as ``row``.
    """
    row = F.col(row_col) if row_col else F.lit(0)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    sized = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
            key.alias("key"), row.cast("long").alias("row"),
        )
    )
    counts = cut_lineage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = tilts(counts.filter("size > 0"), source_targets(totals, weights, share, most), most)
    few = _few(solved)
    bound = F.broadcast(solved) if few else solved
    full = F.col("target") >= most * F.col("source_size")  # the tilt would be infinite
    rate = F.when((F.col("target") <= 0) | (F.col("size") == 0), 0.0).when(full, F.lit(float(most)))
    rate = rate.otherwise(rate_of(F.col("tilt"), F.col("size") / F.col("mean"), most))
    rated = (
        sized.join(bound, sized["source"].eqNullSafe(solved["source"]), "left")
        .select("doc_id", "key", "row", sized["source"], "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(rate, F.lit(0.0)).alias("rate"))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", F.round((F.col("rate") - F.floor("rate")) * UNITS).cast("long"))
    )
    # Slices of the order (size class, hash): a size class that holds many rows has many slices.
    level = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 4).cast("int")
    rated = cut_lineage(rated.withColumn("level", level))
    crowd = rated.groupBy("source", "level").agg(F.count(F.lit(1)).alias("rows"))
    crowd = bounded(crowd.select(F.col("source").alias("_s"), F.col("level").alias("_l"), F.ceil(F.col("rows") / slice_rows).cast("int").alias("cuts")))
    joined = rated.join(crowd, rated["source"].eqNullSafe(crowd["_s"]) & (rated["level"] == crowd["_l"])).drop("_s", "_l")
    cut = joined.withColumn("slice", F.pmod(F.col("key"), F.col("cuts")).cast("int")).drop("cuts")
    upto = _running() + UNITS // 2
    more = (F.floor(upto / UNITS) - F.floor((upto - F.col("part")) / UNITS)).cast("long")
    placed = cut_lineage(_with_running(cut, "part").withColumn("more", more).drop("_offset", "_inside"))
    # The words by which a source misses its target go to, or come from, its smallest documents that were rounded the other way.
    short = placed.groupBy("source").agg((F.first("target") - F.sum((F.col("whole") + F.col("more")) * F.col("size"))).alias("short"))
    short = bounded(short.select(F.col("source").alias("_s"), "short"))
    owed = placed.join(short, placed["source"].eqNullSafe(short["_s"])).drop("_s")
    turns = (F.col("part") > 0) & (F.col("more") == F.when(F.col("short") > 0, F.lit(0)).otherwise(F.lit(1)))
    owed = _with_running(owed.withColumn("turn", F.when(turns, F.col("size")).otherwise(F.lit(0)).cast("long")), "turn")
    turned = turns & (_running() <= F.abs("short"))
    copies = (F.col("whole") + F.when(turned, 1 - F.col("more")).otherwise(F.col("more"))).cast("long")
    return owed.select(
        *["row"] * (row_col is not None), "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _running() -> Column:
    """What ``_with_running`` adds, up to and with the row."""
    return F.col("_offset") + F.col("_inside")


def _with_running(cut: DataFrame, what: str) -> DataFrame:
    """Adds the two parts of a running sum inside each source, in the order of size class, slice, size and hash."""
    parts = cut.groupBy("source", "level", "slice").agg(F.sum(what).alias("sum"))
    before = W.partitionBy("source").orderBy("level", "slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice
    offsets = parts.select(
        F.col("source").alias("_s"), F.col("level").alias("_l"), F.col("slice").alias("_c"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_offset")
    )
    offsets = bounded(offsets)
    inside = W.partitionBy("source", "level", "slice").orderBy("size", "key", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)
    running = cut.withColumn("_inside", F.sum(what).over(inside))
    return running.join(
        offsets, running["source"].eqNullSafe(offsets["_s"]) & (running["level"] == offsets["_l"]) & (running["slice"] == offsets["_c"])
    ).drop("_s", "_l", "_c")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture as documents: each row as often as the mix takes it, in the columns of ``docs``.

    Rows are numbered and written once, so rows that share an id, or have none, are each taken as often as the mix says.
    """
    rows, row = numbered(docs)
    taken = mix(rows, id_col=id_col, row_col=row, **options).filter("copies > 0").select(F.col("row").alias("taken_row"), "copies")
    whole = rows.select(F.col(row).alias("of_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    joined = whole.join(taken, F.col("of_row") == F.col("taken_row"))
    repeated = joined.select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])
