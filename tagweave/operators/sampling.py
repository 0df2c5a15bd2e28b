"""Samples, splits, balanced batches and triplets, all chosen by seeded hash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_bucket, hex_head, seeded
from tagweave.functions.order import below_cut, with_hash_rank
from tagweave.operators.blocks import all_squared_distances, matrix_of

SORTED_SAMPLE = 100_000
REPEATS_AT_ONCE = 10_000
SLICES = 65_536
#: Distances of a batch that mining holds at once.
ANCHOR_CELLS = 262_144


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly ``n`` rows (or all): the first in seeded order.

    A small sample is a per-task top-n.  A large one counts rows per hash slice, takes
    whole slices and sorts only the slice where the count is reached.
    """
    order = [seeded(seed, F.col(id_col)), F.col(id_col)]
    if n <= SORTED_SAMPLE:
        return df.orderBy(*order).limit(n)
    slice_of = hash_bucket(seeded(seed, F.col(id_col)), SLICES)
    sizes = df.groupBy(slice_of.alias("slice")).agg(F.count(F.lit(1)).alias("n"))  # <= SLICES rows
    running = sizes.withColumn("upto", F.sum("n").over(W.orderBy("slice")))
    edge = running.filter(F.col("upto") > n).orderBy("slice").first()
    if edge is None:
        return df
    rest = n - (edge["upto"] - edge["n"])
    whole = df.filter(slice_of < edge["slice"])
    return whole.unionByName(df.filter(slice_of == edge["slice"]).orderBy(*order).limit(int(rest)))


def stratified_split(
    df: DataFrame, label: str, id_col: str, fraction: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split``: ``round(fraction * class size)`` rows of each class are validation."""
    known = df.filter(F.col(label).isNotNull())
    held_out = below_cut(known, [label], id_col, seed, lambda n: F.round(F.lit(fraction) * n))
    return held_out.withColumn("split", F.when(F.col("_below"), "validation").otherwise("train")).drop("_below")


def batch_plan(class_sizes: DataFrame, batch_size: int) -> tuple[int, int]:
    """Rows per class and batch, and the number of batches."""
    row = class_sizes.agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("m")).first()
    per_class = max(2, batch_size // max(1, row["c"]))
    return per_class, max(1, (row["m"] or 0) // per_class)


def balanced_batches(
    df: DataFrame, label: str, id_col: str, batch_size: int, seed: int = 42
) -> DataFrame:
    """Class-balanced batches: adds ``batch_id`` and ``seat`` (1..batch_size).

    Each class lines up in seeded order and repeats until all batches are full, so a
    row knows its own places by arithmetic and no join is needed.
    """
    per_class, batches = batch_plan(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), batch_size)
    places = per_class * batches
    ranked = with_hash_rank(df, [label], id_col, seed, "_pos").filter(F.col("_pos") < places)
    turns = F.ceil((F.lit(places) - F.col("_pos")) / F.col("group_n")).cast("bigint")
    # A lone row of a rare class repeats as often as the largest class has rows:
    # repeat it in two steps, so that neither builds one huge array.
    stretches = F.sequence(F.lit(0).cast("bigint"), F.floor((turns - 1) / REPEATS_AT_ONCE))
    spread = ranked.withColumn("_turns", turns).withColumn("_stretch", F.explode(stretches))
    if places > REPEATS_AT_ONCE:
        spread = spread.repartition(label, "_pos", "_stretch")
    first = F.col("_stretch") * REPEATS_AT_ONCE
    last = F.least(first + REPEATS_AT_ONCE, F.col("_turns")) - 1
    placed = spread.withColumn("_turn", F.explode(F.sequence(first, last))).withColumn(
        "_place", F.col("_pos") + F.col("_turn") * F.col("group_n")
    )
    batched = placed.withColumn("batch_id", F.floor(F.col("_place") / per_class))
    shuffled = seeded(seed, F.col("batch_id"), F.col(label), F.col("_place"))
    seats = batched.withColumn("seat", F.row_number().over(W.partitionBy("batch_id").orderBy(shuffled)))
    return seats.filter(F.col("seat") <= batch_size).select("batch_id", "seat", *df.columns)


def mine_triplets(
    batched: DataFrame, margin: float = 0.5, cap: int = 64, seed: int = 42
) -> DataFrame:
    """Semi-hard triplets of each batch, at most ``cap``, in seat order.

    ``batched`` has ``batch_id, seat, golden_id, label_id, embedding``.  The positive is
    drawn among the same label, the negative among those with
    ``d_ap < d_an < d_ap + margin``, else it is the nearest of another label.  Pairs of
    a batch are compared inside its task, a few anchors with all others at a time; only the triplets become rows.
    """

    def draw(batch: int, role: str, anchor: int, seats: np.ndarray) -> int:
        """Index of the seat with the lowest md5 for this anchor."""
        keys = [hashlib.md5(f"{seed}:{batch}:{role}:{anchor}:{s}".encode()).digest() for s in seats]
        return min(range(len(keys)), key=keys.__getitem__)

    def mine(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seat", "ascending")]).combine_chunks()
        batch = table["batch_id"][0].as_py()
        seats = table["seat"].to_numpy()
        labels = table["label_id"].to_numpy()
        points = matrix_of(table["embedding"].combine_chunks())
        picked: list[tuple[int, int, int, float, float]] = []
        step = max(1, ANCHOR_CELLS // max(1, len(points)))
        for a in range(len(points)):
            if len(picked) >= cap:
                break
            if a % step == 0:
                squared = all_squared_distances(points[a : a + step], points)
            same = np.flatnonzero((labels == labels[a]) & (seats != seats[a]))
            other = np.flatnonzero(labels != labels[a])
            if not len(same) or not len(other):
                continue
            p = same[draw(batch, "p", seats[a], seats[same])]
            d_ap = float(np.sqrt(squared[a % step, p]))
            d_an = np.sqrt(squared[a % step, other])
            semi = np.flatnonzero((d_an > d_ap) & (d_an < d_ap + margin))
            n = semi[draw(batch, "n", seats[a], seats[other[semi]])] if len(semi) else int(d_an.argmin())
            picked.append((a, p, other[n], d_ap, float(d_an[n])))
        index = {name: pa.array([t[i] for t in picked], pa.int64()) for i, name in enumerate("apn")}
        ids = table["golden_id"]
        return pa.table(
            {
                "batch_id": pa.array([batch] * len(picked), pa.int64()),
                "anchor_seat": pa.array(seats).take(index["a"]).cast(pa.int32()),
                "anchor_id": ids.take(index["a"]),
                "positive_id": ids.take(index["p"]),
                "negative_id": ids.take(index["n"]),
                "d_ap": pa.array([t[3] for t in picked], pa.float64()),
                "d_an": pa.array([t[4] for t in picked], pa.float64()),
            }
        )

    kind = batched.schema["golden_id"].dataType.simpleString()
    return (
        batched.select("batch_id", "seat", "golden_id", "label_id", "embedding")
        .groupBy("batch_id")
        .applyInArrow(
            mine,
            f"batch_id bigint, anchor_seat int, anchor_id {kind}, positive_id {kind}, negative_id {kind},"
            " d_ap double, d_an double",
        )
    )


def random_triplets(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random triplets ``(draw, anchor_id, positive_id, negative_id)``.

    The anchor's class is drawn among classes with two rows or more, the negative's
    among all others.
    """
    ranked = with_hash_rank(df.select(id_col, label), [label], id_col, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n")))).scalar()

    def roll(role: str, sides: Column) -> Column:
        return hex_head(seeded(seed, F.col("draw"), F.lit(role))) % sides

    def entry(array: str, at: Column) -> Column:
        return F.try_element_at(array, (at + 1).cast("int"))

    drawn = (
        df.sparkSession.range(n)
        .select(F.col("id").alias("draw"), classes.alias("classes"))
        .withColumn("anchors", F.filter("classes", lambda c: c.n >= 2))
        .filter((F.size("anchors") > 0) & (F.size("classes") > 1))
        .withColumn("a", entry("anchors", roll("class", F.size("anchors"))))
        .withColumn("others", F.filter("classes", lambda c: c.label != F.col("a.label")))
        .withColumn("o", entry("others", roll("other", F.size("others"))))
        .withColumn("a_pos", roll("anchor", F.col("a.n")))
        .withColumn("p_pos", (F.col("a_pos") + 1 + roll("positive", F.col("a.n") - 1)) % F.col("a.n"))
        .withColumn("n_pos", roll("negative", F.col("o.n")))
    )

    def pick(role: str, label_at: str, pos: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(label_at).alias("label"), F.col(pos).alias("pos"))

    picks = drawn.select(
        "draw",
        F.explode(
            F.array(pick("a", "a.label", "a_pos"), pick("p", "a.label", "p_pos"), pick("n", "o.label", "n_pos"))
        ).alias("k"),
    ).select("draw", "k.*")
    rows = ranked.select(F.col(label).alias("label"), "pos", id_col)
    found = picks.join(rows, ["label", "pos"])

    def of(role: str, name: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(id_col))).alias(name)

    return found.groupBy("draw").agg(of("a", "anchor_id"), of("p", "positive_id"), of("n", "negative_id"))
