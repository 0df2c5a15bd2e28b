"""k centres of each class in one pass, with a certified radius (Charikar et al. 2004, the doubling algorithm).

The state of a class is at most ``k`` of its rows and a scale.  A row within twice the scale of a centre is covered, any other becomes a
centre; with more than ``k`` centres the scale doubles and centres within it of one before them go.  Memory is ``k`` vectors however many rows pass,
and states merge: the centres of one are rows for another, each with the radius that it already covers.

Rows of a class are dealt to slices of about ``slice_rows`` by a hash of their id and pass in its order, so the choice does not depend on
partitions.  ``fan_in`` states feed one on the next level until a class has one: a task streams one slice, or ``fan_in * k`` centres.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_bucket, seeded
from tagweave.functions.session import bounded, cut_lineage
from tagweave.functions.vectors import as_double
from tagweave.operators.blocks import arrow_type, matrix_of

SLICE_ROWS = 1 << 18


class Cover:
    """Centres of the rows seen so far.

    ``radius`` is a proven bound: every row lies within it of a centre.  ``least`` is one from below: no ``k`` centres
    cover the rows within less.
    """

    def __init__(self, k: int) -> None:
        self.k, self.scale, self.radius, self.least = k, 0.0, 0.0, 0.0
        self.ids: list = []
        self.points: np.ndarray | None = None

    def add(self, ids: list, points: np.ndarray, within: np.ndarray, block: int = 4096) -> None:
        """Rows in their order; ``within`` is what each already covers."""
        if self.points is None:
            self.points = np.empty((0, points.shape[1]))
        for at in range(0, len(points), block):
            self._block(ids[at : at + block], points[at : at + block], within[at : at + block])

    def _block(self, ids: list, points: np.ndarray, within: np.ndarray) -> None:
        near = self._nearest(points)
        at = 0
        while at < len(points):
            far = np.flatnonzero(near[at:] > 2 * self.scale)
            upto = at + int(far[0]) if len(far) else len(points)
            if upto > at:
                self.radius = max(self.radius, float((near[at:upto] + within[at:upto]).max()))
            if upto == len(points):
                return
            self.ids.append(ids[upto])
            self.points = np.vstack([self.points, points[upto : upto + 1]])
            self.radius = max(self.radius, float(within[upto]))
            at = upto + 1
            if len(self.ids) > self.k:
                self._merge()
                near[at:] = self._nearest(points[at:])
            else:
                near[at:] = np.minimum(near[at:], _distance(points[at:], self.points[-1:])[:, 0])

    def _nearest(self, points: np.ndarray) -> np.ndarray:
        return _distance(points, self.points).min(axis=1) if len(self.points) else np.full(len(points), np.inf)

    def _merge(self) -> None:
        """Double the scale until at most ``k`` centres are farther from each other than it."""
        while len(self.ids) > self.k:
            gaps = _distance(self.points, self.points)
            closest = float(gaps[np.triu_indices(len(gaps), 1)].min())
            self.least = max(self.least, closest / 2)  # two of k + 1 such rows share a centre
            self.scale = max(2 * self.scale, closest)
            kept: list[int] = []
            moved = 0.0
            for c in range(len(gaps)):
                to = float(gaps[c, kept].min()) if kept else np.inf
                if to > self.scale:
                    kept.append(c)
                else:
                    moved = max(moved, to)
            self.radius += moved
            self.ids, self.points = [self.ids[c] for c in kept], self.points[kept]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences, a strip at a time: equal rows are at distance zero."""
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.sqrt(np.square(a[at : at + step, None, :] - b[None, :, :]).sum(axis=2))
    return out


def core_set(golden: DataFrame, k: int, seed: int = 42, slice_rows: int = SLICE_ROWS, fan_in: int = 8) -> DataFrame:
    """``(label_id, golden_id, radius, least)``: at most ``k`` centres of each class of ``golden(golden_id, label_id, embedding)``.

    Every row of the class lies within ``radius`` of a centre, and no ``k`` rows could do better than ``least``.  Rows without label or vector
    take no part; equal vectors count once; a class of at most ``k`` different vectors has radius 0.
    """
    if k < 1 or slice_rows < 1 or fan_in < 2:
        raise ValueError("k and slice_rows must be positive and fan_in at least 2")
    rows = golden.filter(F.col("label_id").isNotNull() & F.col("embedding").isNotNull())
    sizes = rows.groupBy("label_id").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    sizes = bounded(sizes)
    nodes = sizes.agg(F.max("slices")).first()[0] or 1
    draw = seeded(seed, F.lit("centre"), F.col("golden_id"))
    rows = rows.select("label_id", "golden_id", as_double(F.col("embedding")).alias("embedding"), draw.alias("draw"))
    # One number per row splits any class into its own count of slices.
    node = F.floor(hash_bucket(F.col("draw"), 1 << 20) * F.col("slices") / (1 << 20)).cast("int")
    placed = rows.join(sizes, "label_id").withColumn("node", node)
    placed = placed.withColumns({"radius": F.lit(0.0), "least": F.lit(0.0)}).drop("slices")
    states = cut_lineage(_covered(placed, k))
    while nodes > 1:
        nodes = ceil(nodes / fan_in)
        states = cut_lineage(_covered(states.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")), k))
    return states.select("label_id", "golden_id", "radius", "least")


def _covered(placed: DataFrame, k: int) -> DataFrame:
    """The state of each ``(label_id, node)``, a row for each centre; rows stream through in order of ``draw``."""
    columns = ["label_id", "golden_id", "embedding", "draw", "node", "radius", "least"]
    placed = placed.select(*columns)
    schema = pa.schema([(f.name, arrow_type(f.dataType)) for f in placed.schema.fields])

    def result(key: tuple, state: Cover, least: float) -> pa.RecordBatch:
        n = len(state.ids)
        ids, draws = zip(*state.ids)
        vectors = pa.array(list(state.points), pa.list_(pa.float64()))
        values = [[key[0]] * n, list(ids), vectors, list(draws), [key[1]] * n, [state.radius] * n, [max(state.least, least)] * n]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, least = None, Cover(k), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label_id", "node"))
            new = np.append(True, (label[1:] != label[:-1]) | (node[1:] != node[:-1]))
            starts = np.append(np.flatnonzero(new), batch.num_rows)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                part, here = batch.slice(a, b - a), (label[a].item(), node[a].item())
                if here != key:
                    if key is not None:
                        yield result(key, state, least)
                    key, state, least = here, Cover(k), 0.0
                ids = list(zip(part.column("golden_id").to_pylist(), part.column("draw").to_pylist()))
                state.add(ids, matrix_of(part.column("embedding")), part.column("radius").to_numpy())
                least = max(least, pc.max(part.column("least")).as_py())
        if key is not None:
            yield result(key, state, least)

    ordered = placed.repartition("label_id", "node").sortWithinPartitions("label_id", "node", "draw", "golden_id")
    return ordered.mapInArrow(run, placed.schema)
