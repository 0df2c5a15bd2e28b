"""Approximate nearest neighbours by counting collisions on single projections.

Query-aware collision counting (Gan et al. 2012; Huang et al. 2015).  Vectors are scaled to length 1, so the largest
cosine is the least distance.  Rows are cut into blocks of bounded size, and queries into groups of bounded size;
each group meets each block in one task.  There each of ``projections`` random directions gives one sorted array of the
block.  A query lays a window around its own value on every array; a row that falls into at least
``need`` of the windows is verified by its exact cosine.  If the k-th verified row is farther than
the windows' radius promises, all windows widen to the next of ``RADII`` (virtual rehashing: the arrays stay as
they are, a window only takes in what is new at its two ends) until it is not, or the windows hold the whole block.
Blocks' nearest are merged for the query.

The number of candidates has no limit.  ``need`` is set so that a row within the radius misses it with probability ``miss``.

Nulls: vectors that are null, empty, zero, or hold null or non-finite parts neither ask nor answer; the others are neighbours
of vectors of their own length only.  A row without id takes no part.  Rows repeated under one
id answer as one (the larger cosine counts), and a query's own id never answers it.  Ties go to the smaller
id.  Without queries or candidates the result is empty.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, stored_with_count
from tagweave.llm.common import usable, vectors_of

PROJECTIONS, WIDTH, MISS = 64, 2.0, 0.2
#: From where all but equal vectors are apart to the diameter of the sphere.
RADII = 0.1 * 1.2 ** np.arange(18)
BLOCK_ROWS, QUERY_ROWS = 16_384, 2048


def needed(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a row exactly at the radius has with probability ``1 - miss``.

    A difference of length r has a normal projection of deviation r; a window reaches ``width / 2`` radii to each side.
    """
    if miss == 0:
        return 0
    one = math.erf(width / 2 / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * one**k * (1 - one) ** (projections - k)
        if below > miss:
            return k
    return projections


class Arrays:
    """One block: its vectors, and its order along each projection."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray) -> None:
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        values = self.vectors @ directions
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.sort(values, axis=0).T.copy()

    def windows(self, places: np.ndarray, width: float) -> np.ndarray:
        """Ends of each query's windows: (query, radius, side, projection); the last radius holds the whole block."""
        n, m = len(self.vectors), len(self.sorted)
        ends = np.empty((len(places), len(RADII) + 1, 2, m), np.int32)
        ends[:, -1, 0], ends[:, -1, 1] = 0, n
        for j in range(m):
            for side, sign in enumerate((-1, 1)):
                bounds = places[:, j, None] + sign * RADII * width / 2
                ends[:, :-1, side, j] = np.searchsorted(self.sorted[j], bounds.ravel(), "left" if side == 0 else "right").reshape(bounds.shape)
        return ends

    def near(self, query: np.ndarray, ends: np.ndarray, k: int, need: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows found and their cosines; ``skip`` is a row that is the query's own, or -1."""
        n = len(self.vectors)
        counts, done = np.zeros(n, np.int64), np.zeros(n, bool)
        low = high = None
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        for radius, now in zip([*RADII, math.inf], ends.tolist()):
            if low is None:
                parts = [order[a:b] for order, a, b in zip(self.order, *now)]
            else:
                parts = [order[a:b] for order, a, b in zip(self.order, now[0], low) if a < b]
                parts += [order[a:b] for order, a, b in zip(self.order, high, now[1]) if a < b]
            low, high = now
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= need) & ~done)
            if len(new):
                done[new] = True
                new = new[new != skip]
                rows = np.append(rows, new)
                cosines = np.append(cosines, self.vectors[new] @ query)
            if len(rows) >= k:
                kth = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                if math.sqrt(max(0.0, 2 - 2 * kth)) <= radius:
                    break
        return rows, cosines


def search(
    vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", projections: int = PROJECTIONS,
    width: float = WIDTH, miss: float = MISS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = 29,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row with ``asks``, the ``k`` nearest of all other rows found."""
    good = vectors.filter(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    good, n = stored_with_count(good.dropDuplicates(["id", "v"]).withColumn("size", F.size("v")))
    queries = good.filter("asks")
    n_queries = queries.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    block, group = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(groups))
    left = good.select("size", "id", "v", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("asks"))
    right = queries.select("size", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.cast("int").alias("group"), F.lit(True).alias("asks"))
    need = needed(projections, width, miss)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(held: pa.Table) -> pa.Table:
        asking = held.column("asks").to_numpy()
        ids, matrix = held.column("id").to_numpy(), vectors_of(held.column("v").combine_chunks())
        own, q_ids = ids[~asking], ids[asking]
        if not len(own) or not len(q_ids):
            return out.empty_table()
        directions = np.random.default_rng(seed).normal(size=(matrix.shape[1], projections))
        members = matrix[~asking]
        arrays, sought = Arrays(members, directions), matrix[asking]
        sought = sought / np.linalg.norm(sought, axis=1, keepdims=True)
        ends = arrays.windows(sought @ directions, width)
        where = {i: r for r, i in enumerate(own.tolist())}
        most = k + len(own) - len(where)  # rows that share an id do not crowd others out
        parts: list[tuple] = []
        for q_id, query, raw, end in zip(q_ids.tolist(), sought, matrix[asking], ends):
            rows, cosines = arrays.near(query, end, most, need, where.get(q_id, -1))
            keep = own[rows] != q_id
            rows, cosines = rows[keep], cosines[keep]
            if len(rows) > most:  # exact sums decide among those that rounding could part
                edge = np.partition(cosines, len(cosines) - most)[len(cosines) - most]
                rows = rows[cosines >= edge - 1e-12]
            exact = _cosines(raw, members[rows])
            best = np.lexsort((own[rows], -exact))
            best = best[np.sort(np.unique(own[rows][best], return_index=True)[1])[:k]]
            parts.append((np.full(len(best), q_id), own[rows][best], exact[best]))
        return pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(out.names)}, schema=out)

    met = left.unionByName(right).groupBy("size", "block", "group").applyInArrow(meet, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return cut_lineage(met).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """On the vectors as they are, each sum by itself, so that equal vectors have equal cosines."""
    dots = np.array([float(np.dot(query, r)) for r in rows])
    lengths = np.array([math.sqrt(float(np.dot(r, r))) for r in rows])
    return dots / (lengths * math.sqrt(float(np.dot(query, query)))) if len(rows) else dots


def exact(vectors: DataFrame, asks: Column, k: int = 5, **options) -> DataFrame:
    """The same by brute force, for measuring recall: no collision is needed."""
    return search(vectors, asks, k, projections=1, miss=0.0, **options)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    hits = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, truth.count())
