"""Exact duplicates against what was seen before, by a minimal perfect hash over the distinct digests.

An ``Index`` holds every distinct digest of the history once, dealt into shards of bounded size by the digest.  A shard is
one row: a minimal perfect hash (levels of bit arrays, Limasset et al. 2017) and, in the order of its slots, the full
digests, the winners' locators (id and row) and how many rows were seen.  New documents are grouped by digest before
they move; a shard then looks its share up.  Any digest has a slot, so a hit counts only if all 32 bytes in the
slot are those asked for: then the rows are repeats and are added to the slot.  Digests without a hit form
groups of their own and become slots of the next index.  Nothing grows with the size of a group: a group travels as one row a task.

The digest is SHA-256 of the text with each run of ``[\\x20\\x09-\\x0D]`` as one space.  Of a group the row with the smallest id stays; of
rows that share that id one stays, any other column aside.  Rows without id come last: they stay only where all of the group
lack one (``keep_id`` is null then).  A null text is an empty one, and empty texts are equal.  Texts are used whole.  An empty
table gives an empty one.  Other columns are not read.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, stored_with_count
from tagweave.llm.common import by_group

SHARD_DIGESTS = 1 << 12
#: A group with more than this share of all rows is hot; there are at most 200 such groups.
HOT = 200
GAMMA, LEVELS = 2, 64
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces need no work."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]{2,}|[\t-\r]", " ")


# --- the minimal perfect hash -----------------------------------------------------


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    """Of rows of 64-bit words, another one for each level."""
    h = np.full(len(keys), (level + 1) * int(ODD) % (1 << 64), np.uint64)
    for word in keys.T:
        h ^= word
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


class PerfectHash:
    """A place in ``0..n-1`` for each of ``n`` different keys; any other key gets some place, or -1.

    Each level has two bits for each key that is left; a bit is set where exactly one key falls.  The others
    go to the next level.  A key's place is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.cumsum(b) - 1 for b in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys must be different")
            size = max(8, -(-GAMMA * len(keys) // 8) * 8)
            at = (_hash(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            levels.append(np.bincount(at, minlength=size) == 1)
            keys = keys[~levels[-1][at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place, left = np.full(len(keys), -1), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_hash(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            place[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return place

    def packed(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpacked(cls, sizes: list[int], data: bytes) -> "PerfectHash":
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if sizes else [])


# --- the index ----------------------------------------------------------------------

GROUP = "digest binary, doc_id long, row long, size long"
SHARD = "shard int, levels array<int>, bits binary, digests binary, doc_ids array<long>, rows array<long>, sizes array<long>"
_SHARD = pa.schema(
    [("shard", pa.int32()), ("levels", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "rows", "sizes")]
)


@dataclass(frozen=True)
class Index:
    """``table`` has one row a shard that holds digests; ``groups()`` are its slots."""

    table: DataFrame
    shards: int

    def groups(self, least: int = 1) -> DataFrame:
        """``(digest, doc_id, row, size)`` of the groups of at least so many rows."""
        out = pa.schema([("digest", pa.binary())] + [(n, pa.int64()) for n in ("doc_id", "row", "size")])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, rows, sizes = (batch.column(n)[k].values for n in ("doc_ids", "rows", "sizes"))
                    several = pa.array(sizes.to_numpy() >= least)
                    columns = [_fixed(batch.column("digests")[k].as_py()), ids, rows, sizes]
                    yield pa.RecordBatch.from_arrays([c.filter(several) for c in columns], schema=out)

        return self.table.mapInArrow(run, GROUP)


def _fixed(data: bytes) -> pa.Array:
    """Digests of 32 bytes that lie one after the other."""
    n = len(data) // 32
    return pa.Array.from_buffers(pa.binary(32), n, [None, pa.py_buffer(data)]).cast(pa.binary())


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def _joined(column: pa.Array | pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _shard(number: int, digests: bytes, ids: pa.Array, rows: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    keys = _words(digests)
    places = PerfectHash.of(keys)
    order = np.argsort(places(keys))
    levels, bits = places.packed()
    one = lambda values: pa.array([values], pa.list_(pa.int64()))
    columns = [pa.array([number], pa.int32()), pa.array([levels], pa.list_(pa.int32())), pa.array([bits]), pa.array([keys[order].tobytes()])]
    return pa.RecordBatch.from_arrays([*columns, one(ids.take(pa.array(order)).to_pylist()), one(rows[order]), one(sizes[order])], schema=_SHARD)


def grouped(digests: DataFrame) -> DataFrame:
    """``(digest, doc_id, row, size)`` of ``digests(digest, doc_id, row)``; the winner is the smallest id, then row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    return digests.groupBy("digest").agg(first, F.count(F.lit(1)).alias("size")).select("digest", "first.doc_id", "first.row", "size")


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(groups: DataFrame, shards: int) -> Index:
    """An index of ``groups``, whose digests are all different, as a written table."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = batch.column("shard")[0].as_py()
        yield _shard(number, _joined(batch.column("digest")), batch.column("doc_id"), batch.column("row").to_numpy(), batch.column("size").to_numpy())

    dealt = _dealt(groups, shards).repartition("shard").sortWithinPartitions("shard")
    return Index(cut_lineage(dealt.mapInArrow(by_group(("shard",), step), SHARD)), shards)


def absorb(index: Index, arrivals: DataFrame) -> Index:
    """The index after ``arrivals``, groups of new rows: hits are added to their slots, the others become new slots.

    The smaller id wins a slot, whichever side it comes from.
    """

    def look_up(new: pa.Table, old: pa.Table) -> pa.Table:
        if not old.num_rows:
            table = _shard(new["shard"][0].as_py(), _joined(new["digest"]), new["doc_id"].combine_chunks(), new["row"].to_numpy(), new["size"].to_numpy())
            return pa.Table.from_batches([table])
        if not new.num_rows:
            return old.select(_SHARD.names).cast(_SHARD)
        held = {name: old[name][0] for name in _SHARD.names}
        slots = PerfectHash.unpacked(held["levels"].as_py(), held["bits"].as_py())
        digests, asked = held["digests"].as_py(), _words(_joined(new["digest"]))
        place = slots(asked)
        hit = (place >= 0) & (_words(digests)[place] == asked).all(axis=1)  # byte for byte
        known, place = np.flatnonzero(hit), place[hit]
        sizes, rows = held["sizes"].values.to_numpy().copy(), held["rows"].values.to_numpy().copy()
        new_ids, new_rows, new_sizes = new["doc_id"].combine_chunks(), new["row"].to_numpy(), new["size"].to_numpy()
        sizes[place] += new_sizes[known]  # a digest arrives once
        ids, none = _with_mask(held["doc_ids"].values)
        his, his_none = _with_mask(new_ids)
        theirs = lambda a, b: (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))
        won = theirs((his_none[known], his[known], new_rows[known]), (none[place], ids[place], rows[place]))
        at, by = place[won], known[won]
        ids[at], none[at], rows[at] = his[by], his_none[by], new_rows[by]
        rest = np.flatnonzero(~hit)
        all_ids = pa.array(np.append(ids, his[rest]), mask=np.append(none, his_none[rest]))
        table = _shard(held["shard"].as_py(), digests + asked[rest].tobytes(), all_ids, np.append(rows, new_rows[rest]), np.append(sizes, new_sizes[rest]))
        return pa.Table.from_batches([table])

    dealt = _dealt(arrivals, index.shards).groupBy("shard").cogroup(index.table.groupBy("shard"))
    return Index(cut_lineage(dealt.applyInArrow(look_up, SHARD)), index.shards)


def _with_mask(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.fill_null(0).to_numpy(zero_copy_only=False).copy(), np.asarray(ids.is_null())


# --- the operator -----------------------------------------------------------------


def digests_of(docs: DataFrame, history: Column, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``(row, doc_id, digest, old)`` as a written table, so that a row keeps its number; and the number of rows."""
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    old = F.coalesce(history, F.lit(False))
    return stored_with_count(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), old.alias("old")))


def exact_duplicates(docs: DataFrame, history: Column | bool = False, id_col: str = "doc_id", text: str = "text", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    ``history`` says which rows were there before and make the first index; the rest is looked up in it.  The answer
    is the same for any history.
    """
    rows, n = digests_of(docs, history if isinstance(history, Column) else F.lit(history), id_col, text)
    index = build_index(grouped(rows.filter("old")), max(1, -(-n // shard_digests)))
    index = absorb(index, grouped(rows.filter("not old")))
    groups = cut_lineage(index.groups(2)).select(F.col("digest").alias("of"), F.struct(F.col("doc_id").alias("id"), "row", "size").alias("group"))
    is_hot = F.col("group.size") > n // HOT
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    same = F.col("digest") == F.col("of")
    found = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same, "left"))
    alone = F.col("group").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("group.id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group.size")).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("group.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def earlier_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows whose id lies below the middle of the range of ids."""
    ends = docs.agg(F.min(F.col(id_col).cast("long")).alias("low"), F.max(F.col(id_col).cast("long")).alias("high")).first()
    return F.lit(False) if ends["low"] is None else F.col(id_col) < (ends["low"] + ends["high"]) // 2


def duplicates_sql() -> str:
    return """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST) = 1 AS kept, s AS text_sha256
        FROM d WINDOW w AS (PARTITION BY s)"""
