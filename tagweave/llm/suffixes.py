"""Exact removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A string of ``length`` bytes counts as repeated if it starts at two places of all texts.  Three steps:

1. *Deal.*  Each window of ``length`` bytes is given to the least hash of ``anchor`` bytes in it; neighbouring
   windows that share the place of that hash are one piece.  Equal windows have the same hash, so all that could be equal meets under one key, and a key met
   once is settled.  Pieces equal as a whole are counted, not compared: hot copies are pre-aggregated.
2. *Merge.*  What is left of a range of keys is cut into shards of bounded size.  A shard's suffixes are sorted,
   in symbols of ``block`` bytes, and with them its transform: the symbol before each suffix.  The shards' orders are merged
   by refining an interleave (Holt and McMillan 2014): a round takes the symbols in the interleave's order and deals
   the shard numbers out by symbol, stably, which makes the order right for one symbol more.  A border between neighbours
   falls in the round whose symbol parts them, so borders are common prefixes (Egidi and Manzini 2017), and
   neighbours without one after ``length / block`` rounds are a repeated interval.  No suffix is sorted again.
3. *Cut.*  Repeated windows become byte spans of their document, are joined where they touch, and leave the text.

Symbols and pieces are compared by 64-bit hashes inside a key.  A key with very many different pieces
(``crowd``) is not merged in one task: its pieces are dealt again in halves, by what their windows share around the anchor, until
keys have few enough (``split_crowds``).

Nulls: a null text is an empty one; a text shorter than ``length`` keeps all its bytes.  A row without id is a document.
Rows repeated with id and text are copies like any others, so texts of ``length`` bytes or more lose all of theirs.
An empty table gives an empty one.  Other columns are not read.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, stored_with_count
from tagweave.llm.common import by_group, give_back, kept

LENGTH, ANCHOR, BLOCK = 400, 64, 100
CHUNK = 1 << 19
SHARD = 1 << 18
CROWD = 3000
ODD = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 22) - 1)  # of a gram in its chunk
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and powers of an odd number and of its inverse modulo 2**64.

    A worker keeps one table, long enough for a chunk; what is longer is made for the call.
    """

    def make(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = np.random.default_rng(20140814).integers(1, 1 << 63, 256, np.uint64)
        up = np.cumprod(np.full(size, ODD), dtype=np.uint64)
        down = np.cumprod(np.full(size, np.uint64(pow(int(ODD), -1, 1 << 64))), dtype=np.uint64)
        return values, up, down

    usual = CHUNK + LENGTH
    return kept(("powers",), lambda: make(usual)) if n <= usual else make(n)


class Hashes:
    """Hashes of any substring of one array of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        values, up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of the substrings of one size, at every place."""
        return self._mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima from both ends of blocks (van Herk)."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def pieces_of(data: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Pieces ``(start, windows, key, content)`` of texts that start at ``starts`` of ``data`` (the last is the end)."""
    hashes = Hashes(data)
    grams = hashes.every(anchor)
    # The leftmost of the least, so that two windows of one piece are never equal.
    least = sliding_min(grams & ~PLACE | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
    whole = np.zeros(len(least), bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        whole[a : max(a, b - length + 1)] = True
    new = np.zeros(len(least), bool)
    new[starts[:-1][starts[:-1] < len(least)]] = True
    new[1:] |= (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    edges = np.append(np.flatnonzero(new), len(least))
    first, windows = edges[:-1], np.diff(edges)
    good = whole[first]
    first, windows = first[good], windows[good]
    return first, windows, grams[(least[first] & PLACE).astype(np.int64)], hashes.of(first, first + windows + length - 1)


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def text_sum(text: Column) -> Column:
    return F.xxhash64(_bytes(text))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(doc_id, sum, text)``: a document is its id and text, so that ids need not be unique or there at all."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_sum(F.col(text)).alias("sum"), _bytes(F.col(text)).alias("text"))


def deal(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Pieces ``(doc_id, sum, start, windows, key, content)`` of all texts; no shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("sum", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("key", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            starts = np.append(0, np.cumsum([len(h[3]) for h in held]))
            first, windows, key, content = pieces_of(data, starts, length, anchor)
            of = np.searchsorted(starts, first, "right") - 1
            ids, missing = np.array([h[0] or 0 for h in held], np.int64), np.array([h[0] is None for h in held])
            sums, at = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[of], mask=missing[of]), pa.array(sums[of]), pa.array(at[of] + first - starts[of]), pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], schema=out
            )

        held, size = [], 0
        for batch in batches:
            for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("sum").to_pylist(), batch.column("text")):
                text = text.as_buffer()
                for at in range(0, len(text) - length + 1, CHUNK):
                    held.append((doc_id, mark, at, text[at : at + CHUNK + length - 1]))
                    size += len(held[-1][3])
                    if size >= CHUNK:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return texts.filter(F.octet_length("text") >= length).mapInArrow(
        run, "doc_id long, sum long, start long, windows int, key long, content long"
    )


# --- merging ----------------------------------------------------------------------


def _order(symbols: np.ndarray, after: np.ndarray, rounds: int) -> np.ndarray:
    """A shard's suffixes in the order of their first ``rounds`` symbols, by doubling ranks."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    known, step = 1, after
    while known < rounds:
        beyond = np.append(rank, -1)[step] + 1
        rank = np.unique(rank * (len(rank) + 1) + beyond, return_inverse=True)[1]
        step = np.append(step, len(step))[step]
        known *= 2
    return np.argsort(rank, kind="stable")


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, block: int = BLOCK, shard: int = SHARD) -> np.ndarray:
    """Which places of ``data`` start a string of ``length`` bytes that another place of its texts starts too."""
    if length % block:
        raise ValueError("length must be a multiple of block")
    # One place more for each text: its empty suffix.
    sizes, rounds = np.diff(starts), length // block
    own = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    n, starts = len(data) + len(sizes), starts + np.arange(len(starts))
    padded = np.zeros(n, np.uint8)
    padded[own] = data
    end = np.repeat((starts[1:] - 1).astype(np.int32), sizes + 1)  # of each place's text
    begin = np.repeat(starts[:-1].astype(np.int32), sizes + 1)
    places = np.arange(n, dtype=np.int32)
    full = places + block <= end  # has a symbol
    symbols = np.zeros(n, np.uint64)
    every = Hashes(padded).every(block) if n >= block else np.zeros(0, np.uint64)
    symbols[: len(every)] = every | np.uint64(1)
    symbols[~full] = 0
    # Shards of whole texts, each sorted by itself.
    owner = np.zeros(n, np.uint16)
    cuts, last = [0], 0
    for s in starts[1:].tolist():
        if s - last >= shard or s == n:
            cuts.append(s)
            last = s
    suffix = np.empty(n, np.int32)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        after = np.where(full[a:b], places[a:b] + block - a, b - a)
        suffix[a:b] = a + _order(symbols[a:b], np.minimum(after, b - a), rounds)
        owner[a:b] = k
    # The transform: the symbol before each suffix, 0 where its text begins less than a block earlier.
    inner = suffix - block >= begin[suffix]
    before = np.where(inner, symbols[np.maximum(suffix - block, 0)], np.uint64(0))
    before = np.unique(before, return_inverse=True)[1].astype(np.int32)
    del symbols, every
    short = np.flatnonzero(~full[suffix])  # suffixes without a symbol come first, each alone
    z = owner.copy()
    group = np.zeros(n, np.int32)
    for _ in range(rounds):
        at = np.empty(n, np.int32)  # the interleave: places in the shards' orders
        at[np.argsort(z, kind="stable")] = np.arange(n)
        at_inner = inner[at]
        symbol, old = before[at][at_inner], group[at_inner]
        dealt = np.argsort(symbol, kind="stable")
        z = np.concatenate([owner[short], z[at_inner][dealt]])
        symbol, old = symbol[dealt], old[dealt]
        border = np.ones(n, bool)
        border[len(short) + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        group = np.cumsum(border, dtype=np.int32)
    at = np.empty(n, np.int32)
    at[np.argsort(z, kind="stable")] = np.arange(n)
    alone = border & np.append(border[1:], True)
    found = np.zeros(n, bool)
    found[suffix[at[~alone]]] = True
    return (found & (places + length <= end))[own]


def _spans(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that the found windows cover, run by run."""
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length


SPAN = "doc_id long, sum long, start long, stop long"


def merge_pieces(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Spans of pieces ``(key, doc_id, sum, start, bytes)`` that another piece, or another place of the same, repeats."""
    out = pa.schema([("doc_id", pa.int64()), ("sum", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = batch.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(held), np.uint8)
        starts = np.append(0, np.cumsum([len(b) for b in held]))
        found = repeated_windows(data, starts, length, block)
        first, stop = _spans(found, length)  # a window never leaves its piece, so runs part where pieces do
        of = np.searchsorted(starts, first, "right") - 1
        begin = batch.column("start").to_numpy()[of] - starts[of]
        rows = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("sum").take(rows), pa.array(begin + first), pa.array(begin + stop)], schema=out
        )

    dealt = pieces.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(by_group(("key",), step, 1500), SPAN)


PART = "doc_id long, sum long, start long, windows int, at int, low int, high int, key long, content long, bytes binary"
_PART = pa.schema(
    [("doc_id", pa.int64()), ("sum", pa.int64()), ("start", pa.int64())]
    + [(n, pa.int32()) for n in ("windows", "at", "low", "high")]
    + [("key", pa.int64()), ("content", pa.int64()), ("bytes", pa.binary())]
)


def halves(pieces: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Each piece in two: its windows with few bytes before the anchor, and those with many.

    All windows of a piece hold its anchor, whose place in it is ``at`` (null at first: ``key`` is its hash); a window is known by the number of
    bytes before the anchor, from ``low`` to ``high`` in a piece.  Windows of one half share at least so many bytes before and
    behind the anchor: their hash is the half's key, and equal windows have equal keys.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for doc_id, mark, start, key, data, at, low, high in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "sum", "start", "key", "bytes", "at", "low", "high")]):
                hashes = Hashes(np.frombuffer(data, np.uint8))
                if at is None:
                    at = int(np.flatnonzero(hashes.every(anchor).view(np.int64) == key)[0])
                    low, high = 0, length - anchor
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(0, at - b), min(len(data) - length, at - a)  # windows, by where they start
                    if first > last:
                        continue
                    core = hashes.of(np.array([at - a, first]), np.array([at - b + length, last + length]))
                    k = int(core[0]) ^ (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % (1 << 64)
                    signed = [x - (1 << 64) if x >> 63 else x for x in (k, int(core[1]))]
                    rows.append([doc_id, mark, start + first, last - first + 1, at - first, a, b, *signed, data[first : last + length]])
            columns = zip(*rows) if rows else [[] for _ in _PART]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PART)], schema=_PART)
        give_back()

    return pieces.select("doc_id", "sum", "start", "key", "bytes", "at", "low", "high").mapInArrow(run, PART)


def split_crowds(crowded: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, crowd: int = CROWD) -> list[DataFrame]:
    """Spans of pieces ``(doc_id, sum, key, start, bytes)`` whose keys have too many to merge in one task.

    Pieces are halved, again and again, until a key has few enough: a piece becomes a few smaller ones, most of which meet
    no other and are settled.  Halves of one window are equal or alone, so it ends after ``log2(length)`` rounds.
    """
    spans = []
    part = crowded.withColumns({c: F.lit(None).cast("int") for c in ("at", "low", "high")})
    while True:
        part = cut_lineage(halves(part, length, anchor))
        contents = part.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "sum", "start")).alias("first"))
        contents = cut_lineage(contents)
        whole = part.join(contents.filter("n > 1").select("key", "content"), ["key", "content"])
        spans.append(cut_lineage(whole.select("doc_id", "sum", "start", (F.col("start") + F.col("windows") + length - 1).alias("stop"))))
        several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select("key", (F.col("pieces") > crowd).alias("crowded"))
        first = contents.select("key", "content", F.col("first.doc_id").alias("_id"), F.col("first.sum").alias("_sum"), F.col("first.start").alias("_start"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")) & (F.col("start") == F.col("_start"))
        left = part.join(several, "key").join(first, ["key", "content"]).filter(same).drop("_id", "_sum", "_start").dropDuplicates(["key", "content"])
        left, some = stored_with_count(left)
        if not some:
            return spans
        spans.append(cut_lineage(merge_pieces(left.filter("not crowded").select("key", "doc_id", "sum", "start", "bytes"), length, block)))
        part = left.filter("crowded")
        if part.isEmpty():
            return spans


# --- the operator -----------------------------------------------------------------


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Spans ``(doc_id, sum, start, stop)`` of ``texts(doc_id, sum, text)`` that repeated windows cover; they may touch."""
    pieces = cut_lineage(deal(texts, length, anchor))
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min("content").alias("low"), F.max("content").alias("high"))
    busy = cut_lineage(keys.filter("all > 1"))
    met = cut_lineage(pieces.join(busy.select("key"), "key"))
    # Pieces that are there again as a whole.
    first = F.min(F.struct("doc_id", "sum", "start", "windows")).alias("first")
    contents = cut_lineage(met.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), first))
    twice = contents.filter("n > 1").select("key", "content")
    whole = met.join(twice, ["key", "content"]).select("doc_id", "sum", "start", (F.col("start") + F.col("windows") + length - 1).alias("stop"))
    # Different pieces of one key: one of each content goes on with its bytes.
    several = contents.join(busy.filter("low <> high").select("key"), "key")
    crowds = several.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter(F.col("pieces") > crowd).select("key", F.lit(True).alias("crowded"))
    wanted = several.join(crowds, "key", "left").select(
        F.col("first.doc_id").alias("_id"), F.col("first.sum").alias("_sum"),
        F.struct("key", F.col("first.start").alias("start"), (F.col("first.windows") + length - 1).alias("size"), F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("piece"),
    )
    wanted = wanted.groupBy("_id", "_sum").agg(F.collect_list("piece").alias("pieces"))
    cut = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")))
    cut = cut.select("doc_id", "sum", "text", F.explode("pieces").alias("p")).select(
        "doc_id", "sum", "p.key", "p.start", "p.crowded", F.substring("text", F.col("p.start").cast("int") + 1, F.col("p.size").cast("int")).alias("bytes")
    )
    cut = cut_lineage(cut)
    spans = whole.unionByName(merge_pieces(cut.filter("not crowded"), length, block))
    crowded = cut.filter("crowded").select("doc_id", "sum", "key", "start", "bytes")
    for more in [] if crowded.isEmpty() else split_crowds(crowded, length, anchor, block, crowd):
        spans = spans.unionByName(more)
    return spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = True, **options
) -> DataFrame:
    """``(doc_id, sum, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row.

    ``sum`` is ``text_sum`` of the text; ``kept`` is the text that is left, without what a cut leaves of a character,
    and null without ``with_text``.
    """
    texts = _texts(docs, id_col, text)
    spans = repeated_spans(texts, length, **options)
    spans = spans.groupBy("doc_id", "sum").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")), "left")
    schema = "doc_id long, sum long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    out = pa.schema([("doc_id", pa.int64()), ("sum", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(text: bytes, starts, stops) -> tuple:
        if not starts:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
        first, stop = np.array(starts), np.maximum.accumulate(np.array(stops))
        new = np.append(True, first[1:] > stop[:-1])
        first, stop = first[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
        kept = b"".join([text[a:b] for a, b in zip([0, *stop.tolist()], [*first.tolist(), len(text)])])
        return len(text), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(*r) for r in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("stops").to_pylist())]
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]
            columns[4] = [k.decode(errors="ignore") for k in columns[4]] if with_text else [None] * len(rows)
            made = [pa.array(c, f.type) for c, f in zip(columns, list(out)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), *made], schema=out)

    return joined.select("doc_id", "sum", "text", "starts", "stops").mapInArrow(run, schema)
