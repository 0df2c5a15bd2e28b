"""SimHash near-duplicates with Burkhard-Keller trees.

A fingerprint takes part in one shard for each of ``max_bits + 1`` bands of its 64 bits: two
fingerprints that differ in at most ``max_bits`` bits agree in a whole band, so every link lies
inside a shard.  A shard's fingerprints form a tree whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius.  A shard above
``shard_rows`` is cut into several trees, and each of its fingerprints is sent to all of them:
that sends trees of proven size to the tasks, however large the table is.  A tree yields links
to the local root of each group it meets, never all pairs.

Nulls: a null text is an empty one, with fingerprint zero, linked like any other.  A row
without id gets a fingerprint and no component.  Rows repeated under one id are one document.
Equal fingerprints are one node, whose name is its smallest id.  An empty table gives an empty
one.  Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage
from tagweave.llm.common import by_batch, by_group, runs
from tagweave.llm.components import components

BITS = 64
SEED = 42
SHARD_ROWS = 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """The majority of each bit over the hashes of all word shingles, as a signed long."""
    tokens = text.lower().split()  # of bytes: A-Z, and space and 09-0D
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """``(doc_id, fp)`` of every row, and ``mark``, a whole number, if one is asked for; one pass over the texts, no shuffle."""
    more = [] if mark is None else ["mark"]
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [(m, pa.int64()) for m in more])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            data = batch.column("text").cast(pa.binary()).to_pylist()
            return {"doc_id": batch.column("doc_id"), "fp": [fingerprint(x or b"", words) for x in data]} | {m: batch.column(m) for m in more}

        return step

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[mark.cast("long").alias(m) for m in more])
    return asked.mapInArrow(by_batch(make, out), "doc_id long, fp long" + ", mark long" * len(more))


class Tree:
    """A Burkhard-Keller tree of integers under Hamming distance; equal values are kept once."""

    def __init__(self, radius: int) -> None:
        self.radius, self.root = radius, None

    def add(self, value: int, name) -> None:
        if self.root is None:
            self.root = (value, name, {})
            return
        node = self.root
        while distance := (value ^ node[0]).bit_count():
            below = node[2].get(distance)
            if below is None:
                node[2][distance] = (value, name, {})
                return
            node = below

    def near(self, value: int) -> list:
        """Names within the radius."""
        found, todo, radius = [], [self.root] if self.root else [], self.radius
        while todo:
            held, name, below = todo.pop()
            distance = (value ^ held).bit_count()
            if distance <= radius:
                found.append(name)
            for edge, node in below.items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(node)
        return found


def _links(values: list[int], names: list[int], planted: list[bool], radius: int) -> list[tuple[int, int]]:
    """Links that connect what one tree connects: of its own rows to their local root, of visitors to the roots they meet."""
    tree, parent = Tree(radius), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value, name, own in zip(values, names, planted):
        if own:
            parent[name] = name
            for other in tree.near(value):
                a, b = top(name), top(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            tree.add(value, name)
    out = [(name, top(name)) for name in parent if top(name) != name]
    for value, name, own in zip(values, names, planted):
        if not own:
            out += [(name, root) for root in {top(x) for x in tree.near(value)}]
    return out


def fingerprint_links(nodes: DataFrame, max_bits: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect the same ``nodes(name, fp)`` as all pairs within ``max_bits`` bits do."""
    width = BITS // (max_bits + 1)
    if width < 1:
        raise ValueError("max_bits must be under 64")
    mask = (1 << width) - 1 if width < BITS else -1
    bands = F.posexplode(F.array(*[F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask).cast("long")) for i in range(max_bits + 1)]))
    banded = nodes.select("name", "fp", bands.alias("band", "part"))
    hot = banded.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
    hot = hot.select("band", "part", F.ceil(F.col("n") / shard_rows).cast("int").alias("trees"))
    trees = F.coalesce("trees", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    sent = (
        banded.join(hot, ["band", "part"], "left")
        .withColumn("own", own)
        .select("band", "part", "name", "fp", "own", F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree"))
        .select("band", "part", "tree", "name", "fp", (F.col("own") == F.col("tree")).alias("planted"))
    )
    keys = ("band", "part", "tree")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def step(batch: pa.RecordBatch):
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        edges = runs(*[columns[k] for k in keys])
        a: list[int] = []
        b: list[int] = []
        fps = columns["fp"].view(np.uint64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo > 1:
                for x, y in _links(fps[lo:hi].tolist(), columns["name"][lo:hi].tolist(), columns["planted"][lo:hi].tolist(), max_bits):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=out)

    dealt = sent.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(by_group(keys, step, 20_000), "a long, b long")


def classes(prints: DataFrame, max_bits: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(fp, group)`` of the different fingerprints ``prints(fp)``: ``group`` is the least one reachable, itself included."""
    nodes = cut_lineage(prints.select("fp", F.col("fp").alias("name")).distinct())
    roots = components(fingerprint_links(nodes, max_bits, shard_rows)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    marked = cut_lineage(fingerprints(docs, words, id_col, text))
    named = marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("name"))
    named = cut_lineage(named.join(classes(named, max_bits), "fp"))
    first = named.groupBy("group").agg(F.min("name").alias("component_id"))
    found = named.join(first, "group").select("fp", "component_id")
    return marked.join(found, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def surplus(docs: DataFrame, mark: Column, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What to drop so that one row of each group of near copies stays: the smallest id, rows without id last.

    ``mark`` is a checksum of the text, so ``(doc_id, mark)`` stands for equal rows.  The first table holds the pairs of which
    no row stays, the second ``(doc_id, mark)`` of which one of several rows stays.
    """
    marked = cut_lineage(fingerprints(docs, words, id_col, text, mark))
    kinds = marked.groupBy("fp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    kinds = cut_lineage(kinds.join(classes(marked, max_bits), "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    several = kinds.groupBy("group").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    met = cut_lineage(kinds.join(several, "group").select("doc_id", "mark", "n", (order == F.col("first")).alias("stays")))
    return met.filter("not stays").select("doc_id", "mark"), met.filter("stays and n > 1").select("doc_id", "mark")
