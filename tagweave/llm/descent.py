"""Near-duplicate embeddings by NN-descent.

Vectors of one label that are equal are one node.  A neighbour graph of the ``k`` nearest known
nodes starts from neighbours in random orders (hyperplane codes, and a projection inside a code) and is refined by joining neighbours
of neighbours (Dong et al. 2011): around each node its nearest neighbours, both ways, are compared
with each other, if one of them is new, and a pair is kept where it betters a list.  The rounds end when few lists change.

All pairs compared at or above the threshold are links, also those that better no list, and components of links are classes.
A list whose ``k`` entries are all links is saturated: it may have more.  Those inside its class need no list: classes are compared in
full, block against block, and only counts leave a task.  So a class of any size costs no pairs in a shuffle,
and the links counted are exact within classes.  Those to other classes are searched for by saturated nodes with lists
that hold other classes only, again and again until no class grows.

Recall is audited node by node on hash samples of lone nodes, small and large classes, compared with all nodes of their label; below ``wanted`` the
search goes on with new orders, up to ``passes``, and then all blocks of a label are compared.  The audit's last result is in
column ``audit_recall`` (1 after the comparison).

Nulls: rows whose label or vector is null, and vectors that are empty, zero, or hold null or non-finite
parts, link with nothing and are their own class, as are vectors of different length to each other.  A row without id links with nothing
and has no class.  Each row gives one row.  Equal vectors of one label link; rows repeated under one id are
links of each other like any others.  An empty table gives an empty one.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage, stored_with_count
from tagweave.llm.common import by_group, runs, usable, vectors_of
from tagweave.llm.components import components

PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
MET = PAIR.append(pa.field("link", pa.bool_()))
SLACK = 1e-9  # links are counted exactly at the end
BLOCK = 1024


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def first_pairs(nodes: DataFrame, size: int, n: int, tables: int, reach: int, seed: int) -> DataFrame:
    """Pairs ``(u, v, sim)`` of nodes near each other in one of ``tables`` random orders of their label.

    Orders are dealt out by range, so that a crowded code is many tasks; pairs across the ends of tasks are not made.
    Nodes with a column ``root`` are paired with those before the run of their own root.
    """
    across = "root" in nodes.columns
    bits = max(0, round(math.log2(max(n, 1) / 256)))
    placed = pa.schema([("label", pa.int64()), ("order", pa.int32()), ("code", pa.int64()), ("at", pa.float64()), ("node", pa.int64()), ("root", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(tables, size, bits + 1))
        for batch in batches:
            unit = _unit(vectors_of(batch.column("vec")))
            for k in range(tables):
                values = unit @ planes[k]
                code = (values[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(unit), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(np.full(len(unit), k, np.int32)), pa.array(code.astype(np.int64)), pa.array(values[:, bits]), batch.column("node"), batch.column("root"), batch.column("vec")], schema=placed
                )

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = pa.concat_tables([last, held]).combine_chunks() if last is not None else held
            old = last.num_rows if last is not None else 0
            keys = [held.column(c).to_numpy() for c in ("label", "order", "code")]
            node, unit = held.column("node").to_numpy(), _unit(vectors_of(held.column("vec").combine_chunks()))
            begin = np.arange(len(node))  # of the run of the same root
            if across and len(node):
                ends = runs(*keys, held.column("root").to_numpy())
                begin = np.repeat(ends[:-1], np.diff(ends))
            for d in range(1, min(reach, len(node) - 1) + 1):
                a = np.arange(old, len(node))
                a = a[begin[a] >= d]
                b = begin[a] - d
                same = np.logical_and.reduce([k[a] == k[b] for k in keys])
                a, b = a[same], b[same]
                sim = np.einsum("ij,ij->i", unit[a], unit[b])
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(sim)], schema=PAIR)
            last = held.slice(max(0, held.num_rows - reach))

    keys = ["label", "order", "code", "at"]
    asked = nodes.select("label", "node", F.col("root" if across else "node").alias("root"), "vec")
    dealt = asked.mapInArrow(place, "label long, order int, code long, at double, node long, root long, vec array<double>")
    return dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pair, "u long, v long, sim double")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, from directed pairs ``(u, v, sim, fresh)``; a pair met before is not fresh."""
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = W.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: directed pairs that better the list of their first node, with the graph's own."""
    return _round(graph, nodes, k).filter("listed").select("u", "v", "sim", "fresh")


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The first of those each row is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root, len(root)).min(1))
        if (low == root).all():
            return root
        root = low


def _round(graph: DataFrame, nodes: DataFrame, k: int, threshold: float = math.inf, inner: DataFrame | None = None) -> DataFrame:
    """``(u, v, sim, fresh, listed, link)``: what ``refine`` gives is listed, and links connect all that was compared at or above the threshold.

    Nodes with a column ``root`` are not compared with those of their own; ``inner`` has pairs whose nodes look where each other look.
    """
    order = W.partitionBy("v").orderBy(F.col("sim").desc(), "u")
    back = graph.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    around = graph.select(F.col("u").alias("middle"), F.col("v").alias("node"), "fresh").union(back.select("v", "u", "fresh"))
    if inner is not None:
        own = graph.groupBy("u").agg(F.max("fresh").alias("fresh")).select("u", F.col("u").alias("v"), "fresh")
        around = around.union(inner.select("u", "v", F.lit(False))).union(own)
    around = around.groupBy("middle", "node").agg(F.max("fresh").alias("fresh"))
    edge = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("edge"))
    root = F.col("root" if "root" in nodes.columns else "node").alias("root")
    state = nodes.select("node", "vec", root).join(edge.withColumnRenamed("u", "node"), "node", "left")
    state = state.select("node", "vec", "root", F.coalesce("edge", F.lit(-2.0)).alias("edge"))
    met = around.join(state, "node").repartition("middle").sortWithinPartitions("middle")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        middle, node, root = (batch.column(c).to_numpy() for c in ("middle", "node", "root"))
        fresh, edge = batch.column("fresh").to_numpy(zero_copy_only=False).astype(bool), batch.column("edge").to_numpy()
        unit = _unit(vectors_of(batch.column("vec")))
        ends = runs(middle)
        parts = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a < 2 or not fresh[a:b].any():
                continue
            sim = unit[a:b] @ unit[a:b].T
            may = (root[a:b, None] != root[a:b]) & (fresh[a:b, None] | fresh[a:b])
            better = may & (sim > edge[a:b, None])
            linked = may & (sim >= threshold - SLACK)
            link = np.zeros_like(better)
            if linked.any():
                linked |= linked.T
                to = _local_roots(linked)
                link[np.arange(b - a), to] = to != np.arange(b - a)
            i, j = np.nonzero(better | link)
            parts.append((node[a:b][i], node[a:b][j], sim[i, j], link[i, j]))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=MET)

    found = met.mapInArrow(by_group(("middle",), step, 8192), "u long, v long, sim double, link boolean")
    found = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("link").alias("link")).withColumn("fresh", F.lit(True))
    pairs = graph.select("u", "v", "sim", F.lit(False).alias("link"), F.lit(False).alias("fresh")).unionByName(found)
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("link").alias("link"))
    order = W.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    ranked = once.withColumn("listed", F.row_number().over(order) <= k)
    return ranked.filter("listed or link").select("u", "v", "sim", "fresh", "listed", "link")


def class_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(node, n)``: rows linked with each node inside its class, its own included; ``members(root, node, vec, copies)``."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("root", F.col("own").alias("i"), every.alias("j"), "node", "vec", "copies", F.lit(True).alias("asks"))
    right = rows.select("root", every.alias("i"), F.col("own").alias("j"), "node", "vec", "copies", F.lit(False).alias("asks"))
    keys = ("root", "i", "j")
    out = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(c).to_numpy() for c in keys]
        node, copies, asks = batch.column("node").to_numpy(), batch.column("copies").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        matrix = vectors_of(batch.column("vec"))
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        ends = runs(*columns)
        nodes, counts = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            x, y = np.flatnonzero(asks[a:b]) + a, np.flatnonzero(~asks[a:b]) + a
            if len(x) and len(y):
                linked = matrix[x] @ matrix[y].T / (length[x, None] * length[y]) >= threshold
                linked |= node[x, None] == node[y]
                nodes.append(node[x])
                counts.append(linked @ copies[y])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts))], schema=out)

    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(by_group(keys, step, 8192), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, roots: DataFrame, threshold: float, sample: int, seed: int, k: int = 10) -> float:
    """Share of nodes with links whose partners are all in their class: the lesser of that in large classes and in all others.

    Up to ``sample`` nodes each of those alone, in classes of at most ``k`` nodes and in larger ones are compared with all
    nodes of their label, and each of these three counts by the nodes it stands for.  So losses among small groups do not vanish beside a large one.
    """
    rooted = nodes.join(roots, "node", "left").select("node", "label", "vec", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    kind = F.when(F.col("size") == 1, 0).when(F.col("size") <= k, 1).otherwise(2).alias("kind")
    kinds = cut_lineage(rooted.join(sizes, "root").select("node", "label", "vec", kind))
    stands = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # three kinds
    order = (F.xxhash64(F.lit(seed), "node"), "node")
    drawn = [r for own in stands for r in kinds.filter(F.col("kind") == own).orderBy(*order).limit(sample).collect()]
    if not drawn:
        return 1.0
    ids, labels, of_kind = (np.array([r[c] for r in drawn]) for c in ("node", "label", "kind"))
    unit = _unit(np.array([r["vec"] for r in drawn]))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = batch.column("node").to_numpy(), batch.column("label").to_numpy()
            linked = (_unit(vectors_of(batch.column("vec"))) @ unit.T >= threshold) & (label[:, None] == labels) & (node[:, None] != ids)
            i, j = np.nonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(node[i]), pa.array(np.ones(len(i)))], schema=PAIR)

    true = nodes.select("node", "label", "vec").mapInArrow(meet, "u long, v long, sim double").select("u", "v")
    for end in ("u", "v"):
        true = true.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    same = F.coalesce("u_root", "u") == F.coalesce("v_root", "v")
    whole = {r["u"]: r["whole"] for r in true.groupBy("u").agg(F.bool_and(same).alias("whole")).collect()}  # a row for each sampled node
    shares = []
    for group in ((0, 1), (2,)):
        linked = found = 0.0
        for own in group:
            mine = ids[of_kind == own].tolist()
            weight = stands.get(own, 0) / max(1, len(mine))
            linked += weight * sum(i in whole for i in mine)
            found += weight * sum(whole.get(i, False) for i in mine)
        shares.append(found / linked if linked else 1.0)
    return min(shares)


def exact_links(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes of a label that are linked, by comparing every block with every block of it.

    Only links to local roots leave a task, so a class of any size gives no more rows than a block has, for each pair of blocks.
    """
    sizes = nodes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = nodes.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = rows.select("label", "own", other.alias("other"), "node", "vec")
    spread = spread.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "vec")
    keys = ("label", "i", "j")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, unit = batch.column("node").to_numpy(), _unit(vectors_of(batch.column("vec")))
        ends = runs(*[batch.column(c).to_numpy() for c in keys])
        a, b = [], []
        for at, to in zip(ends[:-1].tolist(), ends[1:].tolist()):
            root = _local_roots(unit[at:to] @ unit[at:to].T >= threshold - SLACK)
            tied = np.flatnonzero(root != np.arange(to - at))
            a.append(node[at:to][tied])
            b.append(node[at:to][root[tied]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)

    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(by_group(keys, step, 4096), "a long, b long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, k: int = 10, tables: int = 6, few: float = 0.01, rounds: int = 8, wanted: float = 0.995,
    passes: int = 3, sample: int = 1024, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", seed: int = 17,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_recall)`` of every row."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label).cast("string"), F.size(vector)).alias("label"), F.col(vector).cast("array<double>").alias("vec"),
        (usable(vector) & F.col(id_col).isNotNull() & F.col(label).isNotNull()).alias("good"),
    )
    nodes, n = stored_with_count(rows.filter("good").groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    links, roots, recall = None, None, 1.0
    if n:
        sizes = [r["size"] for r in nodes.select(F.size("vec").alias("size")).distinct().collect()]  # one search for each length
        for turn in range(passes):
            for size in sizes:
                own = nodes.filter(F.size("vec") == size)
                found = _search(own, size, n, threshold, k, tables, few, rounds, seed + 1000 * turn)
                links = found if links is None else links.unionByName(found)
            roots = cut_lineage(components(links))
            recall = min(audit(nodes.filter(F.size("vec") == size), roots, threshold, sample, seed + turn, k) for size in sizes)
            if recall >= wanted:
                break
        else:  # the search did not get there: compare all blocks
            for size in sizes:
                links = links.unionByName(exact_links(nodes.filter(F.size("vec") == size), threshold))
            roots, recall = cut_lineage(components(links)), 1.0
        rooted = nodes.join(roots, "node", "left").select("label", "vec", "node", "copies", F.coalesce("root", "node").alias("root"))
        heads = roots.select("root").distinct()
        counts = class_counts(rooted.join(heads, "root", "left_semi"), threshold)
        done = rooted.join(counts, "node", "left").select("label", "vec", "root", F.coalesce("n", "copies").alias("n"))
    else:
        done = nodes.select("label", "vec", F.col("node").alias("root"), F.col("copies").alias("n"))
    good = rows.filter("good").join(done, ["label", "vec"]).select("id", (F.col("n") - 1).alias("n_links"), F.col("root").alias("component_id"))
    rest = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall")
    )


def _descend(found: DataFrame, nodes: DataFrame, n: int, threshold: float, k: int, few: float, rounds: int, inner: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph refined from first pairs, and links ``(a, b)`` that connect all pairs compared at or above the threshold."""
    linked = F.col("sim") >= threshold - SLACK
    as_links = lambda pairs: pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = found.select("u", "v", "sim").union(found.select("v", "u", "sim")).withColumn("fresh", F.lit(True))
    graph, links = cut_lineage(_lists(both, k)), as_links(found.filter(linked))
    for _ in range(rounds):
        met = cut_lineage(_round(graph, nodes, k, threshold, inner))
        graph = met.filter("listed").select("u", "v", "sim", "fresh")
        links = links.union(as_links(met.filter("link")))
        if graph.filter("fresh").count() <= few * k * n:
            break
    return graph, links.union(as_links(graph.filter(linked)))


def _search(nodes: DataFrame, size: int, n: int, threshold: float, k: int, tables: int, few: float, rounds: int, seed: int) -> DataFrame:
    """Links ``(a, b)`` found by one pass of NN-descent."""
    reach = max(2, k // 2)
    found = cut_lineage(first_pairs(nodes, size, n, tables, reach, seed))
    graph, links = _descend(found, nodes, n, threshold, k, few, rounds)
    full = graph.filter(F.col("sim") >= threshold - SLACK).groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    full, some = stored_with_count(nodes.join(full.select(F.col("u").alias("node")), "node", "left_semi").select("label", "vec", "node"))
    while some:
        # Saturated nodes look at other classes only, as long as classes grow.
        seed += 1
        links = cut_lineage(links.distinct())
        rooted = full.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = rooted.groupBy("label").agg((F.min("root") < F.max("root")).alias("several")).filter("several")
        hot, m = stored_with_count(rooted.join(several.select("label"), "label", "left_semi"))
        if not m:
            break
        class_of = hot.select(F.col("node").alias("v"), F.col("root").alias("v_root"))
        inner = graph.join(hot.select(F.col("node").alias("u"), "root"), "u").join(class_of, "v").filter("root = v_root")
        found = cut_lineage(first_pairs(hot, size, m, tables, reach, seed).join(hot.select(F.col("node").alias("u"), "root"), "u").join(class_of, "v").filter("root <> v_root").select("u", "v", "sim"))
        _, more = _descend(found, hot, m, threshold, k, few, rounds, cut_lineage(inner.select("u", "v")))
        more, grown = stored_with_count(more)
        if not grown:
            break
        links = links.union(more)
    return links
