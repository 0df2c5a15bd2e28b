"""Fill-in-the-middle texts, cut at units counted chunk by chunk.

A text is cut into chunks where a rolling hash of its last 32 bytes says so, so equal passages of different documents fall
into equal chunks.  A chunk's summary tells how many units (code points) begin in it and how many bytes at its
front belong to a unit begun before.  A worker keeps summaries under the rolling hash and size of their chunk together with its
bytes, and takes one only if the bytes are equal; the cache is bounded in bytes.  Running sums of the chunks' counts tell
in which chunk a cut lies, and only that chunk is read for its place.

Which documents are rearranged and where they are cut follows from SHA-256 of ``1:`` and the id (empty for a null id), so
reruns agree and rows repeated under one id are drawn alike.  A null text is an empty one; an empty text, and one that contains
a marker, stays plain.  Texts are used whole.  An empty table gives an empty one.  Other columns are not read.
"""

import hashlib
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_batch, kept

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WINDOW, SMALLEST, LARGEST = 32, 64, 4096
#: One place in 512 is a cut.
CUT_BITS = 9
CACHE_BYTES = 8 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``WINDOW`` bytes that end at each place (fewer at the front), by doubling."""
    h = np.random.default_rng(32).integers(0, 1 << 32, 256, np.uint32)[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def chunks_of(size: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes whose hash asks for ``cuts``: none too small, none too large."""
    ends, last = [], 0
    for cut in [*cuts, size]:
        while cut - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if cut - last >= SMALLEST:
            ends.append(cut)
            last = cut
    if last < size:
        ends.append(size)
    return ends


def leads(chunk: bytes) -> np.ndarray:
    """Places where a code point begins."""
    return np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)


def summary(chunk: bytes) -> tuple[int, int]:
    """How many units begin here, and how many bytes at the front end a unit begun before."""
    if chunk.isascii():
        return len(chunk), 0
    begins = leads(chunk)
    return len(begins), int(begins[0]) if len(begins) else len(chunk)


class Summaries:
    """Summaries of chunks by rolling hash and size, held with their bytes; older ones nobody asked for go first."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.most, self.bytes = most, 0
        self.young: dict[tuple[int, int], tuple[bytes, tuple[int, int]]] = {}
        self.old: dict[tuple[int, int], tuple[bytes, tuple[int, int]]] = {}

    def __call__(self, mark: int, chunk: bytes) -> tuple[int, int]:
        key = (mark, len(chunk))
        known = self.young.get(key) or self.old.get(key)
        if known is not None and known[0] == chunk:
            if key not in self.young:
                self._hold(key, known)
            return known[1]
        made = summary(chunk)
        self._hold(key, (chunk, made))
        return made

    def _hold(self, key: tuple[int, int], entry: tuple[bytes, tuple[int, int]]) -> None:
        if self.bytes + key[1] > self.most // 2:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.bytes += key[1] * (key not in self.young)
        self.young[key] = entry


class Units:
    """The units of one text: how many, and where the first ``k`` of them end."""

    def __init__(self, text: bytes, ends: list[int], marks: list[int], summaries: Summaries) -> None:
        self.text, self.ends = text, ends
        self.parts = [summaries(mark, text[a:b]) for mark, a, b in zip(marks, [0, *ends], ends)]
        self.upto = list(accumulate(n for n, _ in self.parts))
        self.n = self.upto[-1] if ends else 0

    def end(self, k: int) -> int:
        if k >= self.n:
            return len(self.text)
        at = int(np.searchsorted(self.upto, k, "right"))  # the chunk in which unit k begins
        start = self.ends[at - 1] if at else 0
        within = k - (self.upto[at] - self.parts[at][0])
        if within == 0:
            return start + self.parts[at][1]
        chunk = self.text[start : self.ends[at]]
        return start + (within if self.parts[at][0] == len(chunk) else int(leads(chunk)[within]))


def draw(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def rearranged(doc_id: int | None, text: bytes, units: Units, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    one, two, three, four = draw(doc_id)
    n = units.n
    if not n or three % 100 >= rate or (b"<" in text and any(m in text for m in (PREFIX, SUFFIX, MIDDLE))):
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = units.end(first), units.end(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return n, "spm", first, second - first, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return n, "psm", first, second - first, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: int = 90, spm: int = 20) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row; no shuffle.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of those with the suffix first.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def make() -> Callable[[pa.RecordBatch], dict]:
        summaries = kept(("chunk summaries",), Summaries)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            begins = [0, *accumulate(map(len, texts))]
            marks = rolling(np.frombuffer(b"".join(texts), np.uint8)) if begins[-1] else np.zeros(0, np.uint32)
            cuts = np.flatnonzero(marks >> np.uint32(32 - CUT_BITS) == 0) + 1
            edges = np.searchsorted(cuts, begins)
            rows = []
            for k, (doc_id, t) in enumerate(zip(batch.column("doc_id").to_pylist(), texts)):
                # The hash of a text's first bytes reaches back into another text; no chunk ends there.
                inside = (cuts[edges[k] : edges[k + 1]] - begins[k]).tolist()
                ends = chunks_of(len(t), inside)
                own = marks[np.array(ends, np.int64) + begins[k] - 1].tolist() if ends else []
                rows.append(rearranged(doc_id, t, Units(t, ends, own, summaries), rate, spm))
            n, form, first, second, made = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]
            return {"doc_id": batch.column("doc_id"), "n": n, "form": form, "prefix_chars": first, "middle_chars": second, "output": pa.array(made, pa.binary()).cast(pa.string())}

        return step

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return asked.mapInArrow(by_batch(make, out), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  A text with a marker is plain, so the markers found are ours."""
    parts = F.split(output, "<[PSM]>", 4)
    whole = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
    return whole.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    text = restored(F.col("output"), F.col("form"))
    sums = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


def fill_in_middle_sql() -> str:
    return """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        e AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                     ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
        g AS (SELECT *, left(t, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM g"""
