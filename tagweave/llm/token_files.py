"""Token ids of all documents in flat binary files.

A folder holds, for each part of the documents in ascending ``doc_id``:

- ``<part>.ids``: the ids of all its documents, one after the other, as little-endian unsigned
  integers of 16 bits if all ids of the vocabulary fit, else of 32;
- ``<part>.docs``: its ``doc_id`` values as 64-bit integers;
- ``<part>.offsets``: one 64-bit number a document and one more, the place of its first
  id among the ids of *all* documents.

A part is one range of ``doc_id``, written by one task as a stream.  Tasks return how much they wrote, and
running sums of that are the parts' bases; a second, small pass adds them to the offsets.  A file's name is
unique to the attempt that wrote it and only files in the manifest count, so a lost or repeated task
leaves nothing wrong.  Readers map the files into memory.

Nulls: a null text is an empty one, so its document is the end id alone.  Rows without id come first and
are stored under the least 64-bit integer.  Rows repeated under one id are documents of their own, in the
order of their texts.  An empty table has no parts.
"""

import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.session import scratch_path, stored_with_count
from tagweave.llm.bpe import STEP_ROWS, Pieces
from tagweave.llm.common import give_back, in_steps

NO_ID = -(1 << 63)


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a Spark path, and the path in it."""
    if folder.startswith("file:") or ":" not in folder:
        return pa.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, else read."""
    store, at = _store(folder)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(f"{at}/{name}", kind, "r") if os.path.getsize(f"{at}/{name}") else np.zeros(0, kind)
    with store.open_input_file(f"{at}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(
    docs: DataFrame, pieces: Callable[[], Pieces], folder: str, id_type: str = "<u2", end_id: int = 2,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the files and return the manifest ``(part, name, docs, ids, base)``, a stored table."""
    out = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), pieces()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name, docs, ids = f"{part:06d}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(f"{at}/{name}.ids") as tokens, store.open_output_stream(f"{at}/{name}.docs") as keys, store.open_output_stream(f"{at}/{name}.sizes") as sizes:
            for batch in in_steps(batches, STEP_ROWS):
                found, counts = known.batch(batch.column("text"), end_id, id_type)
                tokens.write(pa.py_buffer(found))
                keys.write(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                sizes.write(counts.astype("<i8").tobytes())
                docs, ids = docs + len(counts), ids + len(found)
        give_back()
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [docs], "ids": [ids]}, schema=out)

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = asked.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts, n = stored_with_count(ordered.mapInArrow(write, "part int, name string, docs long, ids long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    based = parts.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                sizes = _mapped(folder, f"{name}.sizes", "<i8")
                with store.open_output_stream(f"{at}/{name}.offsets") as f:
                    f.write((base + np.append(0, np.cumsum(sizes))).astype("<i8").tobytes())
            yield batch

    spread = based.repartition(max(n, 1), "part")
    return stored_with_count(spread.mapInArrow(place, spread.schema))[0]


def read_tokens(manifest: DataFrame, folder: str, id_type: str = "<u2", rows: int = 10_000) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ids are little-endian unsigned 32-bit integers."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                ids, docs, offsets = _mapped(folder, f"{name}.ids", id_type), _mapped(folder, f"{name}.docs", "<i8"), _mapped(folder, f"{name}.offsets", "<i8")
                for at in range(0, len(docs), rows):
                    edge = offsets[at : at + rows + 1]
                    inside = (edge - base).tolist()
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(inside, inside[1:])]
                    keys = np.array(docs[at : at + rows])
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(keys, mask=keys == NO_ID), "start": np.array(edge[:-1]), "n_tokens": np.diff(edge), "ids_crc32": crcs}, schema=out
                    )

    parts = manifest.count()
    return manifest.repartition(max(parts, 1), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_on_disk(docs: DataFrame, pieces: Callable[[], Pieces], folder: str | None = None, **options) -> DataFrame:
    """Write all documents and read them back from the files."""
    folder = folder or scratch_path(docs.sparkSession)
    manifest = write_tokens(docs, pieces, folder, **options)
    return read_tokens(manifest, folder, options.get("id_type", "<u2"))
