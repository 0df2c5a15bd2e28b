"""Runs of words that repeat with a period, found by recursive frequency splitting and a scan by lags.

A run of period ``q`` counts if it has ``max(least, times * q)`` words, so each of its words occurs ``times`` times in it.
A word that is rarer than that in its segment (at first: its document) can be in no run there: it splits the segment, and the parts
are counted anew until nothing splits.  Words of ordinary text are gone after a few rounds; what is left is
scanned for lags.  A window of ``s`` words, ``q <= s < 2q``, recurs inside a run of smallest period ``q`` after exactly ``q`` words (a
shorter way would make a shorter period), so for each ``s = 1, 2, 4, ...`` the lags to a window's next occurrence
name all lags that can matter, and places next to each other with the same lag are a run with its ends.
Windows get their numbers by doubling, so a segment of ``m`` words costs ``m log m`` steps and not one a lag and word.

All documents of a batch are split and scanned together, in arrays.  The rounds of splitting end early if there are
``ROUNDS`` of them, which only a text made for it needs; the scan finds the same runs in any segments.

Nulls: a null text is an empty one and has no words, runs or text.  Rows repeated and without id are documents like any
others.  Texts are used whole.  An empty table gives an empty one.  Other columns are not read.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_batch

LEAST, TIMES, ROUNDS = 6, 4, 64

Places = Callable[[int | None, int], np.ndarray | None]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the different keys from 0, the stable order, and which of it start a new key."""
    order = np.argsort(keys, kind="stable")
    inside = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = inside[1:] != inside[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order, new


def surviving(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places and segment numbers of the words that splitting leaves; ``lengths`` are those of the documents."""
    places, segment = np.arange(len(codes)), np.repeat(np.arange(len(lengths)), lengths)
    wide = int(codes.max(initial=0)) + 1
    stable_places, stable_marks = [places[:0]], [places[:0]]
    for _ in range(ROUNDS):
        long = np.bincount(segment)[segment] >= least if len(segment) else np.zeros(0, bool)
        places, segment = places[long], segment[long]
        if not len(places):
            break
        rank, _, _ = ranked(segment * wide + codes[places])
        rare = np.bincount(rank)[rank] < times
        splits = np.zeros(segment[-1] + 1, bool)
        splits[segment[rare]] = True
        split = splits[segment]
        stable_places.append(places[~split])
        stable_marks.append(places[~split] - _since_start(segment[~split]))
        go_on = split & ~rare
        places, segment = places[go_on], segment[go_on]
        if len(places):
            new = np.ones(len(places), bool)
            new[1:] = (np.diff(places) != 1) | (np.diff(segment) != 0)
            segment = np.cumsum(new) - 1
    stable_places.append(places)
    stable_marks.append(places - _since_start(segment))
    places, first = np.concatenate(stable_places), np.concatenate(stable_marks)
    order = np.argsort(places)
    return places[order], first[order]


def _since_start(segment: np.ndarray) -> np.ndarray:
    """How far each place is from the first of its segment."""
    if not len(segment):
        return segment
    new = np.ones(len(segment), bool)
    new[1:] = segment[1:] != segment[:-1]
    starts = np.flatnonzero(new)
    return np.arange(len(segment)) - np.repeat(starts, np.diff(np.append(starts, len(segment))))


def runs_of(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start and then period, in places of ``codes``.

    ``codes`` are the words of documents of ``lengths`` one after the other; equal words have equal codes.
    """
    if times < 3:
        raise ValueError("times must be 3 or more, so that a window longer than the period recurs in a run")
    places, first = surviving(codes, lengths, least, times)
    _, of = np.unique(first, return_inverse=True)
    size = np.bincount(of)[of] if len(of) else of
    number = np.full(len(codes) + 1, -1)
    number[places], _, _ = ranked(of * (int(codes.max(initial=0)) + 1) + codes[places])
    last = first + size
    found, s = [], 1
    while True:
        room = (size > (times // 2) * s) & (places + s <= last)  # a period over s / 2 must fit in ``times`` times
        places, first, size, last = places[room], first[room], size[room], last[room]
        if not len(places):
            break
        if s > 1:
            half = s // 2
            number[places], order, new = ranked(number[places] * (len(codes) + 1) + number[places + half])
        else:
            number[places], order, new = ranked(number[places])
        again = np.flatnonzero(~new)
        lag = np.zeros(len(places), np.int64)
        lag[order[again - 1]] = places[order[again]] - places[order[again - 1]]
        at = np.flatnonzero((2 * lag > s) & (lag <= s))
        if len(at):
            start = np.ones(len(at), bool)
            start[1:] = (np.diff(places[at]) != 1) | (np.diff(lag[at]) != 0) | (np.diff(first[at]) != 0)
            begin = np.flatnonzero(start)
            period = lag[at][begin]
            length = np.diff(np.append(begin, len(at))) - 1 + s + period
            good = length >= np.maximum(least, times * period)
            found.append(np.stack([places[at][begin][good], length[good], period[good]]))
        s *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def collapse(codes: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words stay: all but those of a run after its first period."""
    start, length, period = runs
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, places: Places | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, text)`` of every row; no shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``runs`` is an array of ``(start, length, period)`` in words, by start and then period;
    ``text`` has the words that stay, joined by one space.  ``places(doc_id, n)`` may say which of a document's
    ``n`` words each place takes before the search.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("text", pa.string())])

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            texts = pc.fill_null(batch.column("text"), "")
            split = pc.ascii_split_whitespace(texts)
            flat, of = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
            word = pc.binary_length(flat).to_numpy() > 0
            coded = flat.filter(pa.array(word)).dictionary_encode()
            lengths = np.bincount(of[word], minlength=len(texts))
            codes, begins = coded.indices.to_numpy().astype(np.int64), np.append(0, np.cumsum(lengths))
            if places is not None:
                source = np.arange(len(codes))
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    if lengths[k] and (moved := places(doc_id, int(lengths[k]))) is not None:
                        source[begins[k] : begins[k + 1]] = begins[k] + moved
                codes = codes[source]
            runs = runs_of(codes, lengths, least, times)
            stays = collapse(codes, runs)
            document = np.searchsorted(begins, runs[0], "right") - 1
            counts = np.append(0, np.cumsum(np.bincount(document, minlength=len(texts))))
            fields = [pa.array(x) for x in (runs[0] - begins[document], runs[1], runs[2])]
            kept = np.append(0, np.cumsum(stays))[begins]
            words = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), coded.dictionary.take(pa.array(codes[stays])))
            return {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(lengths.astype(np.int64)),
                "runs": pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(run))),
                "text": pc.binary_join(words, " "),
            }

        return step

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(by_batch(make, out), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def digests(collapsed: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of ``collapse_runs``."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.less")
    return collapsed.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
