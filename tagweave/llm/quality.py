"""Quality scores by regularised quadratic discriminant analysis.

One pass over the texts makes a few statistics of each whole document, as logarithms of smoothed ratios.
Counts, sums and products of the statistics of each class come from one grouped sum over all
labelled rows; from them a class has a mean and a covariance, shrunk towards the pooled one
and towards a multiple of the identity (Friedman 1989).  The Cholesky factors are made once; a score
is the logistic of the two Mahalanobis log densities' difference and the log ratio of the class sizes.

Nulls: a null text is an empty one, with statistics of its own; labels that are null or neither 0 nor 1, and labels of unknown
documents, teach nothing.  Repeated labels count as often as they are there.  With one class only, or none,
every score is that class's (smoothed) share.  Rows without id are scored.  An empty table gives an empty one.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage
from tagweave.llm.common import by_batch, vectors_of

STATISTICS = (
    "words", "word_length", "upper", "digits", "marks", "symbols", "other_bytes", "distinct_words", "distinct_pairs",
    "distinct_lines", "longest_word",
)


def _byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 white space, 4 sentence marks, 5 other ASCII, 6 beyond ASCII."""
    kind = np.full(256, 5, np.int64)
    kind[128:] = 6
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\v\f", 3), (b".,;:'\"-()?", 4)):
        kind[list(chars)] = k
    return kind


def statistics(text: bytes, kinds: np.ndarray) -> list[float]:
    """The statistics of one document; finite for every text."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    lower, upper, digits, _, marks, symbols, other = np.bincount(kinds, by_byte, minlength=7).tolist()
    words, lines = text.split(), text.split(b"\n")
    letters, n = lower + upper + other, len(words)
    ratio = lambda a, b: float(np.log((a + 1) / (b + 10)))
    part = lambda a, b: float(np.log((a + 5) / (b + 5)))
    return [
        float(np.log(n + 1)),
        float(np.log((len(text) + 5) / (n + 1))),
        ratio(upper, letters),
        ratio(digits, letters),
        ratio(marks, letters),
        ratio(symbols, letters),
        ratio(other, letters),
        part(len(set(words)), n),
        part(len(set(zip(words, words[1:]))), max(n - 1, 0)),
        part(len(set(lines)), len(lines)),
        float(np.log(max(map(len, words), default=0) + 5)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """``(doc_id, x)`` of every row, and ``mark``, a whole number, if one is asked for; one pass, no shuffle."""
    more = [] if mark is None else ["mark"]
    out = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))] + [(m, pa.int64()) for m in more])

    def make():
        kinds = _byte_classes()

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            return {"doc_id": batch.column("doc_id"), "x": [statistics(t or b"", kinds) for t in texts]} | {m: batch.column(m) for m in more}

        return step

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[mark.cast("long").alias(m) for m in more])
    return asked.mapInArrow(by_batch(make, out), "doc_id long, x array<double>" + ", mark long" * len(more))


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the documents, by the checksum of the id, that never teaches."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors of both classes, and the log densities' constants."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        bad, good = (
            self.constants[k] - 0.5 * np.square((x - self.means[k]) @ self.factors[k].T).sum(1) for k in (0, 1)
        )
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit(featured: DataFrame, labels: DataFrame, shrink: float = 0.2, ridge: float = 0.01) -> Model:
    """``shrink`` of each covariance is the pooled one, and then ``ridge`` of it its mean variance.

    All labelled rows count; what reaches the driver is a matrix of the statistics for each class.
    """
    d = len(STATISTICS)
    known = labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    taught = featured.join(known, "doc_id").select("label", "x")
    out = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            label, x = batch.column("label").to_numpy(), vectors_of(batch.column("x")).reshape(-1, d)
            parts = {"label": [], "at": [], "value": []}
            for k in np.unique(label):
                own = np.column_stack([np.ones((label == k).sum()), x[label == k]])
                parts["label"].append(np.full((d + 1) ** 2, k, np.int32))
                parts["at"].append(np.arange((d + 1) ** 2, dtype=np.int32))
                parts["value"].append((own.T @ own).ravel())
            return {k: np.concatenate(v) if v else [] for k, v in parts.items()}

        return step

    sums = np.zeros((2, (d + 1) ** 2))
    summed = taught.mapInArrow(by_batch(make, out), "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    for row in summed.collect():  # two matrices, whatever the input
        sums[row["label"], row["at"]] = row["value"]
    moments = sums.reshape(2, d + 1, d + 1)
    n = moments[:, 0, 0]
    if min(n) < 2:
        return Model(float((n[1] + 1) / (n.sum() + 2)))
    means = moments[:, 0, 1:] / n[:, None]
    scatter = np.array([moments[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(0) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        mixed = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / d, 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Model(float(n[1] / n.sum()), means, np.array(factors), np.array(constants))


def score(featured: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, and ``mark`` where ``featured`` has one."""
    more = [c for c in featured.columns if c == "mark"]
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())] + [(m, pa.int64()) for m in more])
    d = len(STATISTICS)

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": model.score(vectors_of(batch.column("x")).reshape(-1, d))} | {m: batch.column(m) for m in more}

    return featured.mapInArrow(by_batch(make, out), "doc_id long, score double" + ", mark long" * len(more))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; ``labels(doc_id, label)`` of held-out documents are not used."""
    featured = cut_lineage(features(docs, id_col, text))
    model = fit(featured, labels.filter(~held_out()), **options)
    return score(featured, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def rejected(docs: DataFrame, labels: DataFrame, mark: Column, least: float = 0.5, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The different ``(doc_id, mark)`` of the rows that score under ``least``; ``mark`` is a checksum of the text.

    A score depends on the text alone, so equal rows are rejected together, and other texts under the same or no id are not.
    """
    featured = cut_lineage(features(docs, id_col, text, mark))
    model = fit(featured, labels.filter(~held_out()), **options)
    return score(featured, model).filter(F.col("score") < least).select("doc_id", "mark").distinct()
