"""Fit vocabularies, scaler and labels; turn records into unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed_values import KNOWN_VALUES, MISSING, TEXT_PROMPT, UNKNOWN_TOKEN
from tagweave.functions.order import with_rows_before
from tagweave.functions.session import arrow_once, bounded, cut_lineage, literal_rows
from tagweave.functions.text import tokens
from tagweave.spec import RoleSpec

#: Rows an encoder holds as matrices at once, whatever the size of an Arrow batch.
STEP_ROWS = 1_024

# --- Fit -------------------------------------------------------------------------


def fit_vocab(
    df: DataFrame, columns: Sequence[str], known: Mapping[str, Sequence[str]] = KNOWN_VALUES
) -> DataFrame:
    """``(col, value, id)``: ``<UNK>`` is 0, then known values in order, then new ones by value."""
    seeds = {c: list(dict.fromkeys([UNKNOWN_TOKEN, *known.get(c, [])])) for c in columns}
    listed = [(c, v, i) for c, values in seeds.items() for i, v in enumerate(values)]
    seeded_rows = literal_rows(df.sparkSession, listed, "col string, value string, id int")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns]
    )
    fresh = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .distinct()
        .join(F.broadcast(seeded_rows.select("col", "value")), ["col", "value"], "left_anti")  # fixed lists
    )
    counted = fresh.select(F.struct("col", "value").alias("value"), F.lit(1).cast("bigint").alias("n"))
    ranked = with_rows_before(counted).select("value.col", "value.value", "before")
    firsts = ranked.groupBy("col").agg(F.min("before").alias("first"))
    used = F.create_map(*[F.lit(x) for c in columns for x in (c, len(seeds[c]))])
    numbered = ranked.join(F.broadcast(firsts), "col").select(  # a row for each named column
        "col", "value", (F.col("before") - F.col("first") + used[F.col("col")]).cast("int").alias("id")
    )
    return seeded_rows.unionByName(numbered)


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("col").agg(F.count(F.lit(1)).alias("size"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, mean, std)`` with the population deviation; a constant column gets 1."""
    sums = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("col"),
            F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("std"),
        )
        for c in columns
    ]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def fit_labels(df: DataFrame, label: str) -> DataFrame:
    """``(label_id, category)``: distinct labels numbered from 0 in sorted order."""
    return number_labels(df.filter(F.col(label).isNotNull()).select(F.col(label).alias("category")).distinct())


def number_labels(distinct: DataFrame, stored: bool = False) -> DataFrame:
    ranked = with_rows_before(
        distinct.select(F.col("category").alias("value"), F.lit(1).cast("bigint").alias("n")), stored=stored
    )
    return ranked.select(F.col("before").cast("int").alias("label_id"), F.col("value").alias("category"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _with_share(df: DataFrame, label: str) -> DataFrame:
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total)


def class_weights(df: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """``(label, weight)``: ``(N / n_c) ** power``."""
    return _with_share(df, label).select(label, F.pow(F.col("total") / F.col("n"), F.lit(power)).alias("weight"))


def class_temperatures(df: DataFrame, label: str, base: float = 0.07, power: float = 0.3) -> DataFrame:
    """``(label, temperature)``: ``base * (n_c / N) ** power``."""
    share = F.col("n") / F.col("total")
    return _with_share(df, label).select(label, (F.lit(base) * F.pow(share, F.lit(power))).alias("temperature"))


def minority_classes(counts: DataFrame, at_most: int = 500) -> DataFrame:
    return counts.filter(F.col("n") <= at_most)


# --- Project -----------------------------------------------------------------------


def encode_categoricals(
    df: DataFrame, vocab: DataFrame, columns: Sequence[str], stored: bool = False
) -> DataFrame:
    """Add ``<col>_id``; a value the vocabulary has not seen is 0, a missing one is ``NULL``.

    ``stored`` says that ``vocab`` has been through ``bounded`` already.
    """
    known = vocab if stored else bounded(vocab)
    for c in columns:
        ids = known.filter(F.col("col") == c).select(F.col("value").alias("_value"), F.col("id").alias("_id"))
        key = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        df = (
            df.withColumn("_value", key)
            .join(ids, "_value", "left")
            .withColumn(f"{c}_id", F.coalesce("_id", F.lit(0)))
            .drop("_value", "_id")
        )
    return df


def scale_numeric(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<col>_scaled``; a missing number counts as 0.0 before scaling."""
    fitted = {r["col"]: r for r in scaler.filter(F.col("col").isin(list(columns))).collect()}  # a row per column
    scaled = {}
    for c in columns:
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        scaled[f"{c}_scaled"] = (value - F.lit(fitted[c]["mean"])) / F.lit(fitted[c]["std"])
    return df.withColumns(scaled)


def prompt_text(text: Column, prompt: str = TEXT_PROMPT) -> Column:
    return F.concat(F.lit(prompt), F.coalesce(text, F.lit("")))


def tokenise(df: DataFrame, text: str, max_tokens: int | None = None) -> DataFrame:
    """Add ``tokens``; the whole text unless ``max_tokens`` is given."""
    return df.withColumn("tokens", tokens(F.col(text), max_tokens))


def _present(words: Column) -> Column:
    return F.coalesce(words, F.array().cast("array<string>"))


class WordBuckets:
    """``token_buckets`` of a batch of word lists: each different word is hashed once, and a worker keeps a bounded number of words."""

    def __init__(self, dim: int, most: int = 200_000):
        self.dim, self.most, self.seen = dim, most, {}

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each row, and the buckets of all words."""
        coded = words.flatten().cast(pa.binary()).dictionary_encode()
        if len(self.seen) > self.most:
            self.seen.clear()
        buckets = np.array([self._of(w) for w in coded.dictionary.to_pylist()], np.int64)
        return np.diff(words.offsets.to_numpy()), buckets[coded.indices.to_numpy()]

    def _of(self, word: bytes) -> int:
        bucket = self.seen.get(word)
        if bucket is None:
            bucket = self.seen[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.dim
        return bucket


def _in_steps(fn: Callable[..., np.ndarray], *columns: pa.Array) -> pa.Array:
    """``fn`` over a batch, a bounded number of rows at once, as one list column."""
    rows = len(columns[0])
    return _as_lists(np.vstack([fn(*[c.slice(at, STEP_ROWS) for c in columns]) for at in range(0, max(rows, 1), STEP_ROWS)]))


def pool_tokens(words: Column, dim: int) -> Column:
    """Mean of the tokens' hashed unit vectors: ``array<double>`` of length ``dim``."""

    buckets = WordBuckets(dim)

    @arrow_once(T.ArrayType(T.DoubleType()))
    def pooled(words: pa.Array) -> pa.Array:
        return _in_steps(lambda part: _mean_of(*buckets(part), dim), words)

    return pooled(_present(words))


def _mean_of(sizes: np.ndarray, buckets: np.ndarray, dim: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(rows * dim + buckets, minlength=len(sizes) * dim).reshape(len(sizes), dim)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)


def _as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; squares are added up in position order as SQL does."""
    total = np.zeros(len(matrix))
    for d in range(matrix.shape[1]):
        total += matrix[:, d] * matrix[:, d]
    return matrix / (np.sqrt(total) + 1e-9)[:, None]


@dataclass(frozen=True)
class EncoderSpec:
    """Widths and weights of the default encoder's three parts."""

    text_dim: int = 256
    category_dim: int = 16  # at least this many places for each categorical column, more if the vocabulary has more
    category_weight: float = 0.25
    numeric_weight: float = 0.1
    prompt: str = ""
    max_tokens: int | None = None


def text_vector(df: DataFrame, text: str, spec: EncoderSpec = EncoderSpec(), out: str = "text_vector") -> DataFrame:
    """Unit vector of the text alone."""
    dim = spec.text_dim
    buckets = WordBuckets(dim)

    @arrow_once(T.ArrayType(T.FloatType()))
    def vector(words: pa.Array) -> pa.Array:
        return _in_steps(lambda part: _unit(_mean_of(*buckets(part), dim)).astype(np.float32), words)

    words = tokens(prompt_text(F.col(text), spec.prompt), spec.max_tokens)
    return df.withColumn(out, vector(_present(words)))


def fuse(words: Column, ids: Column, numbers: Column, spec: EncoderSpec = EncoderSpec()) -> Column:
    """Unit vector of text, one-hot ``ids array<int>`` and ``numbers array<double>``."""
    dim, width = spec.text_dim, spec.category_dim
    weight, scale = spec.category_weight, spec.numeric_weight
    buckets = WordBuckets(dim)

    def fused(words: pa.Array, codes: pa.Array, values: pa.Array) -> np.ndarray:
        rows = len(words)
        parts = [_unit(_mean_of(*buckets(words), dim))]
        slots = codes.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        for c in range(slots.shape[1]):
            hot = np.zeros((rows, width))
            hot[np.arange(rows), slots[:, c] % width] = weight
            parts.append(hot)
        parts.append(values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) * scale)
        return _unit(np.hstack(parts)).astype(np.float32)

    @arrow_once(T.ArrayType(T.FloatType()))
    def vector(words: pa.Array, codes: pa.Array, values: pa.Array) -> pa.Array:
        return _in_steps(fused, words, codes, values)

    return vector(_present(words), ids, numbers)


def category_width(vocab: DataFrame, spec: EncoderSpec) -> int:
    """Places of the one-hot parts: no two ids of a fitted vocabulary share one."""
    largest = vocab.agg(F.max("id")).first()[0]
    return max(spec.category_dim, (largest or 0) + 1)


def encode(
    df: DataFrame,
    roles: RoleSpec,
    vocab: DataFrame,
    scaler: DataFrame,
    spec: EncoderSpec = EncoderSpec(),
    stored: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """Add ``embedding``: text, categorical and numeric parts side by side, unit length.

    A projection: the only join is against the vocabulary.  ``where`` chooses records before they are encoded, down in
    the scan; a filter on the result cannot move below the encoder, which runs once per row.
    """
    df = df if where is None else df.filter(where)
    spec = replace(spec, category_dim=category_width(vocab, spec))
    coded = scale_numeric(encode_categoricals(df, vocab, roles.categorical, stored), scaler, roles.numeric)
    ids, numbers = [f"{c}_id" for c in roles.categorical], [f"{c}_scaled" for c in roles.numeric]
    words = tokens(prompt_text(F.col(roles.text), spec.prompt), spec.max_tokens)
    fused = fuse(words, F.array(*ids).cast("array<int>"), F.array(*numbers).cast("array<double>"), spec)
    return coded.withColumn("embedding", fused).drop(*ids, *numbers)


def encode_with(
    df: DataFrame, make_model: Callable[[], Callable], inputs: Sequence[Column], batch_size: int = 512
) -> DataFrame:
    """Add ``embedding`` from a user's model, loaded once per Python worker.

    ``make_model()`` returns a function from NumPy input batches to a float matrix.
    """
    model = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", model(*inputs))


def with_metadata(df: DataFrame, roles: RoleSpec) -> DataFrame:
    """Add ``metadata``: the record's description, amount, label and categorical columns."""
    names = [roles.text, *roles.numeric, *roles.categorical]
    kept = [F.col(c) for c in dict.fromkeys(names) if c in df.columns]
    label = [F.col(roles.label).alias("label")] if roles.label in df.columns else []
    return df.withColumn("metadata", F.struct(*kept, *label))


# --- Fitted state --------------------------------------------------------------------


@dataclass
class Artifacts:
    """Everything fitted on the training rows: small tables, computed once."""

    roles: RoleSpec
    vocab: DataFrame
    scaler: DataFrame
    labels: DataFrame
    counts: DataFrame
    encoder: EncoderSpec = EncoderSpec()

    def stored(self) -> Artifacts:
        return Artifacts(
            self.roles, bounded(self.vocab), cut_lineage(self.scaler), bounded(self.labels), self.counts, self.encoder
        )


def fit(
    df: DataFrame,
    roles: RoleSpec,
    known: Mapping[str, Sequence[str]] = KNOWN_VALUES,
    encoder: EncoderSpec = EncoderSpec(),
) -> Artifacts:
    """``encoder`` is kept with the state, so that what is loaded later encodes alike."""
    counts = cut_lineage(class_counts(df, roles.label).withColumnRenamed(roles.label, "category"))
    return Artifacts(
        roles,
        fit_vocab(df, roles.categorical, known),
        fit_scaler(df, roles.numeric),
        number_labels(counts, stored=True),
        counts,
        encoder,
    ).stored()


def transform(df: DataFrame, artifacts: Artifacts, spec: EncoderSpec | None = None) -> DataFrame:
    """Encode any rows, training or new, with the fitted state; add ``label_id`` if labelled."""
    roles = artifacts.roles
    coded = encode(df, roles, artifacts.vocab, artifacts.scaler, spec or artifacts.encoder, stored=True)
    if roles.label not in df.columns:
        return coded
    return coded.join(artifacts.labels.withColumnRenamed("category", roles.label), roles.label, "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
