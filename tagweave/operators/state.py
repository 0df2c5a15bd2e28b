"""Fitted state that later batches are added to, without reading old rows again.

``fit_state`` keeps what the fitted tables are made of: values, counts, means and sums of squares, and class means of
vectors.  Two states merge into the state of all their rows.  Ids never change: known values and categories keep theirs, new ones
come after them in order of value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.fixed_values import KNOWN_VALUES
from tagweave.functions.order import with_rows_before
from tagweave.functions.session import cut_lineage
from tagweave.functions.vectors import as_double, l2_normalise
from tagweave.operators.features import Artifacts, EncoderSpec, class_counts, fit_vocab, number_labels
from tagweave.spec import RoleSpec


@dataclass(frozen=True)
class FitState:
    """``vocab (col, value, id)``, ``moments (col, n, mean, m2)``, ``counts (category, n)`` and ``labels (label_id, category)``."""

    roles: RoleSpec
    vocab: DataFrame
    moments: DataFrame
    counts: DataFrame
    labels: DataFrame

    def stored(self) -> FitState:
        return replace(self, **{name: cut_lineage(getattr(self, name)) for name in TABLES})

    def artifacts(self, encoder: EncoderSpec = EncoderSpec()) -> Artifacts:
        """The fitted tables that encoding needs."""
        scaler = F.sqrt(F.col("m2") / F.col("n"))
        table = self.moments.select("col", "mean", F.when(scaler == 0, 1.0).otherwise(scaler).alias("std"))
        return Artifacts(self.roles, self.vocab, table, self.labels, self.counts, encoder)


TABLES = ("vocab", "moments", "counts", "labels")


def fit_state(df: DataFrame, roles: RoleSpec, known: Mapping[str, Sequence[str]] = KNOWN_VALUES) -> FitState:
    counts = cut_lineage(class_counts(df, roles.label).withColumnRenamed(roles.label, "category"))
    return FitState(roles, fit_vocab(df, roles.categorical, known), moments(df, roles.numeric), counts, number_labels(counts, stored=True)).stored()


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, n, mean, m2)``: count, mean and summed squared distance from it of the values that are not null."""
    parts = [F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in columns]
    values = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
    return values.groupBy("col").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """Of several tables of moments in one: distances are moved to the common mean, so nothing large is subtracted."""
    some = parts.filter("n > 0")
    mean = some.groupBy("col").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("common"))
    moved = some.join(F.broadcast(mean), "col").withColumn("away", F.col("mean") - F.col("common"))  # a row for each column
    return moved.groupBy("col").agg(F.sum("n").alias("n"), F.first("common").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("away") * F.col("away")).alias("m2"))


def _after(old: DataFrame, new: DataFrame, keys: list[str], id_col: str, within: list[str]) -> DataFrame:
    """``old`` and, after its largest id in each ``within``, the rows of ``new`` it does not have, in order."""
    fresh = new.select(*keys).join(old.select(*keys), keys, "left_anti").distinct()
    ranked = with_rows_before(fresh.select(F.struct(*keys).alias("value"), F.lit(1).cast("bigint").alias("n"))).select("value.*", "before")
    last = old.groupBy(*within).agg(F.max(id_col).alias("last"))
    first = ranked.groupBy(*within).agg(F.min("before").alias("first"))
    if within:
        ranked = ranked.join(F.broadcast(first), within).join(F.broadcast(last), within, "left")  # a row for each column
    else:
        ranked = ranked.crossJoin(first).crossJoin(last)  # one row each
    number = F.col("before") - F.col("first") + F.coalesce(F.col("last"), F.lit(-1)) + 1
    return old.select(*keys, id_col).unionByName(ranked.select(*keys, number.cast("int").alias(id_col)))


def merge_states(old: FitState, new: FitState) -> FitState:
    """The state of the rows of both; ids of ``old`` stay as they are."""
    if old.roles != new.roles:
        raise ValueError("states of other columns do not merge")
    counts = old.counts.unionByName(new.counts).groupBy("category").agg(F.sum("n").alias("n"))
    return FitState(
        old.roles,
        _after(old.vocab, new.vocab, ["col", "value"], "id", ["col"]),
        merged_moments(old.moments.unionByName(new.moments)),
        counts,
        _after(old.labels, new.labels, ["category"], "label_id", []),
    ).stored()


def save_state(state: FitState, folder: str) -> None:
    for name in TABLES:
        getattr(state, name).write.parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str, roles: RoleSpec) -> FitState:
    return FitState(roles, *[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


# --- Prototypes ------------------------------------------------------------------------


def class_sums(golden: DataFrame) -> DataFrame:
    """``(label_id, n, mean)``: how many vectors a class has, and their mean; one vector a task and class is shuffled."""
    vectors = golden.filter(F.col("embedding").isNotNull()).select("label_id", array_to_vector(as_double(F.col("embedding"))).alias("v"))
    means = vectors.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m"))
    return means.select("label_id", "n", vector_to_array("m").alias("mean"))


def merged_sums(parts: DataFrame) -> DataFrame:
    """Class sums of several batches as those of all their rows."""
    weighed = parts.select("label_id", "n", array_to_vector("mean").alias("v"), F.col("n").cast("double").alias("w"))
    means = weighed.groupBy("label_id").agg(F.sum("n").alias("n"), Summarizer.mean(F.col("v"), F.col("w")).alias("m"))
    return means.select("label_id", "n", vector_to_array("m").alias("mean"))


def prototypes_of(sums: DataFrame) -> DataFrame:
    """``(label_id, proto)``: unit class means."""
    return sums.select("label_id", l2_normalise(F.col("mean")).alias("proto"))
