"""Column names, missing values, label filters and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed_values import COLUMN_ALIASES, MISSING, OOD_LABEL, RECORD_DEFAULTS


def normalise_columns(df: DataFrame, aliases: Mapping[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Rename known variants; a name that is already taken is left alone."""
    renames: dict[str, str] = {}
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns and new not in renames.values():
            renames[old] = new
    return df.withColumnsRenamed(renames)


def fill_null_strings(df: DataFrame, value: str = MISSING) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=names) if names else df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_defaults(
    df: DataFrame, defaults: Mapping[str, str] = RECORD_DEFAULTS, amount: str = "tran_amt_in_ac"
) -> DataFrame:
    """Add absent columns with their default and read the amount as a number."""
    require_columns(df, [amount])
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns({**absent, amount: F.col(amount).cast("double")})


def in_distribution(df: DataFrame, label: str = "category", ood: str | int = OOD_LABEL) -> DataFrame:
    """Rows with a label other than the OOD label; unlabelled rows are dropped."""
    return df.filter(F.col(label) != F.lit(ood))


def unlabelled(df: DataFrame, label: str = "category") -> DataFrame:
    """One row ``n``: how many rows ``in_distribution`` drops for want of a label."""
    return df.agg(F.count_if(F.col(label).isNull()).alias("n"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows are left after the filter")
    return df


def unknown_categories(golden: DataFrame, labels: DataFrame, label: str = "category") -> DataFrame:
    """Golden categories the label table does not know."""
    return golden.select(label).distinct().join(labels.select(label), label, "left_anti")


def missing_categories(golden: DataFrame, labels: DataFrame, label: str = "category") -> DataFrame:
    """Known categories without a golden row."""
    return labels.select(label).distinct().join(golden.select(label).distinct(), label, "left_anti")


def require_known_categories(golden: DataFrame, labels: DataFrame, label: str = "category") -> DataFrame:
    """Raise on golden categories outside the label table (shows the first 20)."""
    unknown = [r[0] for r in unknown_categories(golden, labels, label).orderBy(label).limit(20).collect()]
    if unknown:
        raise ValueError(f"golden records have unknown categories: {unknown}")
    return golden
