"""Write results, and route them to the auto-tagged and the review sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.session import cut_lineage
from tagweave.operators.reports import export_rows


def write_results(scored: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    rows = export_rows(scored)
    if fmt == "csv":
        rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode(mode).format(fmt).save(path)


def route(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(auto-tagged, for review)``: every row is in exactly one of the two."""
    review = F.coalesce(F.col("needs_llm"), F.lit(True))
    return scored.filter(~review), scored.filter(review)


def write_routed(scored: DataFrame, auto_path: str, review_path: str, mode: str = "errorifexists") -> None:
    """Score once into the shared folder, and write both sides from there."""
    for part, path in zip(route(cut_lineage(scored)), (auto_path, review_path)):
        part.write.mode(mode).parquet(path)
