"""Tag a stream of records against a fixed corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagweave.plans.tagging import Corpus, predict
from tagweave.sources.sinks import write_routed


def score_stream(
    records: DataFrame,
    corpus: Corpus | Callable[[], Corpus],
    auto_path: str,
    review_path: str,
    checkpoint: str,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Score each micro-batch and write its two routes.

    ``corpus`` may be a function, such as ``latest_corpus``: it is asked before each batch, and a batch sees one whole version.  ``encoder`` adds ``embedding`` to a batch.  A batch has its own folder and overwrites
    it when it is tried again after a failure, so no row is written twice.
    """
    current = (lambda: corpus) if isinstance(corpus, Corpus) else corpus
    current().packed(), current().packed_prototypes()  # broadcast once, before the first batch

    def write(batch: DataFrame, number: int) -> None:
        scored = predict(encoder(batch) if encoder else batch, current(), **options)
        write_routed(scored, f"{auto_path}/batch={number}", f"{review_path}/batch={number}", "overwrite")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
