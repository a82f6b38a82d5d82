"""Extraction and cleaning of pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import stages
from docloom.sources.versions import Versions


def extract_stream(source: DataFrame, root: str, checkpoint: str, hold_days: int | None = None) -> StreamingQuery:
    """Takes what has arrived in source (raw pages, as stages.extracted reads them) into the versions
    under root, a batch a version. What a batch has to know of earlier ones is in the manifest, not in a
    state store. A version is marked with its batch, so that one that is run again after a failure
    between its commit and the stream's is passed over: each page has one row."""

    def step(batch: DataFrame, number: int) -> None:
        store = Versions(batch.sparkSession, root)
        if store.current().marks.get("batch", -1) < number:
            stages.run_extraction(store, batch, {"batch": number}, hold_days)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
