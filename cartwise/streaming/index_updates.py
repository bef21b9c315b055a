"""A stream of product changes kept in a search index of segments.

A micro-batch writes a segment and publishes a version that says which batch it holds, so a batch that runs
again after a failure changes nothing, and a search sees all of a batch or nothing of it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from cartwise.operators.segments import IndexStore
from cartwise.operators.upsert import latest
from cartwise.sources.versions import FAN


def index_stream(changes: DataFrame, store: IndexStore, checkpoint: str, version: str = "version", fan: int = FAN):
    """Start applying ``changes``, as for ``IndexStore.apply``, of which the newest by ``version`` counts per product and batch.

    The checkpoint belongs to the index: batches of another one would count as known.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        own = replace(store, spark=batch.sparkSession)
        own.apply(latest(batch, "product_id", version).drop(version), batch_id)
        own.fold(fan)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
