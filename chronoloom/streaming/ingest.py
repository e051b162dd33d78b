"""Incremental ingestion of episodes (an extension: the batch operators, one micro-batch at a time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import EPISODES
from ..sources.store import GraphStore

Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def ingest_stream(store: GraphStore, folder: str, checkpoint: str, extract: Extract | None = None) -> StreamingQuery:
    """Read JSON episodes as they arrive and append what is new. A batch that runs again appends nothing twice."""
    stream = store.spark.readStream.schema(EPISODES).json(folder)

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.where(F.col("id").isNotNull()).dropDuplicates(["id"])
        if extract:
            entities, edges = extract(rows)
            store.append_new("entities", entities, ["id"], ["created_at"])
            store.append_new("edges", edges, ["id"], ["recorded_at"])
        store.append_new("episodes", rows, ["id"], ["recorded_at"])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
