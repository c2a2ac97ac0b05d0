"""Arrivals as a stream: micro-batches appended to the store's logs, in order of arrival."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Store


def ingest_payloads(arrivals: DataFrame, store: Store, checkpoint: str, source: str) -> StreamingQuery:
    """Streams (kind, key, as_of, payload, fetched_at as text) into a store with a path.

    Every batch is one append under the query's id, which its checkpoint keeps, and the batch's number, so
    one that is run again after a failure is not appended twice, and no other writer is touched.
    Arrival order is the batch, then the row in it; a batch follows what the store held when it came.
    """
    if store.path is None:
        raise ValueError("a store in memory takes no stream")

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        store.append_payloads(batch, source, under=f"stream-{query}-{number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
