"""Incremental work as streams: micro-batches into a keyed table, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KeyedTable, latest


def upsert_stream(rows: DataFrame, table: KeyedTable, order: str, checkpoint: str):
    """A query that puts every micro-batch into the table, the last row of a key counting; run again, a batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(latest(batch, [table.key], [F.desc(order)]))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n, total): tumbling windows with a watermark; the same plan for a stream and a table."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size)
    return events.groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
