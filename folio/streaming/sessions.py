"""Streams (an extension of the engine): sessions, windows of events, incremental reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.operators.index import Store, concept_hashes


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, session_start, session_end, events): runs of a key's events with gaps below `gap`.

    Batch or stream; a stream needs a delay after which late events are dropped."""
    rows = events.withWatermark(ts, delay) if delay else events
    grouped = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str | None = None, ts: str = "ts") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling or sliding windows."""
    rows = events.withWatermark(ts, delay) if delay else events
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def reconcile_stream(passages: DataFrame, store: Store, model_id: str, width: int, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of passages into the store. A batch brings whole concepts; others stay.

    Repeating a batch changes nothing, so a restart after a failure is safe."""

    def fold(batch: DataFrame, _: int) -> None:
        key = ["book", "namespace", "concept_id"]
        fresh = batch.join(concept_hashes(batch, key), key)
        units = store.units()
        if units is not None:
            fresh = units.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(units.columns))
        store.build(fresh, model_id, width)

    return passages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
