"""Ingest of exchange records as a stream: files of JSON lines in, a trace store out.

A record is (trace_id, captured_at, provider, request, response).  Replays of a trace within the watermark are dropped by the stream; later
ones find the trace in the store.  Each micro-batch is turned into traces and events like a batch and becomes one segment of
the store.  Turns and totals are derived when read, by trace and order, so that late records need no state here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators import ingest, store
from ledgerline.sources.runs import exchange_events

SCHEMA = "trace_id string, captured_at timestamp, provider string, request string, response string"


def read(spark: SparkSession, path: str, delay: str = "1 hour", max_files: int = 1000) -> DataFrame:
    """The records under path, each trace once."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return rows.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["trace_id"])


def write(records: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame, int], None] | None = None) -> StreamingQuery:
    """Adds the records' traces and events to the store, a segment for each batch; a batch that is run again replaces its own.

    on_batch gets the batch's traces, its events and its number.
    """

    def append(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        traces, events = ingest.assemble_traces(batch), exchange_events(batch)
        store.add_new(traces, events, path, f"batch-{number}")
        if on_batch:
            on_batch(traces, events, number)

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(records: DataFrame, width: str = "1 hour") -> DataFrame:
    """Exchanges and reported tokens by window of capture and provider; late records count until the watermark passes."""
    told = F.from_json("response", "usage struct<total_tokens:bigint>")["usage"]["total_tokens"]
    return records.groupBy(F.window("captured_at", width), "provider").agg(F.count("*").alias("exchanges"), F.sum(told).alias("tokens"))
