"""Trace tables as Parquet: append-only saving, lookup, listing, deletion and purging.

A store is a folder of segments, `v<version>-<name>/{traces,trace_events}`.  A segment counts from when it has its marker `_COMPLETE`,
which is written last; readers take all complete segments of the highest version.  Saving adds a segment.  Deleting
and purging write what remains as one segment of the next version and then drop the older ones, so that readers see either all of the
old rows or all of the new, and a crash in between leaves the old.  There may be many readers, and one writer at a time.

What is saved is sanitised first: usage figures kept under sensitive keys, actors and events' order within one time stamp are not
part of it, as in the stored form this follows; the order of events is kept in event_ordinal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import ingest
from ledgerline.operators.metadata import rewrite

COLUMNS = ("trace_id", "event_id", "event_ordinal", "timestamp", "type", "content_phase", "source_type", "tokens", "provider", "model", "routing_decision", "transformation_summary", "excerpt", "payload_redacted")
MARKER = "_COMPLETE"


def sanitised_events(events: DataFrame) -> DataFrame:
    """The stored form: redacted texts, metadata without sensitive keys, no actor, 0 tokens as none."""
    rows = ingest.sanitise_texts(events)
    meta = rewrite(F.col("metadata"), "storage") if "metadata" in events.columns else F.lit(None).cast("string")
    return rows.select(*(c for c in COLUMNS if c != "tokens" and c in rows.columns), F.when(F.col("tokens") != 0, F.col("tokens")).alias("tokens"), meta.alias("metadata"))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _segments(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Complete segments by version."""
    fs, at = _files(spark, path)
    out: dict[int, list[str]] = {}
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if name.startswith("v") and fs.exists(_files(spark, f"{path}/{name}/{MARKER}")[1]):
            out.setdefault(int(name[1:].split("-")[0]), []).append(f"{path}/{name}")
    return out


def _current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    found = _segments(spark, path)
    version = max(found, default=0)
    return version, sorted(found.get(version, []))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_current(spark, path)[1])


def _write(traces: DataFrame, events: DataFrame, path: str, version: int, name: str) -> None:
    spark, segment = traces.sparkSession, f"{path}/v{version}-{name}"
    events.write.mode("overwrite").parquet(f"{segment}/trace_events")
    traces.write.mode("overwrite").parquet(f"{segment}/traces")
    fs, at = _files(spark, f"{segment}/{MARKER}")
    fs.create(at, True).close()


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    segments = _current(spark, path)[1]
    if not segments:
        raise FileNotFoundError(f"no store at {path}")
    return tuple(spark.read.option("mergeSchema", True).parquet(*(f"{s}/{t}" for s in segments)) for t in ("traces", "trace_events"))  # type: ignore[return-value]


def save(traces: DataFrame, events: DataFrame, path: str) -> None:
    """Adds traces and their events; raises if a trace is stored already (there is no update)."""
    spark = traces.sparkSession
    if exists(spark, path) and not traces.join(_tables(spark, path)[0].select("trace_id"), "trace_id", "left_semi").isEmpty():
        raise ValueError("a trace of this id is stored already")
    _write(traces, sanitised_events(events), path, _current(spark, path)[0], uuid.uuid4().hex)


def add_new(traces: DataFrame, events: DataFrame, path: str, name: str) -> None:
    """As save(), but traces that other segments have are left out, and a segment of this name is written anew: so a batch that comes again changes nothing."""
    spark = traces.sparkSession
    version, segments = _current(spark, path)
    others = [s for s in segments if not s.endswith(f"/v{version}-{name}")]
    if others:
        stored = spark.read.parquet(*(f"{s}/traces" for s in others)).select("trace_id")
        traces, events = (df.join(stored, "trace_id", "left_anti") for df in (traces, events))
    _write(traces, sanitised_events(events), path, version, name)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    traces, events = _tables(spark, path)
    return traces, ingest.cascade(events, traces)


def lookup(spark: SparkSession, path: str, trace_id: str) -> tuple[DataFrame, DataFrame]:
    """One trace and its events in order."""
    traces, events = (df.where(F.col("trace_id") == trace_id) for df in _tables(spark, path))
    return traces, events.orderBy("event_ordinal")


def reconstructed(traces: DataFrame) -> DataFrame:
    """Stored traces as they are handed out: empty texts are null, and a trace without a stored policy has the default one of its mode."""
    texts = {c: F.nullif(F.col(c), F.lit("")) for c in ("ended_at", "provider", "model", "agent", "task") if c in traces.columns and dict(traces.dtypes)[c] == "string"}
    stored: Column = F.col("capture_policy") if "capture_policy" in traces.columns else F.lit(None)
    mode = F.col("mode") if "mode" in traces.columns else F.lit("standard")
    return traces.withColumns(texts).withColumn("capture_policy", F.coalesce(stored.cast("string"), F.to_json(ingest.capture_policy(mode))))


def _rewrite(spark: SparkSession, path: str, traces: DataFrame, events: DataFrame) -> None:
    version, _ = _current(spark, path)
    _write(traces, ingest.cascade(events, traces), path, version + 1, "rewritten")
    for v, segments in _segments(spark, path).items():
        for s in segments if v <= version else ():
            fs, marker = _files(spark, f"{s}/{MARKER}")
            fs.delete(marker, False)
            fs.delete(_files(spark, s)[1], True)


def delete(spark: SparkSession, path: str, trace_id: str) -> bool:
    """Whether anything changed."""
    traces, events = _tables(spark, path)
    if traces.where(F.col("trace_id") == trace_id).isEmpty():
        return False
    _rewrite(spark, path, traces.where(F.col("trace_id") != trace_id), events)
    return True


def purge(spark: SparkSession, path: str, now: str) -> int:
    """How many traces have gone."""
    traces, events = _tables(spark, path)
    before, left = traces.count(), ingest.purge(traces, now)
    gone = before - left.count()
    if gone:
        _rewrite(spark, path, left, events)
    return gone
