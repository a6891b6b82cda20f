"""Traces as runs: what such a projection needs, and what it keeps.

Traces have trace_id, provider, model, agent, task and metadata (JSON text), those that are there; their events are as in
traces.py, with `timestamp` where it is to be checked.  Reports are rows (trace_id, section, turn, item, path, stage, outcome, reason) in the order of
section, turn and item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import losses
from ledgerline.functions.vocabulary import EVENT_TYPES, PHASES, SOURCE_TYPES
from ledgerline.operators import traces as of_traces
from ledgerline.operators.evidence import loss_mappings, project_kinds, project_traces

STAGE = "legacy_trace_to_agent_run"


def entry_issues(events: DataFrame) -> DataFrame:
    """trace_id, path, code, message: events (event_id, trace_id, event_ordinal, timestamp, type, content_phase, source_type) that can't become a block, by their first failing field."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    outside = lambda c, names: ~c.isin(*names)
    checks = {
        "id": blank(F.col("event_id")), "traceId": blank(F.col("trace_id")), "timestamp": blank(F.col("timestamp").cast("string")), "type": F.coalesce(outside(F.col("type"), EVENT_TYPES), F.lit(True)),
        "contentPhase": outside(F.col("content_phase"), PHASES), "sourceType": outside(F.col("source_type"), SOURCE_TYPES),
    }
    first = F.coalesce(*(F.when(bad, losses.ENTRY_MESSAGES[name]) for name, bad in checks.items()))
    at = F.row_number().over(Window.partitionBy("trace_id").orderBy("event_ordinal")) - 1
    rows = events.select("trace_id", F.concat(F.lit("events["), at.cast("string"), F.lit("]")).alias("path"), F.lit("invalid_legacy_event").alias("code"), first.alias("message"))
    return rows.where("message is not null")


def trace_issues(traces: DataFrame) -> DataFrame:
    """trace_id, path, code, message of traces that can't become a run at all; events_valid (if there): whether the events are a list."""
    bad = F.coalesce(F.col("trace_id").cast("string"), F.lit("")) == ""
    listed = F.coalesce("events_valid", F.lit(False)) if "events_valid" in traces.columns else F.lit(True)
    issue = lambda path, code: F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(losses.TRACE_MESSAGES[path]).alias("message"))
    return traces.select("trace_id", F.when(bad, issue("id", "invalid_legacy_trace")).when(~listed, issue("events", "invalid_event_collection")).alias("x")).where("x is not null").select("trace_id", "x.*")


def valid(traces: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The traces, and their events, without any issue."""
    bad = trace_issues(traces).select("trace_id").unionByName(entry_issues(events).select("trace_id")).distinct()
    good = traces.where(F.coalesce(F.col("trace_id").cast("string"), F.lit("")) != "").join(bad, "trace_id", "left_anti")
    return good, events.join(good.select("trace_id"), "trace_id", "left_semi")


def run_name(trace_id: Column, agent: Column, task: Column) -> Column:
    return F.coalesce(agent, task, F.concat(F.lit("trace-"), trace_id))


def to_runs(traces: DataFrame) -> DataFrame:
    """run_id, name, model, provider, agent, task."""
    field = lambda c: (F.col(c) if c in traces.columns else F.lit(None)).cast("string")
    return traces.select(F.col("trace_id").alias("run_id"), run_name(F.col("trace_id"), field("agent"), field("task")).alias("name"), *(field(c).alias(c) for c in losses.RUN_FIELDS))


def _rows(df: DataFrame, section: int, turn: Column, item: Column, path: Column, outcome: Column, reason: Column) -> DataFrame:
    return df.select("trace_id", F.lit(section).alias("section"), turn.cast("long").alias("turn"), item.cast("long").alias("item"), path.alias("path"), F.lit(STAGE).alias("stage"), outcome.alias("outcome"), reason.alias("reason"))


def run_mappings(traces: DataFrame, events: DataFrame) -> DataFrame:
    """What of each trace a run keeps: section 0 its fields, 1 the ids that are made up for turns and blocks, 2 contents and metadata."""
    field = lambda c: (F.col(c) if c in traces.columns else F.lit(None)).cast("string")
    fixed = [(path, F.lit("exact"), F.lit(why)) for path, why in losses.RUN_EXACT]
    for c in losses.RUN_FIELDS:
        there = field(c).isNotNull()
        fixed.append((c, F.when(there, "exact").otherwise("unavailable"), F.when(there, f"{c} is preserved from the legacy trace").otherwise(f"legacy trace carries no {c}")))
    fixed.append(("turns", F.lit("exact"), F.lit(losses.RUN_TURNS)))
    nought = F.lit(0)
    each = traces.select("trace_id", F.posexplode(F.array(*(F.struct(F.lit(p).alias("path"), o.alias("outcome"), why.alias("reason")) for p, o, why in fixed))).alias("item", "x"))
    out = [_rows(each, 0, nought, F.col("item"), F.col("x.path"), F.col("x.outcome"), F.col("x.reason"))]

    turns = of_traces.with_turns(events).select("trace_id", "turn").distinct()
    at = F.concat(F.lit("turns["), (F.col("turn") - 1).cast("string"), F.lit("]"))
    out.append(_rows(turns, 1, F.col("turn") - 1, F.lit(-1), F.concat(at, F.lit(".id")), F.lit("inferred"), F.lit(losses.RUN_IDS["turn"])))
    blocks = of_traces.to_blocks(events).select(F.col("run_id").alias("trace_id"), F.col("turn_number").alias("turn"), "ordinal", "content")
    n = F.row_number().over(Window.partitionBy("trace_id", "turn").orderBy("ordinal")) - 1
    numbered = blocks.withColumn("n", n)
    path = F.concat(at, F.lit(".contextBlocks["), F.col("n").cast("string"), F.lit("].id"))
    out.append(_rows(numbered, 1, F.col("turn") - 1, F.col("n"), path, F.lit("inferred"), F.lit(losses.RUN_IDS["block"])))

    said = blocks.where("content <> ''").select("trace_id").distinct().withColumn("said", F.lit(True))
    last = traces.select("trace_id", field("metadata").alias("metadata")).join(said, "trace_id", "left")
    has = F.coalesce("said", F.lit(False))
    kept = F.coalesce(F.size(F.json_object_keys("metadata")) > 0, F.lit(False))
    for i, (path, there, (yes, no)) in enumerate((("turns[].contextBlocks[].content", has, losses.RUN_CONTENT), ("metadata.traceMetadata", kept, losses.RUN_METADATA))):
        out.append(_rows(last, 2, nought, F.lit(i), F.lit(path), F.when(there, "partial").otherwise("unavailable"), F.when(there, yes).otherwise(no)))
    return reduce(DataFrame.unionByName, out)


def as_trace_events(events: DataFrame) -> DataFrame:
    """Canonical events whose kind has a type, as the events of an older trace: in order, without contents."""
    text, count = F.lit(None).cast("string"), F.lit(None).cast("long")
    return project_kinds(events).where("event_type is not null").select(
        "trace_id", F.col("seq").alias("event_ordinal"), "event_id", F.col("captured_at").alias("timestamp"), F.col("event_type").alias("type"), "content_phase", text.alias("source_type"), text.alias("actor_role"),
        *(count.alias(c) for c in ("tokens", "prompt_tokens", "completion_tokens", "total_tokens")), text.alias("routing_decision"), text.alias("excerpt"),
    )


def evidence_mappings(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """Both reports of evidence that becomes a run, one after the other: trace_id, part (0: to a trace, 1: to a run), section, place, item, path, stage, outcome, reason."""
    first = loss_mappings(statuses, events).select("trace_id", F.lit(0).alias("part"), "section", F.col("event").alias("place"), F.col("item").cast("long").alias("item"), "path", "stage", "outcome", "reason")
    second = run_mappings(project_traces(statuses, events), as_trace_events(events))
    return first.unionByName(second.select("trace_id", F.lit(1).alias("part"), "section", F.col("turn").alias("place"), "item", "path", "stage", "outcome", "reason"))
