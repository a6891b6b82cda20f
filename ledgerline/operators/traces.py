"""Metrics and turns of recorded traces.

Events have trace_id, event_ordinal (their order), type, content_phase, source_type, actor_role, tokens, prompt_tokens,
completion_tokens, total_tokens (of inference metadata), routing_decision and excerpt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import redact
from ledgerline.functions.vocabulary import SOURCE_TYPES

INPUT, OUTPUT = ("said", "sent", "requested", "observed"), ("generated", "returned")
CONTENT_TYPES = ("message", "instruction", "context", "tool_call", "tool_result")


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """trace_id, the column, n and rank by falling n (first seen first); null values are left out."""
    counted = events.where(F.col(column).isNotNull()).groupBy("trace_id", column).agg(F.count("*").alias("n"), F.min("event_ordinal").alias("first"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("n"), "first"))
    return counted.select("trace_id", column, "n", rank.alias("rank"))


def usage_metrics(events: DataFrame) -> DataFrame:
    """trace_id, input_tokens, output_tokens, inference_tokens.

    What inference events report counts; without that, the tokens of other events by phase; null if there are none.
    """
    inference = F.col("type") == "inference"
    said = lambda phases: F.sum(F.when(~inference & F.col("content_phase").isin(*phases), F.col("tokens")))
    told = lambda c: F.sum(F.when(inference, F.col(c)))
    any_ = F.sum(inference.cast("long")) > 0
    return events.groupBy("trace_id").agg(
        F.coalesce(told("prompt_tokens"), said(INPUT)).alias("input_tokens"), F.coalesce(told("completion_tokens"), said(OUTPUT)).alias("output_tokens"),
        F.coalesce(told("total_tokens"), F.when(any_, F.coalesce(told("tokens"), F.lit(0)))).alias("inference_tokens"),
    )


def with_turns(events: DataFrame) -> DataFrame:
    """events with `turn`, from 1: an egress response ends one, the event after it begins the next."""
    before = Window.partitionBy("trace_id").orderBy("event_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.sum((F.col("type") == "egress_response").cast("long")).over(before)
    return events.withColumn("turn", 1 + F.coalesce(ended, F.lit(0)))


def turn_usage(events: DataFrame) -> DataFrame:
    """By turn: prompt, completion and total tokens told, and output tokens (told, else generated messages' if any)."""
    inference = F.col("type") == "inference"
    told = lambda c: F.sum(F.when(inference, F.col(c)))
    generated = F.sum(F.when((F.col("type") == "message") & (F.col("content_phase") == "generated"), F.col("tokens")))
    return with_turns(events).groupBy("trace_id", "turn").agg(
        F.count("*").alias("events"), told("prompt_tokens").alias("prompt_tokens"), told("completion_tokens").alias("completion_tokens"), told("total_tokens").alias("total_tokens"),
        F.coalesce(told("completion_tokens"), F.when(generated > 0, generated)).alias("output_tokens"),
    )


def run_output(turns: DataFrame) -> DataFrame:
    """trace_id, turns, output_tokens (null if nought)."""
    total = F.sum("output_tokens")
    return turns.groupBy("trace_id").agg(F.count("*").alias("turns"), F.when(total != 0, total).alias("output_tokens"))


def source_of(type_: Column, phase: Column, role: Column, own: Column) -> Column:
    """The source type of the block that an event becomes; null if it becomes none."""
    message = F.when(phase == "said", "user_message").when(phase == "generated", "assistant_message").when((phase == "sent") & (role == "model"), "assistant_message")
    return (
        F.when(type_ == "message", message)
        .when(type_ == "instruction", F.when(role == "system", "system_instruction").otherwise("project_instruction"))
        .when((type_ == "tool_call") & (phase == "requested"), "tool_call").when((type_ == "tool_result") & (phase == "observed"), "tool_output")
        .when((type_ == "context") & (phase == "sent"), F.when(own.isin(*SOURCE_TYPES), own).otherwise("unknown"))
        .when(type_.isin("provider_request", "provider_response", "egress_response"), "unknown")
    )


def to_blocks(events: DataFrame) -> DataFrame:
    """The blocks of a trace as a run, with ids numbered as they are made: a turn's id, then those of its blocks.

    Events without a source type drop, and so do those that carry content but have none.
    """
    source = source_of(F.col("type"), F.col("content_phase"), F.col("actor_role"), F.col("source_type"))
    content = F.coalesce("excerpt", F.lit(""))
    rows = with_turns(events).withColumns({"block_source": source, "content": content})
    kept = rows.withColumn("kept", F.col("block_source").isNotNull() & ~(F.col("type").isin(*CONTENT_TYPES) & (F.col("content") == "")))
    order = Window.partitionBy("trace_id").orderBy("event_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("kept").cast("long")).over(order), F.lit(0))
    kept = kept.withColumn("n", earlier + F.col("turn")).where("kept")
    return kept.select(
        F.col("trace_id").alias("run_id"), F.col("turn").alias("turn_number"), F.concat_ws("-", F.lit("pt"), "trace_id", F.col("n").cast("string")).alias("block_id"),
        F.col("block_source").alias("source_type"), "content", F.col("tokens").alias("captured_tokens"), F.col("event_ordinal").alias("ordinal"),
    )


def ordered(events: DataFrame, column: str) -> DataFrame:
    """trace_id, n and the column's redacted values, in order of events."""
    rows = events.where(F.coalesce(F.col(column), F.lit("")) != "").select("trace_id", "event_ordinal", redact(F.col(column)).alias("v"))
    grouped = rows.groupBy("trace_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_ordinal", "v"))).alias("m"))
    return grouped.select("trace_id", "n", F.col("m.v").alias(column))


def event(**given: Column) -> Column:
    """A trace event as a struct: what is given, an id and the time now where these are not.

    The id is random, so write the rows before they are used twice; an id that is given as null stays null.
    """
    made = {"event_id": F.uuid(), "timestamp": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")} | given
    return F.struct(*(c.alias(n) for n, c in made.items()))


def list_summary(events: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """A listing row for each trace: events, tokens in and out as text (— if unknown), error events, status; with traces also their
    status, provider and model (unknown by default)."""
    counts = events.groupBy("trace_id").agg(F.count("*").alias("events"), F.sum((F.col("type") == "provider_error").cast("long")).alias("errors"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    joined = counts.join(usage_metrics(events), "trace_id")
    if traces is None:
        return joined.select("trace_id", "events", "errors", text("input_tokens").alias("input"), text("output_tokens").alias("output"), F.when(F.col("errors") > 0, "error").otherwise("success").alias("status"))
    own = traces.select("trace_id", "status", *(F.coalesce(F.col(c) if c in traces.columns else F.lit(None), F.lit("unknown")).alias(c) for c in ("provider", "model"))).join(joined, "trace_id", "left").na.fill(0, ["events", "errors"])
    return own.select("trace_id", "status", "provider", "model", "events", "errors", text("input_tokens").alias("input"), text("output_tokens").alias("output"))
