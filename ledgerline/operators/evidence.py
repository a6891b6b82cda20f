"""Validation and normalisation of raw evidence observations, for many traces at once.

Observations have trace_id, event_id, seq, observation_id, payload (canonical text) and, where named, span_id, kind,
captured_at, status, role, target and effect.  Issues are rows, never exceptions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import losses
from ledgerline.functions.text import choose
from ledgerline.functions.vocabulary import (
    ACTORS, CONTROL_KINDS, EVENT_KINDS, FIDELITIES, HASH, KIND_TO_EVENT, MEDIA_TYPE, PAYLOADS, ROLE_TO_PHASE, ROLES, SEMVER, STATUSES, SURFACES, TARGETS, TIMESTAMP,
)

REQUEST_KIND = r"_(request|call)$"
#: Codes of a rejected record, by the bucket that a projection reports.
ISSUE_BUCKETS = {"unsupported_evidence_schema_version": "unsupported_schema_version"} | dict.fromkeys(
    ("trace_disagrees_with_derivation", "analysis_disagrees_with_derivation", "completeness_disagrees_with_derivation"), "trace_derivation_conflict") | dict.fromkeys(
    ("terminal_declaration_not_final", "cancelled_invalid_effect", "cancelled_invalid_target", "error_invalid_effect", "error_invalid_target", "error_invalid_actor", "target_span_requires_span",
     "target_trace_requires_null_span"), "invalid_lifecycle")


def positions(observations: DataFrame) -> DataFrame:
    """trace_id, event_id, seq: n observations, their ids (by UTF-8 bytes), whether their contents conflict, one payload.

    Observations are dealt out by trace once; everything below needs no other exchange.
    """
    return observations.repartition("trace_id").groupBy("trace_id", "event_id", "seq").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("observation_id")).alias("observation_ids"),
        (F.min("payload") != F.max("payload")).alias("conflict"), F.min("payload").alias("payload"),
    )


def conflicts(at: DataFrame) -> DataFrame:
    """Positions whose observations differ in content: their record is rejected."""
    return at.where("conflict").select("trace_id", "event_id", "seq", F.lit("same_id_same_seq_content_conflict").alias("code"))


def ranked(at: DataFrame) -> DataFrame:
    """at with `retained` (an event's lowest position stays, its others are discarded) and `retained_seq`."""
    event = Window.partitionBy("trace_id", "event_id")
    return at.withColumn("retained_seq", F.min("seq").over(event)).withColumn("retained", F.col("seq") == F.col("retained_seq"))


def retained(at: DataFrame) -> DataFrame:
    return ranked(at).where("retained")


def collisions(at: DataFrame) -> DataFrame:
    """Places in a trace that different retained events claim."""
    grouped = retained(at).groupBy("trace_id", "seq").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    return grouped.where("n > 1").withColumn("code", F.lit("different_id_same_seq_collision"))


def accepted(at: DataFrame) -> DataFrame:
    """The positions of traces without conflicts and collisions, as ranked() gives them."""
    here, trace = Window.partitionBy("trace_id", "seq"), Window.partitionBy("trace_id")
    claims = ranked(at).withColumn("_claims", F.sum(F.col("retained").cast("int")).over(here))
    bad = claims.withColumn("_bad", F.max(F.col("conflict") | (F.col("_claims") > 1)).over(trace))
    return bad.where("not _bad").drop("_claims", "_bad")


def exact_replays(at: DataFrame) -> DataFrame:
    return at.where("n > 1 and not conflict").select("trace_id", "event_id", "seq", "n", "observation_ids")


def moved_duplicates(at: DataFrame) -> DataFrame:
    """Discarded positions with the one that was kept, and whether another event is retained at the place."""
    taken = F.max("retained").over(Window.partitionBy("trace_id", "seq"))
    return ranked(at).withColumn("independently_represented", taken).where("not retained").select("trace_id", "event_id", "retained_seq", "seq", "observation_ids", "independently_represented")


def _open_places(at: DataFrame) -> DataFrame:
    """ranked() with `_gap`: the first place of the gap that ends before this retained place, or that this discarded one opens.

    Between retained events a gap is all that lies between them.  Beyond the last one only discarded positions are
    known, and runs of them are gaps.  The two kinds never touch.
    """
    trace = Window.partitionBy("trace_id")
    rows = ranked(at).withColumn("_last", F.max(F.when(F.col("retained"), F.col("seq"))).over(trace))
    rows = rows.withColumn("_tail", ~F.col("retained") & (F.col("seq") > F.col("_last")))
    # Of several rows at one place the first counts; retained ones, tail ones and others are parted.
    order = Window.partitionBy("trace_id", "retained", "_tail").orderBy("seq", "event_id")
    before = F.lag("seq").over(order)
    return rows.withColumn("_before", before).withColumn(
        "_gap", F.when(F.col("retained") & (F.col("seq") > F.coalesce("_before", F.lit(-1)) + 1), F.coalesce("_before", F.lit(-1)) + 1).when(F.col("_tail") & (F.coalesce("_before", F.lit(-2)) < F.col("seq") - 1), F.col("seq")))


def gaps(at: DataFrame) -> DataFrame:
    """trace_id, start_seq, end_seq (exclusive), previous_seq and next_seq: places without a retained event."""
    rows = _open_places(at)
    inner = rows.where("retained and _gap is not null").select("trace_id", F.col("_gap").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("_before").alias("previous_seq"), F.col("seq").alias("next_seq"))
    run = F.last("_gap", ignorenulls=True).over(Window.partitionBy("trace_id").orderBy("seq", "event_id"))
    tail = rows.where("_tail").withColumn("start_seq", run).groupBy("trace_id", "start_seq").agg((F.max("seq") + 1).alias("end_seq"), F.max("_last").alias("previous_seq"))
    return inner.unionByName(tail.select("trace_id", "start_seq", "end_seq", "previous_seq", F.lit(None).cast("long").alias("next_seq")))


def _terminal(target: str) -> Column:
    return (F.col("target") == target) & (((F.col("kind") == "error") & (F.col("effect") == "fail")) | ((F.col("kind") == "cancelled") & (F.col("effect") == "cancel")))


def _status(events: DataFrame, keys: list[str], target: str, end: str) -> DataFrame:
    """The status by the last event, and whether an earlier terminal declaration contradicts it."""
    declared = F.coalesce(_terminal(target), F.lit(False))
    last = F.max_by(F.struct("seq", "kind", "captured_at", declared.alias("declared")), "seq")
    rows = events.groupBy(*keys).agg(last.alias("z"), F.sum(declared.cast("long")).alias("declarations"), F.max((F.col("kind") == end).cast("int")).alias("ended"), F.count("*").alias("events"))
    status = F.when(F.col("z.kind") == end, "completed").when(F.col("z.declared"), F.when(F.col("z.kind") == "error", "failed").otherwise("cancelled")).otherwise("unknown")
    prior = F.col("declarations") - F.col("z.declared").cast("long") > 0
    return rows.select(
        *keys, status.alias("status"), F.when(status != "unknown", F.col("z.captured_at")).alias("finished_at"), F.when(F.col("z.kind") == end, F.col("z.seq")).alias("end_seq"),
        (prior & status.isin("completed", "unknown")).alias("terminal_declaration_not_final"), ((F.col("ended") == 1) & (status == "unknown")).alias("end_without_completion"), "events",
    )


def trace_status(events: DataFrame) -> DataFrame:
    return _status(events, ["trace_id"], "trace", "interaction_end").drop("end_seq", "end_without_completion")


def span_status(events: DataFrame) -> DataFrame:
    """Of spans that were started."""
    started = events.where("kind = 'span_start' and span_id is not null").select("trace_id", "span_id").distinct()
    return _status(events.where("span_id is not null").join(started, ["trace_id", "span_id"], "left_semi"), ["trace_id", "span_id"], "span", "span_end")


def orphan_references(events: DataFrame) -> DataFrame:
    """Events of spans that were never started, and ends of such spans."""
    started = events.where("kind = 'span_start' and span_id is not null").select("trace_id", "span_id").distinct()
    lost = events.where("span_id is not null").join(started, ["trace_id", "span_id"], "left_anti").select("trace_id", "event_id", "span_id", "kind")
    return lost.select("trace_id", "event_id", "span_id", F.lit("unknown_span_reference").alias("code")).unionByName(
        lost.where("kind = 'span_end'").select("trace_id", "event_id", "span_id", F.lit("orphan_span_end").alias("code")))


def retry_references(retries: DataFrame, events: DataFrame) -> DataFrame:
    """trace_id, event_id, code: retries (original_id, error_id) whose references are unknown or of the wrong kind."""
    known = events.select("trace_id", F.col("event_id").alias("ref"), F.col("kind").alias("ref_kind"))

    def check(column: str, wrong: Column, unknown: str, mismatch: str) -> DataFrame:
        rows = retries.where(F.col(column).isNotNull()).select("trace_id", "event_id", F.col(column).alias("ref"))
        joined = rows.join(known, ["trace_id", "ref"], "left")
        code = F.when(F.col("ref_kind").isNull(), unknown).when(wrong, mismatch)
        return joined.select("trace_id", "event_id", code.alias("code")).where("code is not null")

    return check("original_id", ~F.col("ref_kind").rlike(REQUEST_KIND), "retry_unknown_original", "retry_original_not_request").unionByName(
        check("error_id", F.col("ref_kind") != "error", "retry_unknown_error", "retry_error_not_error"))


def start_issues(events: DataFrame) -> DataFrame:
    """Traces without a start event, or whose start isn't the first."""
    at = events.groupBy("trace_id").agg(F.min(F.when(F.col("kind") == "interaction_start", F.col("seq"))).alias("start"))
    code = F.when(F.col("start").isNull(), "missing_interaction_start").when(F.col("start") != 0, "interaction_start_not_first")
    return at.select("trace_id", code.alias("code")).where("code is not null")


def observation_issues(observations: DataFrame) -> DataFrame:
    """trace_id, observation_id, code: structural issues of each observation.  An unknown kind ends its checks."""
    ident = lambda c: ~F.coalesce(F.col(c).cast("string").rlike(r"\S"), F.lit(False))
    known, control = F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False)), F.col("kind").isin(*CONTROL_KINDS)
    stamp = lambda c: ~F.coalesce(F.col(c).rlike(TIMESTAMP) & (F.date_format(F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd") == F.substring(c, 1, 10)), F.lit(False))
    role = F.col("role")
    checks = [
        (ident("observation_id"), "observation_id_invalid"), (ident("event_id"), "event_id_invalid"), (ident("trace_id"), "trace_id_invalid"),
        (F.col("span_id").isNotNull() & ident("span_id") if "span_id" in observations.columns else F.lit(False), "span_id_invalid"), (F.col("seq").isNull() | (F.col("seq") < 0), "seq_invalid"),
        (~known, "unknown_event_kind"), (known & stamp("captured_at"), "captured_at_invalid"), (known & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid_evidence_status"),
        (known & stamp("raw_captured_at") if "raw_captured_at" in observations.columns else F.lit(False), "raw_captured_at_invalid"),
        (known & control & role.isNotNull(), "control_event_has_role"), (known & ~control & role.isNull(), "missing_observation_role"),
        (known & ~control & role.isNotNull() & ~role.isin(*ROLES), "invalid_observation_role"), (known & ~control & (role == "unobservable") & (F.coalesce("status", F.lit("")) != "unknown"), "unobservable_requires_unknown"),
        (known & ~control & F.col("payload").isNull(), "payload_not_object"),
    ]
    codes = F.array_compact(F.array(*(F.when(bad, code) for bad, code in checks)))
    return observations.select("trace_id", "observation_id", F.explode(codes).alias("code"))


def duplicate_ids(observations: DataFrame, order: str) -> DataFrame:
    """Second and later observations of one id in a trace."""
    n = F.row_number().over(Window.partitionBy("trace_id", "observation_id").orderBy(order))
    return observations.withColumn("_n", n).where("_n > 1").select("trace_id", "observation_id", F.lit("duplicate_observation_id").alias("code"))


def envelope_issues(kind: Column, status: Column, fidelity: Column, hash_: Column, encoding: Column, content_type: Column, model: Column, provider: Column) -> Column:
    """Codes of a request's or response's envelope (kind: request or response)."""
    faithful, bytes_ = fidelity.isin(*FIDELITIES), fidelity == "byte_faithful"
    captured, has = status == "captured", hash_.isNotNull()
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    stops = ~F.coalesce(faithful, F.lit(False))
    early = stops | (bytes_ & ~captured)
    checks = [
        (stops, "envelope_invalid_fidelity"), (~stops & has & ~hash_.rlike(HASH), "native_content_hash_invalid"), (~stops & bytes_ & ~captured, "byte_faithful_without_captured"),
        (~early & bytes_ & (encoding.isNull() | ~F.coalesce(content_type.rlike(MEDIA_TYPE), F.lit(False))), "byte_faithful_requires_native_fields"),
        (~early & bytes_ & ~has, "byte_faithful_requires_native_hash"), (~early & ~bytes_ & has & ~captured, "native_hash_without_captured"),
        (~early & (kind == "request") & empty(model), "request_envelope_missing_model"), (~early & (kind == "request") & empty(provider), "request_envelope_missing_provider"),
    ]
    return F.array_compact(F.array(*(F.when(bad, code) for bad, code in checks)))


def _json_type(v: Column, path: str) -> Column:
    """The type of a field (OBJECT<...>, ARRAY<...>, STRING, VOID for null, ...); null if there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, type_: str) -> Column:
    return F.coalesce(_json_type(v, path).startswith(type_), F.lit(False))


def _string(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def _integer(v: Column, path: str, least: int) -> Column:
    x = F.when(F.coalesce(_json_type(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False)), F.try_variant_get(v, path, "double"))
    return F.coalesce((x == F.floor(x)) & (x >= least), F.lit(False))


def kind_issues(observations: DataFrame) -> DataFrame:
    """trace_id, observation_id, code: what each kind requires of its payload (JSON text), and of its span by the lifecycle target."""
    kind, span, p = F.col("kind"), F.col("span_id"), F.col("_p")
    lacks = lambda name: ~_is(p, f"$.{name}", "OBJECT")
    checks = [((kind == k) & lacks(name), code) for k, name, code in PAYLOADS]
    target, effect = F.coalesce(_string(p, "$.lifecycleTarget"), F.lit("")), F.coalesce(_string(p, "$.lifecycleEffect"), F.lit(""))
    ends, retry = kind.isin("error", "cancelled"), (kind == "retry") & ~lacks("retry")
    checks += [
        ((kind == "tool_call") & (lacks("tool") | ~_is(p, "$.tool.name", "STRING")), "tool_call_invalid"), ((kind == "error") & ~F.coalesce(_string(p, "$.actor").isin(*ACTORS), F.lit(False)), "error_invalid_actor"),
        ((kind == "error") & ~target.isin(*TARGETS), "error_invalid_target"), ((kind == "error") & ~effect.isin("fail", "none"), "error_invalid_effect"),
        ((kind == "cancelled") & ~target.isin(*TARGETS), "cancelled_invalid_target"), ((kind == "cancelled") & (effect != "cancel"), "cancelled_invalid_effect"),
        (ends & (target == "span") & span.isNull(), "target_span_requires_span"), (ends & (target == "trace") & span.isNotNull(), "target_trace_requires_null_span"),
        (retry & (F.coalesce(_string(p, "$.retry.originalRequestEventId"), F.lit("")) == ""), "retry_missing_original"), (retry & ~_integer(p, "$.retry.attempt", 1), "retry_invalid_attempt"),
    ]

    def envelope(side: str, applies: Column) -> Column:
        at = f"$.{side}Envelope"
        hash_ = F.when(_json_type(p, f"{at}.nativeContentHash").isNotNull(), F.coalesce(_string(p, f"{at}.nativeContentHash"), F.lit("")))
        codes = envelope_issues(F.lit(side), F.coalesce("status", F.lit("")), _string(p, f"{at}.providerNativeFidelity"), hash_, *(_string(p, f"{at}.{x}") for x in ("nativeEncoding", "nativeContentType", "model", "provider")))
        return F.when(applies & _is(p, at, "OBJECT"), codes).otherwise(F.array().cast("array<string>"))

    listed = F.when((kind == "model_request") & _is(p, "$.contextContributions", "ARRAY"), F.try_variant_get(p, "$.contextContributions", "array<variant>"))
    contributions = F.flatten(F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda c: F.when(~_is(c, "$", "OBJECT"), F.array(F.lit("contribution_invalid"))).otherwise(F.array_compact(F.array(
        F.when(F.coalesce(_string(c, "$.artifactId"), F.lit("")) == "", "contribution_missing_artifact"), F.when(~_integer(c, "$.position", 0), "contribution_invalid_position"))))))
    own = F.array_compact(F.array(*(F.when(bad, code) for bad, code in checks)))
    codes = F.concat(own, envelope("request", kind == "model_request"), envelope("response", kind.isin("model_response", "model_response_chunk")), contributions)
    rows = observations.where(kind.isin(*EVENT_KINDS)).withColumn("_p", F.try_parse_json("payload"))
    return rows.select("trace_id", "observation_id", F.explode(codes).alias("code"))


def validation_issues(observations: DataFrame) -> DataFrame:
    """trace_id, observation_id, code: all checks of single observations, their payloads being JSON texts."""
    is_object = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
    return observation_issues(observations.withColumn("payload", F.when(is_object, F.col("payload")))).unionByName(kind_issues(observations))


def boundary_issues(boundaries: DataFrame) -> DataFrame:
    """trace_id, code: of capture boundaries (boundary: JSON text)."""
    v = F.col("_v")
    strings = lambda path: F.when(_is(v, path, "ARRAY"), F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: _string(x, "$")))
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    thing, missing = _is(v, "$", "OBJECT"), _json_type(v, "$.missingRecord")
    stated = missing.isNotNull() & (missing != "VOID")
    checks = [
        (~thing, "capture_boundary_missing"), (thing & ~known(_string(v, "$.captureSurface"), SURFACES), "capture_surface_invalid"), (thing & ~known(_string(v, "$.observationBoundary"), ROLES), "observation_boundary_invalid"),
        (thing & ~F.coalesce(F.forall(strings("$.declaredEventKinds"), lambda x: x.isNotNull()), F.lit(False)), "declared_event_kinds_invalid"),
        (thing & ~F.coalesce(F.forall(strings("$.declaredSurfaces"), lambda x: known(x, SURFACES)), F.lit(False)), "declared_surfaces_invalid"),
        (thing & stated & ~missing.startswith("OBJECT"), "missing_record_invalid"), (thing & stated & missing.startswith("OBJECT") & (F.coalesce(_string(v, "$.missingRecord.reason"), F.lit("")) == ""), "missing_record_reason_invalid"),
    ]
    codes = F.array_compact(F.array(*(F.when(bad, code) for bad, code in checks)))
    return boundaries.withColumn("_v", F.try_parse_json("boundary")).select("trace_id", F.explode(codes).alias("code"))


def parent_issues(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, code: spans whose parent_id isn't a span of the trace."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    return spans.where("parent_id is not null").join(known, ["trace_id", "parent_id"], "left_anti").select("trace_id", "span_id", F.lit("unknown_parent_span").alias("code"))


def first_stage(issues: DataFrame) -> DataFrame:
    """Issues (record_id, stage, ...) of each record's first failing stage: later stages weren't reached."""
    return issues.withColumn("_first", F.min("stage").over(Window.partitionBy("record_id"))).where("stage = _first").drop("_first")


def schema_gate(version: Column) -> Column:
    """True for a semantic version of major 1."""
    return F.coalesce(version.rlike(SEMVER) & version.startswith("1."), F.lit(False))


def completeness(at: DataFrame, status: Column) -> DataFrame:
    """trace_id, events, by_status (vocabulary order, only what occurs), gap_count, duplicates (labels), from the positions of accepted traces.

    status: of an event, by its columns.  One pass over the positions of each trace.
    """
    kept = F.col("retained")
    rows = _open_places(at).withColumn("_status", status)
    place = lambda text: F.concat(F.lit(text), "event_id", F.lit("@"), F.col("retained_seq" if "different" in text else "seq").cast("string"))
    # An event that was seen at several other places is one duplicate: its first discarded position tells.
    moved = F.row_number().over(Window.partitionBy("trace_id", "event_id", "retained").orderBy("seq")) == 1
    rows = rows.withColumn("_moved", moved & ~kept)
    label = lambda when, at_, text: F.when(when, F.struct(F.col(at_).alias("seq"), "event_id", place(text).alias("label")))
    by = rows.groupBy("trace_id").agg(
        F.sum(kept.cast("long")).alias("events"), F.count("_gap").alias("gap_count"), *(F.sum((kept & (F.col("_status") == s)).cast("long")).alias(f"s_{s}") for s in STATUSES),
        F.collect_list(label((F.col("n") > 1) & ~F.col("conflict"), "seq", "exact_replay:")).alias("replays"), F.collect_list(label(F.col("_moved"), "retained_seq", "same_id_different_seq:")).alias("moves"),
    )
    text = F.concat_ws(",", *(F.when(F.col(f"s_{s}") > 0, F.concat(F.lit(f"{s}="), F.col(f"s_{s}").cast("string"))) for s in STATUSES))
    labels = F.array_join(F.transform(F.array_sort(F.concat("replays", "moves")), lambda x: x["label"]), ",")
    return by.select("trace_id", "events", text.alias("by_status"), "gap_count", labels.alias("duplicates"))


def boundary_statement(boundary: Column, events: Column) -> Column:
    """What a capture boundary (JSON text) declares, as one line."""
    v = F.try_parse_json(boundary)
    listed = lambda path: F.concat(F.lit("["), F.array_join(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>")), ","), F.lit("]"))
    field = lambda path: F.try_variant_get(v, path, "string")
    by = F.when(_is(v, "$.missingRecord.reportedBy", "OBJECT"), F.concat(F.lit(" reportedBy="), field("$.missingRecord.reportedBy.captureSurface"), F.lit("/"), field("$.missingRecord.reportedBy.observationBoundary"))).otherwise("")
    missing = F.when(_is(v, "$.missingRecord", "OBJECT"), F.concat(field("$.missingRecord.reason"), by)).otherwise("none")
    parts = (("boundary(captureSurface=", field("$.captureSurface")), ("; observationBoundary=", field("$.observationBoundary")), ("; declaredEventKinds=", listed("$.declaredEventKinds")),
             ("; declaredSurfaces=", listed("$.declaredSurfaces")), ("; missing=", missing), ("; events=", events.cast("string")))
    return F.concat(*(x for name, value in parts for x in (F.lit(name), value)), F.lit(")"))


def project_kinds(events: DataFrame) -> DataFrame:
    """events with the trace event type and phase they become; outcome `unavailable` if the kind has none."""
    type_ = choose(F.col("kind"), KIND_TO_EVENT)
    return events.withColumns({
        "event_type": type_.cast("string"), "content_phase": F.when(type_.isNotNull(), choose(F.col("role"), ROLE_TO_PHASE)).cast("string"), "outcome": F.when(type_.isNull(), "unavailable").otherwise("partial"),
    })


def project_traces(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """trace_id, status of the older trace model, provider and model of the first model request, events kept and dropped."""
    kinds = project_kinds(events)
    first = F.min_by(F.struct("provider" if "provider" in events.columns else F.lit(None).cast("string").alias("provider"), "model"), F.when(F.col("kind") == "model_request", F.col("seq")))
    told = kinds.groupBy("trace_id").agg(first.alias("q"), F.sum((F.col("outcome") != "unavailable").cast("long")).alias("kept"), F.sum((F.col("outcome") == "unavailable").cast("long")).alias("dropped"))
    state = F.when(F.col("status") == "completed", "success").when(F.col("status").isin("failed", "cancelled"), "error").otherwise("started")
    return statuses.join(told, "trace_id").select("trace_id", state.alias("status"), "q.provider", "q.model", "kept", "dropped")


def _mapping(df: DataFrame, section: int, event: Column, item: Column, path: Column, outcome: Column, reason: Column) -> DataFrame:
    return df.select(
        "trace_id", F.lit(section).alias("section"), event.cast("long").alias("event"), item.cast("int").alias("item"), path.alias("path"), F.lit("evidence_to_legacy_trace").alias("stage"), outcome.alias("outcome"), reason.alias("reason"))


def _present(payload: Column, path: str) -> Column:
    """Whether the JSON text has a value there that isn't null."""
    type_ = F.schema_of_variant(F.try_variant_get(payload, f"$.{path}", "variant"))
    return F.coalesce(type_.startswith("ARRAY") if path == "contextContributions" else type_ != "VOID", F.lit(False))


def loss_mappings(statuses: DataFrame, events: DataFrame, spans: DataFrame | None = None, conditions: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """trace_id, section, event, item (their order), path, stage, outcome and reason: what an older trace can't hold.

    Section 0 is the trace's, 1 the spans', 2 the events': one row for each event (partial, or unavailable if its kind has no
    type) and one for each field of it that is lost; 3 the raw declarations'.  events may have `payload` (JSON text); spans:
    trace_id, place, duration_ms, participants (only their losses; that a trace has spans shows in its events); conditions: trace_id; observations:
    trace_id, place, payload.
    """
    lost, nought = F.lit("unavailable"), F.lit(0)
    model = F.min_by(F.struct("model"), F.when(F.col("kind") == "model_request", F.col("seq")))["model"]
    told = events.groupBy("trace_id").agg(model.alias("model"), F.max(((F.col("kind") == "span_start") & F.col("span_id").isNotNull()).cast("int")).alias("spans"))
    traces = statuses.join(told, "trace_id")
    done, derived = F.col("finished_at").isNotNull(), F.col("model").isNotNull()
    not_done = F.concat(F.lit('canonical trace has no observed terminal time (status "'), "status", F.lit('"); legacy endedAt is omitted'))
    special = {
        "trace.finishedAt": (F.lit("trace.finishedAt"), F.when(done, "exact").otherwise("unavailable"), F.when(done, losses.FINISHED).otherwise(not_done)),
        "trace.status": (F.lit("trace.status"), F.lit("partial"), choose(F.col("status"), losses.STATUS_REASONS)),
        "trace.provider": (F.when(derived, losses.INFERRED[0]).otherwise("trace.provider"), F.when(derived, "inferred").otherwise("unavailable"), F.when(derived, losses.INFERRED[1]).otherwise(losses.NO_PROVIDER)),
    }
    fields = ("path", "outcome", "reason")
    fixed = F.array(*(F.struct(F.lit(i).alias("item"), *(c.alias(n) for n, c in zip(fields, special.get(p, tuple(map(F.lit, (p, o, r)))), strict=True))) for i, (p, o, r) in enumerate(losses.LOSSES)))
    each = traces.select("trace_id", F.explode(fixed).alias("x"))
    out = [_mapping(each, 0, nought, F.col("x.item"), F.col("x.path"), F.col("x.outcome"), F.col("x.reason")), _mapping(traces.where("spans = 1"), 1, nought, nought, F.lit("trace.spans"), lost, F.lit(losses.SPANS))]
    if conditions is not None:
        out.append(_mapping(conditions.select("trace_id").distinct(), 0, nought, F.lit(len(losses.LOSSES)), F.lit("trace.conditions"), lost, F.lit(losses.CONDITIONS)))
    if spans is not None:
        for i, (present, (name, why)) in enumerate(zip((F.col("duration_ms").isNotNull(), F.size("participants") > 0), losses.SPAN_LOSSES, strict=True)):
            out.append(_mapping(spans.where(present), 1, F.col("place"), F.lit(1 + i), F.concat(F.lit("trace.spans["), F.col("place").cast("string"), F.lit(f"].{name}")), lost, F.lit(why)))

    # One pass over the events: each gives an array of its rows.
    at = F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")) - 1
    kinds = project_kinds(events).withColumns({"at": at, "_p": F.try_parse_json("payload") if "payload" in events.columns else F.lit(None).cast("variant")})
    path = F.concat(F.lit("events["), F.col("at").cast("string"), F.lit("]"))
    kept, unseen = F.col("event_type").isNotNull(), F.coalesce(F.col("role") == "unobservable", F.lit(False))
    note = F.when(F.col("content_phase").isNotNull(), F.concat(F.lit('; observationRole "'), "role", F.lit('" approximated by ContentPhase "'), "content_phase", F.lit('"'))).when(unseen, '; observationRole "unobservable" has no ContentPhase approximation').otherwise("")
    reason = F.when(kept, F.concat(F.lit('kind "'), "kind", F.lit('": '), choose(F.col("kind"), losses.KIND_REASONS), note)).otherwise(F.concat(F.lit('canonical event kind "'), "kind", F.lit('" has no legacy TraceEventType; omitted from the legacy trace view')))
    rows = [(F.lit(True), F.lit(""), F.when(kept, "partial").otherwise("unavailable"), reason), (kept & unseen, F.lit(".observationRole"), lost, F.lit(losses.UNOBSERVABLE))]
    rows += [(F.col("kind").isin(*kinds_) & _present(F.col("_p"), there), F.lit(f".{told_ or there}"), lost, F.lit(why)) for kinds_, there, told_, why in losses.FIELD_LOSSES]
    rows += [(F.col("kind") == "error", F.lit(f".{name}"), lost, F.lit(why)) for name, why in losses.ERROR_LOSSES]
    made = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(i).alias("item"), F.concat(path, suffix).alias("path"), outcome.alias("outcome"), why.alias("reason"))) for i, (when, suffix, outcome, why) in enumerate(rows))))
    each = kinds.select("trace_id", "at", F.explode(made).alias("x"))
    out.append(_mapping(each, 2, F.col("at"), F.col("x.item"), F.col("x.path"), F.col("x.outcome"), F.col("x.reason")))
    if observations is not None:
        raw = observations.withColumn("_p", F.try_parse_json("payload"))
        for i, (name, why) in enumerate(losses.DECLARATION_LOSSES):
            out.append(_mapping(raw.where(_present(F.col("_p"), name)), 3, F.col("place"), F.lit(i), F.concat(F.lit("rawObservations["), F.col("place").cast("string"), F.lit(f"].payload.{name}")), lost, F.lit(why)))
    return reduce(DataFrame.unionByName, out)


def translate_issue(code: Column) -> Column:
    return choose(code, ISSUE_BUCKETS, F.lit("invalid_evidence_record"))
