"""Queries over evidence, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import losses
from ledgerline.functions.text import choose
from ledgerline.functions.vocabulary import EVENT_KINDS
from ledgerline.operators import canonical, evidence, projections, records
from ledgerline.sources.tables import event_traces, lineitem_observations, table

V4 = """WITH p AS (SELECT l_orderkey AS trace_id, 'e' || (l_partkey % 40) AS event_id, CAST((l_linenumber - 1) * 2 + l_suppkey % 2 AS BIGINT) AS seq, count(*) AS n, min(l_returnflag) <> max(l_returnflag) AS conflict, min(l_returnflag) AS payload,
 string_agg(l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(l_quantity AS BIGINT) || ':' || strftime(l_shipdate, '%Y%m%d'), ',' ORDER BY l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(l_quantity AS BIGINT) || ':' || strftime(l_shipdate, '%Y%m%d')) AS ids
 FROM lineitem GROUP BY 1, 2, 3),
 r0 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, event_id ORDER BY seq) = 1 AS retained FROM p),
 col AS (SELECT trace_id, seq, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM r0 WHERE retained GROUP BY 1, 2 HAVING count(*) > 1),
 a AS (SELECT * FROM p WHERE trace_id NOT IN (SELECT trace_id FROM p WHERE conflict) AND trace_id NOT IN (SELECT trace_id FROM col)),
 r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, event_id ORDER BY seq) = 1 AS retained FROM a),
 k AS (SELECT trace_id, seq, lag(seq) OVER (PARTITION BY trace_id ORDER BY seq) AS prev FROM (SELECT DISTINCT trace_id, seq FROM r WHERE retained)),
 tl AS (SELECT d.trace_id, d.seq, x.last, d.seq - row_number() OVER (PARTITION BY d.trace_id ORDER BY d.seq) AS isl FROM (SELECT DISTINCT trace_id, seq FROM r WHERE NOT retained) d JOIN (SELECT trace_id, max(seq) AS last FROM k GROUP BY 1) x ON x.trace_id = d.trace_id AND d.seq > x.last),
 gap AS (SELECT trace_id, coalesce(prev, -1) + 1 AS start_seq, seq AS end_seq, prev AS previous_seq, seq AS next_seq FROM k WHERE seq > coalesce(prev, -1) + 1
  UNION ALL SELECT trace_id, min(seq), max(seq) + 1, max(last), NULL FROM tl GROUP BY trace_id, isl) """
V7 = """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, 'ev-' || event_id AS event_id, row_number() OVER (PARTITION BY user_id || '-' || strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS seq,
 event_id AS i, event_type AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || CASE WHEN event_id % 31 = 0 THEN '' ELSE 'Z' END AS captured_at, json_extract_string(props, '$.k') AS k FROM events),
 v AS (SELECT *, CASE WHEN t = 'purchase' THEN 'interaction_end' WHEN t = 'error' THEN CASE WHEN i % 7 = 0 THEN 'cancelled' ELSE 'error' END WHEN t = 'signup' THEN 'span_end' WHEN t = 'click' THEN 'span_start'
   WHEN seq = 0 THEN 'interaction_start' WHEN i % 29 = 0 THEN 'teleport' ELSE 'model_request' END AS kind,
  CASE WHEN t IN ('click', 'signup') OR i % 4 = 1 THEN 's' || (i % 2) END AS span_id, CASE WHEN t = 'error' THEN CASE i % 3 WHEN 0 THEN 'trace' WHEN 1 THEN 'span' ELSE 'none' END END AS target,
  CASE WHEN t = 'error' THEN CASE WHEN i % 7 = 0 THEN 'cancel' WHEN i % 2 = 0 THEN 'fail' ELSE 'none' END END AS effect, CASE i % 5 WHEN 0 THEN 'captured' WHEN 1 THEN 'redacted' WHEN 2 THEN 'unknown' WHEN 3 THEN 'captured' ELSE 'bogus' END AS status,
  CASE i % 6 WHEN 0 THEN 'client_sent' WHEN 1 THEN 'provider_reported' WHEN 2 THEN 'unobservable' WHEN 3 THEN 'application_constructed' WHEN 4 THEN 'nobody' END AS role, CASE WHEN i % 3 > 0 THEN 'm' || (i % 3) END AS model FROM e) """


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical events of evidence: a user's day is a trace; kinds, spans and roles by id."""
    t = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    trace = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    seq = F.row_number().over(Window.partitionBy(trace).orderBy(i)) - 1
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss."), F.lpad((i % 1000).cast("string"), 3, "0"), F.when(i % 31 == 0, "").otherwise("Z"))
    rows = t.select(trace.alias("trace_id"), F.concat(F.lit("ev-"), i.cast("string")).alias("event_id"), seq.cast("long").alias("seq"), i.alias("i"), kind.alias("t"), stamp.alias("captured_at"), F.get_json_object("props", "$.k").alias("payload"))
    i, t_ = F.col("i"), F.col("t")
    error = t_ == "error"
    return rows.withColumns({
        "kind": F.when(t_ == "purchase", "interaction_end").when(error, F.when(i % 7 == 0, "cancelled").otherwise("error")).when(t_ == "signup", "span_end").when(t_ == "click", "span_start")
        .when(F.col("seq") == 0, "interaction_start").when(i % 29 == 0, "teleport").otherwise("model_request"),
        "span_id": F.when(t_.isin("click", "signup") | (i % 4 == 1), F.concat(F.lit("s"), (i % 2).cast("string"))), "target": F.when(error, choose(i % 3, {0: "trace", 1: "span", 2: "none"})),
        "effect": F.when(error, F.when(i % 7 == 0, "cancel").when(i % 2 == 0, "fail").otherwise("none")), "status": choose(i % 5, {0: "captured", 1: "redacted", 2: "unknown", 3: "captured", 4: "bogus"}),
        "role": choose(i % 6, {0: "client_sent", 1: "provider_reported", 2: "unobservable", 3: "application_constructed", 4: "nobody"}).cast("string"), "model": F.when(i % 3 > 0, F.concat(F.lit("m"), (i % 3).cast("string"))),
    })


def _at(spark, d):
    return evidence.positions(lineitem_observations(spark, d))


def _joined(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(column, ",")).drop(*([column] if column != name else []))


def exact_replays(spark, d):
    return _joined(evidence.exact_replays(_at(spark, d)), "observation_ids", "ids")


def content_conflicts(spark, d):
    return evidence.conflicts(_at(spark, d))


def seq_collisions(spark, d):
    return _joined(evidence.collisions(_at(spark, d)), "event_ids", "event_ids")


def retained_positions(spark, d):
    return evidence.ranked(evidence.accepted(_at(spark, d))).select("trace_id", "event_id", "seq", "retained")


def moved_duplicates(spark, d):
    return _joined(evidence.moved_duplicates(evidence.accepted(_at(spark, d))), "observation_ids", "ids")


def sequence_gaps(spark, d):
    return evidence.gaps(evidence.accepted(_at(spark, d)))


def evidence_completeness(spark, d):
    status = choose(F.col("payload"), {"A": "captured", "N": "redacted", "R": "truncated"})
    return evidence.completeness(evidence.accepted(_at(spark, d)), status)


def content_digest(spark, d):
    """The digest of the canonical form of contents that nest, with exponents, escapes and fields in any order."""
    rows = _at(spark, d).where("not conflict").select("trace_id", "event_id", "seq", F.col("payload").alias("flag"))
    payload = F.concat(F.lit('{"z":{"flag":"'), "flag", F.lit('\\n\\u0001","B":[1e2,0.10,true,null]},"a":{"y":"\\"é","x":'), F.col("seq").cast("string"), F.lit(".0}}"))
    box = F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("trace_id").cast("string").alias("traceId"), F.col("seq"), F.lit("tool_result").alias("kind"), F.lit("captured").alias("evidenceStatus"), F.lit("returned").alias("observationRole")))
    return canonical.project(rows.withColumns({"container": box, "payload": payload})).select("trace_id", "event_id", "seq", F.sha2("event", 256).alias("digest"))


def event_digest(spark, d):
    """The digest of each event's canonical JSON: all fields of the container and those of the payload."""
    names = {"eventId": "event_id", "traceId": "trace_id", "spanId": "span_id", "seq": "seq", "kind": "kind", "capturedAt": "captured_at", "evidenceStatus": "status", "observationRole": "role"}
    box = F.to_json(F.struct(*(F.col(c).alias(n) for n, c in names.items())))
    rows = lifecycle_events(spark, d).select("trace_id", "event_id", "seq", box.alias("container"), F.concat(F.lit('{"k":'), "payload", F.lit("}")).alias("payload"))
    return canonical.project(rows).select("trace_id", "event_id", "seq", F.sha2("event", 256).alias("digest"))


def trace_status(spark, d):
    return evidence.trace_status(lifecycle_events(spark, d))


def span_status(spark, d):
    return evidence.span_status(lifecycle_events(spark, d))


def orphan_references(spark, d):
    return evidence.orphan_references(lifecycle_events(spark, d))


def start_issues(spark, d):
    return evidence.start_issues(lifecycle_events(spark, d))


def retry_references(spark, d):
    e = lifecycle_events(spark, d)
    retries = e.where("kind = 'model_request'").select("trace_id", "event_id", F.concat(F.lit("ev-"), (F.col("i") - F.col("i") % 50).cast("string")).alias("original_id"), F.when(F.col("i") % 2 == 0, F.concat(F.lit("ev-"), (F.col("i") - F.col("i") % 20).cast("string"))).alias("error_id"))
    # Against all events of the day, whatever the user, so that references resolve at times.
    day = lambda df: df.withColumn("trace_id", F.substring("trace_id", -10, 10))
    return evidence.retry_references(day(retries), day(e))


def observation_issues(spark, d):
    e = lifecycle_events(spark, d).withColumn("observation_id", F.concat(F.lit("o-"), F.col("event_id")))
    return evidence.observation_issues(e)


def evidence_issues(spark, d):
    """observation_issues with the checks by kind: payloads are made by id."""
    e = lifecycle_events(spark, d)
    i, kind = F.col("i"), F.col("kind")
    ok = '{"providerNativeFidelity":"structurally_faithful","model":"m","provider":"p"}'
    request = choose(i % 5, {
        0: "{}", 1: '{"requestEnvelope":{}}', 2: '{"requestEnvelope":{"providerNativeFidelity":"structurally_faithful","model":"m"}}', 3: '{"requestEnvelope":{"providerNativeFidelity":"byte_faithful","model":"m","provider":"p"}}',
        4: '{"requestEnvelope":' + ok + ',"contextContributions":[1,{"artifactId":"a","position":0},{"position":-1}]}'})
    ends = F.concat(F.lit('{"lifecycleTarget":"'), "target", F.lit('","lifecycleEffect":"'), "effect", F.lit('","actor":"'), choose(i % 3, {0: "model", 1: "tool", 2: "nobody"}), F.when(i % 4 > 0, '","error":{},"cancellation":{}}').otherwise('"}'))
    payload = F.when(kind == "model_request", request).when(kind.isin("error", "cancelled"), ends).otherwise("{}")
    return evidence.validation_issues(e.withColumns({"observation_id": F.concat(F.lit("o-"), F.col("event_id")), "payload": F.when(F.col("payload").isNotNull(), payload)}))


def parent_issues(spark, d):
    """Started spans of a trace, each the other's child."""
    spans = lifecycle_events(spark, d).where("kind = 'span_start'").select("trace_id", "span_id").distinct()
    return evidence.parent_issues(spans.withColumn("parent_id", F.when(F.col("span_id") == "s0", "s1")))


def kind_projection(spark, d):
    return evidence.project_kinds(lifecycle_events(spark, d)).select("trace_id", "event_id", "kind", "event_type", "content_phase", "outcome")


def _projected(spark, d):
    e = lifecycle_events(spark, d)
    return evidence.project_traces(evidence.trace_status(e), e)


def trace_projection(spark, d):
    return _projected(spark, d)


#: A payload for each kind, some of its fields by id; the same expression in both dialects.
RECORD_PAYLOAD = """CASE kind WHEN 'model_request' THEN '{"requestEnvelope":{"providerNativeFidelity":"structurally_faithful","provider":"p' || (j % 3) || '","model":"m' || (j % 4) || '"' || CASE WHEN j % 2 = 0 THEN ',"messages":[]' ELSE '' END
 || CASE WHEN j % 3 = 0 THEN ',"nativeEncoding":"utf-8","nativeContentType":"a/b"' ELSE ',"nativeContentHash":null' END || CASE WHEN j % 5 = 0 THEN ',"providerNative":{"x":1}' ELSE '' END || '}' || CASE WHEN j % 4 = 0 THEN ',"contextContributions":[]' ELSE '' END || '}'
 WHEN 'model_response' THEN '{"responseEnvelope":{"providerNativeFidelity":"structurally_faithful"' || CASE WHEN j % 2 = 0 THEN ',"finishReason":"stop"' ELSE '' END || CASE WHEN j % 3 = 0 THEN ',"usage":{}' ELSE ',"usage":null' END || CASE WHEN j % 5 = 0 THEN ',"nativeContentHash":"x"' ELSE '' END || '}}'
 WHEN 'model_response_chunk' THEN '{"responseEnvelope":{"providerNativeFidelity":"structurally_faithful","chunkIndex":' || (j % 7) || '}}'
 WHEN 'model_usage' THEN '{"usage":{"evidenceStatus":"captured"' || CASE WHEN j % 2 = 0 THEN ',"inputTokens":{"value":0}' ELSE '' END || CASE WHEN j % 3 = 0 THEN ',"outputTokens":0' ELSE '' END || CASE WHEN j % 5 = 0 THEN ',"totalTokens":null' ELSE ',"totalTokens":1' END || '}}'
 WHEN 'context_assembled' THEN CASE WHEN j % 2 = 0 THEN '{"contextContributions":[{"artifactId":"a"}],"missing":{}}' ELSE '{"contextContributions":"[]","redaction":true}' END
 WHEN 'tool_result' THEN CASE WHEN j % 3 = 0 THEN '{"toolResult":{},"truncation":{"length":1},"missing":null}' ELSE '{"toolResult":{}}' END ELSE '{}' END"""


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical events of all kinds, with payloads: a user's day is a trace."""
    e = lifecycle_events(spark, sf_dir).select("trace_id", "event_id", "seq", "i", "captured_at", "role", "span_id", "status")
    kinds = F.array(*map(F.lit, EVENT_KINDS))
    rows = e.withColumns({"kind": F.element_at(kinds, (F.col("i") % len(EVENT_KINDS)).cast("int") + 1), "j": F.expr(f"CAST(floor(i / {len(EVENT_KINDS)}) AS BIGINT)")})
    ends = F.col("kind").isin("error", "cancelled")
    rows = rows.withColumns({
        "payload": F.expr(RECORD_PAYLOAD), "target": F.when(ends, F.when(F.col("j") % 2 == 0, "trace").otherwise("span")), "effect": F.when(ends, F.when(F.col("kind") == "cancelled", "cancel").otherwise("fail")),
    })
    return rows.withColumns({c: F.when(F.col("kind") == "model_request", F.get_json_object("payload", f"$.requestEnvelope.{c}")) for c in ("provider", "model")})


def loss_report(spark, d):
    """All that evidence loses when it becomes an older trace: fixed mappings, spans, events and their fields, conditions and declarations."""
    e = record_events(spark, d)
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")) - 1
    spans = e.where("kind = 'span_start' and span_id is not null").select("trace_id", place.alias("place"), F.when(F.col("j") % 2 == 0, F.col("j")).alias("duration_ms"), F.when(F.col("j") % 3 == 0, F.array(F.lit("p"))).alias("participants"))
    conditions = e.where("i % 50 = 0").select("trace_id")
    observations = e.select("trace_id", F.col("seq").alias("place"), "payload")
    return evidence.loss_mappings(evidence.trace_status(e), e, spans, conditions, observations)


def issue_buckets(spark, d):
    """What a projection reports for each code of a rejected record."""
    return evidence_issues(spark, d).select("trace_id", "observation_id", "code", evidence.translate_issue(F.col("code")).alias("bucket"))


def _plain_traces(spark, d):
    n = F.length("trace_id")
    return event_traces(spark, d).select("trace_id").distinct().select(
        "trace_id", F.when(n % 2 == 0, "p").alias("provider"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("agent"), F.when(n % 3 > 0, "t").alias("task"), F.when(n % 2 == 0, '{"a":1}').when(n % 3 == 0, "{}").alias("metadata"))


def trace_entry_issues(spark, d):
    """Events with planted faults: an odd one by id each."""
    i, text = F.col("event_ordinal"), F.lit(None).cast("string")
    e = event_traces(spark, d).withColumns({"event_id": F.when(i % 11 > 0, F.col("event_id")), "timestamp": F.when(i % 13 > 0, "2024").otherwise(""), "type": F.when(i % 17 > 0, F.col("type")).otherwise("odd"), "content_phase": F.when(i % 19 > 0, F.col("content_phase")).otherwise("odd")})
    return projections.entry_issues(e.withColumn("source_type", F.when(i % 23 == 0, "odd").when(i % 2 == 0, "diff").otherwise(text)))


def run_report(spark, d):
    return projections.run_mappings(_plain_traces(spark, d), event_traces(spark, d))


def evidence_run_report(spark, d):
    e = lifecycle_events(spark, d)
    return projections.evidence_mappings(evidence.trace_status(e), e)


BOUNDARY = '{"captureSurface":"mcp","observationBoundary":"returned","declaredEventKinds":["error","retry"],"declaredSurfaces":["mcp"],"missingRecord":{"reason":"late","reportedBy":{"captureSurface":"tool","observationBoundary":"client_sent"}}}'


def record_views(spark, d):
    """Records made of a user's day, a few with faults: their issues, or what their views say."""
    e = lifecycle_events(spark, d)
    i, seq = F.col("i"), F.col("seq")
    last = seq == F.count("*").over(Window.partitionBy("trace_id")) - 1
    kind = F.when(seq == 0, "interaction_start").when(last & (F.col("t") == "purchase"), "interaction_end").otherwise("tool_result")
    control = kind != "tool_result"
    # Every ninth event leaves a place free behind it.
    at = seq + F.coalesce(F.sum((i % 9 == 0).cast("long")).over(Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stamp = F.concat(F.substring("captured_at", 1, 23), F.lit("Z"))
    box = F.struct(
        F.concat(F.lit("o-"), "event_id").alias("observationId"), F.col("event_id").alias("eventId"), F.col("trace_id").alias("traceId"), F.lit(None).cast("string").alias("spanId"), at.alias("seq"), kind.alias("kind"), stamp.alias("capturedAt"),
        F.when(i % 5 == 1, "redacted").otherwise("captured").alias("evidenceStatus"), F.when(~control, F.when(i % 97 == 0, "nobody").otherwise("returned")).alias("observationRole"), F.when(i % 89 == 0, "x").otherwise(stamp).alias("rawCapturedAt"),
        F.struct(F.struct(F.col("payload").alias("k")).alias("toolResult")).alias("payload"))
    one = e.select("trace_id", F.struct(seq.alias("n"), F.to_json(box, {"ignoreNullFields": "false"}).alias("o")).alias("x")).groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = one.select("trace_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda o: o["o"]), ","), F.lit("]")).alias("observations"), F.lit(BOUNDARY).alias("boundary"), F.lit("1.0.0").alias("version"))
    done = records.construct_records(rows)
    field = lambda path: F.get_json_object("parsed.record", f"$.{path}")
    return done.select(
        "trace_id", F.array_join(F.array_sort(F.transform("parsed.issues", lambda x: x["code"])), ",").alias("codes"), field("trace.status").alias("status"), field("trace.startedAt").alias("started_at"),
        field("completeness.boundaryStatement").alias("statement"), F.coalesce(field("completeness.eventsByStatus.redacted").cast("long"), F.lit(0)).alias("redacted"),
        F.coalesce(F.json_array_length(field("analysis.sequenceGaps")), F.lit(0)).cast("long").alias("gaps"))


def loss_mappings(spark, d):
    e = lifecycle_events(spark, d)
    return evidence.loss_mappings(evidence.trace_status(e), e)


QUERIES = {f.__name__: f for f in (
    exact_replays, content_conflicts, seq_collisions, retained_positions, moved_duplicates, sequence_gaps, evidence_completeness, content_digest, event_digest, trace_status, span_status, orphan_references,
    start_issues, retry_references, observation_issues, evidence_issues, issue_buckets, parent_issues, kind_projection, trace_projection, loss_report, loss_mappings, trace_entry_issues, run_report, evidence_run_report, record_views,
)}


def _status_sql(keys: str, target: str, end: str, source: str) -> str:
    declared = f"coalesce(target = '{target}' AND ((kind = 'error' AND effect = 'fail') OR (kind = 'cancelled' AND effect = 'cancel')), false)"
    return f"""z AS (SELECT {keys}, arg_max(kind, seq) AS kind, arg_max(captured_at, seq) AS fin, max(seq) AS last, arg_max({declared}, seq) AS d, sum(CASE WHEN {declared} THEN 1 ELSE 0 END) AS n, max(CASE WHEN kind = '{end}' THEN 1 ELSE 0 END) AS ended, count(*) AS events FROM {source} GROUP BY ALL),
 st AS (SELECT *, CASE WHEN kind = '{end}' THEN 'completed' WHEN d THEN CASE kind WHEN 'error' THEN 'failed' ELSE 'cancelled' END ELSE 'unknown' END AS status FROM z) """


_TRACE = _status_sql("trace_id", "trace", "interaction_end", "v")
_OUT = "status, CASE WHEN status <> 'unknown' THEN fin END AS finished_at, n - CASE WHEN d THEN 1 ELSE 0 END > 0 AND status IN ('completed', 'unknown') AS terminal_declaration_not_final, events"
_STARTED = "(SELECT trace_id, span_id FROM v WHERE kind = 'span_start' AND span_id IS NOT NULL)"
_KIND = "CASE kind WHEN 'model_request' THEN 'provider_request' WHEN 'error' THEN 'provider_error' END"
_PROJECTED = V7 + ", " + _TRACE + f""", pr AS (SELECT st.trace_id, CASE WHEN any_value(st.status) = 'completed' THEN 'success' WHEN any_value(st.status) IN ('failed', 'cancelled') THEN 'error' ELSE 'started' END AS status,
 CAST(NULL AS VARCHAR) AS provider, (array_agg(v.model ORDER BY v.seq) FILTER (v.kind = 'model_request'))[1] AS model, CAST(sum(CASE WHEN {_KIND.replace('kind', 'v.kind', 1)} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN {_KIND.replace('kind', 'v.kind', 1)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped
 FROM st JOIN v USING (trace_id) GROUP BY 1) """
_DAY = "substr(trace_id, length(trace_id) - 9)"
ORACLE = {
    "exact_replays": V4 + "SELECT trace_id, event_id, seq, n, ids FROM p WHERE n > 1 AND NOT conflict",
    "content_conflicts": V4 + "SELECT trace_id, event_id, seq, 'same_id_same_seq_content_conflict' AS code FROM p WHERE conflict",
    "seq_collisions": V4 + "SELECT *, 'different_id_same_seq_collision' AS code FROM col",
    "retained_positions": V4 + "SELECT trace_id, event_id, seq, retained FROM r",
    "moved_duplicates": V4 + "SELECT d.trace_id, d.event_id, x.seq AS retained_seq, d.seq, d.ids, EXISTS (SELECT 1 FROM r y WHERE y.retained AND y.trace_id = d.trace_id AND y.seq = d.seq) AS independently_represented FROM r d JOIN r x ON x.trace_id = d.trace_id AND x.event_id = d.event_id AND x.retained WHERE NOT d.retained",
    "sequence_gaps": V4 + "SELECT * FROM gap",
    "evidence_completeness": V4 + """, s AS (SELECT trace_id, count(*) AS events, sum(CASE WHEN payload = 'A' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN payload = 'N' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN payload = 'R' THEN 1 ELSE 0 END) AS t FROM r WHERE retained GROUP BY 1),
 l AS (SELECT trace_id, seq, event_id, 'exact_replay:' || event_id || '@' || seq AS label FROM r WHERE n > 1 UNION ALL SELECT DISTINCT d.trace_id, x.seq, d.event_id, 'same_id_different_seq:' || d.event_id || '@' || x.seq FROM r d JOIN r x ON x.trace_id = d.trace_id AND x.event_id = d.event_id AND x.retained WHERE NOT d.retained)
 SELECT s.trace_id, events, concat_ws(',', CASE WHEN c > 0 THEN 'captured=' || CAST(c AS BIGINT) END, CASE WHEN d > 0 THEN 'redacted=' || CAST(d AS BIGINT) END, CASE WHEN t > 0 THEN 'truncated=' || CAST(t AS BIGINT) END) AS by_status,
 coalesce((SELECT count(*) FROM gap WHERE gap.trace_id = s.trace_id), 0) AS gap_count, coalesce((SELECT string_agg(label, ',' ORDER BY seq, event_id, label) FROM l WHERE l.trace_id = s.trace_id), '') AS duplicates FROM s""",
    "content_digest": V4 + """SELECT trace_id, event_id, seq, sha256('{"a":{"x":' || seq || ',"y":"\\"é"},"capturedAt":null,"eventId":"' || event_id || '","evidenceStatus":"captured","kind":"tool_result","observationRole":"returned","seq":' || seq || ',"spanId":null,"traceId":"' || trace_id || '","z":{"B":[100,0.1,true,null],"flag":"' || payload || '\\n\\u0001"}}') AS digest FROM p WHERE NOT conflict""",
    "trace_status": V7 + ", " + _TRACE + f"SELECT trace_id, {_OUT} FROM st",
    "span_status": V7 + f", w AS (SELECT * FROM v WHERE span_id IS NOT NULL AND (trace_id, span_id) IN {_STARTED}), " + _status_sql("trace_id, span_id", "span", "span_end", "w")
    + f"SELECT trace_id, span_id, {_OUT}, CASE WHEN kind = 'span_end' THEN last END AS end_seq, ended = 1 AND status = 'unknown' AS end_without_completion FROM st",
    "orphan_references": V7 + f", o AS (SELECT * FROM v WHERE span_id IS NOT NULL AND (trace_id, span_id) NOT IN {_STARTED}) SELECT trace_id, event_id, span_id, 'unknown_span_reference' AS code FROM o UNION ALL SELECT trace_id, event_id, span_id, 'orphan_span_end' FROM o WHERE kind = 'span_end'",
    "start_issues": V7 + "SELECT * FROM (SELECT trace_id, CASE WHEN min(seq) FILTER (kind = 'interaction_start') IS NULL THEN 'missing_interaction_start' WHEN min(seq) FILTER (kind = 'interaction_start') <> 0 THEN 'interaction_start_not_first' END AS code FROM v GROUP BY 1) WHERE code IS NOT NULL",
    "retry_references": V7 + f""", q AS (SELECT {_DAY} AS trace_id, event_id, i, kind FROM v), y AS (SELECT trace_id, event_id, 'ev-' || (i - i % 50) AS a, CASE WHEN i % 2 = 0 THEN 'ev-' || (i - i % 20) END AS b FROM q WHERE kind = 'model_request')
 SELECT * FROM (SELECT y.trace_id, y.event_id, CASE WHEN q.kind IS NULL THEN 'retry_unknown_original' WHEN NOT regexp_matches(q.kind, '_(request|call)$') THEN 'retry_original_not_request' END AS code FROM y LEFT JOIN q ON q.trace_id = y.trace_id AND q.event_id = y.a
 UNION ALL SELECT y.trace_id, y.event_id, CASE WHEN q.kind IS NULL THEN 'retry_unknown_error' WHEN q.kind <> 'error' THEN 'retry_error_not_error' END FROM y LEFT JOIN q ON q.trace_id = y.trace_id AND q.event_id = y.b WHERE y.b IS NOT NULL) WHERE code IS NOT NULL""",
    "observation_issues": V7 + """, x AS (SELECT *, kind <> 'teleport' AS known, kind IN ('interaction_start', 'interaction_end', 'span_start', 'span_end') AS control FROM v)
 SELECT trace_id, 'o-' || event_id AS observation_id, unnest(list_filter([CASE WHEN NOT known THEN 'unknown_event_kind' END, CASE WHEN known AND captured_at NOT LIKE '%Z' THEN 'captured_at_invalid' END, CASE WHEN known AND status = 'bogus' THEN 'invalid_evidence_status' END,
 CASE WHEN known AND control AND role IS NOT NULL THEN 'control_event_has_role' END, CASE WHEN known AND NOT control AND role IS NULL THEN 'missing_observation_role' END, CASE WHEN known AND NOT control AND role = 'nobody' THEN 'invalid_observation_role' END,
 CASE WHEN known AND NOT control AND role = 'unobservable' AND status <> 'unknown' THEN 'unobservable_requires_unknown' END, CASE WHEN known AND NOT control AND k IS NULL THEN 'payload_not_object' END], lambda c: c IS NOT NULL)) AS code FROM x""",
    "kind_projection": V7 + f"SELECT trace_id, event_id, kind, {_KIND} AS event_type, CASE WHEN {_KIND} IS NOT NULL THEN CASE role WHEN 'application_constructed' THEN 'transformed' WHEN 'client_sent' THEN 'sent' WHEN 'provider_reported' THEN 'observed' WHEN 'returned' THEN 'returned' END END AS content_phase, CASE WHEN {_KIND} IS NULL THEN 'unavailable' ELSE 'partial' END AS outcome FROM v",
    "trace_projection": _PROJECTED + "SELECT * FROM pr",
}
ORACLE["evidence_issues"] = ORACLE["observation_issues"] + """ UNION ALL SELECT trace_id, 'o-' || event_id, unnest(list_filter([
 CASE WHEN kind = 'model_request' AND (k IS NULL OR i % 5 = 0) THEN 'model_request_missing_envelope' END, CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 1 THEN 'envelope_invalid_fidelity' END,
 CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 2 THEN 'request_envelope_missing_provider' END, CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 3 THEN 'byte_faithful_requires_native_fields' END,
 CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 3 THEN 'byte_faithful_requires_native_hash' END, CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 4 THEN 'contribution_invalid' END,
 CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 4 THEN 'contribution_missing_artifact' END, CASE WHEN kind = 'model_request' AND k IS NOT NULL AND i % 5 = 4 THEN 'contribution_invalid_position' END,
 CASE WHEN kind = 'error' AND (k IS NULL OR i % 3 = 2) THEN 'error_invalid_actor' END, CASE WHEN kind = 'error' AND (k IS NULL OR i % 4 = 0) THEN 'error_payload_missing' END, CASE WHEN kind = 'cancelled' AND (k IS NULL OR i % 4 = 0) THEN 'cancellation_missing' END,
 CASE WHEN kind IN ('error', 'cancelled') AND k IS NULL THEN kind || '_invalid_target' END, CASE WHEN kind IN ('error', 'cancelled') AND k IS NULL THEN kind || '_invalid_effect' END,
 CASE WHEN kind IN ('error', 'cancelled') AND k IS NOT NULL AND target = 'span' AND span_id IS NULL THEN 'target_span_requires_span' END, CASE WHEN kind IN ('error', 'cancelled') AND k IS NOT NULL AND target = 'trace' AND span_id IS NOT NULL THEN 'target_trace_requires_null_span' END
 ], lambda c: c IS NOT NULL)) FROM v"""
ORACLE["parent_issues"] = V7 + ", s AS (SELECT DISTINCT trace_id, span_id FROM v WHERE kind = 'span_start') SELECT trace_id, span_id, 'unknown_parent_span' AS code FROM s WHERE span_id = 's0' AND NOT EXISTS (SELECT 1 FROM s x WHERE x.trace_id = s.trace_id AND x.span_id = 's1')"
_JSON = """CASE WHEN {0} IS NULL THEN 'null' ELSE '"' || {0} || '"' END"""
ORACLE["event_digest"] = V7 + f"""SELECT trace_id, event_id, seq, sha256('{{"capturedAt":"' || captured_at || '","eventId":"' || event_id || '","evidenceStatus":"' || status || '",' || CASE WHEN k IS NULL OR kind IN ('interaction_start', 'interaction_end', 'span_start', 'span_end') THEN '' ELSE '"k":' || k || ',' END
 || '"kind":"' || kind || '",' || CASE WHEN role IS NULL OR kind IN ('interaction_start', 'interaction_end', 'span_start', 'span_end') THEN '' ELSE '"observationRole":"' || role || '",' END || '"seq":' || seq || ',"spanId":' || {_JSON.format('span_id')} || ',"traceId":"' || trace_id || '"}}') AS digest FROM v"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in mapping.items()) + " END"


_FIXED = ", ".join(f"({i}, '{p}', {_quoted(o or '')}, {_quoted(r or '')})" for i, (p, o, r) in enumerate(losses.LOSSES))
_ERRORS = ", ".join(f"({2 + len(losses.FIELD_LOSSES) + i}, '{name}', {_quoted(why)})" for i, (name, why) in enumerate(losses.ERROR_LOSSES))
_FIELDS = ", ".join(f"({2 + i}, {list(kinds)}, '$.{there}', '{told or there}', {there == 'contextContributions'}, {_quoted(why)})" for i, (kinds, there, told, why) in enumerate(losses.FIELD_LOSSES))
_ROLE = "CASE role WHEN 'application_constructed' THEN 'transformed' WHEN 'client_sent' THEN 'sent' WHEN 'provider_reported' THEN 'observed' WHEN 'returned' THEN 'returned' END"
_LOSSES = f""", g AS (SELECT st.trace_id, any_value(st.status) AS status, (array_agg(v.model ORDER BY v.seq) FILTER (v.kind = 'model_request'))[1] AS model, bool_or(v.kind = 'span_start' AND v.span_id IS NOT NULL) AS spans FROM st JOIN v USING (trace_id) GROUP BY 1),
 f(item, path, outcome, reason) AS (VALUES {_FIXED}), m AS (SELECT *, KIND IS NOT NULL AS kept, {_ROLE} AS phase FROM v),
 o AS (SELECT trace_id, 0 AS section, 0 AS event, item, CASE WHEN item = 6 AND model IS NOT NULL THEN 'trace.events[].requestEnvelope' ELSE path END AS path,
  CASE item WHEN 3 THEN CASE WHEN status = 'unknown' THEN 'unavailable' ELSE 'exact' END WHEN 6 THEN CASE WHEN model IS NULL THEN 'unavailable' ELSE 'inferred' END ELSE outcome END AS outcome,
  CASE item WHEN 3 THEN CASE WHEN status = 'unknown' THEN 'canonical trace has no observed terminal time (status "unknown"); legacy endedAt is omitted' ELSE {_quoted(losses.FINISHED)} END WHEN 4 THEN {_cases('status', losses.STATUS_REASONS)}
   WHEN 6 THEN CASE WHEN model IS NULL THEN {_quoted(losses.NO_PROVIDER)} ELSE {_quoted(losses.INFERRED[1])} END ELSE reason END AS reason FROM g, f
  UNION ALL SELECT trace_id, 1, 0, 0, 'trace.spans', 'unavailable', {_quoted(losses.SPANS)} FROM g WHERE spans
  UNION ALL SELECT trace_id, 2, seq, 0, 'events[' || seq || ']', CASE WHEN kept THEN 'partial' ELSE 'unavailable' END, CASE WHEN kept THEN 'kind "' || kind || '": ' || {_cases('kind', losses.KIND_REASONS)}
    || CASE WHEN phase IS NOT NULL THEN '; observationRole "' || role || '" approximated by ContentPhase "' || phase || '"' WHEN role = 'unobservable' THEN '; observationRole "unobservable" has no ContentPhase approximation' ELSE '' END
   ELSE 'canonical event kind "' || kind || '" has no legacy TraceEventType; omitted from the legacy trace view' END FROM m
  UNION ALL SELECT trace_id, 2, seq, 1, 'events[' || seq || '].observationRole', 'unavailable', {_quoted(losses.UNOBSERVABLE)} FROM m WHERE kept AND role = 'unobservable'
  UNION ALL SELECT trace_id, 2, seq, n, 'events[' || seq || '].' || x, 'unavailable', why FROM m, (VALUES {_ERRORS}) l(n, x, why) WHERE kind = 'error')"""
_LOSS_ROWS = " SELECT trace_id, section, event, item, path, 'evidence_to_legacy_trace' AS stage, outcome, reason FROM o"
ORACLE["loss_mappings"] = V7 + ", " + _TRACE + _LOSSES.replace("KIND IS NOT NULL", f"{_KIND} IS NOT NULL") + _LOSS_ROWS
_KINDS = ", ".join(f"'{k}'" for k in EVENT_KINDS)
V9 = V7.replace("v AS (SELECT", "v7 AS (SELECT") + f""", v8 AS (SELECT trace_id, event_id, seq, i, captured_at, role, span_id, [{_KINDS}][i % {len(EVENT_KINDS)} + 1] AS kind, CAST(floor(i / {len(EVENT_KINDS)}) AS BIGINT) AS j FROM v7),
 v AS (SELECT *, {RECORD_PAYLOAD} AS payload, CASE WHEN kind IN ('error', 'cancelled') THEN CASE WHEN j % 2 = 0 THEN 'trace' ELSE 'span' END END AS target, CASE kind WHEN 'error' THEN 'fail' WHEN 'cancelled' THEN 'cancel' END AS effect,
  CASE WHEN kind = 'model_request' THEN 'm' || (j % 4) END AS model FROM v8) """
_MAPPED = ", ".join(f"'{k}'" for k in losses.KIND_REASONS)
ORACLE["loss_report"] = V9 + ", " + _TRACE + _LOSSES.replace("KIND IS NOT NULL", f"kind IN ({_MAPPED})") + f""", sp AS (SELECT trace_id, j, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS place FROM v WHERE kind = 'span_start' AND span_id IS NOT NULL),
 q AS (SELECT * FROM o UNION ALL SELECT DISTINCT trace_id, 0, 0, {len(losses.LOSSES)}, 'trace.conditions', 'unavailable', {_quoted(losses.CONDITIONS)} FROM v WHERE i % 50 = 0
  UNION ALL SELECT trace_id, 1, place, 1, 'trace.spans[' || place || '].durationMs', 'unavailable', {_quoted(losses.SPAN_LOSSES[0][1])} FROM sp WHERE j % 2 = 0
  UNION ALL SELECT trace_id, 1, place, 2, 'trace.spans[' || place || '].participants', 'unavailable', {_quoted(losses.SPAN_LOSSES[1][1])} FROM sp WHERE j % 3 = 0
  UNION ALL SELECT trace_id, 2, seq, n, 'events[' || seq || '].' || told, 'unavailable', why FROM v, (VALUES {_FIELDS}) l(n, kinds, there, told, listed, why)
   WHERE list_contains(kinds, kind) AND coalesce(json_type(payload, there), 'NULL') <> 'NULL' AND (NOT listed OR json_type(payload, there) = 'ARRAY')
  UNION ALL SELECT trace_id, 3, seq, n, 'rawObservations[' || seq || '].payload.' || x, 'unavailable', why FROM v, (VALUES {', '.join(f"({i}, '{n}', {_quoted(w)})" for i, (n, w) in enumerate(losses.DECLARATION_LOSSES))}) l(n, x, why) WHERE coalesce(json_type(payload, '$.' || x), 'NULL') <> 'NULL')
""" + _LOSS_ROWS.replace("FROM o", "FROM q")
_BUCKETS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.ISSUE_BUCKETS.items())
ORACLE["issue_buckets"] = f"SELECT *, CASE code {_BUCKETS} ELSE 'invalid_evidence_record' END AS bucket FROM ({ORACLE['evidence_issues']})"
_TRACES = """e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS o, 'ev-' || event_id AS event_id, CASE event_type WHEN 'view' THEN 'inference' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'message' WHEN 'purchase' THEN 'egress_response' ELSE 'provider_error' END AS type,
 CASE event_type WHEN 'click' THEN 'said' WHEN 'signup' THEN 'generated' WHEN 'purchase' THEN 'returned' ELSE 'observed' END AS phase FROM events) """
_ENTRY = losses.ENTRY_MESSAGES
ORACLE["trace_entry_issues"] = f"""WITH {_TRACES}, n AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY o) - 1 AS k, CASE WHEN o % 11 = 0 THEN '{_ENTRY['id']}' WHEN o % 13 = 0 THEN '{_ENTRY['timestamp']}' WHEN o % 17 = 0 THEN '{_ENTRY['type']}' WHEN o % 19 = 0 THEN '{_ENTRY['contentPhase']}'
 WHEN o % 23 = 0 THEN '{_ENTRY['sourceType']}' END AS message FROM e) SELECT trace_id, 'events[' || k || ']' AS path, 'invalid_legacy_event' AS code, message FROM n WHERE message IS NOT NULL"""


def _run_sql(traces: str, events: str) -> str:
    """Views r(trace_id, section, turn, item, path, outcome, reason) over traces (trace_id, provider, model, agent, task, meta) and events (trace_id, o, turn, block, said)."""
    fields = " UNION ALL ".join(
        f"SELECT trace_id, 0 AS section, 0 AS turn, {2 + i} AS item, '{c}' AS path, CASE WHEN {c} IS NULL THEN 'unavailable' ELSE 'exact' END AS outcome, CASE WHEN {c} IS NULL THEN 'legacy trace carries no {c}' ELSE '{c} is preserved from the legacy trace' END AS reason FROM rt" for i, c in enumerate(losses.RUN_FIELDS))
    fixed = ", ".join(f"({i}, '{p}', {_quoted(w)})" for i, (p, w) in [(0, losses.RUN_EXACT[0]), (1, losses.RUN_EXACT[1]), (6, ("turns", losses.RUN_TURNS))])
    return f"""rt AS ({traces}), re AS ({events}), rb AS (SELECT *, row_number() OVER (PARTITION BY trace_id, turn ORDER BY o) - 1 AS k FROM re WHERE block), r AS ({fields}
 UNION ALL SELECT trace_id, 0, 0, i, p, 'exact', w FROM rt, (VALUES {fixed}) l(i, p, w)
 UNION ALL SELECT DISTINCT trace_id, 1, turn, -1, 'turns[' || turn || '].id', 'inferred', {_quoted(losses.RUN_IDS['turn'])} FROM re
 UNION ALL SELECT trace_id, 1, turn, k, 'turns[' || turn || '].contextBlocks[' || k || '].id', 'inferred', {_quoted(losses.RUN_IDS['block'])} FROM rb
 UNION ALL SELECT trace_id, 2, 0, 0, 'turns[].contextBlocks[].content', CASE WHEN s THEN 'partial' ELSE 'unavailable' END, CASE WHEN s THEN {_quoted(losses.RUN_CONTENT[0])} ELSE {_quoted(losses.RUN_CONTENT[1])} END
  FROM (SELECT trace_id, trace_id IN (SELECT trace_id FROM re WHERE block AND said) AS s FROM rt)
 UNION ALL SELECT trace_id, 2, 0, 1, 'metadata.traceMetadata', CASE WHEN meta THEN 'partial' ELSE 'unavailable' END, CASE WHEN meta THEN {_quoted(losses.RUN_METADATA[0])} ELSE {_quoted(losses.RUN_METADATA[1])} END FROM rt) """


_RUN = "SELECT trace_id, section, CAST(turn AS BIGINT) AS turn, item, path, 'legacy_trace_to_agent_run' AS stage, outcome, reason FROM r"
ORACLE["run_report"] = f"WITH {_TRACES}, " + _run_sql(
    "SELECT DISTINCT trace_id, CASE WHEN length(trace_id) % 2 = 0 THEN 'p' END AS provider, 'm' AS model, CAST(NULL AS VARCHAR) AS agent, CASE WHEN length(trace_id) % 3 > 0 THEN 't' END AS task, length(trace_id) % 2 = 0 AS meta FROM e",
    "SELECT trace_id, o, CAST(coalesce(sum(CASE WHEN type = 'egress_response' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn, type IN ('message', 'egress_response') AS block, true AS said FROM e",
) + _RUN
ORACLE["evidence_run_report"] = V7 + ", " + _TRACE + _LOSSES.replace("KIND IS NOT NULL", f"{_KIND} IS NOT NULL") + ", " + _run_sql(
    "SELECT trace_id, CAST(NULL AS VARCHAR) AS provider, model, CAST(NULL AS VARCHAR) AS agent, CAST(NULL AS VARCHAR) AS task, false AS meta FROM g",
    "SELECT trace_id, seq AS o, 0 AS turn, kind = 'model_request' AS block, false AS said FROM v WHERE kind IN ('model_request', 'error')",
) + "SELECT trace_id, 0 AS part, section, event AS place, item, path, 'evidence_to_legacy_trace' AS stage, outcome, reason FROM o UNION ALL SELECT trace_id, 1, section, turn, item, path, 'legacy_trace_to_agent_run', outcome, reason FROM r"
ORACLE["record_views"] = V7 + """, n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS total, lag(i) OVER (PARTITION BY trace_id ORDER BY seq) AS prior FROM v), k AS (SELECT *, CASE WHEN seq = 0 THEN 'interaction_start' WHEN seq = total - 1 AND t = 'purchase' THEN 'interaction_end' ELSE 'tool_result' END AS kd FROM n),
 c AS (SELECT trace_id, code FROM k, (VALUES (1, 'invalid_observation_role'), (2, 'raw_captured_at_invalid')) l(x, code) WHERE CASE x WHEN 1 THEN kd = 'tool_result' AND i % 97 = 0 ELSE i % 89 = 0 END), b AS (SELECT trace_id, string_agg(code, ',' ORDER BY code) AS codes FROM c GROUP BY 1)
 SELECT k.trace_id, coalesce(any_value(codes), '') AS codes, CASE WHEN any_value(codes) IS NULL THEN CASE WHEN bool_or(kd = 'interaction_end') THEN 'completed' ELSE 'unknown' END END AS status, CASE WHEN any_value(codes) IS NULL THEN min(substr(captured_at, 1, 23) || 'Z') FILTER (seq = 0) END AS started_at,
 CASE WHEN any_value(codes) IS NULL THEN 'boundary(captureSurface=mcp; observationBoundary=returned; declaredEventKinds=[error,retry]; declaredSurfaces=[mcp]; missing=late reportedBy=tool/client_sent; events=' || count(*) || ')' END AS statement,
 CASE WHEN any_value(codes) IS NULL THEN count(*) FILTER (i % 5 = 1) ELSE 0 END AS redacted, CASE WHEN any_value(codes) IS NULL THEN count(*) FILTER (prior % 9 = 0) ELSE 0 END AS gaps FROM k LEFT JOIN b ON b.trace_id = k.trace_id GROUP BY 1"""
