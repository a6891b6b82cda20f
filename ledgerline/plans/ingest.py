"""Queries over exchanges, redaction, routing and retention, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerline.functions.text import RULES, B, E, credential_like, display_hash, html_escape, redact, redact_and_truncate, token_estimate
from ledgerline.operators import ingest, metadata
from ledgerline.sources import runs
from ledgerline.sources.tables import table

TOKEN = r'token\s*=\s*"[0-9a-f]+"'
NOW = "1997-06-30 00:00:00"
PROVIDERS = [
    (0, "alpha", None, [("Brand#11", ["Brand#12"])]), (1, "beta", "Brand#22", [("Brand#12", ["Brand#23"]), ("Brand#21", [])]), (2, "gamma", None, [("Brand#31", ["Brand#11"])]),
]


def _providers(spark):
    return spark.createDataFrame(PROVIDERS, "ordinal int, id string, default_model string, models array<struct<id:string,aliases:array<string>>>")


def redact_custom(spark, d):
    return table(spark, d, "documents").select("doc_id", redact(F.col("text"), [TOKEN]).alias("redacted"))


def redact_builtin_planted(spark, d):
    text = F.concat(F.lit("api_key="), F.col("event_id").cast("string"), F.lit("; use Bearer abc"), F.col("user_id").cast("string"), F.lit(" now; my sk-abcdefgh"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", redact(text).alias("redacted"))


def redact_truncate(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", redact_and_truncate(F.col("text"), 240, [TOKEN]).alias("excerpt"))


def credential_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", credential_like(F.coalesce("text", F.lit("")), [TOKEN]).alias("credential_like"))


def token_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def display_hashes(spark, d):
    return table(spark, d, "events").select("event_id", display_hash(F.concat_ws("::", "event_type", "props")).alias("hash"))


def escaped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", html_escape(F.col("html")).alias("escaped"))


def metadata_sanitise(spark, d):
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"apiKey":"x","note":"api_key='), F.col("event_id").cast("string"), F.lit('","nested":{"totalTokens":5,"kept":"a"},"empty":{"secret":1},"list":["b",{"auth":1}]}'))
    return table(spark, d, "events").select("event_id", metadata.rewrite(text, "storage").alias("stored"))


def payload_policy(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    mode = F.when(i % 3 == 0, "minimal").when(i % 3 == 1, "standard").otherwise("debug")
    rows = e.select("event_id", mode.alias("mode"), ingest.capture_policy(mode).alias("p"), F.concat(F.lit("p-"), i.cast("string")).alias("payload_id"), F.when(i % 2 == 0, F.concat(F.lit("api_key="), i.cast("string"))).otherwise(F.concat(F.lit("key-"), i.cast("string"))).alias("storage_key"),
                    F.when(i % 5 > 0, F.concat(F.lit("secret="), i.cast("string"), F.lit(", ok"))).alias("excerpt"), F.lit(False).alias("payload_redacted"))
    return ingest.sanitise_payload(rows.select("*", "p.raw_payloads", "p.excerpts")).select("event_id", "mode", "payload_id", "storage_key", "excerpt", "payload_redacted")


def provider_models(spark, d):
    """Brands of parts as models of the parts' types."""
    made = table(spark, d, "part").groupBy(F.col("p_type").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("p_brand").alias("id")))).alias("models"))
    return ingest.provider_models(made)


def route_models(spark, d):
    return ingest.route(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model")), _providers(spark))


def exchange_outcome(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", (i % 13 != 0).alias("body_ok"), (i % 17 == 0).alias("body_too_large"), (i % 11 != 0).alias("has_provider"), (i % 19 != 0).alias("has_key"), (i % 7 == 0).alias("upstream_failed"),
        F.when(i % 5 == 0, 429).when(i % 5 == 1, 302).otherwise(200).alias("http_status"), (i % 3 != 0).alias("body_is_object"))
    return ingest.outcome(rows).select("event_id", "traced", "trace_status", "error_type", "client_status")


def _retained(spark, d):
    o = table(spark, d, "orders")
    days = F.when(F.col("o_orderkey") % 3 == 1, 30).when(F.col("o_orderkey") % 3 == 2, 90)
    return ingest.expiry(o.select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderdate").alias("created_at"), days.alias("retention_days")))


def _text(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def retention_expiry(spark, d):
    return _text(_retained(spark, d), "created_at", "expires_at")


def purge_expired(spark, d):
    return ingest.purge(_retained(spark, d), NOW).select("trace_id")


def cascade_delete(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), "l_linenumber")
    return ingest.cascade(rows, ingest.purge(_retained(spark, d), NOW)).groupBy("trace_id").agg(F.count("*").alias("events"))


def list_page(spark, d):
    return _text(ingest.page(_retained(spark, d), 100, 50), "created_at", "expires_at")


def append_verdicts(spark, d):
    """Every event comes to a store that has the first text of each key, those of the stored part again."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("text"), "event_id")
    old = e.where("event_id % 3 = 0").groupBy("k").agg(F.min("text").alias("text"))
    return ingest.classify_append(old, e, "k", "text").groupBy("k", "text", "verdict").agg(F.count("*").alias("n"))


def assembled_traces(spark, d):
    """A trace of each conversation's exchange, a few without a model or an answer."""
    i = F.col("conv_id")
    request = F.when(i % 3 > 0, F.concat(F.lit('{"model":"q'), (i % 4).cast("string"), F.lit('"}'))).otherwise("{}")
    response = F.when(i % 5 == 0, "oops").when(i % 7 > 0, '{"model":"r"}').otherwise("{}")
    rows = table(spark, d, "conversations").select("conv_id").distinct().select(i.cast("string").alias("trace_id"), F.lit("2024-01-01T00:00:00Z").alias("captured_at"), F.when(i % 2 == 0, "alpha").otherwise("beta").alias("provider"), request.alias("request"), response.alias("response"))
    return ingest.assemble_traces(rows, {"beta": "b"}).select("trace_id", "provider", "model", "mode", "status", "expires_at")


def exchange_trace_events(spark, d):
    c = table(spark, d, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    request = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("content")).alias("message"))).alias("choices"), F.struct((F.col("conv_id") % 50).alias("prompt_tokens"), F.lit(7).alias("completion_tokens"), (F.col("conv_id") % 50 + 7).alias("total_tokens")).alias("usage")))
    x = m.select(F.col("conv_id").cast("string").alias("trace_id"), F.lit("alpha").alias("provider"), request.alias("request"), response.alias("response"))
    return runs.exchange_events(x).select("trace_id", "event_ordinal", "type", "content_phase", "actor_role", "tokens", "routing_decision", "size")


QUERIES = {f.__name__: f for f in (
    redact_custom, redact_builtin_planted, redact_truncate, credential_texts, token_sizes, display_hashes, escaped_pages, metadata_sanitise, payload_policy, provider_models, route_models, exchange_outcome,
    retention_expiry, purge_expired, cascade_delete, list_page, append_verdicts, assembled_traces, exchange_trace_events,
)}
_T = r"(?i)token\s*=\s*\"[0-9a-f]+\""


def _rules_sql(text: str) -> str:
    """text after the built-in rules, whose looks to the side are word boundaries in DuckDB."""
    for pattern, to in RULES:
        pattern = re.sub(r"\(\?:\(\?<=.*\)$", r"\\b", pattern).replace(B, r"\b").replace(E, r"\b")
        pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return text


_O = """WITH t AS (SELECT o_orderkey AS trace_id, o_orderdate AS created_at, CASE o_orderkey % 3 WHEN 1 THEN 30 WHEN 2 THEN 90 END AS retention_days FROM orders), r AS (SELECT *, created_at + to_days(CAST(retention_days AS INTEGER)) AS expires_at FROM t),
 x AS (SELECT * FROM r WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '1997-06-30 00:00:00') """
_TEXT = "trace_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, retention_days, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at"
ORACLE = {
    "redact_custom": f"SELECT doc_id, {_rules_sql(f"regexp_replace(text, '{_T}', '[REDACTED]', 'g')")} AS redacted FROM documents",
    "redact_builtin_planted": "SELECT event_id, 'api_key=[REDACTED]; use Bearer [REDACTED] now; my [REDACTED_API_KEY]' AS redacted FROM events",
    "redact_truncate": f"WITH r AS (SELECT doc_id, regexp_replace(text, '{_T}', '[REDACTED]', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE left(t, 239) || '…' END AS excerpt FROM r",
    "credential_texts": f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{_T}') AS credential_like FROM documents",
    "token_sizes": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents",
    "display_hashes": """SELECT event_id, lower(to_hex(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(event_type || '::' || props, ''), lambda c: CAST(ord(c) AS BIGINT))),
 lambda h, c: CASE WHEN (((h * 31 + c) % 4294967296) + 4294967296) % 4294967296 >= 2147483648 THEN (((h * 31 + c) % 4294967296) + 4294967296) % 4294967296 - 4294967296 ELSE (((h * 31 + c) % 4294967296) + 4294967296) % 4294967296 END)))) AS hash FROM events""",
    "escaped_pages": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "metadata_sanitise": """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"nested":{"kept":"a"},"list":["b"]}' AS stored FROM events""",
    "payload_policy": """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'standard' ELSE 'debug' END AS mode FROM events)
 SELECT event_id, mode, CASE WHEN mode = 'debug' OR (mode = 'standard' AND event_id % 5 > 0) THEN 'p-' || event_id END AS payload_id, CASE WHEN mode = 'debug' AND event_id % 2 = 1 THEN 'key-' || event_id END AS storage_key,
 CASE WHEN mode <> 'minimal' AND event_id % 5 > 0 THEN 'secret=[REDACTED], ok' END AS excerpt, CASE WHEN mode = 'debug' THEN false WHEN mode = 'standard' AND event_id % 5 > 0 THEN true END AS payload_redacted FROM e""",
    "provider_models": "SELECT DISTINCT p_brand AS id, p_type AS owned_by FROM part",
    "route_models": "SELECT p_partkey, p_brand AS model, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'alpha' WHEN p_brand IN ('Brand#23', 'Brand#21') THEN 'beta' WHEN p_brand = 'Brand#31' THEN 'gamma' ELSE 'beta' END AS provider FROM part",
    "exchange_outcome": """WITH e AS (SELECT event_id AS i, event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 11 = 0 OR event_id % 19 = 0 AS pre, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 302 ELSE 200 END AS s FROM events),
 f AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'upstream_request_error' WHEN s <> 200 THEN 'upstream_non_2xx' WHEN i % 3 = 0 THEN 'upstream_invalid_body' END AS err FROM e)
 SELECT i AS event_id, NOT pre AS traced, CASE WHEN NOT pre THEN CASE WHEN err IS NULL THEN 'success' ELSE 'error' END END AS trace_status, CASE WHEN NOT pre THEN err END AS error_type,
 CAST(CASE WHEN i % 17 = 0 THEN 413 WHEN i % 13 = 0 OR i % 11 = 0 THEN 400 WHEN i % 19 = 0 THEN 500 WHEN i % 7 = 0 THEN 502 WHEN s = 429 THEN 429 WHEN s = 302 THEN 502 WHEN i % 3 = 0 THEN 502 ELSE 200 END AS INTEGER) AS client_status FROM f""",
    "retention_expiry": _O + f"SELECT {_TEXT} FROM r",
    "purge_expired": _O + "SELECT trace_id FROM x",
    "cascade_delete": _O + "SELECT l_orderkey AS trace_id, count(*) AS events FROM lineitem WHERE l_orderkey IN (SELECT trace_id FROM x) GROUP BY 1",
    "list_page": _O + f"SELECT {_TEXT} FROM (SELECT * FROM r ORDER BY r.created_at DESC, trace_id LIMIT 100 OFFSET 50)",
    "append_verdicts": """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS k, min(event_type) AS h FROM events WHERE event_id % 3 = 0 GROUP BY 1), n AS (SELECT CAST(user_id AS VARCHAR) AS k, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS n, min(event_type) OVER (PARTITION BY user_id) AS lo FROM events)
 SELECT n.k, text, CASE WHEN h IS NOT NULL THEN CASE WHEN h = text THEN 'already_present' ELSE 'conflict' END WHEN n = 1 THEN 'stored' WHEN text = lo THEN 'already_present' ELSE 'conflict' END AS verdict, count(*) AS n FROM n LEFT JOIN o ON o.k = n.k GROUP BY ALL""",
    "assembled_traces": """SELECT CAST(conv_id AS VARCHAR) AS trace_id, CASE WHEN conv_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, CASE WHEN conv_id % 5 > 0 AND conv_id % 7 > 0 THEN 'r' WHEN conv_id % 3 > 0 THEN 'q' || (conv_id % 4) WHEN conv_id % 2 = 1 THEN 'b' END AS model, 'standard' AS mode,
 CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, CAST(NULL AS VARCHAR) AS expires_at FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "exchange_trace_events": """WITH c AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS o FROM conversations WHERE role IN ('system', 'user', 'assistant')), z AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1)
 SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(o AS INTEGER) AS event_ordinal, CASE role WHEN 'system' THEN 'instruction' ELSE 'message' END AS type, CASE role WHEN 'user' THEN 'said' ELSE 'sent' END AS content_phase, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS actor_role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(NULL AS VARCHAR) AS routing_decision, length(text) AS size FROM c
 UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(n + k AS INTEGER), t, p, a, CASE t WHEN 'message' THEN 1 WHEN 'inference' THEN conv_id % 50 + 7 END, r, CASE t WHEN 'message' THEN 4 END FROM z, (VALUES (0, 'provider_request', 'requested', 'ingress', 'routed to alpha'), (1, 'provider_response', 'observed', 'provider', NULL), (2, 'message', 'generated', 'model', NULL), (3, 'inference', 'observed', 'provider', NULL), (4, 'egress_response', 'returned', 'ingress', NULL)) v(k, t, p, a, r)""",
}
