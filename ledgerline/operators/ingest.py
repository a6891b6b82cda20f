"""Routing, outcomes, capture policies, retention and listing of recorded exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import choose, credential_like, redact, redact_and_truncate
from ledgerline.functions.vocabulary import EXCERPT, PAGE

#: What each mode stores.
POLICIES = {
    "minimal": dict(routing=False, transformations=False, excerpts=False, raw_payloads=False, tool_results=False),
    "standard": dict(routing=True, transformations=True, excerpts=True, raw_payloads=False, tool_results=False),
    "debug": dict(routing=True, transformations=True, excerpts=True, raw_payloads=True, tool_results=True),
}


def capture_policy(mode: Column) -> Column:
    """The default policy by mode; other modes are taken as standard."""
    flags = [F.when(mode == "minimal", POLICIES["minimal"][k]).when(mode == "debug", POLICIES["debug"][k]).otherwise(POLICIES["standard"][k]).alias(k) for k in POLICIES["standard"]]
    return F.struct(*flags, F.lit(EXCERPT).alias("max_excerpt_length"), F.lit(False).alias("store_secrets"), F.lit(False).alias("store_api_keys"))


def provider_models(providers: DataFrame) -> DataFrame:
    """id and owned_by of every model (providers: id, models array of (id, aliases))."""
    return providers.select(F.col("id").alias("owned_by"), F.explode("models").alias("m")).select(F.col("m.id").alias("id"), "owned_by")


def route(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """requests (model) with `provider`: the first that has the model by id or alias; else the first with a default
    model; else the first.  providers: ordinal, id, default_model, models; a configuration, so small by nature.
    """
    names = providers.select("ordinal", "id", F.explode("models").alias("m")).select("ordinal", "id", F.explode(F.concat(F.array("m.id"), F.coalesce("m.aliases", F.array().cast("array<string>")))).alias("model"))
    first = names.groupBy("model").agg(F.min_by("id", "ordinal").alias("named"))
    default = providers.agg(F.min_by("id", F.when(F.col("default_model").isNotNull(), F.col("ordinal"))).alias("a"), F.min_by("id", "ordinal").alias("b")).first()  # one row
    return requests.join(first, "model", "left").withColumn("provider", F.coalesce("named", F.lit(default["a"] or default["b"]))).drop("named")


def outcome(exchanges: DataFrame) -> DataFrame:
    """exchanges (body_ok, body_too_large, has_provider, has_key, upstream_failed, http_status, body_is_object) with traced, trace_status,
    error_type and client_status."""
    pre = ~F.col("body_ok") | F.col("body_too_large") | ~F.col("has_provider") | ~F.col("has_key")
    s = F.col("http_status")
    not_2xx, failed = ~s.between(200, 299), F.col("upstream_failed")
    error = F.when(failed, "upstream_request_error").when(not_2xx, "upstream_non_2xx").when(~F.col("body_is_object"), "upstream_invalid_body")
    status = (
        F.when(F.col("body_too_large"), 413).when(~F.col("body_ok") | ~F.col("has_provider"), 400).when(~F.col("has_key"), 500)
        .when(failed, 502).when(not_2xx, F.when(s.between(400, 599), s).otherwise(502)).when(~F.col("body_is_object"), 502).otherwise(200)
    )
    return exchanges.withColumns({
        "traced": ~pre, "trace_status": F.when(~pre, F.when(error.isNotNull(), "error").otherwise("success")), "error_type": F.when(~pre, error), "client_status": status.cast("int"),
    })


def assemble_traces(exchanges: DataFrame, default_models: dict[str, str] | None = None) -> DataFrame:
    """A trace for each exchange (trace_id, captured_at, provider, request and response as JSON; ended_at, base_url and trace_status if known).

    The model is the response's, else the request's, else the provider's default.  Without a status an exchange without a response that is
    an object is an error.  Traces are stored in standard mode and don't expire.
    """
    field = lambda c: F.col(c) if c in exchanges.columns else F.lit(None).cast("string")
    answered = F.coalesce(F.schema_of_variant(F.try_parse_json("response")).startswith("OBJECT"), F.lit(False))
    status = F.coalesce(field("trace_status"), F.when(answered, "success").otherwise("error"))
    known = choose(F.col("provider"), default_models or {}).cast("string")
    model = F.coalesce(F.get_json_object("response", "$.model"), F.get_json_object("request", "$.model"), known)
    return exchanges.select(
        "trace_id", F.col("captured_at").alias("started_at"), field("ended_at").cast(exchanges.schema["captured_at"].dataType).alias("ended_at"), "provider", model.alias("model"), F.lit("standard").alias("mode"), status.alias("status"),
        F.to_json(F.struct(field("base_url").alias("baseUrl"))).alias("metadata"), F.to_json(capture_policy(F.lit("standard"))).alias("capture_policy"),
        F.col("captured_at").alias("created_at"), F.lit(None).cast(exchanges.schema["captured_at"].dataType).alias("expires_at"),
    )


def sanitise_payload(events: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Payload columns (payload_id, storage_key, excerpt, payload_redacted) as the policy (mode, raw_payloads, excerpts) lets them be stored."""
    debug, short = (F.col("mode") == "debug") & F.col("raw_payloads"), F.col("excerpts") & (F.coalesce("excerpt", F.lit("")) != "")
    text = redact_and_truncate(F.col("excerpt"), EXCERPT, patterns)
    key = F.when(~credential_like(F.col("storage_key"), patterns), F.col("storage_key"))
    return events.withColumns({
        "payload_id": F.when(debug | short, F.col("payload_id")), "storage_key": F.when(debug, key), "excerpt": F.when(debug | short, text),
        "payload_redacted": F.when(debug, F.col("payload_redacted")).when(short, True),
    })


def sanitise_texts(events: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return events.withColumns({c: redact(F.col(c), patterns) for c in ("routing_decision", "transformation_summary") if c in events.columns})


def expiry(traces: DataFrame) -> DataFrame:
    """traces (created_at, retention_days) with expires_at; null without a positive retention."""
    days = F.when(F.col("retention_days") > 0, F.col("retention_days"))
    return traces.withColumn("expires_at", F.col("created_at") + F.make_interval(days=days))


def purge(traces: DataFrame, now: str) -> DataFrame:
    """What remains: traces that don't expire strictly before now."""
    return traces.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast(traces.schema["expires_at"].dataType)))


def cascade(events: DataFrame, traces: DataFrame) -> DataFrame:
    """The events of traces that remain."""
    return events.join(traces.select("trace_id"), "trace_id", "left_semi")


def page(traces: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of the listing: latest first, then by trace_id."""
    return traces.orderBy(F.desc("created_at"), "trace_id").offset(offset).limit(limit)


def classify_append(stored: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """new with `verdict`: stored (unknown key), already_present (same text) or conflict; of repeats the first text counts.

    For an append-only store: only `stored` rows are to be written.
    """
    have = stored.select(F.col(key), F.col(text).alias("_have"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(text))
    rows = new.withColumn("_n", first).join(have, key, "left")
    lowest = F.min(text).over(Window.partitionBy(key))
    verdict = F.when(F.col("_have").isNotNull(), F.when(F.col("_have") == F.col(text), "already_present").otherwise("conflict")).when(F.col("_n") == 1, "stored").when(F.col(text) == lowest, "already_present").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("_n", "_have")
