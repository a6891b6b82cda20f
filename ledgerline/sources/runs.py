"""Run JSON files as runs, turns and blocks, and chat exchanges as trace events.

Files are read with a fixed schema; rows that aren't runs go to a quarantine with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import choose, redact_and_truncate, token_estimate, utf16_length
from ledgerline.functions.vocabulary import EXCERPT, ROLE_TO_SOURCE, SOURCE_TYPES

TURNS = """array<struct<id:string,turnNumber:bigint,outputTokens:bigint,metadata:string,messages:array<struct<role:string,content:string>>,
toolCalls:array<struct<id:string,name:string,arguments:string,output:string>>,contextBlocks:array<struct<id:string,sourceType:string,name:string,content:string>>>>"""
RUN = f"id string, name string, model string, provider string, agent string, task string, outputTokens bigint, metadata string, turns {TURNS}"
BLOCK = "array<struct<id:string,source:string,name:string,content:string>>"
EVENT = "array<struct<type:string,content_phase:string,source_type:string,actor_role:string,tokens:bigint,text:string,routing_decision:string,metadata:string>>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return parse_runs(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def parse_runs(texts: DataFrame) -> DataFrame:
    """texts (json) with the run's fields and `problem`: why it is no run, or null."""
    v = F.try_parse_json("json")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    bad = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(F.coalesce(kind("$.id"), F.lit("")) != "STRING", "no id").when(F.coalesce(kind("$.name"), F.lit("")) != "STRING", "no name")
        .when(~F.coalesce(kind("$.turns"), F.lit("")).startswith("ARRAY"), "no turns")
    )
    return texts.withColumn("problem", bad).withColumn("run", F.when(bad.isNull(), F.from_json("json", RUN))).select("problem", "json", "run.*")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem is not null").select("json", "problem")


def runs(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem is null").select(F.col("id").alias("run_id"), "name", "model", "provider", "agent", "task", F.col("outputTokens").alias("output_tokens"), "metadata")


def turns(parsed: DataFrame) -> DataFrame:
    """run_id, turn_id (turn-N by default), turn_number (its place by default), output_tokens; turns without blocks too."""
    each = parsed.where("problem is null").select(F.col("id").alias("run_id"), F.posexplode("turns").alias("at", "t"))
    return each.select("run_id", _turn_id().alias("turn_id"), F.coalesce("t.turnNumber", F.col("at") + 1).cast("long").alias("turn_number"), F.col("t.outputTokens").alias("output_tokens"), "at", "t")


def _turn_id() -> Column:
    return F.coalesce(F.col("t.id"), F.concat(F.lit("turn-"), (F.col("at") + 1).cast("string")))


def blocks(parsed: DataFrame) -> DataFrame:
    """Blocks in order: a turn's messages, then its tool calls (call, output), then its own blocks."""
    t = turns(parsed)
    tid = F.col("turn_id")

    def message(m):
        source = choose(m["role"], ROLE_TO_SOURCE, F.lit("unknown"))
        return F.struct(F.concat_ws("-", F.lit("msg"), tid, F.coalesce(m["role"], F.lit("unknown"))).alias("id"), source.alias("source"), source.alias("name"), F.coalesce(m["content"], F.lit("")).alias("content"))

    def calls(c):
        ident, name = F.coalesce(c["id"], F.concat(F.lit("tc-"), tid)), F.coalesce(c["name"], F.lit("tool"))
        call = F.struct(F.concat(ident, F.lit("-call")).alias("id"), F.lit("tool_call").alias("source"), name.alias("name"), F.concat_ws(" ", name, F.coalesce(c["arguments"], F.lit("{}"))).alias("content"))
        out = F.struct(F.concat(ident, F.lit("-output")).alias("id"), F.lit("tool_output").alias("source"), F.concat(name, F.lit("-output")).alias("name"), c["output"].alias("content"))
        return F.when(c["output"].isNull(), F.array(call)).otherwise(F.array(call, out))

    def own(b):
        source = F.when(b["sourceType"].isin(*SOURCE_TYPES), b["sourceType"]).otherwise("unknown")
        return F.struct(F.coalesce(b["id"], F.concat(F.lit("block-"), tid)).alias("id"), source.alias("source"), b["name"].alias("name"), F.coalesce(b["content"], F.lit("")).alias("content"))

    none = F.array().cast(BLOCK)
    parts = F.concat(
        F.coalesce(F.transform("t.messages", message).cast(BLOCK), none), F.coalesce(F.flatten(F.transform("t.toolCalls", calls)).cast(BLOCK), none), F.coalesce(F.transform("t.contextBlocks", own).cast(BLOCK), none))
    each = t.select("run_id", "turn_id", "turn_number", "at", F.posexplode(parts).alias("n", "b"))
    return each.select(
        "run_id", "turn_id", "turn_number", F.col("b.id").alias("block_id"), F.col("b.source").alias("source_type"), F.col("b.name").alias("name"), F.col("b.content").alias("content"),
        F.lit(None).cast("long").alias("captured_tokens"), (F.col("at").cast("long") * 1_000_000_000 + F.col("n")).alias("ordinal"),
    )


def _event(type_: str, phase: str, source: Column, role: str, text: Column | None, routing: Column | None = None, metadata: Column | None = None, tokens: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    counted = (token_estimate(text) if text is not None else F.lit(None).cast("long")) if tokens is None else tokens
    return F.struct(F.lit(type_).alias("type"), F.lit(phase).alias("content_phase"), source.cast("string").alias("source_type"), F.lit(role).alias("actor_role"), counted.alias("tokens"), (null if text is None else text).alias("text"), (null if routing is None else routing).alias("routing_decision"), (null if metadata is None else metadata).alias("metadata"))


def exchange_events(exchanges: DataFrame) -> DataFrame:
    """Trace events of chat exchanges (trace_id, provider, model, request and response as JSON), in order.

    Request: system, user and assistant messages (others drop), tool schemas, the provider request.  Response: the
    provider response, a message for each choice, usage if there is any, the egress response.
    """
    shape = "model string, messages array<struct<role:string,content:string>>, tools array<string>"
    answer = "model string, choices array<struct<message:struct<role:string,content:string>>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
    x = exchanges.select("trace_id", "provider", "response", F.from_json("request", shape).alias("q"), F.from_json("response", answer).alias("a"))
    empty, null = F.array().cast(EVENT), F.lit(None)

    def message(m):
        text = F.coalesce(m["content"], F.lit(""))
        return F.when(m["role"] == "system", _event("instruction", "sent", F.lit("system_instruction"), "system", text)).when(m["role"] == "user", _event("message", "said", F.lit("user_message"), "user", text)).when(
            m["role"] == "assistant", _event("message", "sent", F.lit("assistant_message"), "model", text))

    told = F.to_json(F.struct(F.size(F.coalesce("q.messages", F.array())).alias("messageCount"), F.size(F.coalesce("q.tools", F.array())).alias("toolCount")))
    usage = F.col("a.usage")
    total = F.coalesce(usage["total_tokens"], F.coalesce(usage["prompt_tokens"], F.lit(0)) + F.coalesce(usage["completion_tokens"], F.lit(0)))
    has = F.coalesce(usage["prompt_tokens"], usage["completion_tokens"], usage["total_tokens"]).isNotNull()
    meta = F.to_json(F.struct(usage["prompt_tokens"].alias("promptTokens"), usage["completion_tokens"].alias("completionTokens"), usage["total_tokens"].alias("totalTokens")))
    parts = [
        F.coalesce(F.array_compact(F.transform("q.messages", message)).cast(EVENT), empty),
        F.coalesce(F.transform("q.tools", lambda t: _event("context", "requested", F.lit("tool_call"), "agent", t)).cast(EVENT), empty),
        F.array(_event("provider_request", "requested", null, "ingress", None, F.concat(F.lit("routed to "), "provider"), told)).cast(EVENT),
        F.when(F.col("a").isNotNull() & F.col("response").isNotNull(), F.concat(
            F.array(_event("provider_response", "observed", null, "provider", None)).cast(EVENT),
            F.coalesce(F.transform("a.choices", lambda c: _event("message", "generated", F.lit("assistant_message"), "model", F.coalesce(c["message"]["content"], F.lit("")))).cast(EVENT), empty),
            F.when(has, F.array(_event("inference", "observed", null, "provider", None, None, meta, total)).cast(EVENT)).otherwise(empty),
            F.array(_event("egress_response", "returned", null, "ingress", None, None, F.to_json(F.struct(F.size(F.coalesce("a.choices", F.array())).alias("choiceCount"))))).cast(EVENT))).otherwise(empty),
    ]
    each = x.select("trace_id", "provider", F.coalesce("a.model", "q.model").alias("model"), F.posexplode(F.concat(*parts)).alias("event_ordinal", "e"))
    told = lambda k: F.get_json_object("e.metadata", f"$.{k}").cast("long")
    return each.select(
        "trace_id", F.concat_ws("-", "trace_id", F.col("event_ordinal").cast("string")).alias("event_id"), "event_ordinal", "provider", "model", *(F.col(f"e.{c}").alias(c) for c in ("type", "content_phase", "source_type", "actor_role", "tokens", "routing_decision", "metadata")),
        redact_and_truncate(F.col("e.text"), EXCERPT).alias("excerpt"), utf16_length(F.col("e.text")).alias("size"), told("promptTokens").alias("prompt_tokens"), told("completionTokens").alias("completion_tokens"), told("totalTokens").alias("total_tokens"),
    )


def not_available(*_: object) -> DataFrame:
    raise NotImplementedError("this format has no reader yet")


#: Readers by format name; the two placeholders raise.
PARSERS = {"run-json": parse_runs, "opencode": not_available}
ADAPTERS = {"openai-compatible": exchange_events, "anthropic": not_available}
