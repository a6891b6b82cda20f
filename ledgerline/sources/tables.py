"""Views of the synthetic tables in the shapes that the operators take (runs, turns, blocks, events, observations)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import choose, token_estimate
from ledgerline.functions.vocabulary import ROLE_TO_SOURCE

BLOCKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_id", "turn_id")] + [T.StructField("turn_number", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("block_id", "source_type", "name", "content")]
    + [T.StructField("captured_tokens", T.LongType()), T.StructField("ordinal", T.LongType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a run, each of its rows a turn with one block."""
    t = table(spark, sf_dir, "conversations")
    number = F.col("turn") + 1
    turn = F.concat(F.lit("turn-"), number.cast("string"))
    return t.select(
        F.col("conv_id").cast("string").alias("run_id"), turn.alias("turn_id"), number.alias("turn_number"), F.concat_ws("-", F.lit("msg"), turn, "role").alias("block_id"),
        choose(F.col("role"), ROLE_TO_SOURCE, F.lit("unknown")).alias("source_type"), choose(F.col("role"), ROLE_TO_SOURCE, F.lit("unknown")).alias("name"),
        F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("long").alias("captured_tokens"), F.col("turn").alias("ordinal"),
    )


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 97 runs of 7 turns; reading order is by turn, then by doc_id."""
    t = table(spark, sf_dir, "documents")
    kinds = ("project_instruction", "file_tree", "tool_output", "log_output", "build_output", "file_content")
    number, i = F.col("doc_id") % 7 + 1, F.col("doc_id").cast("string")
    named = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("dist/a"), i, F.lit(".js"))).when(F.col("doc_id") % 4 == 1, "pnpm-lock.yaml").otherwise(F.concat(F.lit("src/f"), i, F.lit(".ts")))
    return t.select(
        F.concat(F.lit("r"), (F.col("n_chars") % 97).cast("string")).alias("run_id"), F.concat(F.lit("turn-"), number.cast("string")).alias("turn_id"), number.alias("turn_number"),
        F.concat(F.lit("d-"), i).alias("block_id"), choose(F.col("n_chars") % 6, dict(enumerate(kinds))).alias("source_type"),
        F.when(F.col("n_chars") % 6 == 5, named).otherwise(F.col("source")).alias("name"), F.coalesce("text", F.lit("")).alias("content"),
        F.lit(None).cast("long").alias("captured_tokens"), (number * 1_000_000_000_000 + F.col("doc_id")).alias("ordinal"),
    )


def with_tokens(blocks: DataFrame, estimate: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """tokens: always estimated anew, by any function of the content's column; claimed_tokens: as captured, if they were."""
    own = blocks.withColumn("tokens", estimate(F.col("content")).cast("long"))
    return own.withColumn("claimed_tokens", F.coalesce("captured_tokens", "tokens"))


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace events: a trace is a user's day."""
    t = table(spark, sf_dir, "events")
    kinds = {"view": "inference", "click": "message", "signup": "message", "purchase": "egress_response", "error": "provider_error"}
    phases = {"view": "observed", "click": "said", "signup": "generated", "purchase": "returned", "error": "observed"}
    k, view = F.get_json_object("props", "$.k").cast("long"), F.col("event_type") == "view"
    prompt, done = F.when(view, k), F.when(view, F.floor("value").cast("long"))
    return t.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id").alias("event_ordinal"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_id"), choose(F.col("event_type"), kinds).alias("type"), choose(F.col("event_type"), phases).alias("content_phase"),
        F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("actor_role"), k.alias("tokens"), prompt.alias("prompt_tokens"), done.alias("completion_tokens"),
        (prompt + done).alias("total_tokens"), F.concat(F.lit("route-"), (F.col("event_id") % 5).cast("string")).alias("routing_decision"), F.col("props").alias("excerpt"),
    )


def lineitem_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw observations of evidence: an order is a trace."""
    t = table(spark, sf_dir, "lineitem")
    seq = (F.col("l_linenumber") - 1) * 2 + F.col("l_suppkey") % 2
    return t.select(
        F.col("l_orderkey").alias("trace_id"), F.concat(F.lit("e"), (F.col("l_partkey") % 40).cast("string")).alias("event_id"), seq.cast("long").alias("seq"), F.col("l_returnflag").alias("payload"),
        F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")), F.col("l_quantity").cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("observation_id"),
    )
