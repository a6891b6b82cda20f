"""Token accounting over blocks, for many runs at once.

Blocks have run_id, turn_id, turn_number, block_id, source_type, name, content, ordinal, tokens and claimed_tokens
(sources.tables.with_tokens).  Ties go by ordinal, a block's place in its run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.vocabulary import TOP_BLOCKS


def turns_of(blocks: DataFrame) -> DataFrame:
    """run_id, turn_id, turn_number, for inputs whose turns are only known from their blocks."""
    return blocks.select("run_id", "turn_id", "turn_number").distinct()


def run_totals(blocks: DataFrame, turns: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """run_id, input_tokens, output_tokens, turn_count, block_count; runs and turns without blocks count too.

    Output tokens are the run's own (runs.output_tokens), else the sum of its turns' (turns.output_tokens), else null.
    """
    by_block = blocks.groupBy("run_id").agg(F.sum("tokens").alias("input_tokens"), F.count("*").alias("block_count"))
    out = F.sum("output_tokens") if "output_tokens" in turns.columns else F.max(F.lit(None).cast("long"))
    by_turn = turns.groupBy("run_id").agg(F.count("*").alias("turn_count"), out.alias("turn_output"))
    joined = by_turn.join(by_block, "run_id", "full")
    own = F.lit(None).cast("long")
    if runs is not None:
        joined, own = runs.select("run_id", F.col("output_tokens").alias("own_output")).join(joined, "run_id", "left"), F.col("own_output")
    nought = F.lit(0)
    return joined.select(
        "run_id", F.coalesce("input_tokens", nought).alias("input_tokens"), F.coalesce(own, F.col("turn_output")).alias("output_tokens"),
        F.coalesce("turn_count", nought).alias("turn_count"), F.coalesce("block_count", nought).alias("block_count"),
    )


def tokens_by_turn(blocks: DataFrame, turns: DataFrame) -> DataFrame:
    sums = blocks.groupBy("run_id", "turn_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"))
    joined = turns.join(sums, ["run_id", "turn_id"], "left")
    return joined.select("run_id", "turn_id", "turn_number", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def tokens_by_source(blocks: DataFrame) -> DataFrame:
    """run_id, source_type, tokens, blocks, share of the run's tokens (0 for none), rank by falling tokens."""
    sums = blocks.groupBy("run_id", "source_type").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"), F.min("ordinal").alias("first"))
    run = Window.partitionBy("run_id")
    total = F.sum("tokens").over(run)
    rank = F.row_number().over(run.orderBy(F.desc("tokens"), "first"))
    return sums.select("run_id", "source_type", "tokens", "blocks", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"), rank.alias("rank"))


def largest_blocks(blocks: DataFrame, n: int = TOP_BLOCKS) -> DataFrame:
    """The n largest of each run, with rank; Spark prunes within each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("tokens"), "ordinal"))
    own = blocks.select("run_id", "turn_id", "block_id", "source_type", "name", "tokens", "ordinal")
    return own.withColumn("rank", rank).where(F.col("rank") <= n)


def repeated_groups(blocks: DataFrame) -> DataFrame:
    """Groups of blocks of one run with equal source type and content, more than one.

    tokens_each is the first block's; total_tokens counts every occurrence, the first included.  The content itself
    isn't shuffled, only its SHA-256.
    """
    grouped = blocks.groupBy("run_id", "source_type", F.sha2("content", 256).alias("digest")).agg(
        F.count("*").alias("occurrences"), F.min_by("tokens", "ordinal").alias("tokens_each"), F.min("ordinal").alias("first"),
        F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "turn_id"))).alias("members"),
    ).where("occurrences > 1")
    total = F.col("tokens_each") * F.col("occurrences")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("total_tokens"), "first"))
    return grouped.withColumn("total_tokens", total).withColumn("rank", rank).drop("first")


def duplicate_ratio(totals: DataFrame, groups: DataFrame) -> DataFrame:
    """run_id, duplicate_tokens and duplicate_ratio (0 where the run has no tokens)."""
    sums = groups.groupBy("run_id").agg(F.sum("total_tokens").alias("duplicate_tokens"))
    d, t = F.coalesce("duplicate_tokens", F.lit(0)), F.col("input_tokens")
    return totals.select("run_id", "input_tokens").join(sums, "run_id", "left").select("run_id", d.alias("duplicate_tokens"), F.when(t > 0, d / t).otherwise(0.0).alias("duplicate_ratio"))
