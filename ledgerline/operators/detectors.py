"""Ten rule detectors over analysed blocks, and the recommendations that follow.

Every detector yields at most one row a run: run_id, finding, severity, tokens, turns and blocks (joined ids, first seen
first), heuristic.  All of them read two aggregates, one over a run's blocks and one over its repeated groups; a run's
matching blocks are lists in one row there, as they are in the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.vocabulary import DOMINANCE, DUPLICATE_RATIO, FINDINGS, GENERATED, IRRELEVANT, LARGE, LATE, LOCKFILE, LOGS, OVERSIZED, RELEVANT, SEVERITIES, TOOL_OUTPUTS, TOP_BLOCKS
from ledgerline.operators import analysis


def _of_groups(groups: DataFrame) -> DataFrame:
    """run_id, the largest group of two types (struct of rank, total_tokens, members), all log groups and all groups."""
    own = F.struct("rank", "total_tokens", "members")
    largest = lambda type_: F.min_by(own, F.when(F.col("source_type") == type_, F.col("rank")))
    return groups.groupBy("run_id").agg(
        largest("project_instruction").alias("instruction"), largest("file_tree").alias("tree"), F.array_sort(F.collect_list(F.when(F.col("source_type").isin(*LOGS), own))).alias("logs"), F.array_sort(F.collect_list(own)).alias("groups"),
    )


def _of_blocks(blocks: DataFrame) -> DataFrame:
    """run_id, tokens and tool_tokens, and lists of the blocks that detectors look for (o: their order)."""
    run = Window.partitionBy("run_id")
    rows = blocks.select("run_id", "turn_id", "turn_number", "block_id", "source_type", "name", "tokens", "claimed_tokens", "ordinal").withColumns({
        "rank": F.row_number().over(run.orderBy(F.desc("tokens"), "ordinal")), "turn_tokens": F.sum("tokens").over(Window.partitionBy("run_id", "turn_number", "turn_id")),
        # A large block's turn is the first that has a block of its id.
        "first_turn": F.first("turn_id").over(Window.partitionBy("run_id", "block_id").orderBy("ordinal")),
    })
    name, source = F.coalesce("name", F.lit("")), F.col("source_type")
    large = F.struct(F.col("rank").alias("o"), F.col("first_turn").alias("turn_id"), "block_id", "tokens")
    named = F.struct(F.col("ordinal").alias("o"), "turn_id", "block_id", F.col("claimed_tokens").alias("tokens"))
    file = F.struct(F.struct("turn_number", "ordinal").alias("o"), "turn_id", "block_id", F.col("claimed_tokens").alias("tokens"))
    tool, top = source.isin(*TOOL_OUTPUTS), F.col("rank") <= TOP_BLOCKS
    listed = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
    return rows.groupBy("run_id").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.when(tool, F.col("tokens")).otherwise(0)).alias("tool_tokens"), F.size(F.collect_set(F.struct("turn_id", "turn_number"))).alias("n_turns"),
        listed(top & tool & (F.col("tokens") >= OVERSIZED), large).alias("oversized"), listed(top & (F.col("tokens") >= LARGE), large).alias("large"),
        listed((source == "dependency_lockfile") | name.rlike(LOCKFILE), named).alias("lockfiles"), listed((source == "generated_artifact") | name.rlike(GENERATED), named).alias("generated"),
        F.array_sort(F.collect_set(F.when(F.col("turn_tokens") > 0, F.struct("turn_number", "turn_id")))).alias("busy_turns"),
        listed((source == "file_content") & name.rlike(RELEVANT) & ~name.rlike(IRRELEVANT), file).alias("files"),
    )


def _total(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda z, x: z + x[field])


def _findings() -> dict[str, tuple[Column, Column, Column, Column]]:
    """By finding: when it holds, tokens, turn ids and block ids, over the columns of both aggregates."""
    turns, ids = lambda rows: F.transform(rows, lambda x: x["turn_id"]), lambda rows: F.transform(rows, lambda x: x["block_id"])
    none = F.array().cast("array<string>")

    def blocks(column: str) -> tuple[Column, ...]:
        rows = F.col(column)
        return F.size(rows) > 0, _total(rows, "tokens"), turns(rows), ids(rows)

    def groups(rows: Column, when: Column) -> tuple[Column, ...]:
        members = F.flatten(F.transform(rows, lambda g: g["members"]))
        return when, _total(rows, "total_tokens"), turns(members), ids(members)

    def one(column: str) -> tuple[Column, ...]:
        return groups(F.array(column), F.col(column).isNotNull())

    repeated = F.coalesce(_total(F.col("groups"), "total_tokens"), F.lit(0))
    # The run's first relevant file after half of its turns, in runs of three turns or more.
    late = F.try_element_at(F.filter("files", lambda x: x["o"]["turn_number"] > F.ceil(F.col("n_turns") * LATE)), F.lit(1))
    return {
        "repeated_project_instruction": one("instruction"), "repeated_file_tree": one("tree"), "oversized_tool_output": blocks("oversized"), "repeated_log_output": groups(F.col("logs"), F.size("logs") > 0),
        "lockfile_in_context": blocks("lockfiles"), "generated_artifact_in_context": blocks("generated"), "large_single_context_block": blocks("large"),
        "high_duplicate_context_ratio": groups(F.col("groups"), (F.col("tokens") > 0) & (repeated / F.col("tokens") > DUPLICATE_RATIO)),
        "tool_output_dominates_context": ((F.col("tokens") > 0) & (F.col("tool_tokens") / F.col("tokens") >= DOMINANCE), F.col("tool_tokens"), turns(F.col("busy_turns")), none),
        "late_relevant_file_heuristic": ((F.col("n_turns") >= 3) & late.isNotNull(), late["tokens"], F.array(late["turn_id"]), F.array(late["block_id"])),
    }


def all_findings(blocks: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """All findings with `position` in their run: by severity, then in the detectors' order.

    turns: where turns without blocks count, too; else they are those of the blocks.
    """
    runs = _of_blocks(blocks).join(_of_groups(analysis.repeated_groups(blocks)), "run_id", "left")
    if turns is not None:
        runs = runs.drop("n_turns").join(turns.groupBy("run_id").agg(F.count("*").alias("n_turns")), "run_id", "left")
    made = _findings()
    order = sorted(FINDINGS, key=lambda k: (SEVERITIES.index(FINDINGS[k][2]), FINDINGS[k][0]))
    rows = []
    for name in order:
        when, tokens, turn_ids, block_ids = made[name]
        _, _, severity, heuristic, _ = FINDINGS[name]
        rows.append(F.when(F.coalesce(when, F.lit(False)), F.struct(
            F.lit(name).alias("finding"), F.lit(severity).alias("severity"), tokens.cast("long").alias("tokens"), F.array_join(F.array_distinct(turn_ids), ",").alias("turns"), F.array_join(block_ids, ",").alias("blocks"),
            F.lit(heuristic).alias("heuristic"))))
    each = runs.select("run_id", F.posexplode(F.array_compact(F.array(*rows))).alias("position", "x"))
    return each.select("run_id", "x.*", (F.col("position") + 1).alias("position"))


def each(blocks: DataFrame, turns: DataFrame | None = None) -> dict[str, DataFrame]:
    """The findings by detector, in the detectors' order."""
    found = all_findings(blocks, turns).drop("position")
    return {name: found.where(F.col("finding") == name) for name in FINDINGS}


def recommendations(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """run_id, recommendation, finding, position: one of each kind, in the findings' order (a fixed table of ten rows)."""
    known = spark.createDataFrame([(k, v[4]) for k, v in FINDINGS.items()], "finding string, recommendation string")
    joined = findings.select("run_id", "finding", F.col("position").alias("at")).join(F.broadcast(known), "finding")
    once = joined.groupBy("run_id", "recommendation").agg(F.min_by("finding", "at").alias("finding"), F.min("at").alias("at"))
    return once.select("run_id", "recommendation", "finding", F.row_number().over(Window.partitionBy("run_id").orderBy("at")).alias("position"))
