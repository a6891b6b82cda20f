"""Queries over runs, findings and traces, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.vocabulary import FINDINGS
from ledgerline.operators import analysis, detectors, traces
from ledgerline.sources.tables import conversation_blocks, document_blocks, event_traces, with_tokens

V1 = """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn + 1 AS turn_number, 'turn-' || (turn + 1) AS turn_id, 'msg-turn-' || (turn + 1) || '-' || role AS block_id,
 CASE role WHEN 'system' THEN 'system_instruction' WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'unknown' END AS source_type,
 turn AS ordinal, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM conversations) """
V2 = """WITH b AS (SELECT 'r' || (n_chars % 97) AS run_id, doc_id % 7 + 1 AS turn_number, 'turn-' || (doc_id % 7 + 1) AS turn_id, 'd-' || doc_id AS block_id,
 CASE n_chars % 6 WHEN 0 THEN 'project_instruction' WHEN 1 THEN 'file_tree' WHEN 2 THEN 'tool_output' WHEN 3 THEN 'log_output' WHEN 4 THEN 'build_output' ELSE 'file_content' END AS source_type,
 CASE WHEN n_chars % 6 = 5 THEN CASE doc_id % 4 WHEN 0 THEN 'dist/a' || doc_id || '.js' WHEN 1 THEN 'pnpm-lock.yaml' ELSE 'src/f' || doc_id || '.ts' END ELSE source END AS name,
 coalesce(text, '') AS content, (doc_id % 7 + 1) * 1000000000000 + doc_id AS ordinal, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents),
 top AS (SELECT * FROM (SELECT run_id, turn_id, block_id, source_type, name, tokens, row_number() OVER (PARTITION BY run_id ORDER BY tokens DESC, ordinal) AS rank FROM b) WHERE rank <= 10),
 g0 AS (SELECT run_id, source_type, content, count(*) AS occurrences, arg_min(tokens, ordinal) AS tokens_each, min(ordinal) AS first FROM b GROUP BY ALL HAVING count(*) > 1),
 g AS (SELECT *, tokens_each * occurrences AS total_tokens, row_number() OVER (PARTITION BY run_id ORDER BY tokens_each * occurrences DESC, first) AS rank FROM g0),
 m AS (SELECT g.run_id, g.source_type, g.rank, b.block_id, b.turn_id, b.ordinal FROM g JOIN b USING (run_id, source_type, content)),
 tot AS (SELECT run_id, CAST(sum(tokens) AS BIGINT) AS input_tokens FROM b GROUP BY 1),
 dup AS (SELECT tot.run_id, CAST(coalesce(sum(g.total_tokens), 0) AS BIGINT) AS duplicate_tokens, CASE WHEN input_tokens > 0 THEN coalesce(sum(g.total_tokens), 0) / CAST(input_tokens AS DOUBLE) ELSE 0.0 END AS duplicate_ratio
   FROM tot LEFT JOIN g ON g.run_id = tot.run_id GROUP BY tot.run_id, input_tokens) """
V3 = """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS o, 'ev-' || event_id AS event_id,
 CASE event_type WHEN 'view' THEN 'inference' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'message' WHEN 'purchase' THEN 'egress_response' ELSE 'provider_error' END AS type,
 CASE event_type WHEN 'view' THEN 'observed' WHEN 'click' THEN 'said' WHEN 'signup' THEN 'generated' WHEN 'purchase' THEN 'returned' ELSE 'observed' END AS phase,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS p,
 CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS c, 'route-' || (event_id % 5) AS routing, props AS excerpt FROM events),
 t AS (SELECT *, 1 + coalesce(sum(CASE WHEN type = 'egress_response' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e),
 u AS (SELECT trace_id, CAST(coalesce(sum(p), sum(CASE WHEN type <> 'inference' AND phase IN ('said', 'sent', 'requested', 'observed') THEN tokens END)) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(c), sum(CASE WHEN type <> 'inference' AND phase IN ('generated', 'returned') THEN tokens END)) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(p + c), CASE WHEN count(*) FILTER (type = 'inference') > 0 THEN coalesce(sum(tokens) FILTER (type = 'inference'), 0) END) AS BIGINT) AS inference_tokens FROM e GROUP BY 1) """


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(conversation_blocks(spark, sf_dir))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(document_blocks(spark, sf_dir))


def tokens_by_source(spark, d):
    return analysis.tokens_by_source(v1(spark, d))


def run_totals(spark, d):
    b = v1(spark, d)
    return analysis.run_totals(b, analysis.turns_of(b))


def tokens_by_turn(spark, d):
    b = v1(spark, d)
    return analysis.tokens_by_turn(b, analysis.turns_of(b))


def largest_blocks(spark, d):
    return analysis.largest_blocks(v2(spark, d)).drop("ordinal")


def repeated_groups(spark, d):
    g = analysis.repeated_groups(v2(spark, d))
    ids = lambda f: F.array_join(F.transform("members", lambda m: m[f]), ",")
    return g.select("run_id", "source_type", "occurrences", "tokens_each", "total_tokens", "rank", ids("block_id").alias("blocks"), ids("turn_id").alias("turns"))


def duplicate_ratio(spark, d):
    b = v2(spark, d)
    return analysis.duplicate_ratio(analysis.run_totals(b, analysis.turns_of(b)), analysis.repeated_groups(b))


def _detector(name: str):
    def run(spark, d):
        return detectors.each(v2(spark, d))[name].drop("severity", "heuristic")

    run.__name__ = f"detect_{name}"
    return run


def all_findings(spark, d):
    return detectors.all_findings(v2(spark, d))


def recommendations(spark, d):
    return detectors.recommendations(spark, detectors.all_findings(v2(spark, d)))


def events_by_type(spark, d):
    return traces.counts_by(event_traces(spark, d), "type")


def events_by_phase(spark, d):
    return traces.counts_by(event_traces(spark, d), "content_phase")


def usage_metrics(spark, d):
    return traces.usage_metrics(event_traces(spark, d))


def turn_segments(spark, d):
    return traces.with_turns(event_traces(spark, d)).select("trace_id", "event_id", "turn")


def turn_usage(spark, d):
    return traces.turn_usage(event_traces(spark, d))


def run_output(spark, d):
    return traces.run_output(traces.turn_usage(event_traces(spark, d)))


def trace_to_blocks(spark, d):
    return traces.to_blocks(event_traces(spark, d)).drop("ordinal")


def trace_list_summary(spark, d):
    return traces.list_summary(event_traces(spark, d))


def ordered_decisions(spark, d):
    return traces.ordered(event_traces(spark, d), "routing_decision").select("trace_id", "n", F.array_join("routing_decision", ",").alias("decisions"))


def run_source_totals(spark, d):
    """Totals of each run beside its largest source (the flagship)."""
    b = v1(spark, d)
    top = analysis.tokens_by_source(b).where("rank = 1").select("run_id", F.col("source_type").alias("top_source"), F.col("tokens").alias("top_tokens"))
    return analysis.run_totals(b, analysis.turns_of(b)).drop("output_tokens").join(top, "run_id")


# A finding from rows (run_id, tokens, turn_id, block_id, o): blocks in order of o, turns as first seen.
def _shape(rows: str) -> str:
    return f"""f AS ({rows}), ft AS (SELECT run_id, string_agg(turn_id, ',' ORDER BY o) AS turns FROM (SELECT run_id, turn_id, min(o) AS o FROM f GROUP BY 1, 2) GROUP BY 1)
 SELECT f.run_id, '%s' AS finding, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(ft.turns) AS turns, string_agg(block_id, ',' ORDER BY o) AS blocks FROM f JOIN ft USING (run_id) GROUP BY f.run_id"""


def _groups(where: str) -> str:
    # A group's tokens count once: on its first member.
    rows = f"""SELECT m.run_id, CASE WHEN row_number() OVER (PARTITION BY m.run_id, m.rank ORDER BY m.ordinal) = 1 THEN g.total_tokens ELSE 0 END AS tokens, m.turn_id, m.block_id, m.rank * 100000000000000 + m.ordinal AS o
 FROM m JOIN g USING (run_id, source_type, rank) WHERE {where}"""
    return _shape(rows)


_FIRST = "m.rank = (SELECT min(rank) FROM g x WHERE x.run_id = m.run_id AND x.source_type = '{0}') AND m.source_type = '{0}'"
FINDING_SQL = {
    "repeated_project_instruction": _groups(_FIRST.format("project_instruction")),
    "repeated_file_tree": _groups(_FIRST.format("file_tree")),
    "oversized_tool_output": _shape("SELECT run_id, tokens, turn_id, block_id, rank AS o FROM top WHERE source_type IN ('tool_output', 'log_output', 'test_output', 'build_output') AND tokens >= 1000"),
    "repeated_log_output": _groups("m.source_type IN ('log_output', 'test_output', 'build_output')"),
    "lockfile_in_context": _shape("SELECT run_id, tokens, turn_id, block_id, ordinal AS o FROM b WHERE source_type = 'dependency_lockfile' OR regexp_matches(name, '(?i)pnpm-lock|package-lock|yarn\\.lock|composer\\.lock|Cargo\\.lock')"),
    "generated_artifact_in_context": _shape("SELECT run_id, tokens, turn_id, block_id, ordinal AS o FROM b WHERE source_type = 'generated_artifact' OR regexp_matches(name, '(?i)(^|/)(dist|build|coverage|out|\\.next)/|\\.min\\.(js|css)$')"),
    "large_single_context_block": _shape("SELECT run_id, tokens, turn_id, block_id, rank AS o FROM top WHERE tokens >= 2000"),
    "high_duplicate_context_ratio": _groups("m.run_id IN (SELECT run_id FROM dup WHERE duplicate_ratio > 0.25)"),
    "tool_output_dominates_context": """x AS (SELECT run_id, sum(tokens) AS n, sum(CASE WHEN source_type IN ('tool_output', 'log_output', 'test_output', 'build_output') THEN tokens ELSE 0 END) AS t FROM b GROUP BY 1),
 y AS (SELECT run_id, turn_id, turn_number FROM b GROUP BY ALL HAVING sum(tokens) > 0)
 SELECT x.run_id, '%s' AS finding, CAST(any_value(t) AS BIGINT) AS tokens, string_agg(turn_id, ',' ORDER BY turn_number) AS turns, '' AS blocks FROM x JOIN y USING (run_id) WHERE n > 0 AND t / CAST(n AS DOUBLE) >= 0.5 GROUP BY 1""",
    "late_relevant_file_heuristic": """x AS (SELECT run_id, count(DISTINCT turn_number) AS n FROM b GROUP BY 1 HAVING count(DISTINCT turn_number) >= 3),
 y AS (SELECT b.*, row_number() OVER (PARTITION BY run_id ORDER BY turn_number, ordinal) AS k FROM b JOIN x USING (run_id) WHERE source_type = 'file_content' AND turn_number > ceil(n * 0.5)
  AND regexp_matches(name, '\\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|md)$') AND NOT regexp_matches(name, '(?i)test|spec|\\.d\\.ts|dist|build|coverage'))
 SELECT run_id, '%s' AS finding, tokens, turn_id AS turns, block_id AS blocks FROM y WHERE k = 1""",
}


def _finding_sql(name: str) -> str:
    return V2 + ", " + FINDING_SQL[name].replace("%s", name)


def _union_sql() -> str:
    """All findings in one statement: each detector is a subquery over the shared views."""
    parts = []
    for name, (order, _, severity, heuristic, rec) in FINDINGS.items():
        body = FINDING_SQL[name].replace("%s", name)
        rank = {"high": 0, "warning": 1, "info": 2}[severity]
        parts.append(f"SELECT *, '{severity}' AS severity, {str(heuristic).lower()} AS heuristic, {rank * 100 + order} AS k, '{rec}' AS recommendation FROM (WITH {body})")
    return V2 + ", fs AS (" + " UNION ALL ".join(parts) + ") "


QUERIES = {f.__name__: f for f in (
    run_source_totals, tokens_by_source, run_totals, tokens_by_turn, largest_blocks, repeated_groups, duplicate_ratio, *(_detector(n) for n in FINDINGS), all_findings, recommendations,
    events_by_type, events_by_phase, usage_metrics, turn_segments, turn_usage, run_output, trace_to_blocks, trace_list_summary, ordered_decisions,
)}

_COUNTS = V3 + "SELECT trace_id, {0}, count(*) AS n, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, min(o)) AS rank FROM (SELECT trace_id, o, type, phase AS content_phase FROM e) GROUP BY trace_id, {0}"
_TURN = """tu AS (SELECT trace_id, CAST(turn AS BIGINT) AS turn, count(*) AS events, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens,
 CAST(coalesce(sum(c), CASE WHEN sum(tokens) FILTER (type = 'message' AND phase = 'generated') > 0 THEN sum(tokens) FILTER (type = 'message' AND phase = 'generated') END) AS BIGINT) AS output_tokens FROM t GROUP BY 1, 2) """
_S1 = """s AS (SELECT run_id, source_type, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS blocks, CASE WHEN sum(sum(tokens)) OVER (PARTITION BY run_id) > 0 THEN sum(tokens) / CAST(sum(sum(tokens)) OVER (PARTITION BY run_id) AS DOUBLE) ELSE 0.0 END AS share,
 row_number() OVER (PARTITION BY run_id ORDER BY sum(tokens) DESC, min(ordinal)) AS rank FROM b GROUP BY 1, 2) """
ORACLE = {
    "run_source_totals": V1 + ", " + _S1 + "SELECT b.run_id, CAST(sum(b.tokens) AS BIGINT) AS input_tokens, count(DISTINCT b.turn_id) AS turn_count, count(*) AS block_count, any_value(s.source_type) AS top_source, any_value(s.tokens) AS top_tokens FROM b JOIN s ON s.run_id = b.run_id AND s.rank = 1 GROUP BY 1",
    "tokens_by_source": V1 + ", " + _S1 + "SELECT * FROM s",
    "run_totals": V1 + "SELECT run_id, CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, count(DISTINCT turn_id) AS turn_count, count(*) AS block_count FROM b GROUP BY 1",
    "tokens_by_turn": V1 + "SELECT run_id, turn_id, turn_number, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS blocks FROM b GROUP BY ALL",
    "largest_blocks": V2 + "SELECT * FROM top",
    "repeated_groups": V2 + "SELECT g.run_id, g.source_type, occurrences, tokens_each, total_tokens, g.rank, string_agg(m.block_id, ',' ORDER BY m.ordinal) AS blocks, string_agg(m.turn_id, ',' ORDER BY m.ordinal) AS turns FROM g JOIN m USING (run_id, source_type, rank) GROUP BY ALL",
    "duplicate_ratio": V2 + "SELECT * FROM dup",
    **{f"detect_{n}": _finding_sql(n) for n in FINDINGS},
    "all_findings": _union_sql() + "SELECT run_id, finding, severity, tokens, turns, blocks, heuristic, row_number() OVER (PARTITION BY run_id ORDER BY k) AS position FROM fs",
    "recommendations": _union_sql() + "SELECT run_id, recommendation, finding, row_number() OVER (PARTITION BY run_id ORDER BY k) AS position FROM fs",
    "events_by_type": _COUNTS.format("type"),
    "events_by_phase": _COUNTS.format("content_phase"),
    "usage_metrics": V3 + "SELECT * FROM u",
    "turn_segments": V3 + "SELECT trace_id, event_id, CAST(turn AS BIGINT) AS turn FROM t",
    "turn_usage": V3 + ", " + _TURN + "SELECT * FROM tu",
    "run_output": V3 + ", " + _TURN + "SELECT trace_id, count(*) AS turns, CAST(CASE WHEN sum(output_tokens) <> 0 THEN sum(output_tokens) END AS BIGINT) AS output_tokens FROM tu GROUP BY 1",
    "trace_to_blocks": V3 + """, k AS (SELECT *, CASE WHEN type = 'message' AND phase = 'said' THEN 'user_message' WHEN type = 'message' AND phase = 'generated' THEN 'assistant_message' WHEN type = 'egress_response' THEN 'unknown' END AS source_type FROM t),
 n AS (SELECT *, source_type IS NOT NULL AS kept, coalesce(sum(CASE WHEN source_type IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + turn AS n FROM k)
 SELECT trace_id AS run_id, CAST(turn AS BIGINT) AS turn_number, 'pt-' || trace_id || '-' || CAST(n AS BIGINT) AS block_id, source_type, excerpt AS content, tokens AS captured_tokens FROM n WHERE kept""",
    "trace_list_summary": V3 + """SELECT trace_id, count(*) AS events, CAST(sum(CASE WHEN type = 'provider_error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, coalesce(CAST(any_value(u.input_tokens) AS VARCHAR), '—') AS input,
 coalesce(CAST(any_value(u.output_tokens) AS VARCHAR), '—') AS output, CASE WHEN sum(CASE WHEN type = 'provider_error' THEN 1 ELSE 0 END) > 0 THEN 'error' ELSE 'success' END AS status FROM e JOIN u USING (trace_id) GROUP BY 1""",
    "ordered_decisions": V3 + "SELECT trace_id, count(*) AS n, string_agg(routing, ',' ORDER BY o) AS decisions FROM e GROUP BY 1",
}
