"""Reports of one run, or of many as JSON rows.

Texts are redacted before they are escaped or printed.  The terminal and HTML forms are for one run or trace, whose
analysis is small: top-k lists and one row for each source type or finding.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import redact
from ledgerline.functions.vocabulary import FINDINGS
from ledgerline.operators import analysis, detectors
from ledgerline.operators import traces as of_traces

DISCLAIMERS = (
    "Token counts are approximate estimates.", "Full raw payloads are not included in this report.", "API keys, secrets, and authorization headers are never stored or reported.",
)


def analysis_json(blocks: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """run_id and report: the analysis of every run as JSON, set at a time."""
    turns = analysis.turns_of(blocks) if turns is None else turns
    totals, groups = analysis.run_totals(blocks, turns), analysis.repeated_groups(blocks)
    ordered = lambda df, name, *cols: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    parts = [
        totals, analysis.duplicate_ratio(totals, groups),
        ordered(analysis.tokens_by_source(blocks), "tokensBySourceType", "rank", "source_type", "tokens", "blocks", "share"),
        ordered(analysis.tokens_by_turn(blocks, turns), "tokensByTurn", "turn_number", "turn_id", "tokens"),
        ordered(analysis.largest_blocks(blocks).withColumn("name", redact(F.col("name"))), "largestBlocks", "rank", "block_id", "source_type", "name", "tokens"),
        ordered(detectors.all_findings(blocks, turns), "findings", "position", "finding", "severity", "tokens", "turns", "blocks"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "run_id", "left")
    return out.select("run_id", F.to_json(F.struct(*(c for c in out.columns))).alias("report"))


NULLS = {"ignoreNullFields": "false"}


def _have(df: DataFrame, column: str, type_: str = "string") -> Column:
    return (F.col(column) if column in df.columns else F.lit(None)).cast(type_)


def _head(traces: DataFrame, patterns: list[str] | None) -> Column:
    """id, status and so on of a trace, redacted; null where unknown."""
    names = {"id": "trace_id", "status": "status", "provider": "provider", "model": "model", "agent": "agent", "task": "task", "mode": "mode", "startedAt": "started_at", "endedAt": "ended_at"}
    return F.struct(*(redact(F.nullif(_have(traces, c), F.lit("")), patterns).alias(n) for n, c in names.items()), F.coalesce("event_count", F.lit(0)).alias("eventCount"))


def _metrics() -> Column:
    names = {"totalInputTokens": "input_tokens", "totalOutputTokens": "output_tokens", "inferenceTokens": "inference_tokens"}
    return F.struct(*(F.col(c).alias(n) for n, c in names.items()), F.lit(True).alias("approximate"))


def _with_metrics(traces: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("trace_id").agg(F.count("*").alias("event_count"))
    return traces.join(counts, "trace_id", "left").join(of_traces.usage_metrics(events), "trace_id", "left")


def trace_json(traces: DataFrame, events: DataFrame, generated_at: str, patterns: list[str] | None = None) -> DataFrame:
    """trace_id and report: each trace as JSON, set at a time.  Empty collections are left out; unknown fields of the trace are null.

    traces: trace_id, status, provider, model, agent, task, mode, started_at, ended_at, as far as they are there.  An event's excerpt is
    reported if payload_redacted says so (or isn't known).
    """
    def breakdown(column: str, name: str, field: str) -> DataFrame:
        rows = of_traces.counts_by(events, column).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias(field), F.col("n").alias("count")))).alias("m"))
        return rows.select("trace_id", F.transform("m", lambda x: F.struct(x[field].alias(field), x["count"].alias("count"))).alias(name))

    shown = F.coalesce("payload_redacted", F.lit(False)) if "payload_redacted" in events.columns else F.lit(True)
    texts = events.select(
        "trace_id", "event_ordinal", "type", *(F.nullif(_have(events, c), F.lit("")).alias(c) for c in ("routing_decision", "transformation_summary")), F.when(shown, F.nullif(_have(events, "excerpt"), F.lit(""))).alias("excerpt"),
    )
    listed = lambda when, what: F.array_sort(F.collect_list(F.when(F.col(when).isNotNull(), F.struct("event_ordinal", what.alias("v")))))
    own = lambda c: redact(F.col(c), patterns)
    excerpt = F.struct(own("type").alias("eventType"), own("excerpt").alias("text"))
    optional = {"routingDecisions": ("routing_decision", own("routing_decision")), "transformations": ("transformation_summary", own("transformation_summary")), "excerpts": ("excerpt", excerpt)}
    lists = texts.groupBy("trace_id").agg(*(listed(when, what).alias(n) for n, (when, what) in optional.items()))
    rows = _with_metrics(traces, events).join(breakdown("type", "types", "type"), "trace_id", "left").join(breakdown("content_phase", "phases", "phase"), "trace_id", "left").join(lists, "trace_id", "left")
    none = [F.array().cast(f"array<struct<{x}:string,count:bigint>>") for x in ("type", "phase")]
    head = F.to_json(F.struct(
        F.lit("trace").alias("reportType"), F.lit(generated_at).alias("generatedAt"), _head(traces, patterns).alias("trace"), _metrics().alias("tokenMetrics"),
        F.coalesce("types", none[0]).alias("eventTypeBreakdown"), F.coalesce("phases", none[1]).alias("contentPhaseBreakdown")), NULLS)
    more = [F.when(F.size(n) > 0, F.concat(F.lit(f',"{n}":'), F.to_json(F.transform(n, lambda x: x["v"])))).otherwise("") for n in optional]
    tail = F.lit(',"disclaimers":' + json.dumps(DISCLAIMERS) + "}")
    return rows.select("trace_id", F.concat(F.left(head, F.length(head) - 1), *more, tail).alias("report"))


def trace_list_json(traces: DataFrame, events: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """trace_id and report: a listing entry of each trace as JSON, unknown fields null."""
    rows = _with_metrics(traces, events)
    return rows.select("trace_id", F.to_json(F.struct(_head(traces, patterns).alias("h"), _metrics().alias("tokenMetrics")), NULLS).alias("t")).select(
        "trace_id", F.regexp_replace("t", r'^\{"h":\{(.*)\},"tokenMetrics"', r'{$1,"tokenMetrics"').alias("report"))


def trace_terminal(report: dict) -> str:
    """One trace's report (parsed JSON) as text."""
    t, m = report["trace"], report["tokenMetrics"]
    lines = ["Trace report", ""]
    rows = [("Trace ID", t["id"]), ("Status", t["status"]), ("Provider", t["provider"] or "unknown"), ("Model", t["model"] or "unknown"), ("Mode", t["mode"]), ("Started", t["startedAt"]), ("Ended", t["endedAt"]), ("Agent", t["agent"]), ("Task", t["task"]), ("Events", t["eventCount"])]
    rows += [(name, f"{m[k]} (approximate)") for name, k in (("Input tokens", "totalInputTokens"), ("Output tokens", "totalOutputTokens"), ("Inference tokens", "inferenceTokens")) if m[k] is not None]
    lines += [f"  {name + ':':<17} {value}" for name, value in rows if value is not None]
    for title, name, field in (("Events by type", "eventTypeBreakdown", "type"), ("Events by content phase", "contentPhaseBreakdown", "phase")):
        if report[name]:
            lines += ["", title, *(f"  {x[field]:<24} {x['count']}" for x in report[name])]
    for title, name in (("Routing decisions", "routingDecisions"), ("Transformation summaries", "transformations"), ("Content excerpts (redacted)", "excerpts")):
        if report.get(name):
            lines += ["", title, *(f"  [{x['eventType']}] {x['text']}" if isinstance(x, dict) else f"  {x}" for x in report[name])]
    return "\n".join([*lines, "", *report["disclaimers"]]) + "\n"


def _table(head: list[str], rows: list[list[object]]) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(str('—' if x is None else x))}</{tag}>" for x in row) + "</tr>"
    return f"<table>{cells('th', head) if head else ''}{''.join(cells('td', r) for r in rows)}</table>"


def _document(title: str, body: list[str]) -> str:
    style = "body{font-family:sans-serif;max-width:60rem;margin:2rem auto}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:.3rem .6rem;border-bottom:1px solid #ddd}.finding{border-left:4px solid #888;padding:.5rem 1rem;margin:.5rem 0}.high{border-color:#c00}.warning{border-color:#e80}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(body)}</body></html>\n'


def trace_page(report: dict) -> str:
    """One trace's report (parsed JSON) as an HTML page."""
    t, m = report["trace"], report["tokenMetrics"]
    rows = [["Trace ID", t["id"]], ["Status", t["status"]], ["Provider", t["provider"] or "unknown"], ["Model", t["model"] or "unknown"], ["Mode", t["mode"]], ["Started", t["startedAt"]], ["Ended", t["endedAt"]], ["Agent", t["agent"]], ["Task", t["task"]], ["Events", t["eventCount"]]]
    rows += [[name, f"{m[k]} (approx)"] for name, k in (("Input tokens", "totalInputTokens"), ("Output tokens", "totalOutputTokens"), ("Inference tokens", "inferenceTokens")) if m[k] is not None]
    body = [_table([], rows), "<h2>Events by type</h2>", _table(["Type", "Count"], [[x["type"], x["count"]] for x in report["eventTypeBreakdown"]]), "<h2>Events by content phase</h2>", _table(["Phase", "Count"], [[x["phase"], x["count"]] for x in report["contentPhaseBreakdown"]])]
    for title, name in (("Routing decisions", "routingDecisions"), ("Transformation summaries", "transformations"), ("Content excerpts (redacted)", "excerpts")):
        if report.get(name):
            item = lambda x: f"<strong>[{html.escape(x['eventType'])}]</strong> {html.escape(x['text'])}" if isinstance(x, dict) else html.escape(x)
            body.append(f"<h2>{title}</h2><ul>{''.join(f'<li>{item(x)}</li>' for x in report[name])}</ul>")
    return _document(f"Trace report {t['id']}", [*body, *(f"<p>{html.escape(d)}</p>" for d in report["disclaimers"])])


def _one(report: DataFrame, run_id: str) -> dict:
    row = report.where(F.col("run_id") == run_id).select("report").first()
    if row is None:
        raise KeyError(run_id)
    return json.loads(row[0])


def terminal(report: DataFrame, run_id: str) -> str:
    r = _one(report, run_id)
    lines = [f"Run {run_id}", f"  Turns:        {r['turn_count']}", f"  Blocks:       {r['block_count']}", f"  Input tokens: {r['input_tokens']} (approximate)"]
    lines += [f"  Repeated:     {int(r['duplicate_ratio'] * 100 + 0.5)}% ({r['duplicate_tokens']} tokens)", "", "Tokens by source type"]
    lines += [f"  {x['source_type']:<24} {x['tokens']:<8} {int(x['share'] * 100 + 0.5)}%" for x in r.get("tokensBySourceType", [])]
    lines += ["", "Largest blocks", *(f"  {x.get('name') or x['source_type']:<48} ~{x['tokens']} tokens" for x in r.get("largestBlocks", [])[:5])]
    found = r.get("findings", [])
    lines += ["", f"Findings ({len(found)})", *(f"  [{x['severity'].upper()}] {FINDINGS[x['finding']][1]}: {x['tokens']} tokens" for x in found)]
    lines += ["", "Recommendations", *([f"  {i}. {FINDINGS[x['finding']][4]}" for i, x in enumerate(found, 1)] or ["  none"])]
    return "\n".join(lines) + "\n"


def page(report: DataFrame, run_id: str) -> str:
    """One run's report as an HTML page; texts are redacted before they are escaped."""
    r, percent = _one(report, run_id), lambda x: f"{int(x * 100 + 0.5)}%"
    found = r.get("findings", [])
    cards = [["Estimated input tokens", r["input_tokens"]], ["Turns", r["turn_count"]], ["Blocks", r["block_count"]], ["Repeated context", percent(r["duplicate_ratio"])]]
    body = [
        _table([], cards), "<h2>Tokens by source type</h2>", _table(["Source type", "Tokens", "Blocks", "Share"], [[x["source_type"], x["tokens"], x["blocks"], percent(x["share"])] for x in r.get("tokensBySourceType", [])]),
        "<h2>Turns</h2>", _table(["#", "Input tokens"], [[x["turn_number"], x["tokens"]] for x in r.get("tokensByTurn", [])]),
        "<h2>Largest blocks</h2>", _table(["Type", "Name", "Tokens"], [[x["source_type"], x.get("name", ""), x["tokens"]] for x in r.get("largestBlocks", [])]), "<h2>Findings</h2>", *([] if found else ["<p>None detected.</p>"]),
    ]
    for x in found:
        _, title, severity, heuristic, _ = FINDINGS[x["finding"]]
        body.append(f"<div class=\"finding {severity}\"><strong>[{severity.upper()}] {html.escape(title)}</strong>{' <em>heuristic</em>' if heuristic else ''}<p>{x['tokens']} tokens; turns {html.escape(x['turns'])}; blocks {html.escape(x['blocks']) or '—'}</p></div>")
    body += ["<h2>Recommendations</h2>", *([f"<p>{FINDINGS[x['finding']][4]}</p>" for x in found] or ["<p>None.</p>"]), "<p>Token counts are approximate estimates.</p>"]
    return _document(f"Run {run_id}", body)


def listing(rows: DataFrame) -> str:
    """A page of list rows (at most a page) as a table of fixed widths."""
    cut = lambda s, n: s if len(s) <= n else s[: n - 1] + "…"
    widths = {"trace_id": 24, "status": 8, "provider": 16, "model": 20, "events": 8, "input": 10, "output": 10}
    widths = {k: w for k, w in widths.items() if k in rows.columns}
    out = [" ".join(f"{k:<{w}}" for k, w in widths.items())]
    out += [" ".join(f"{cut(str(r[k]), w):<{w}}" for k, w in widths.items()) for r in rows.collect()]
    return "\n".join(out) + "\n"
