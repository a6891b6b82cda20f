"""python -m ledgerline.cli analyze FILE | list STORE | show STORE TRACE  [--report terminal|json|html] [--out FILE] | delete STORE TRACE | purge STORE NOW"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import ingest, reports, store, traces
from ledgerline.sources import runs
from ledgerline.sources.tables import with_tokens


def analyze(spark: SparkSession, path: str, kind: str) -> str:
    parsed = runs.read_runs(spark, path)
    bad = runs.quarantine(parsed).first()
    if bad:
        raise SystemExit(f"{path}: {bad['problem']}")
    report = reports.analysis_json(with_tokens(runs.blocks(parsed)), runs.turns(parsed).select("run_id", "turn_id", "turn_number", "output_tokens"))
    run_id = runs.runs(parsed).first()["run_id"]
    if kind == "json":
        return report.first()["report"] + "\n"
    return (reports.page if kind == "html" else reports.terminal)(report, run_id)


def _told(events):
    """Usage figures, which stored events keep in their metadata."""
    told = lambda k: F.get_json_object("metadata", f"$.{k}").cast("long")
    return events.withColumns({"prompt_tokens": told("promptTokens"), "completion_tokens": told("completionTokens"), "total_tokens": told("totalTokens")})


def listing(spark: SparkSession, path: str, kind: str) -> str:
    """The latest page of a store."""
    rows, events = store.load(spark, path)
    page = store.reconstructed(ingest.page(rows))
    events = _told(ingest.cascade(events, page))
    if kind == "json":
        return "[" + ",".join(r["report"] for r in reports.trace_list_json(page, events).orderBy("trace_id").collect()) + "]\n"
    return reports.listing(traces.list_summary(events, page).orderBy("trace_id"))


def show(spark: SparkSession, path: str, trace_id: str, kind: str) -> str:
    row, events = store.lookup(spark, path, trace_id)
    found = reports.trace_json(store.reconstructed(row), _told(events), datetime.now(UTC).isoformat(timespec="milliseconds")).first()
    if found is None:
        raise SystemExit(f"no trace {trace_id}")
    report = json.loads(found["report"])
    return found["report"] + "\n" if kind == "json" else (reports.trace_page if kind == "html" else reports.trace_terminal)(report)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, own in {"analyze": ["file"], "list": ["store"], "show": ["store", "trace"], "delete": ["store", "trace"], "purge": ["store", "now"]}.items():
        s = sub.add_parser(name)
        for a in own:
            s.add_argument(a)
        if name in ("analyze", "list", "show"):
            s.add_argument("--report", choices=("terminal", "json", "html") if name != "list" else ("terminal", "json"), default="terminal")
            s.add_argument("--out")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    run = {
        "analyze": lambda: analyze(spark, o.file, o.report), "list": lambda: listing(spark, o.store, o.report), "show": lambda: show(spark, o.store, o.trace, o.report),
        "delete": lambda: f"{'deleted' if store.delete(spark, o.store, o.trace) else 'not found'}\n", "purge": lambda: f"{store.purge(spark, o.store, o.now)} purged\n",
    }
    text = run[o.command]()
    if getattr(o, "out", None):
        with open(o.out, "w") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
