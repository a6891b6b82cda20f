import json

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from ledgerline import cli
from ledgerline.operators import analysis, detectors, evidence, ingest, projections, reports, store, traces
from ledgerline.sources import config, runs
from ledgerline.sources.tables import with_tokens
from ledgerline.streaming import ingest as stream

INSTRUCTION = "Be brief. " * 30
RUN = {
    "id": "r1", "name": "fix", "outputTokens": 42, "turns": [
        {"messages": [{"role": "system", "content": "be good"}, {"role": "user", "content": "hi"}, {"role": "tool", "content": "x"}],
         "toolCalls": [{"name": "sh", "arguments": {"a": 1}, "output": "z" * 4000}, {"id": "c9", "arguments": "raw"}],
         "contextBlocks": [{"sourceType": "project_instruction", "content": INSTRUCTION}, {"sourceType": "nonsense", "name": "pnpm-lock.yaml"}]},
        {"id": "t2", "turnNumber": 5, "contextBlocks": [{"id": "p2", "sourceType": "project_instruction", "content": INSTRUCTION}]},
        {"messages": []},
        {"contextBlocks": [{"id": "late", "sourceType": "file_content", "name": "src/a.py", "content": "print()"}]},
    ],
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [json.dumps(RUN), "[1]", "nope", json.dumps({"name": "x", "turns": []}), json.dumps({"id": "x", "turns": []}), json.dumps({"id": "x", "name": "y", "turns": 3})]
    return runs.parse_runs(spark.createDataFrame([(t,) for t in texts], "json string"))


def test_quarantine(parsed):
    assert sorted(r.problem for r in runs.quarantine(parsed).collect()) == ["no id", "no name", "no turns", "not an object", "not an object"]


def test_blocks_in_order(parsed):
    got = [(r.turn_id, r.block_id, r.source_type, r.name) for r in runs.blocks(parsed).orderBy("ordinal").collect()]
    assert got == [
        ("turn-1", "msg-turn-1-system", "system_instruction", "system_instruction"), ("turn-1", "msg-turn-1-user", "user_message", "user_message"), ("turn-1", "msg-turn-1-tool", "unknown", "unknown"),
        ("turn-1", "tc-turn-1-call", "tool_call", "sh"), ("turn-1", "tc-turn-1-output", "tool_output", "sh-output"), ("turn-1", "c9-call", "tool_call", "tool"),
        ("turn-1", "block-turn-1", "project_instruction", None), ("turn-1", "block-turn-1", "unknown", "pnpm-lock.yaml"), ("t2", "p2", "project_instruction", None), ("turn-4", "late", "file_content", "src/a.py"),
    ]
    content = {r.block_id: r.content for r in runs.blocks(parsed).collect()}
    assert content["tc-turn-1-call"] == 'sh {"a":1}' and content["c9-call"] == "tool raw"


def test_totals_and_findings(spark, parsed):
    blocks, turns = with_tokens(runs.blocks(parsed)), runs.turns(parsed).select("run_id", "turn_id", "turn_number", "output_tokens")
    total = analysis.run_totals(blocks, turns, runs.runs(parsed)).first()
    assert (total.output_tokens, total.turn_count, total.block_count) == (42, 4, 10) and total.input_tokens == 2 + 1 + 1 + 3 + 1000 + 2 + 75 + 0 + 75 + 2
    assert {(r.turn_id, r.tokens) for r in analysis.tokens_by_turn(blocks, turns).collect()} >= {("t2", 75), ("turn-3", 0)}
    g = analysis.repeated_groups(blocks).first()
    assert (g.occurrences, g.tokens_each, g.total_tokens) == (2, 75, 150)
    found = {r.finding: r for r in detectors.all_findings(blocks, turns).collect()}
    assert set(found) == {"repeated_project_instruction", "oversized_tool_output", "lockfile_in_context", "tool_output_dominates_context", "late_relevant_file_heuristic"}
    assert found["oversized_tool_output"].tokens == 1000 and found["tool_output_dominates_context"].position == 1
    recs = [r.recommendation for r in detectors.recommendations(spark, detectors.all_findings(blocks, turns)).orderBy("position").collect()]
    assert recs[0] == "reduce-tool-noise" and len(recs) == 5
    shuffled = with_tokens(runs.blocks(parsed)).repartition(7, F.rand(3))
    assert sorted(map(str, detectors.all_findings(shuffled, turns).collect())) == sorted(map(str, found.values()))
    report = reports.analysis_json(blocks, turns)
    assert json.loads(report.first().report)["input_tokens"] == total.input_tokens
    assert "Findings (5)" in reports.terminal(report, "r1") and reports.page(report, "r1").count('class="finding') == 5


USAGE = [  # events (type, phase, tokens, prompt, completion, total); input, output, inference
    ([("message", "said", 10, None, None, None), ("message", "generated", 20, None, None, None)], (10, 20, None)),
    ([("message", "said", 10, None, None, None), ("inference", "observed", 148, 120, 28, 148)], (120, 28, 148)),
    ([("message", "said", 10, None, None, None), ("inference", "observed", 148, None, None, None)], (10, None, 148)),
    ([("inference", "observed", None, None, None, None)], (None, None, 0)),
    ([("message", "transformed", 5, None, None, None)], (None, None, None)),
]
EVENT = "trace_id string, event_ordinal long, type string, content_phase string, tokens long, prompt_tokens long, completion_tokens long, total_tokens long"


def test_usage(spark):
    rows = [(str(i), k, *e) for i, (events, _) in enumerate(USAGE) for k, e in enumerate(events)]
    got = {r.trace_id: (r.input_tokens, r.output_tokens, r.inference_tokens) for r in traces.usage_metrics(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(USAGE)}


def test_turns(spark):
    kinds = "MEMMEEM"
    rows = [("t", i, "egress_response" if k == "E" else "message", "said", 1, None, None, None) for i, k in enumerate(kinds)]
    assert [r.turn for r in traces.with_turns(spark.createDataFrame(rows, EVENT)).orderBy("event_ordinal").collect()] == [1, 1, 2, 2, 2, 3, 4]


GAPS = [  # retained, discarded, gaps (start, end, previous, next)
    ([0, 1, 2], [], []), ([0, 2, 5], [], [(1, 2, 0, 2), (3, 5, 2, 5)]), ([2, 3], [], [(0, 2, None, 2)]), ([0, 1], [4], [(4, 5, 1, None)]),
    ([0, 1], [2, 3], [(2, 4, 1, None)]), ([0, 1, 3], [3], [(2, 3, 1, 3)]), ([0, 3], [2], [(1, 3, 0, 3)]),
]


def test_gaps(spark):
    rows = []
    for t, (kept, gone, _) in enumerate(GAPS):
        rows += [(t, f"e{s}", s, f"o{t}-{s}", "p") for s in kept]
        rows += [(t, f"e{kept[0]}", s, f"d{t}-{s}", "p") for s in gone]  # the first event again, further on
    obs = spark.createDataFrame(rows, "trace_id long, event_id string, seq long, observation_id string, payload string")
    for df in (obs, obs.repartition(5, F.rand(1))):
        got = {}
        for r in evidence.gaps(evidence.positions(df)).collect():
            got.setdefault(r.trace_id, []).append((r.start_seq, r.end_seq, r.previous_seq, r.next_seq))
        assert {t: sorted(v, key=str) for t, v in got.items()} == {t: sorted(g, key=str) for t, (_, _, g) in enumerate(GAPS) if g}


def exchange():
    request = {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "api_key=abc hello"}, {"role": "odd", "content": "x"}], "tools": [{"name": "t"}]}
    response = {"model": "m2", "choices": [{"message": {"role": "assistant", "content": "fine"}}], "usage": {"prompt_tokens": 120, "completion_tokens": 28, "total_tokens": 148}}
    return json.dumps(request), json.dumps(response)


def test_exchange_events_and_store(spark, tmp_path):
    df = spark.createDataFrame([("t1", "alpha", *exchange()), ("t2", "alpha", "junk", None)], "trace_id string, provider string, request string, response string")
    events = runs.exchange_events(df)
    got = [(r.type, r.content_phase) for r in events.where("trace_id = 't1'").orderBy("event_ordinal").collect()]
    assert got == [("instruction", "sent"), ("message", "said"), ("context", "requested"), ("provider_request", "requested"), ("provider_response", "observed"), ("message", "generated"), ("inference", "observed"), ("egress_response", "returned")]
    assert events.where("type = 'message' and content_phase = 'said'").first().excerpt == "api_key=[REDACTED] hello"
    usage = {r.trace_id: r for r in traces.usage_metrics(events).collect()}
    assert (usage["t1"].input_tokens, usage["t1"].output_tokens, usage["t1"].inference_tokens) == (120, 28, 148)
    path = str(tmp_path / "store")
    head = spark.createDataFrame([("t1", "2024-01-01", None, "success", ""), ("t2", "2024-01-02", "2024-02-01", "error", "m")], "trace_id string, created_at string, expires_at string, status string, model string")
    store.save(head, events, path)
    with pytest.raises(ValueError):
        store.save(head.limit(1), events, path)
    # Usage kept under sensitive keys is lost in the stored form, so phases count.
    back = store.lookup(spark, path, "t1")[1]
    told = lambda k: F.get_json_object("metadata", f"$.{k}").cast("long")
    again = traces.usage_metrics(back.withColumns({"prompt_tokens": told("promptTokens"), "completion_tokens": told("completionTokens"), "total_tokens": told("totalTokens")})).first()
    assert again.inference_tokens == 148 and again.input_tokens != 120
    assert "unknown" in cli.listing(spark, path, "terminal") and [t["id"] for t in json.loads(cli.listing(spark, path, "json"))] == ["t1", "t2"]
    assert "provider_request" in cli.show(spark, path, "t1", "terminal") and "<h2>Events by type</h2>" in cli.show(spark, path, "t1", "html")
    shown = json.loads(cli.show(spark, path, "t1", "json"))
    assert shown["trace"]["eventCount"] == 8 and shown["trace"]["model"] is None and shown["routingDecisions"] == ["routed to alpha"] and "transformations" not in shown and {"eventType": "message", "text": "api_key=[REDACTED] hello"} in shown["excerpts"]
    policy = {r.trace_id: (r.model, json.loads(r.capture_policy)["excerpts"]) for r in store.reconstructed(store.load(spark, path)[0]).collect()}
    assert policy == {"t1": (None, True), "t2": ("m", True)}
    assert store.purge(spark, path, "2024-03-01") == 1 and store.delete(spark, path, "nobody") is False and store.delete(spark, path, "t1") is True
    assert store.load(spark, path)[1].count() == 0


def test_stream_and_store_share_a_layout(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    request, response = exchange()
    row = lambda t, day=1: json.dumps({"trace_id": t, "captured_at": f"2024-01-0{day}T00:00:00Z", "provider": "alpha", "request": request, "response": response})
    x = spark.createDataFrame([("s", "2023-12-31T00:00:00", "alpha", request, response)], "trace_id string, captured_at string, provider string, request string, response string").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    store.save(ingest.assemble_traces(x), runs.exchange_events(x), path)
    seen = []

    def run():
        stream.write(stream.read(spark, str(src)), path, str(tmp_path / "cp"), lambda t, e, n: seen.append((t.count(), e.count()))).awaitTermination(120)

    def held():
        rows, events = store.load(spark, path)
        return {r.trace_id: r.n for r in events.groupBy("trace_id").agg(F.count("*").alias("n")).collect()}, sorted(r.trace_id for r in rows.collect())

    (src / "a.json").write_text("\n".join([row("a"), row("b"), row("a"), row("s")]))
    run()
    assert held() == ({"s": 8, "a": 8, "b": 8}, ["a", "b", "s"]) and seen == [(3, 24)]
    (src / "b.json").write_text(row("c", 9))
    run()
    (src / "c.json").write_text("\n".join([row("d", 9), row("a", 9)]))  # a again, days after the watermark
    run()
    assert held() == (dict.fromkeys("abcds", 8), list("abcds"))
    assert store.delete(spark, path, "a") and held()[1] == list("bcds")
    store.add_new(ingest.assemble_traces(x), runs.exchange_events(x), path, "batch-9")
    store.add_new(ingest.assemble_traces(x.withColumn("trace_id", F.lit("z"))), runs.exchange_events(x.withColumn("trace_id", F.lit("z"))), path, "batch-9")
    assert held()[1] == list("bcdsz")


def test_a_store_without_its_marker_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    x = spark.createDataFrame([("t", "2024-01-01", "p", *exchange())], "trace_id string, captured_at string, provider string, request string, response string")
    store.save(ingest.assemble_traces(x), runs.exchange_events(x), path)
    (marker,) = (tmp_path / "s").glob("v*/_COMPLETE")
    marker.unlink()
    assert not store.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)


def test_config():
    good = {"providers": [{"id": "a", "kind": "openai-compatible", "baseUrl": "https://x.org/v1", "models": [{"id": "m", "aliases": ["n"], "limits": {"c": 5}, "pricing": {"i": 0.5}}]}]}
    assert config.providers(good)[0][1] == "a"
    for change in ({"id": ""}, {"kind": "other"}, {"baseUrl": "ftp://x"}, {"baseUrl": "https://u:p@x.org"}, {"headers": {"Authorization": "x"}}, {"models": {}}, {"models": [{"id": "m", "limits": {"c": 0}}]}, {"models": [{"id": "m", "pricing": {"i": -1}}]}, {"capabilities": {"fly": True}}, {"capabilities": {"tools": 1}}):
        with pytest.raises(config.ConfigError):
            config.providers({"providers": [good["providers"][0] | change]})


def test_every_event_gets_a_verdict(spark, sf_dir):
    rows = entry.queries()["append_verdicts"](spark, sf_dir).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("kind,span,payload,codes", [
    ("error", None, '{"actor":"tool","lifecycleTarget":"span","lifecycleEffect":"fail","error":{}}', ["target_span_requires_span"]),
    ("cancelled", "s", '{"lifecycleTarget":"trace","lifecycleEffect":"cancel","cancellation":{}}', ["target_trace_requires_null_span"]),
    ("tool_call", None, '{"tool":{"name":1}}', ["tool_call_invalid"]), ("model_usage", None, '{"usage":"{}"}', ["usage_missing"]), ("model_usage", None, '{"usage":{}}', []),
    ("retry", None, '{"retry":{"originalRequestEventId":"","attempt":1.5}}', ["retry_invalid_attempt", "retry_missing_original"]), ("retry", None, '{"retry":{"originalRequestEventId":"e","attempt":2}}', []),
    ("model_response", None, '{"responseEnvelope":{"providerNativeFidelity":"structurally_faithful","nativeContentHash":null}}', ["native_content_hash_invalid"]), ("mcp_result", None, "[1]", ["mcp_result_invalid", "payload_not_object"]),
])
def test_kinds_are_checked(spark, kind, span, payload, codes):
    row = ("t", "e", 0, "o", payload, span, kind, "2024-01-01T00:00:00.000Z", "captured", "returned")
    df = spark.createDataFrame([row], "trace_id string, event_id string, seq long, observation_id string, payload string, span_id string, kind string, captured_at string, status string, role string")
    assert sorted(r.code for r in evidence.validation_issues(df).collect()) == codes


def test_boundaries_are_checked(spark):
    good = {"captureSurface": "mcp", "observationBoundary": "returned", "declaredEventKinds": ["error"], "declaredSurfaces": ["mcp"], "missingRecord": None}
    rows = [good, good | {"captureSurface": "x"}, good | {"observationBoundary": 1}, good | {"declaredEventKinds": [1]}, good | {"declaredSurfaces": ["x"]}, good | {"missingRecord": 1}, good | {"missingRecord": {}}, []]
    df = spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(rows)] + [("8", None)], "trace_id string, boundary string")
    assert sorted((r.trace_id, r.code) for r in evidence.boundary_issues(df).collect()) == [
        ("1", "capture_surface_invalid"), ("2", "observation_boundary_invalid"), ("3", "declared_event_kinds_invalid"), ("4", "declared_surfaces_invalid"), ("5", "missing_record_invalid"), ("6", "missing_record_reason_invalid"),
        ("7", "capture_boundary_missing"), ("8", "capture_boundary_missing")]


def test_losses_name_each_event(spark):
    rows = [("t", "a", 0, "interaction_start", None, None, None, None, None, "x"), ("t", "b", 1, "model_request", "unobservable", None, None, None, None, "x"), ("t", "c", 2, "error", "returned", None, "trace", "fail", None, "x"), ("t", "d", 3, "retry", "returned", None, None, None, None, "x")]
    e = spark.createDataFrame(rows, "trace_id string, event_id string, seq long, kind string, role string, span_id string, target string, effect string, model string, captured_at string")
    got = evidence.loss_mappings(evidence.trace_status(e), e).orderBy("section", "event", "item").collect()
    assert all(r.reason and r.stage == "evidence_to_legacy_trace" for r in got)
    assert [(r.path, r.outcome) for r in got[:15]][6] == ("trace.provider", "unavailable")
    assert [(r.path, r.outcome) for r in got[15:]] == [
        ("events[0]", "unavailable"), ("events[1]", "partial"), ("events[1].observationRole", "unavailable"), ("events[2]", "partial"), ("events[2].actor", "unavailable"), ("events[2].lifecycleTarget", "unavailable"),
        ("events[2].lifecycleEffect", "unavailable"), ("events[2].error", "unavailable"), ("events[3]", "unavailable")]
    assert 'observationRole "returned" approximated by ContentPhase "returned"' in got[18].reason


def test_issue_codes_have_their_buckets(spark):
    codes = [("error_invalid_actor", "invalid_lifecycle"), ("trace_disagrees_with_derivation", "trace_derivation_conflict"), ("unsupported_evidence_schema_version", "unsupported_schema_version"), ("seq_invalid", "invalid_evidence_record")]
    df = spark.createDataFrame(codes, "code string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", evidence.translate_issue(F.col("code"))).collect())


def test_a_large_block_counts_in_the_first_turn_of_its_id(spark):
    rows = [("r", f"t{i}", i, "same", "tool_output", None, "x" * (40 if i == 1 else 9000), None, i) for i in (1, 2, 3)]
    schema = "run_id string, turn_id string, turn_number long, block_id string, source_type string, name string, content string, captured_tokens long, ordinal long"
    found = {r.finding: r for r in detectors.all_findings(with_tokens(spark.createDataFrame(rows, schema))).collect()}
    assert (found["oversized_tool_output"].turns, found["oversized_tool_output"].blocks) == ("t1", "same,same") and found["large_single_context_block"].turns == "t1"


def test_estimators_are_exchangeable(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "content string").withColumn("captured_tokens", F.lit(None).cast("long"))
    assert [r.tokens for r in with_tokens(df, lambda c: F.size(F.split(c, " "))).collect()] == [3, 1]


def test_plans_scan_and_shuffle_once(spark, sf_dir):
    import re

    from ledgerline.plans import analysis as a
    from ledgerline.plans import evidence as e

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"Exchange (hash|range)partitioning", text)), len(re.findall(r"FileScan parquet", text))

    assert plan(e.evidence_completeness(spark, sf_dir))[0] <= 3 and plan(e.sequence_gaps(spark, sf_dir))[0] <= 6
    assert plan(a.all_findings(spark, sf_dir))[1] <= 4


def test_events_get_an_id_and_a_time(spark):
    r = spark.range(2).select(traces.event(type=F.lit("message"), event_id=F.when(F.col("id") == 0, "own")).alias("e"), traces.event(type=F.lit("x")).alias("f")).collect()
    assert r[0].e.event_id == "own" and r[1].e.event_id is None and r[0].f.event_id != r[1].f.event_id and r[0].e.timestamp.endswith("Z")


def test_traces_that_are_no_runs(spark):
    heads = spark.createDataFrame([("a", None, "t", True), ("", None, None, True), ("b", "g", "t", False), ("c", None, None, True)], "trace_id string, agent string, task string, events_valid boolean")
    assert sorted((r.trace_id, r.path, r.code) for r in projections.trace_issues(heads).collect()) == [("", "id", "invalid_legacy_trace"), ("b", "events", "invalid_event_collection")]
    rows = [("a", 0, "e0", "2024", "message", "said", None), ("a", 1, None, "", "odd", "odd", "odd"), ("a", 2, "e2", "", "odd", None, None), ("c", 0, "e3", "2024", "message", None, "diff")]
    events = spark.createDataFrame(rows, "trace_id string, event_ordinal long, event_id string, timestamp string, type string, content_phase string, source_type string")
    assert [(r.path, r.message.split(" valid ")[-1]) for r in projections.entry_issues(events).orderBy("path").collect()] == [("events[1]", "id field"), ("events[2]", "timestamp field")]
    good, own = projections.valid(heads, events)
    assert [r.trace_id for r in good.collect()] == ["c"] and own.count() == 1
    assert {r.run_id: r.name for r in projections.to_runs(heads).collect()} == {"a": "t", "": "trace-", "b": "g", "c": "trace-c"}
