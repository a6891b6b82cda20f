"""Paths, outcomes and reasons of the report on what an older trace can't hold.  Fixed values."""

#: Mappings of any trace, in order: path, outcome, reason (those left None depend on the trace).
LOSSES = (
    ("trace.traceId", "exact", "legacy trace id preserves the canonical traceId"),
    ("trace.interactionId", "exact", "canonical interactionId equals traceId (validated invariant); the value is preserved by legacy Trace.id, though the separate interactionId field is not carried"),
    ("trace.startedAt", "exact", "legacy startedAt preserves the canonical startedAt"),
    ("trace.finishedAt", None, None),
    ("trace.status", "partial", None),
    ("trace.captureProfile", "partial", "legacy StorageMode is not carried by canonical evidence (Spec 013 §11.2); the projected view defaults to mode \"standard\" with its default capture policy"),
    ("trace.provider", None, None),
    ("trace.agent", "unavailable", "canonical evidence has no agent concept; legacy agent is omitted"),
    ("trace.task", "unavailable", "canonical evidence has no task concept; legacy task is omitted"),
    ("trace.events[].seq", "partial", "legacy Trace has no seq field; canonical seq ordering is preserved by event order, the seq value itself is not representable"),
    ("trace.events[].evidenceStatus", "unavailable", "legacy TraceEvent has no evidenceStatus field; redacted/truncated/missing/unknown evidence is never turned into content"),
    ("trace.events[].observationRole", "partial", "canonical observation roles are approximated by legacy ContentPhase (Spec 013 §11.2); the conversion is partial and never claims provider-internal state"),
    ("trace.captureSurface", "unavailable", "legacy Trace has no capture-surface field; the declared capture surface is not projected"),
    ("trace.observationBoundary", "unavailable", "legacy Trace has no observation-boundary field; the declared observation boundary is not projected"),
    ("completeness", "unavailable", "legacy Trace has no completeness record; the canonical derived EvidenceRecord.completeness (eventsByStatus, seqGaps, duplicatesDetected, boundaryStatement) is not projected"),
)
FINISHED = "legacy endedAt preserves the canonical finishedAt"
INFERRED = ("trace.events[].requestEnvelope", "legacy trace-level provider/model are derived from the first canonical model_request envelope; reported as inferred, never presented as canonical evidence")
NO_PROVIDER = "no canonical model_request envelope exists from which to derive legacy provider/model"
SPANS = "legacy Trace has no span records; span hierarchy, kind, name, lifecycle status, seq ordering, and timing are not projected"
STATUS_REASONS = {
    "completed": "canonical trace status \"completed\" maps to legacy status \"success\"",
    "failed": "canonical trace status \"failed\" maps to legacy status \"error\"",
    "cancelled": "canonical status \"cancelled\" has no legacy equivalent; mapped to legacy \"error\" as abnormal termination",
    "unknown": "canonical status \"unknown\" (termination unobserved) has no legacy equivalent; mapped to legacy \"started\"",
}
KIND_REASONS = {
    "model_request": "canonical model_request maps to legacy provider_request control event; envelope and native content are not projected into legacy excerpts",
    "model_response": "canonical model_response maps to legacy provider_response; provider-native content is not projected",
    "model_response_chunk": "canonical model_response_chunk maps to legacy provider_response; legacy has no chunk type, so every chunk becomes its own provider_response event and the chunk boundary/index is lost (no aggregation)",
    "model_usage": "canonical model_usage maps to legacy inference event; numeric token accounting is unavailable until the measurement layer exists",
    "tool_call": "canonical tool_call maps to legacy tool_call; tool arguments are not inlined into a legacy excerpt",
    "tool_result": "canonical tool_result maps to legacy tool_result; tool output is not inlined into a legacy excerpt",
    "context_assembled": "canonical context_assembled maps to legacy context event; artifact references and assembled content are not inlined",
    "error": "canonical error maps to legacy provider_error; canonical actor, lifecycleTarget, and lifecycleEffect are not representable in the legacy type",
}
UNOBSERVABLE = "observationRole \"unobservable\" has no ContentPhase approximation; the role is not representable in the legacy vocabulary"
ERROR_LOSSES = (
    ("actor", "legacy TraceEvent provider_error has no actor field; the canonical error actor is not projected"),
    ("lifecycleTarget", "legacy TraceEvent provider_error has no lifecycle-target field; the canonical error lifecycleTarget is not projected"),
    ("lifecycleEffect", "legacy TraceEvent provider_error has no lifecycle-effect field; the canonical error lifecycleEffect is not projected"),
    ("error", "legacy TraceEvent provider_error has no error payload field; the canonical error payload is not projected"),
)
#: Fields of events whose loss is reported where they are: kinds, what must be there, what is reported, reason.
_REQUEST, _RESPONSE = ("model_request",), ("model_response", "model_response_chunk")
_USAGE = "legacy usage is a plain number; the canonical usage {0} value and its per-field evidence status are not projected (token accounting is a later measurement)"
FIELD_LOSSES = (
    (_REQUEST, "requestEnvelope", "requestEnvelope.providerNativeFidelity", "legacy TraceEvent carries no fidelity discriminant; the canonical request providerNativeFidelity (structurally_faithful | byte_faithful) is not projected"),
    (_REQUEST, "requestEnvelope.messages", None, "legacy excerpts never inline normalized request messages; the canonical request messages are not projected"),
    (_REQUEST, "requestEnvelope.providerNative", None, "legacy TraceEvent has no provider-native payload field; the canonical request providerNative body is not projected"),
    (_REQUEST, "requestEnvelope.nativeEncoding", None, "legacy TraceEvent has no native-encoding field; the canonical request nativeEncoding is not projected"),
    (_REQUEST, "requestEnvelope.nativeContentType", None, "legacy TraceEvent has no native-content-type field; the canonical request nativeContentType is not projected"),
    (_REQUEST, "requestEnvelope.nativeContentHash", None, "legacy Trace has no content-hash contract; the request envelope nativeContentHash is not projected"),
    (_RESPONSE, "responseEnvelope", "responseEnvelope.providerNativeFidelity", "legacy TraceEvent carries no fidelity discriminant; the canonical response providerNativeFidelity (structurally_faithful | byte_faithful) is not projected"),
    (_RESPONSE, "responseEnvelope.finishReason", None, "legacy TraceEvent has no finish-reason field; the canonical response finishReason is not projected"),
    (_RESPONSE, "responseEnvelope.providerNative", None, "legacy TraceEvent has no provider-native payload field; the canonical response providerNative body is not projected"),
    (_RESPONSE, "responseEnvelope.usage", None, "legacy TraceEvent has no usage field; the canonical responseEnvelope usage record (with per-field evidence status) is not projected"),
    (_RESPONSE, "responseEnvelope.chunkIndex", None, "legacy TraceEvent has no chunk-index field; streaming chunk index semantics are not representable"),
    (_RESPONSE, "responseEnvelope.nativeEncoding", None, "legacy TraceEvent has no native-encoding field; the canonical response nativeEncoding is not projected"),
    (_RESPONSE, "responseEnvelope.nativeContentType", None, "legacy TraceEvent has no native-content-type field; the canonical response nativeContentType is not projected"),
    (_RESPONSE, "responseEnvelope.nativeContentHash", None, "legacy Trace has no content-hash contract; the response envelope nativeContentHash is not projected"),
    (("model_usage",), "usage", "usage.evidenceStatus", "legacy usage is a plain number with no per-field evidence-status surface; the canonical usage-record evidenceStatus is not projected"),
    *((("model_usage",), f"usage.{x}", None, _USAGE.format(x)) for x in ("inputTokens", "outputTokens", "totalTokens")),
    (("model_request", "context_assembled"), "contextContributions", None, "legacy Trace has no context-contribution concept; artifact references are not projected"),
)
CONDITIONS = "legacy Trace has no conditions field; canonical experimental/environmental conditions are not projected"
SPAN_LOSSES = (
    ("durationMs", "legacy Trace has no duration field or clock-basis contract; span durationMs is not projected"),
    ("participants", "legacy Trace has no span-participant concept; span participants are not projected"),
)
DECLARATION_LOSSES = (
    ("missing", "the canonical missing-evidence declaration is not representable in the legacy vocabulary; the reported absence is never fabricated into content"),
    ("redaction", "the canonical redaction declaration is not representable in the legacy vocabulary; redacted evidence is never turned into content"),
    ("truncation", "the canonical truncation declaration is not representable in the legacy vocabulary; the truncated value is never fabricated into content"),
)
#: Mappings of a trace that becomes a run: exact ones, those that depend on a field (reasons if it is there and if not), and the rest.
RUN_EXACT = (("id", "AgentRun id preserves the legacy trace id"), ("name", "run name follows the legacy convention (agent, else task, else derived from trace id)"))
RUN_FIELDS = ("model", "provider", "agent", "task")
RUN_TURNS = "turn grouping preserves the legacy egress_response cycle-boundary convention"
RUN_IDS = {"turn": "turn identifier is deterministically synthesized by the projection; never presented as canonical evidence", "block": "context-block identifier is deterministically synthesized by the projection; never presented as canonical evidence"}
RUN_CONTENT = (
    "context-block content is limited to the legacy safe excerpts carried on the trace (payloadRef.excerpt); full payloads and secrets are never included",
    "no safe excerpts are carried by the legacy trace events, so no context-block content is produced",
)
RUN_METADATA = (
    "legacy trace metadata is filtered to safe keys by the legacy sanitizer; secret-bearing and raw-payload keys are dropped and are never projected",
    "legacy trace carries no metadata, so no filtered trace metadata is projected",
)
#: What an event of a trace needs to become a block: the first that fails is reported.
ENTRY_MESSAGES = {
    "id": "legacy trace event is missing a valid id field", "traceId": "legacy trace event is missing a valid traceId field", "timestamp": "legacy trace event is missing a valid timestamp field",
    "type": "legacy trace event type is not in the legacy TraceEventType vocabulary", "contentPhase": "legacy trace event contentPhase is not in the legacy ContentPhase vocabulary",
    "sourceType": "legacy trace event sourceType is not in the legacy SourceType vocabulary",
}
TRACE_MESSAGES = {
    "id": "Cannot build an AgentRun view: the legacy trace lacks a valid non-empty string id (needed to namespace deterministic synthesized ids).",
    "events": "Cannot build an AgentRun view: the legacy trace has an absent or invalid events collection.",
}
