"""Closed vocabularies and constants.  Fixed values: results depend on their exact spelling."""

SOURCE_TYPES = (
    "system_instruction", "project_instruction", "user_message", "assistant_message", "tool_call", "tool_output", "file_tree",
    "file_content", "diff", "log_output", "test_output", "build_output", "dependency_lockfile", "generated_artifact", "unknown",
)
TOOL_OUTPUTS = ("tool_output", "log_output", "test_output", "build_output")
LOGS = ("log_output", "test_output", "build_output")
EVENT_TYPES = (
    "message", "instruction", "context", "transformation", "inference", "tool_call", "tool_result", "provider_request",
    "provider_response", "provider_error", "egress_response",
)
PHASES = ("said", "sent", "transformed", "requested", "observed", "generated", "returned")
STATUSES = ("captured", "redacted", "truncated", "missing", "unknown", "not_applicable")
ROLES = ("application_constructed", "client_sent", "provider_reported", "returned", "unobservable")
SURFACES = ("client_side", "ingress_proxy", "tool", "mcp", "context_provider")
ACTORS = ("agent", "model", "tool", "mcp", "retrieval", "context_provider", "capture")
TARGETS = ("trace", "span", "none")
CONTROL_KINDS = ("interaction_start", "interaction_end", "span_start", "span_end")
EVENT_KINDS = (
    *CONTROL_KINDS, "model_request", "model_response", "model_response_chunk", "model_usage", "tool_call", "tool_result",
    "mcp_request", "mcp_result", "retrieval_request", "retrieval_result", "context_provider_request",
    "context_provider_result", "context_assembled", "error", "retry", "cancelled",
)
SPAN_KINDS = ("model", "tool", "mcp", "retrieval", "context_provider", "context_assembly")
ARTIFACT_KINDS = (
    "message", "file", "document", "fragment", "tool_result", "mcp_response", "retrieval_result", "context_provider_result", "repository_content", "manual",
)
FIDELITIES = ("structurally_faithful", "byte_faithful")
#: The object that a kind's payload must have, and the code if it hasn't.
PAYLOADS = (
    ("model_request", "requestEnvelope", "model_request_missing_envelope"), ("model_response", "responseEnvelope", "model_response_missing_envelope"),
    ("model_response_chunk", "responseEnvelope", "model_response_missing_envelope"), ("model_usage", "usage", "usage_missing"), ("tool_result", "toolResult", "tool_result_invalid"),
    ("mcp_request", "mcp", "mcp_request_invalid"), ("mcp_result", "mcpResult", "mcp_result_invalid"), ("retrieval_request", "retrieval", "retrieval_request_invalid"),
    ("retrieval_result", "retrievalResult", "retrieval_result_invalid"), ("context_provider_request", "contextProvider", "context_provider_invalid"),
    ("context_provider_result", "contextProvider", "context_provider_invalid"), ("cancelled", "cancellation", "cancellation_missing"), ("error", "error", "error_payload_missing"), ("retry", "retry", "retry_missing"),
)
#: Formats: content hash, media type, semantic version, time stamp.
HASH = r"^sha256:[0-9a-f]{64}$"
MEDIA_TYPE = r"^[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{0,126}/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]{0,126}$"
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?$"
TIMESTAMP = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}Z$"
KIND_TO_EVENT = {
    "model_request": "provider_request", "model_response": "provider_response", "model_response_chunk": "provider_response",
    "model_usage": "inference", "tool_call": "tool_call", "tool_result": "tool_result", "context_assembled": "context", "error": "provider_error",
}
ROLE_TO_PHASE = {"application_constructed": "transformed", "client_sent": "sent", "provider_reported": "observed", "returned": "returned"}
ROLE_TO_SOURCE = {"system": "system_instruction", "user": "user_message", "assistant": "assistant_message"}

OVERSIZED, LARGE, DUPLICATE_RATIO, DOMINANCE, LATE = 1000, 2000, 0.25, 0.5, 0.5
TOP_BLOCKS, EXCERPT, PAGE = 10, 240, 100

LOCKFILE = r"(?i)pnpm-lock|package-lock|yarn\.lock|composer\.lock|Cargo\.lock"
GENERATED = r"(?i)(^|/)(dist|build|coverage|out|\.next)/|\.min\.(js|css)$"
RELEVANT = r"\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|md)$"
IRRELEVANT = r"(?i)test|spec|\.d\.ts|dist|build|coverage"

#: Finding: detector order, title, severity, whether it is a heuristic, recommendation.
FINDINGS = {
    "repeated_project_instruction": (1, "Repeated project instruction", "info", False, "deduplicate-instructions"),
    "repeated_file_tree": (2, "Repeated file tree", "info", False, "compress-file-tree"),
    "oversized_tool_output": (3, "Oversized tool output", "warning", False, "trim-tool-output"),
    "repeated_log_output": (4, "Repeated log output", "warning", False, "collapse-logs"),
    "lockfile_in_context": (5, "Lockfile included in context", "info", False, "lockfile-caution"),
    "generated_artifact_in_context": (6, "Generated artifact in context", "warning", False, "exclude-generated-artifacts"),
    "large_single_context_block": (7, "Large single context block", "warning", False, "split-large-blocks"),
    "high_duplicate_context_ratio": (8, "High duplicate context ratio", "high", False, "deduplicate-context"),
    "tool_output_dominates_context": (9, "Tool output dominates context", "high", False, "reduce-tool-noise"),
    "late_relevant_file_heuristic": (10, "Likely relevant file appeared late", "info", True, "prioritize-relevant-files"),
}
SEVERITIES = ("high", "warning", "info")
