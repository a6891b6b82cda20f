"""Guards: whether a JSON text is a value of a kind, as boolean columns.

Null and texts that aren't JSON fail every guard.  Formats are checked on plain strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.vocabulary import ARTIFACT_KINDS, EVENT_KINDS, FIDELITIES, HASH, MEDIA_TYPE, ROLES, SEMVER, SPAN_KINDS, STATUSES, TIMESTAMP


def _all(*parts: Column) -> Column:
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def is_one_of(text: Column, names: tuple[str, ...]) -> Column:
    return _all(text.isin(*names))


def is_status(text: Column) -> Column:
    return is_one_of(text, STATUSES)


def is_role(text: Column) -> Column:
    return is_one_of(text, ROLES)


def is_event_kind(text: Column) -> Column:
    return is_one_of(text, EVENT_KINDS)


def is_span_kind(text: Column) -> Column:
    return is_one_of(text, SPAN_KINDS)


def is_artifact_kind(text: Column) -> Column:
    return is_one_of(text, ARTIFACT_KINDS)


def is_identifier(text: Column) -> Column:
    """Not empty, and not blanks alone."""
    return _all(text.rlike(r"\S"))


def is_content_hash(text: Column) -> Column:
    return _all(text.rlike(HASH))


def is_content_type(text: Column) -> Column:
    return _all(text.rlike(MEDIA_TYPE))


def is_json_content_type(text: Column) -> Column:
    base = F.lower(F.trim(F.split_part(text, F.lit(";"), F.lit(1))))
    return _all((base == "application/json") | base.endswith("+json"))


def is_semantic_version(text: Column) -> Column:
    return _all(text.rlike(SEMVER))


def major_version(text: Column) -> Column:
    return F.regexp_extract(text, r"^([0-9]+)\.", 1).try_cast("int")


def is_timestamp(text: Column) -> Column:
    """A UTC time with milliseconds on a day that exists."""
    day = F.substring(text, 1, 10)
    return _all(text.rlike(TIMESTAMP), F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == day)


class _Json:
    def __init__(self, text: Column):
        self.v = F.try_parse_json(text)

    def kind(self, path: str = "$") -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(self.v, path, "variant")), F.lit(""))

    def object(self) -> Column:
        return self.kind().startswith("OBJECT")

    def string(self, name: str) -> Column:
        """The field's value if it is a string."""
        return F.when(self.kind(f"$.{name}") == "STRING", F.try_variant_get(self.v, f"$.{name}", "string"))

    def strings(self, *names: str) -> Column:
        return _all(*(self.string(n).isNotNull() for n in names))

    def span(self, name: str) -> Column:
        """Null or an identifier, and there."""
        return (self.kind(f"$.{name}") == "VOID") | is_identifier(self.string(name))

    def seq(self, name: str) -> Column:
        x = F.try_variant_get(self.v, f"$.{name}", "double")
        return self.kind(f"$.{name}").rlike("^(BIGINT|DECIMAL|DOUBLE)") & (x == F.floor(x)) & (x >= 0)


def is_artifact(json: Column) -> Column:
    x = _Json(json)
    return _all(x.object(), x.strings("artifactId"), is_artifact_kind(x.string("kind")), is_status(x.string("evidenceStatus")))


def is_capture_boundary(json: Column) -> Column:
    x = _Json(json)
    return _all(x.object(), x.strings("captureSurface", "observationBoundary"), *(x.kind(f"$.{n}").startswith("ARRAY") for n in ("declaredEventKinds", "declaredSurfaces")))


def is_response_envelope(json: Column) -> Column:
    x = _Json(json)
    return _all(x.object(), is_one_of(x.string("providerNativeFidelity"), FIDELITIES))


def is_request_envelope(json: Column) -> Column:
    return _all(is_response_envelope(json), _Json(json).strings("model", "provider"))


def is_event(json: Column) -> Column:
    x = _Json(json)
    return _all(x.object(), x.strings("eventId", "traceId"), x.span("spanId"), x.seq("seq"), is_event_kind(x.string("kind")), is_timestamp(x.string("capturedAt")), is_status(x.string("evidenceStatus")))


def is_observation(json: Column) -> Column:
    x = _Json(json)
    role = x.kind("$.observationRole").isin("", "VOID") | is_role(x.string("observationRole"))
    return _all(is_event(json), x.strings("observationId"), role, is_timestamp(x.string("rawCapturedAt")))


def is_span(json: Column) -> Column:
    x = _Json(json)
    return _all(
        x.object(), x.strings("spanId", "name"), is_span_kind(x.string("kind")), x.span("parentSpanId"), x.seq("startSeq"), is_timestamp(x.string("startedAt")),
        is_one_of(x.string("status"), ("completed", "failed", "cancelled", "unknown")))
