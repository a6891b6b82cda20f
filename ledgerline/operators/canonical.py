"""Canonical JSON, canonical events and their digests.

Canonical JSON: keys by code point, no blanks, numbers as doubles in their shortest form, control characters as \\uXXXX
with capital digits.  The recursion runs as one Arrow function; equality of contents is equality of these texts.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.vocabulary import CONTROL_KINDS

#: Payload keys that are never taken over.
UNSAFE = ("__proto__", "constructor", "prototype")
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile('["\\\\\x00-\x1f\ud800-\udfff]')


def number(x: float | int) -> str:
    """A double in the form in which 1e21 is the first with an exponent, and 1e-7 the last."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, (mantissa, _, power) = "-" if x < 0 else "", f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = whole + part, len(whole) + int(power or 0)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0") if "." in mantissa or power else digits.lstrip("0").rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_json(value: object) -> str:
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return '"' + _SPECIAL.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04X}", value) + '"'
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"


def canonical_event(container: dict, payload: object) -> dict:
    """A raw observation's canonical event.

    Control events carry neither role nor payload.  Others take over the payload's fields, which replace the container's
    where both have one.
    """
    event = {k: container.get(k) for k in ("eventId", "traceId", "spanId", "seq", "kind", "capturedAt", "evidenceStatus")}
    if container.get("kind") in CONTROL_KINDS:
        return event
    if container.get("observationRole") is not None:
        event["observationRole"] = container["observationRole"]
    return event | {k: v for k, v in payload.items() if k not in UNSAFE} if isinstance(payload, dict) else event


def canonical(column: Column) -> Column:
    """JSON text in canonical form; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_json(json.loads(text))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(column)


def digest(column: Column) -> Column:
    return F.sha2(canonical(column), 256)


def project(observations: DataFrame) -> DataFrame:
    """observations (container and payload as JSON texts) with `event`, canonical."""

    @F.pandas_udf("string")
    def run(containers: pd.Series, payloads: pd.Series) -> pd.Series:
        pairs = zip(containers, payloads, strict=True)
        return pd.Series([canonical_json(canonical_event(json.loads(c), None if p is None else json.loads(p))) for c, p in pairs])

    return observations.withColumn("event", run("container", "payload"))
