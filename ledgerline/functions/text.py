"""Scalar expressions over texts: size, tokens, hashes and redaction."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED, REDACTED_KEY = "[REDACTED]", "[REDACTED_API_KEY]"
#: White space as the patterns' origin has it, wider than Java's.
_BLANKS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, NWS = f"[{_BLANKS}]", f"[^{_BLANKS}"
#: An ASCII word boundary before and after a word character.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# The names that count as secrets, the forms of their values, and the rules, which apply in this order.
SECRET_NAMES = ("api[_-]?key", "access[_-]?token", "refresh[_-]?token", "id[_-]?token", "auth(?:orization)?", "secret", "password", "credential", "storageKey", "storage_key")
_NAMES = "|".join(SECRET_NAMES)
VALUE = r"""("[^"\r\n]*"|'[^'\r\n]*'|%s,;}]+)""" % NWS
RULES = (
    (rf"(?i){B}(authorization|proxy-authorization|x-api-key){WS}*[:=]{WS}*(?:Bearer{WS}+{NWS},;]+|{NWS},;]+)", f"$1: {REDACTED}"),
    (rf"(?i){B}(cookie|set-cookie){WS}*[:=]{WS}*[^\r\n]+", f"$1: {REDACTED}"),
    (rf"(?i){B}Bearer{WS}+[A-Za-z0-9._~+/=-]+", f"Bearer {REDACTED}"),
    # The end is a boundary of either side, as the last character may be a hyphen, which is no word character.
    (rf"{B}sk-[A-Za-z0-9][A-Za-z0-9_-]{{6,}}(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", REDACTED_KEY),
    (rf"""(?i)(["']?(?:{_NAMES})["']?{WS}*:{WS}*){VALUE}""", f'$1"{REDACTED}"'),
    (rf"(?i){B}({_NAMES}){E}{WS}*[:=]{WS}*{VALUE}", f"$1={REDACTED}"),
    (rf"""(?i){B}([A-Z_][A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|AUTHORIZATION|COOKIE)[A-Z0-9_]*){WS}*={WS}*("[^"\r\n]*"|'[^'\r\n]*'|{NWS}]+)""", f"$1={REDACTED}"),
)
#: Every rule needs one of these (in lower case): a text without them is not scanned by any.
SIGNS = ("key", "auth", "token", "secret", "password", "credential", "cookie", "bearer", "sk-")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; null for null."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the code units, rounded up; null counts as empty."""
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def display_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (factor 31) over UTF-16 units, absolute, in hex.  For display: groups use full values."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda i: F.conv(raw.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    span = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(h, i):
        wide = F.pmod(h * 31 + unit(i), F.lit(1 << 32))
        return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)

    return F.lower(F.hex(F.abs(F.aggregate(span, F.lit(0).cast("long"), step))))


def usable_patterns(patterns: list[str]) -> list[str]:
    """Those that compile; others are skipped."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def redact(text: Column, secret_patterns: list[str] | None = None) -> Column:
    """Own patterns first (any letter case), then the built-in rules in their order."""
    for p in usable_patterns(secret_patterns or []):
        text = F.regexp_replace(text, f"(?i){p}", REDACTED)
    done, low = text, F.lower(text)
    for pattern, to in RULES:
        done = F.regexp_replace(done, pattern, to)
    return F.when(reduce(Column.__or__, (low.contains(x) for x in SIGNS)), done).otherwise(text)


def truncate(text: Column, most: int) -> Column:
    """At most `most` UTF-16 units, the last of a cut text an ellipsis.  A surrogate pair is never split: it goes whole."""
    if most <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    units = F.substring(F.encode(F.left(text, F.lit(most - 1)), "UTF-16BE"), 1, 2 * (most - 1))
    half = F.hex(F.substring(units, -2, 2)).between("D800", "DBFF")
    cut = F.decode(F.when(half, F.substring(units, 1, 2 * (most - 2))).otherwise(units), "UTF-16BE")
    return F.when(utf16_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def redact_and_truncate(text: Column, most: int = 240, secret_patterns: list[str] | None = None) -> Column:
    return truncate(redact(text, secret_patterns), most)


def credential_like(text: Column, secret_patterns: list[str] | None = None) -> Column:
    return redact(text, secret_patterns) != text


def html_escape(text: Column) -> Column:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(to))
    return text


def choose(key: Column, mapping: dict, other: Column | None = None) -> Column:
    """A decision table over a small fixed mapping."""
    out = F.lit(None) if other is None else other
    for k, v in reversed(list(mapping.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
