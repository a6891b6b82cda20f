"""Recursive rewriting of JSON metadata: for storage, for runs, for reports.

Recursion is what built-in functions lack, so JSON texts go through one Arrow function; its result is JSON again.
Null stays null.  A text that isn't a JSON object comes back as null (stored metadata is always an object).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HEADERS = {"authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization"}
SENSITIVE = re.compile("api[_-]?key|auth|token|secret|password|credential", re.I)
DENIED = {
    "authorization", "apikey", "token", "secret", "headers", "rawpayload", "rawrequest", "rawresponse", "password", "clientsecret", "cookie", "setcookie", "session", "accesstoken", "refreshtoken", "idtoken",
}
STORAGE_KEY = "[REDACTED_STORAGE_KEY]"


def redactor(patterns: Iterable[str] = ()) -> Callable[[str], str]:
    """The rules of functions.text on a Python string (their syntax is shared but for the replacements)."""
    from ledgerline.functions.text import REDACTED, RULES, usable_patterns

    own = [re.compile(p, re.I) for p in usable_patterns(list(patterns))]
    rules = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in RULES]

    def run(text: str) -> str:
        for p in own:
            text = p.sub(REDACTED, text)
        for p, to in rules:
            text = p.sub(to, text)
        return text

    return run


def for_storage(value: object, redact: Callable[[str], str], headers: frozenset[str], keep_keys: bool = False) -> object:
    """Sensitive entries go, strings are redacted, empty objects and arrays are left out; None if nothing remains.

    An array within an array is taken as an object with its places as keys.
    """
    items = enumerate(value) if isinstance(value, list) else value.items()
    out: dict = {}
    for key, v in ((str(k), v) for k, v in items):
        if key.lower() in headers or SENSITIVE.search(key):
            continue
        if not keep_keys and isinstance(v, str) and redact(v) != v:
            continue
        if isinstance(v, list):
            kept = [for_storage(x, redact, headers, keep_keys) if isinstance(x, (dict, list)) else redact(x) if isinstance(x, str) else x for x in v]
            kept = [x for x, was in zip(kept, v, strict=True) if not (x is None and isinstance(was, (dict, list)))]
            if kept:
                out[key] = kept
        elif isinstance(v, dict):
            nested = for_storage(v, redact, headers, keep_keys)
            if nested:
                out[key] = nested
        else:
            out[key] = redact(v) if isinstance(v, str) else v
    return out or None


def for_run(value: object) -> object:
    """Without entries whose key, in lower case and without - and _, is denied."""
    if isinstance(value, dict):
        return {k: for_run(v) for k, v in value.items() if re.sub("[-_]", "", k.lower()) not in DENIED}
    return [for_run(v) for v in value] if isinstance(value, list) else value


def for_report(value: object, redact: Callable[[str], str]) -> object:
    """All strings redacted, storage keys replaced."""
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, list):
        return [for_report(v, redact) for v in value]
    if isinstance(value, dict):
        return {k: STORAGE_KEY if re.sub("[-_]", "", k.lower()) == "storagekey" else for_report(v, redact) for k, v in value.items()}
    return value


def rewrite(column: Column, mode: str, patterns: Iterable[str] = (), strip_headers: Iterable[str] = ()) -> Column:
    """column (JSON text) rewritten; mode: storage, run or report."""
    own, headers = list(patterns), frozenset(HEADERS | {h.lower() for h in strip_headers})

    def one(text: str | None, redact: Callable[[str], str]) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        done = for_storage(value, redact, headers) if mode == "storage" else for_run(value) if mode == "run" else for_report(value, redact)
        return None if done is None else json.dumps(done, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        redact = redactor(own)
        return texts.map(lambda t: one(t, redact))

    return run(column)
