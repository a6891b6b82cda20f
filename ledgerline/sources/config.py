"""Provider configuration, validated on the driver."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

KINDS = ("openai-compatible",)
CAPABILITIES = ("streaming", "tools", "vision", "usage", "embeddings")
SENSITIVE_HEADERS = ("authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization", "api-key")
SCHEMA = "ordinal int, id string, kind string, base_url string, default_model string, models array<struct<id:string,aliases:array<string>>>"


class ConfigError(ValueError):
    pass


def _need(ok: object, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _text(v: object) -> bool:
    return isinstance(v, str) and v.strip() != ""


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0


def _flags(where: str, value: object) -> None:
    _need(value is None or isinstance(value, dict), f"{where}: capabilities must be an object")
    for k, v in (value or {}).items():
        _need(k in CAPABILITIES, f"{where}: no capability is called {k}")
        _need(isinstance(v, bool), f"{where}: capability {k} must be true or false")


def _model(where: str, m: object) -> tuple[str, list[str]]:
    _need(isinstance(m, dict), f"{where} must be an object")
    _need(_text(m.get("id")), f"{where}: id must be a text")
    _need("label" not in m or _text(m["label"]), f"{where}: label must be a text")
    aliases = m.get("aliases", [])
    _need(isinstance(aliases, list) and all(map(_text, aliases)), f"{where}: aliases must be texts")
    _flags(where, m.get("capabilities"))
    for group, fits in (("limits", _whole), ("pricing", _number)):
        own = m.get(group, {})
        _need(isinstance(own, dict), f"{where}: {group} must be an object")
        for k, v in own.items():
            _need(fits(v) or (group == "pricing" and k == "currency" and _text(v)), f"{where}: {group}.{k} is out of range")
    return m["id"], aliases


def providers(config: object) -> list[tuple]:
    """Rows of SCHEMA from a configuration; raises ConfigError on the first fault."""
    _need(isinstance(config, dict) and isinstance(config.get("providers"), list) and config["providers"], "providers must be a list that isn't empty")
    out, seen = [], set()
    for i, p in enumerate(config["providers"]):
        where = f"provider {i}"
        _need(isinstance(p, dict), f"{where} must be an object")
        _need(_text(p.get("id")), f"{where}: id must be a text")
        _need(p["id"] not in seen, f"{where}: id {p['id']} is taken")
        seen.add(p["id"])
        _need(p.get("kind") in KINDS, f"{where}: kind must be one of {', '.join(KINDS)}")
        _need(_text(p.get("baseUrl")), f"{where}: baseUrl must be a text")
        url = urlsplit(p["baseUrl"])
        _need(url.scheme in ("http", "https") and url.hostname, f"{where}: baseUrl must be http or https")
        _need(url.username is None and url.password is None, f"{where}: baseUrl must not hold credentials")
        _need("apiKeyEnv" not in p or _text(p["apiKeyEnv"]), f"{where}: apiKeyEnv must be a text")
        _need(p.get("defaultModel") is None or _text(p["defaultModel"]), f"{where}: defaultModel must be a text")
        headers = p.get("headers", {})
        _need(isinstance(headers, dict) and all(isinstance(v, str) for v in headers.values()), f"{where}: headers must be texts")
        _need(not any(h.lower() in SENSITIVE_HEADERS for h in headers), f"{where}: headers must not hold credentials")
        _flags(where, p.get("capabilities"))
        models = p.get("models", [])
        _need(isinstance(models, list), f"{where}: models must be a list")
        out.append((i, p["id"], p["kind"], p["baseUrl"], p.get("defaultModel"), [_model(f"{where}, model {k}", m) for k, m in enumerate(models)]))
    return out


def provider_table(spark: SparkSession, config: object) -> DataFrame:
    return spark.createDataFrame(providers(config), SCHEMA)
