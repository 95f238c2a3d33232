"""Driver-side configuration: environment files, switches, layered settings."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, MutableMapping
from typing import Any


def load_env(text: str, env: MutableMapping[str, str] | None = None) -> None:
    """Fill in what is missing from KEY=VALUE lines; blank lines and comments are skipped, quotes dropped."""
    env = os.environ if env is None else env
    for line in map(str.strip, text.splitlines()):
        key, sep, value = line.partition("=")
        if sep and key.strip() and not line.startswith("#"):
            env.setdefault(key.strip(), value.strip().strip("\"'"))


def switch(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "y", "on"}


def layered(base: Mapping[str, Any], local: Mapping[str, Any]) -> dict[str, Any]:
    """Top-level keys of ``local`` replace those of ``base``."""
    return {**base, **local}


def index_schema(fields: Mapping[str, str]) -> str:
    """A Spark schema from index field names and their declared or derived types."""
    types = {
        "integer": "int", "unsigned_long": "decimal(20,0)", "long": "bigint", "short": "smallint", "float": "float", "text": "string", "keyword": "string",
        "date": "timestamp", "nested": "array<map<string,string>>", "object": "string", "rank_feature": "float", "rank_features": "map<string,float>",
        "dense_vector": "array<float>", "binary": "binary", "geo_point": "struct<lat:double,lon:double>",
    }
    return ", ".join(f"`{name}` {types[kind]}" for name, kind in fields.items())


def read_settings(text: str, kind: str) -> dict[str, Any]:
    """Settings of a JSON or YAML file; an empty one has none. YAML needs its parser to be installed."""
    if kind == "json":
        return json.loads(text) if text.strip() else {}
    if kind != "yaml":
        raise ValueError(f"settings of unknown kind: {kind}")
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need a YAML parser; give them as JSON") from e
    return yaml.safe_load(text) or {}


def base_url(value: str | None, default: str) -> str:
    """An address without white space and slashes at its end; the default where there is none."""
    return (value or "").strip().rstrip("/") or default.rstrip("/")


def number(value: str | None, default: float, kind: type = float) -> float:
    """A number from the environment; the default where it is missing or none."""
    try:
        return kind((value or "").strip())
    except ValueError:
        return default
