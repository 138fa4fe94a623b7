"""Settings: defaults, a profile, a file, the environment and overrides, merged in this order."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "retrieval": {"top_k": 8, "candidates": 30, "hybrid": True, "rrf_k": 60, "rerank": True, "max_context_tokens": 5500, "max_visuals": 3},
    "document": {"ocr": True, "figures": True, "tables": True, "equations": True, "dpi": 170, "max_chunk_words": 260, "min_chunk_words": 60, "max_download_mb": 100},
    "conversation": {"history_tokens": 1500, "rolling_summary": True, "rewrite_queries": True},
    "embedding": {"name": "hashing", "batch": 16, "dim": 1024},
}
PROFILES: dict[str, dict[str, Any]] = {"default": {}, "large": {"retrieval": {"top_k": 10, "max_context_tokens": 8000}}, "lite": {"retrieval": {"top_k": 6, "max_context_tokens": 3500, "rerank": False}}}
PREFIX = "TESSERA_"


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` put in, level by level."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def from_environment(environ: Mapping[str, str]) -> dict[str, Any]:
    """``TESSERA_A__B=1`` sets ``a.b``; values are read as JSON where they can be."""
    out: dict[str, Any] = {}
    for name, value in environ.items():
        if not name.startswith(PREFIX):
            continue
        *path, last = name.removeprefix(PREFIX).lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def load(profile: str = "default", file: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    out = DEFAULTS
    for part in (PROFILES[profile], file or {}, from_environment(environ or {}), overrides or {}):
        out = merged(out, part)
    check(out, DEFAULTS)
    return out


def check(given: Mapping[str, Any], known: Mapping[str, Any], path: str = "") -> None:
    for k, v in given.items():
        if k not in known:
            raise KeyError(f"unknown setting {path}{k}")
        if isinstance(known[k], Mapping):
            check(v, known[k], f"{path}{k}.")


def save(patch: Mapping[str, Any], path: str) -> dict[str, Any]:
    """Merge ``patch`` into the settings file at ``path``."""
    check(patch, DEFAULTS)
    try:
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    except FileNotFoundError:
        old = {}
    new = merged(old, patch)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(new, f, indent=1)
    return new
