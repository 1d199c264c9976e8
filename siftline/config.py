"""Settings: an immutable object, from defaults, a YAML file, the environment and overrides, each before the next."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any, get_type_hints

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Config:
    """Defaults. bm25_weight and semantic_weight are accepted and have no effect: a query's intent sets its weights."""

    num_per_engine: int = 15
    top_n_fetch: int = 10
    max_content_chars: int = 12000
    chunk_size: int = 600
    chunk_overlap: int = 100
    top_chunks_per_page: int = 3
    total_context_chunks: int = 15
    fetch_workers: int = 10
    fetch_timeout: int = 12
    bm25_weight: float = 0.7
    semantic_weight: float = 0.3
    position_bonus: bool = True
    title_match_bonus: float = 1.2
    early_chunk_bonus: float = 1.1
    factual_data_bonus: float = 1.15
    fresh_content_bonus: float = 1.3
    recent_content_bonus: float = 1.15


def _coerced(name: str, value: Any, kind: type) -> Any:
    if kind is bool and not isinstance(value, bool):
        word = str(value).strip().lower()
        if word in TRUE:
            return True
        if word in FALSE:
            return False
        raise ValueError(f"{name}: {value!r} is neither true nor false")
    return kind(value)


def load_config(path: str | None = None, env: Mapping[str, str] | None = None, **overrides: Any) -> Config:
    """Unknown keys are ignored; the path may also come from RAG_CONFIG_PATH, fields from RAG_<FIELD>."""
    env = os.environ if env is None else env
    path = path or env.get("RAG_CONFIG_PATH")
    layers: list[Mapping[str, Any]] = []
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            told = yaml.safe_load(f) or {}
        if not isinstance(told, Mapping):
            raise ValueError(f"{path} holds no mapping")
        layers.append(told)
    hints = get_type_hints(Config)
    names = [f.name for f in fields(Config)]
    layers.append({n: env[f"RAG_{n.upper()}"] for n in names if f"RAG_{n.upper()}" in env})
    layers.append({k: v for k, v in overrides.items() if v is not None})
    out = Config()
    for layer in layers:
        out = replace(out, **{n: _coerced(n, layer[n], hints[n]) for n in names if n in layer})
    return out
