"""Configuration as a plain dictionary: environment values filled in, folders under one base URI."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from typing import Any

_VALUE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def substitute(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${NAME}`` in any string of a nested structure becomes the variable's value, or nothing."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _VALUE.sub(lambda m: env.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return value


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return substitute(yaml.safe_load(f) or {})


@dataclass
class Folders:
    """Where the steps write; ``base`` is any URI that Spark can write to."""

    base: str

    def path(self, kind: str, name: str) -> str:
        return f"{self.base.rstrip('/')}/{kind}/{name}"

    raw = property(lambda self: self.path("raw", "merged.parquet"))
    rewritten = property(lambda self: self.path("interim", "rewritten.parquet"))
    clean = property(lambda self: self.path("interim", "clean.parquet"))
    labeled = property(lambda self: self.path("labeled", "auto_labeled.parquet"))
    tasks = property(lambda self: self.path("labeled", "tasks.jsonl"))
    queue = property(lambda self: self.path("labeled", "review_queue.jsonl"))
    results = property(lambda self: self.path("labeled", "review_results.jsonl"))
    final = property(lambda self: self.path("labeled", "final.parquet"))
    candidates = property(lambda self: self.path("labeled", "candidates.jsonl"))
    model = property(lambda self: self.path("models", "baseline"))


DEFAULTS = {
    "collection": {"max_merged_rows": None, "max_rows_per_source": None},
    "rewrite": {"enabled": True},
    "quality": {"duplicate_subset": ["text"], "iqr_k": 1.5, "missing": "fill", "duplicates": "drop", "outliers": "drop_iqr"},
    "annotation": {"confidence_threshold": 0.7, "max_review_items": None},
    "hitl": {"human_mode": "stop_if_missing"},
    "active_learning": {"batch_size": 100, "strategy": "entropy", "start": 50, "step": 20, "iterations": 5, "strategies": ["entropy", "margin", "random"], "seed": 42},
    "training": {"test_size": 0.2, "seed": 42},
}


def with_defaults(config: dict) -> dict:
    return {k: {**v, **(config.get(k) or {})} for k, v in DEFAULTS.items()} | {k: v for k, v in config.items() if k not in DEFAULTS}
