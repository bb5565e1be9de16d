"""Candidates from a text service: prompts from the policies, calls side by side, waits when the service is busy, rules where it fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rewrite import RewriteOptions, merged, prompt, rule_generate, token_cap

MODES = ("rule", "llm", "hybrid")


class Busy(Exception):
    """The service asks to wait: ``after`` seconds, if it says so."""

    def __init__(self, after: float | None = None):
        super().__init__("the service is busy")
        self.after = after


@dataclass
class Service:
    """``call`` takes the system message, the user message and the most tokens, and returns a text. It goes to the tasks, so it must be picklable.

    A busy service is asked again up to ``retries`` times, after ``wait`` seconds doubled each time up to ``longest``. Up to ``concurrency`` calls run in a task.
    """

    call: Callable[[str, str, int], str]
    retries: int = 8
    wait: float = 1.0
    longest: float = 60.0
    concurrency: int = 4
    max_tokens: int | None = None

    def ask(self, system: str, user: str, tokens: int, sleep: Callable[[float], None] = time.sleep) -> str:
        for k in range(self.retries + 1):
            try:
                return self.call(system, user, tokens)
            except Busy as e:
                if k == self.retries:
                    raise
                sleep(min(self.longest, e.after if e.after is not None else self.wait * 2**k))
        raise ValueError("retries is negative")


def default_mode(service: Service | None) -> str:
    return "hybrid" if service is None else "llm"


def generator(service: Service | None = None, mode: str | None = None) -> Callable[[DataFrame, RewriteOptions], DataFrame]:
    """What ``rewrite.run`` takes as ``generate``.

    ``rule``: templates alone. ``llm``: the service's answers; an error that remains fails the job. ``hybrid``: answers, and the rule's text where the call fails
    or there is no service. A lost task asks again for its rows.
    """
    mode = mode or default_mode(service)
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    if mode == "rule" or (mode == "hybrid" and service is None):
        return rule_generate
    if service is None:
        raise ValueError("mode 'llm' needs a service")

    def generate(df: DataFrame, o: RewriteOptions) -> DataFrame:
        policies = {p.name: merged(p, o.defaults) for p in o.policies}
        rows = rule_generate(df, o) if mode == "hybrid" else df.withColumn("raw", F.array(F.lit(None).cast("string")))

        def one(row: tuple[str | None, str | None, list]) -> list:
            name, text, rule = row
            if name not in policies or not (text or "").strip():
                return rule
            p = policies[name]
            n = p.n_variants or 1
            try:
                return [service.ask(*prompt(p, text, n, o.validation.separator), token_cap(service.max_tokens, n))]
            except Exception:
                if mode == "llm":
                    raise
                return rule

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(service.concurrency) as pool:
                for b in it:
                    asked = zip(*(b.column(c).to_pylist() for c in ("policy", "text", "raw")), strict=True)
                    place = b.schema.get_field_index("raw")
                    yield b.set_column(place, b.schema.field(place), pa.array(list(pool.map(one, asked)), b.schema.field(place).type))

        return rows.mapInArrow(run, rows.schema)

    return generate
