"""URL filter: prefix rules first, then exact membership in a block list through a cascade of Bloom filters.

The cascade needs no join. Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0
takes wrongly, level 2 the listed keys that level 1 takes, and so on, until a level takes nothing wrongly. Over the
corpus's complete key universe the first level that a key misses then tells exactly whether it is listed.
Level 0's false-positive rate falls as the universe grows, so that the filters together take a number of bits in
proportion to the listed keys and the logarithm of the universe. Each filter is one row, an array of words that goes to the executors as a scalar subquery. A cascade
takes at most about ``max_bytes``: a longer list is split by a hash of the key into as many cascades as it needs, over the matching parts of the universe, and a
page's verdict is looked up in one after the other, each pass written. So the method is the same at every size, without joins.

Keys are a host and its parent domains, up to as many labels as a listed domain has (no longer one can be listed): a listed domain blocks its subdomains too.
Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is not listed (allow).
Repeated rows are judged alike, very long urls whole. All other columns of the input are kept; columns named like the results are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_written, written

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Domains that are blocked where no rule fits: each name under each suffix.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{n}.{s}" for n in LISTED_NAMES for s in LISTED_SUFFIXES)

MAX_FILTER_BYTES = 8 << 20
MAX_LEVELS = 64
LISTED_FLAG = "_url_listed"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column, labels: int) -> list[Column]:
    """The host's last label, its last two, and so on; the whole host where it has fewer."""
    return [F.substring_index(host, ".", -i) for i in range(1, labels + 1)]


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    bits: int
    hashes: int
    words: DataFrame | None = None  # one row, one array

    def has(self, key: Column, level: int) -> Column:
        words, hits = self.words.scalar(), []
        for j in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(self.bits))
            word = F.get(words, F.floor(at / 64).cast("int"))
            hits.append(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, hits)


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _first_rate(n_in: int, n_out: int) -> float:
    return min(0.5, n_in * math.sqrt(0.5) / max(n_out, 1))


def _level(keys: DataFrame, n: int, rate: float, level: int) -> Level:
    """A filter over n distinct keys, set bit by bit with partial aggregation and gathered as one row."""
    bits = _bits(n, rate)
    made = Level(bits, max(1, min(20, round(bits / max(n, 1) * math.log(2)))))
    at = [F.pmod(F.xxhash64("key", F.lit(level), F.lit(j)), F.lit(bits)) for j in range(made.hashes)]
    words = (
        keys.select(F.explode(F.array(*at)).alias("at"))
        .groupBy(F.floor(F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("set"))
    )
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("set"))
    full = words.union(blank).groupBy("word").agg(F.bit_or("set").alias("set"))
    made.words = written(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words")), "filter")
    return made


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """``universe`` and ``listed``: distinct strings in a column ``key``."""
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    while n_in:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"the cascade did not settle in {MAX_LEVELS} levels")
        made = _level(inside, n_in, 0.5 if levels else _first_rate(n_in, n_out), len(levels))
        wrong = outside.filter(made.has(F.col("key"), len(levels)))
        levels.append(made)
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    return levels


def listed_by(cascade: list[Level], key: Column) -> Column:
    """True if the key is listed: the first level that misses it has an odd number, or an even number of levels misses none."""
    out = F.lit(len(cascade) % 2 == 1)
    for i in reversed(range(len(cascade))):
        out = F.when(~cascade[i].has(key, i), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules=RULES, listed=LISTED, url: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds host, path, rule, verdict, and method_verdict (what the cascade alone says).

    ``listed``: an iterable of domains or a DataFrame with a column ``key``.
    """
    spark = pages.sparkSession
    keys = (listed.select("key") if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "key string")).filter("key <> ''").distinct()
    rows = pages.drop("host", "path", "rule", "verdict", "method_verdict", LISTED_FLAG).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), LISTED_FLAG: F.lit(False)})
    n_in, labels = keys.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(0))).first()
    hosts = rows.select("host").distinct()
    universe = written((hosts.select(F.explode(F.array(*domains_of(F.col("host"), labels))).alias("key")) if labels else hosts.select(F.col("host").alias("key"))).distinct(), "urlkeys")
    # the levels after the first take about two bits a key each, half as many keys each time
    size = (_bits(n_in, _first_rate(n_in, universe.count())) + 6 * n_in) // 8 if n_in else 0
    parts = size // max_bytes + 1
    part = lambda c: F.pmod(F.xxhash64(c, F.lit("part")), F.lit(parts))
    for k in range(parts):
        cascade = build_cascade(universe.filter(part(F.col("key")) == k), keys.filter(part(F.col("key")) == k))
        if cascade:
            names = [f"_url_key{i}" for i in range(labels)]
            rows = rows.withColumns(dict(zip(names, domains_of(F.col("host"), labels), strict=True)))
            hits = [((part(F.col(n)) == k) if parts > 1 else F.lit(True)) & listed_by(cascade, F.col(n)) for n in names]
            rows = rows.withColumn(LISTED_FLAG, reduce(lambda a, b: a | b, hits, F.col(LISTED_FLAG))).drop(*names)
            rows = written(rows, "urls") if parts > 1 else rows
    drop_written(spark, universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col(LISTED_FLAG), "block").otherwise("allow")
    return rows.withColumn("method_verdict", method).withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.col("method_verdict"))}).drop(LISTED_FLAG)


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    cases = lambda i: "case " + " ".join(f"when {f[0]} then '{f[i]}'" for f in fits)
    bad = " or ".join(f"host = '{d}' or ends_with(host, '.{d}')" for d in LISTED)
    return f"""
    with parts as (
      select page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') as host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
      from pages)
    select page_id, host, path, {cases(1)} else null end as rule, {cases(2)} when {bad} then 'block' else 'allow' end as verdict
    from parts"""


ORACLE = _sql()
