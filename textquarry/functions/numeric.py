"""Numeric expressions and exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A band of at most so many distinct values is brought to the driver.
MAX_BAND = 100_000


def entropy(p: Column | str) -> Column:
    """-sum p ln(p + 1e-12) of an array of probabilities."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.log(x + F.lit(1e-12)))


def margin(p: Column | str) -> Column:
    """Best minus second best of an array; its only element if there is one."""
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norm)


def clamp(c: Column, low, high) -> Column:
    """Null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def finite(c: Column | str) -> Column:
    """NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, exact at any size.

    Spark's ``percentile`` keeps every distinct value of a column in one buffer. Here a first pass brackets each wanted rank between two approximate
    quantiles, a second counts the values below each bracket and the distinct values inside it; a bracket that still holds more than MAX_BAND
    distinct values is narrowed again. NaN and null don't count. Two passes suffice unless a bracket is very wide.
    """
    if not columns:
        return {}
    eps, pairs = 5e-4, [(c, q) for c in columns for q in qs]
    x = {c: finite(c) for c in columns}
    points = sorted({min(1.0, max(0.0, q + e)) for q in qs for e in (-eps, eps)})
    first = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)], *[F.percentile_approx(x[c], points, 10_000).alias(f"p{i}") for i, c in enumerate(columns)], *[F.struct(F.min(x[c]), F.max(x[c])).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    at = {c: dict(zip(points, first[f"p{i}"], strict=True)) if n[c] else {} for i, c in enumerate(columns)}
    ends = {c: tuple(first[f"m{i}"]) for i, c in enumerate(columns)}
    band = {(c, q): (at[c][min(1.0, max(0.0, q - eps))], at[c][min(1.0, max(0.0, q + eps))]) for c, q in pairs if n[c]}
    done: dict[tuple[str, float], float] = {}
    while band:
        todo = list(band)
        sums = []
        for i, (c, q) in enumerate(todo):
            lo, hi = band[c, q]
            sums += [F.count_if(x[c] < lo).alias(f"below{i}"), F.count_if(x[c].between(lo, hi)).alias(f"in{i}"), F.approx_count_distinct(F.when(x[c].between(lo, hi), x[c])).alias(f"d{i}"), F.percentile_approx(F.when(x[c].between(lo, hi), x[c]), [i / 64 for i in range(65)], 10_000).alias(f"g{i}")]
        got = df.agg(*sums).first()
        ready = []
        for i, (c, q) in enumerate(todo):
            rank, lo, hi = (n[c] - 1) * q, *band[c, q]
            low_rank, high_rank = int(rank), min(int(rank) + 1, n[c] - 1)
            if got[f"below{i}"] > low_rank or got[f"below{i}"] + got[f"in{i}"] <= high_rank:
                wide = (ends[c][0] if got[f"below{i}"] > low_rank else lo, ends[c][1] if got[f"below{i}"] + got[f"in{i}"] <= high_rank else hi)
                band[c, q] = wide
            elif got[f"d{i}"] > MAX_BAND and lo < hi and len(set(got[f"g{i}"])) > 3:
                grid, k = got[f"g{i}"], (low_rank - got[f"below{i}"]) * 64 // max(1, got[f"in{i}"])
                band[c, q] = (grid[max(0, k - 1)], grid[min(64, k + 2)])
            else:
                ready.append((c, q, got[f"below{i}"], low_rank, high_rank, rank))
        if ready:
            values = F.array(*[F.struct(F.lit(i).alias("i"), x[c].alias("v")) for i, (c, q, *_) in enumerate(ready)])
            inside = None
            for i, (c, q, *_) in enumerate(ready):
                cond = (F.col("p.i") == i) & F.col("p.v").between(*band[c, q])
                inside = cond if inside is None else inside | cond
            counts: dict[int, list[tuple[float, int]]] = {}
            for r in df.select(F.explode(values).alias("p")).filter(inside).groupBy(F.col("p.i").alias("i"), F.col("p.v").alias("v")).count().collect():
                counts.setdefault(r["i"], []).append((r["v"], r["count"]))
            for i, (c, q, below, low_rank, high_rank, rank) in enumerate(ready):
                seen, found = below, {}
                for v, k in sorted(counts.get(i, [])):
                    for want in (low_rank, high_rank):
                        if seen <= want < seen + k:
                            found[want] = v
                    seen += k
                a, b = found[low_rank], found[high_rank]
                done[c, q] = a + (b - a) * (rank - low_rank)
                del band[c, q]
    return {c: [done.get((c, q)) for q in qs] for c in columns}
