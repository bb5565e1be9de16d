"""Reproducible samples: rows are taken in the order of a hash of (seed, id), never by a random generator.

The hash is hex SHA-256 of ``seed|id``, which any SQL engine can repeat. Null group keys are a group of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "_row_id"
SLOT = 1000


def hash_order(seed: int, row_id: str = ROW_ID) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")), 256)


def cap_per_group(df: DataFrame, group: str, cap: int | None, seed: int = 42, row_id: str = ROW_ID, head: bool = False) -> DataFrame:
    """At most ``cap`` rows a group, in hash order, or the first by id. None and non-positive caps mean no cap.

    Spark limits each group before the shuffle (a rank below a constant), so a hot group sends ``cap`` rows a task at most.
    """
    cap = row_cap(cap)
    if cap is None:
        return df
    order = [F.col(row_id)] if head else [hash_order(seed, row_id), F.col(row_id)]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= cap).drop("_rank")


def row_cap(value) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool):
        raise ValueError("a row cap is a number, not a truth value")
    return int(value) if int(value) > 0 else None


def sample(df: DataFrame, n: int, seed: int = 42, row_id: str = ROW_ID) -> DataFrame:
    return df.orderBy(hash_order(seed, row_id), row_id).limit(max(0, n))


def allocate(df: DataFrame, target: int, group: str = "source") -> DataFrame:
    """source, n_rows, n_taken: largest-remainder shares of ``target`` with at least one row a group.

    With R = target - groups, a group of c rows of n gets min(floor(R c / n), c - 1) more; what remains goes one by one in order of the fractional part, skipping full
    groups, in rounds. Ties: the smaller group. If there are more groups than the target, the first ``target`` groups get one row each.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    everything = Window.partitionBy()  # over groups, not rows
    by_name = Window.orderBy(F.col(group).asc_nulls_first())
    g = sizes.withColumns({"n": F.sum("n_rows").over(everything), "s": F.count("*").over(everything), "place": F.row_number().over(by_name)})
    rest = F.lit(target) - F.col("s")
    raw = rest * F.col("n_rows") / F.col("n")
    g = g.withColumns({"raw": raw, "extra": F.greatest(F.lit(0), F.least(F.floor(raw), F.col("n_rows") - 1)).cast("bigint")})
    g = g.withColumn("left", F.lit(target) - F.col("s") - F.sum("extra").over(everything))
    # further rows as numbered slots: round first, then fraction, then name
    slots = g.filter("left > 0").select(group, "raw", "left", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(0), F.least(F.col("n_rows") - 1 - F.col("extra"), "left")).cast("int"))).alias("round")).filter("round >= 1")
    won = slots.withColumn("turn", F.row_number().over(Window.orderBy("round", (F.col("raw") - F.floor("raw")).desc(), F.col(group).asc_nulls_first()))).filter("turn <= left")
    more = won.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("more"))
    g = g.join(more, F.col(group).eqNullSafe(F.col("_g")), "left")
    taken = F.when((F.col("n") <= target) | F.lit(target <= 0), F.col("n_rows")).when(F.col("s") > target, (F.col("place") <= target).cast("bigint")).otherwise(1 + F.col("extra") + F.coalesce("more", F.lit(0)))
    return g.select(group, "n_rows", taken.cast("bigint").alias("n_taken"))


def stratified_sample(df: DataFrame, target: int, group: str = "source", seed: int = 42, row_id: str = ROW_ID) -> DataFrame:
    """``target`` rows with every group represented; without the group column, a plain sample."""
    if group not in df.columns:
        return sample(df, target, seed, row_id)
    shares = allocate(df, target, group).select(F.col(group).alias("_g"), "n_taken")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, row_id), F.col(row_id)))
    # no group takes more than the target: a constant bound lets Spark cut groups before the shuffle
    ranked = df.withColumn("_rank", rank)
    ranked = ranked.filter(F.col("_rank") <= target) if target > 0 else ranked
    return ranked.join(F.broadcast(shares), F.col(group).eqNullSafe(F.col("_g"))).filter("_rank <= n_taken").drop("_rank", "_g", "n_taken")


def split(df: DataFrame, fraction: float, seed: int = 42, stratify: str | None = None, row_id: str = ROW_ID, few: bool = False) -> DataFrame:
    """Adds ``_test``: true for ceil(fraction * n) rows, of all or of each stratum, in hash order.

    Ranks come from a range sort, not from one window over everything. Within strata, rows are counted by the first digits of their hash; all below the
    place where the counts reach the wanted number are in, and only the rows of the digits at that place, about SLOT a stratum, are ranked.
    ``few``: a row a stratum may be sent to every task, so that the rows themselves stay where they are.
    """
    told = F.broadcast if few else lambda x: x
    if stratify is not None:
        digits = max(1, min(8, math.ceil(math.log(max(1, df.count()) / SLOT, 16))))
        place = F.substring("_h", 1, digits)
        rows = df.withColumn("_h", hash_order(seed, row_id))
        counts = rows.groupBy(F.col(stratify).alias("_s"), place.alias("_p")).agg(F.count("*").alias("_c"))
        by_place = Window.partitionBy("_s").orderBy("_p")
        marks = counts.withColumns({"_upto": F.sum("_c").over(by_place), "_n": F.ceil(F.sum("_c").over(Window.partitionBy("_s")) * fraction)})
        edge = marks.filter("_upto >= _n and _upto - _c < _n").select("_s", F.col("_p").alias("_edge"), (F.col("_n") - F.col("_upto") + F.col("_c")).alias("_more"))
        same = F.col(stratify).eqNullSafe(F.col("_s"))
        at_edge = rows.join(told(edge), same & (place == F.col("_edge")))
        rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", F.col(row_id)))
        last = at_edge.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_more")).select("_s", F.struct("_h", row_id).alias("_last"))
        # a row a stratum; those of fraction 0 have none
        return rows.join(told(last), same, "left").withColumn("_test", F.coalesce(F.struct("_h", row_id) <= F.col("_last"), F.lit(False))).drop("_h", "_s", "_last")
    n = df.count()
    k = -(-n * int(round(fraction * 10**6)) // 10**6)
    chosen = df.select(row_id, hash_order(seed, row_id).alias("_h")).orderBy("_h", row_id).limit(k).select(row_id, F.lit(True).alias("_hit"))
    return df.join(chosen, row_id, "left").withColumn("_test", F.coalesce("_hit", F.lit(False))).drop("_hit")
