"""Connected components of a table of links, by alternating large and small stars (a logarithmic number of rounds).

Every round shuffles links, never gathers a node's neighbours in one task (least neighbours by partial aggregation, then a join whose hot
side adaptive execution can split), and ends in a written table: no lineage grows and nothing reaches the driver but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

MAX_ROUNDS = 64


def _measured(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, written, and their number and checksum, read back from the written table."""
    out = written(edges, "edges")
    got = out.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return out, (got["n"], got["x"])


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b (bigint). Returns node, component: every linked node and the least node it is connected with."""
    spark = links.sparkSession
    clean = links.filter("a is not null and b is not null and a <> b")
    edges, state = _measured(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        new, now = _measured(small.distinct())
        for t in (edges, least, large, low):
            drop_written(spark, t)
        edges, before, state = new, state, now
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
