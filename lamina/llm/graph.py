"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join on node ids; hot centres are summed
before the shuffle and their joins can be split. Each round's links are written
to the shared folder, so a lost executor costs one round at most. The rounds
needed grow with the logarithm of the links.

Defined results: no links, no nodes; loops and repeated links do no harm; a link
with a null end is none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import drop, materialize

#: Rounds before giving up with an error: far beyond the logarithm of any number of links.
MAX_ROUNDS = 100


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link to another; label is the least node reachable. ``links`` holds (a, b) longs."""
    e = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        before, e = e, materialize(_small_star(_large_star(e)), "links")
        drop(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b"), F.col("b")).distinct())
