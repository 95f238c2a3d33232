"""Sharding by longest-processing-time scheduling.

Groups that must stay together (documents of equal text) are jobs whose length
is their size in bytes. Jobs go, longest first, to the least loaded shard, which
a heap finds. Jobs of one size are alike, so the schedule needs only how many
there are of each size: it runs over that histogram, from the largest size down,
and gives each shard a number of jobs of every size. The driver holds one pair of
numbers a distinct size; as sizes are whole bytes, k of them take k * k / 2 bytes
of text, so there are at most 14 million in 100 TB, and far fewer in practice.

A group then finds its shard by its rank among the groups of its size, along
which the shares of the shards lie one after another. Ranks are counted in strips
of the hash of the group, so that no window holds all groups of a size, and rows
of groups with a thousandth of all rows or more get their shard by broadcast.

Defined results: a null text has no bytes, and null texts form one group; an
empty text is a group apart from null; repeated rows are rows of their own with
slots of their own; ties between jobs of one size go by the hash of the text; a
text of any length counts whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, join_small, materialize, shuffle_partitions

#: Rows of one window, on average at most, where ranks and slots are counted.
STRIP_ROWS = 500_000
#: Groups with this share of all rows are joined by broadcast; there are at most so many.
HOT = 1000


def lpt(jobs: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """{job: shard} of (job, size); ties go to the smaller job and the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for job, size in sorted(jobs, key=lambda j: (-j[1], j[0])):
        load, s = heapq.heappop(heap)
        out[job] = s
        heapq.heappush(heap, (load + size, s))
    return out


def lpt_counts(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, jobs for each shard) of (size, jobs), largest size first: what ``lpt`` gives job by job.

    While some shard could take a job and stay within a level, the heap never
    gives one that goes beyond it. So all shards are filled to the highest level
    that the jobs of a size reach, and the few that are left go through the heap.
    """
    load = [0] * shards
    out = []
    for size, jobs in sorted(histogram, reverse=True):
        fits = lambda level: [max(0, level - x) // size for x in load]
        low, high = min(load), max(load) + size * jobs + 1
        while high - low > 1:
            middle = (low + high) // 2
            if sum(fits(middle)) <= jobs:
                low = middle
            else:
                high = middle
        given = fits(low)
        load = [x + n * size for x, n in zip(load, given, strict=True)]
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(jobs - sum(given)):
            _, s = heapq.heappop(heap)
            given[s] += 1
            load[s] += size
            heapq.heappush(heap, (load[s], s))
        out.append((size, given))
    return out


def _scheduled(groups: DataFrame, shards: int, strips: int) -> DataFrame:
    """(grp, n, shard) of ``groups`` (grp, bytes, n)."""
    spark = groups.sparkSession
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("jobs")).toArrow()  # a row a distinct size
    dealt = lpt_counts(list(zip(*(histogram.column(c).to_pylist() for c in ("bytes", "jobs")), strict=True)), shards)
    ends = pa.table({"size": pa.array([x for x, _ in dealt], pa.int64()), "ends": pa.array([list(accumulate(given)) for _, given in dealt], pa.list_(pa.int64()))})
    shares = materialize(spark.createDataFrame(ends), "shard-shares")
    stripped = groups.withColumn("strip", F.pmod(F.xxhash64("grp"), F.lit(strips)))
    before = Window.partitionBy("bytes").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = stripped.groupBy("bytes", "strip").agg(F.count(F.lit(1)).alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    inside = Window.partitionBy("bytes", "strip").orderBy("grp")
    ranked = stripped.join(starts.drop("k"), ["bytes", "strip"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)
    placed = join_small(ranked, shares, {"bytes": "size"})
    return placed.select("grp", "n", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    group = F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b""))
    base = materialize(
        docs.select(
            "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), group.alias("grp"), F.monotonically_increasing_id().alias("row")
        ),
        "shard-base",
    )
    rows = base.count()
    strips = max(4 * shuffle_partitions(spark), rows // STRIP_ROWS)
    groups = materialize(base.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    places = materialize(_scheduled(groups, shards, strips), "shard-places")
    hot = F.broadcast(places.where(F.col("n") * HOT >= rows).select("grp", "shard"))  # at most HOT rows
    rest = places.where(F.col("n") * HOT < rows).select("grp", "shard")
    found = base.join(hot, "grp").unionByName(base.join(hot, "grp", "left_anti").join(rest, "grp"))
    strip = F.pmod(F.xxhash64("row"), F.lit(strips))
    placed = materialize(found.select("doc_id", "size", "text_crc32", "shard", strip.alias("strip")), "shard-placed")
    drop(base, groups, places)
    before = Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "strip").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "strip").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    return placed.join(starts, ["shard", "strip"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    )
