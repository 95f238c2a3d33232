"""Reading order. Comparators that are not transitive follow the input order, carried as ``seq``."""

from __future__ import annotations

from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.runs import by_runs


def fuzzy(rows: list[dict], first: str, second: str, slack: float) -> list[dict]:
    """Stable sort by ``first``; values nearer than ``slack`` compare by ``second``."""

    def compare(a: dict, b: dict) -> float:
        d = a[first] - b[first]
        return d if abs(d) >= slack else a[second] - b[second]

    return sorted(rows, key=cmp_to_key(compare))


def sink(rows: list[dict], before) -> list[dict]:
    """Insertion along the list: each row moves up past neighbours while it belongs before them or they are untagged."""
    out = list(rows)
    for i in range(1, len(out)):
        for j in range(i, 0, -1):
            if before(out[j], out[j - 1]):
                out[j - 1], out[j] = out[j], out[j - 1]
    return out


def by_tag(rows: list[dict], tag: str, then: str, first: str, second: str, slack: float) -> list[dict]:
    def before(a: dict, b: dict) -> bool:
        if a.get(tag) is None or b.get(tag) is None:
            return False
        return (a[tag], a[then]) < (b[tag], b[then])

    return sink(fuzzy(rows, first, second, slack), before)


def reading_order(rows: list[dict], slack: float = 10) -> list[dict]:
    """By (top, x0), then each box moves left past boxes of its line."""
    out = sorted(rows, key=lambda r: (r["top"], r["x0"]))
    for i in range(1, len(out)):
        j = i
        while j and abs(out[j]["top"] - out[j - 1]["top"]) < slack and out[j]["x0"] < out[j - 1]["x0"]:
            out[j - 1], out[j] = out[j], out[j - 1]
            j -= 1
    return out


def ordered(boxes: DataFrame, sort, key: str = "page_id") -> DataFrame:
    """(key, seq, place) in the order that ``sort`` gives each group."""

    def step(rows: list[dict]) -> list[tuple]:
        return [(r[key], r["seq"], i) for i, r in enumerate(sort(rows))]

    return by_runs(boxes, (key,), ("seq",), step, f"{key} long, seq long, place long", [pa.int64()] * 3)


def joined(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of each key in order, blank ones skipped."""
    items = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(*order, text))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s[text]), sep).alias("markdown"))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def bands(mask: DataFrame, gap: int = 8) -> DataFrame:
    """Runs of content rows on each page; fewer than ``gap`` empty rows do not end a run.

    The last run reaches the page's end if fewer than ``gap`` empty rows follow it.
    """
    w = Window.partitionBy("page_id").orderBy("y")
    content = mask.where("has_content").withColumn("prev", F.lag("y").over(w))
    runs = content.withColumn("band", F.sum(F.when(F.col("y") - F.col("prev") > gap, 1).otherwise(0)).over(w))
    ends = mask.groupBy("page_id").agg(F.max("y").alias("y_last"))
    out = runs.groupBy("page_id", "band").agg(F.min("y").alias("top"), F.max("y").alias("bottom")).join(ends, "page_id")
    return out.select("page_id", "band", "top", F.when(F.col("y_last") - F.col("bottom") < gap, F.col("y_last")).otherwise(F.col("bottom")).alias("bottom"))
