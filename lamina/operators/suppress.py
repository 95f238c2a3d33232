"""Order-dependent suppression and clean-up of boxes, one page at a time.

Greedy suppression is a fold over each page's boxes, best first, inside the JVM.
Clean-up goes back and forth between neighbours; it runs over sorted rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.runs import by_runs


def _iou(a: Column, b: Column, border: int) -> Column:
    side = lambda low, high: F.greatest(F.lit(0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]) + border)
    size = lambda x: (x["x1"] - x["x0"]) * (x["bottom"] - x["top"])
    common = side("x0", "x1") * side("top", "bottom")
    return F.try_divide(common.cast("double"), (size(a) + size(b) - common).cast("double"))


def suppress(boxes: DataFrame, limit: float, keys: tuple[str, ...] = ("page_id", "type"), pixel_border: bool = True) -> DataFrame:
    """(page_id, seq) of boxes that survive greedy suppression by score inside each key, of equal scores the smaller seq first.

    A box goes if it overlaps a kept one beyond the limit, or if their overlap is
    no number. With ``pixel_border`` intersections count one pixel more on each
    side and the limit itself is kept; without it neither.
    """
    best_first = F.struct((-F.col("score")).alias("rank"), F.col("seq").alias("n"), "x0", "top", "x1", "bottom", F.col("page_id").alias("page"))
    items = F.array_sort(F.collect_list(best_first))
    grouped = boxes.groupBy(*keys).agg(items.alias("boxes"))

    def fits(kept: Column, box: Column) -> Column:
        value = lambda k: _iou(k, box, int(pixel_border))
        return F.forall(kept, lambda k: F.coalesce(value(k) <= limit if pixel_border else value(k) < limit, F.lit(False)))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda out, box: F.when(fits(out, box), F.concat(out, F.array(box))).otherwise(out))
    return grouped.select(F.explode(kept).alias("box")).select(F.col("box.page").alias("page_id"), F.col("box.n").alias("seq"))


def _apart(a: dict, b: dict) -> bool:
    return a["x1"] < b["x0"] or a["x0"] > b["x1"] or a["bottom"] < b["top"] or a["top"] > b["bottom"]


def _common(a: dict, b: dict) -> float:
    return max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]))


def _share(a: dict, b: dict) -> float:
    size = (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])
    return _common(a, b) / size if size else 0.0


def clean(layouts: list[dict], texts: list[dict], reach: int, least: float) -> list[dict]:
    """Of like neighbours that cover each other by ``least`` the weaker goes; of equal scores the earlier."""
    left, at = list(layouts), 0
    while at + 1 < len(left):
        end = min(at + reach, len(left))
        near = next((j for j in range(at + 1, end) if left[at].get("type") == left[j].get("type") and not _apart(left[at], left[j])), None)
        if near is None or max(_share(left[at], left[near]), _share(left[near], left[at])) < least:
            at += 1
            continue
        mine, other = left[at].get("score"), left[near].get("score")
        if not (mine and other):
            mine, other = (sum(_common(t, left[k]) for t in texts if not _apart(t, left[k])) for k in (at, near))
        left.pop(near if mine > other else at)
    return left


def clean_layouts(layouts: DataFrame, reach: int = 5, least: float = 0.6, texts: DataFrame | None = None) -> DataFrame:
    """(page_id, seq) of the layouts that remain after clean-up, which scans them from top to bottom.

    Of two that cover each other the one with the lower score goes, or, where
    one has no score, the one that covers less of the page's ``texts`` (page_id
    and edges).
    """
    rows = layouts.select("page_id", "seq", "type", "x0", "top", "x1", "bottom", "score")
    if texts is not None:
        edges = F.collect_list(F.struct("x0", "top", "x1", "bottom"))
        rows = rows.join(texts.groupBy("page_id").agg(edges.alias("texts")), "page_id", "left")

    def step(rows: list[dict]) -> list[tuple]:
        return [(r["page_id"], r["seq"]) for r in clean(rows, rows[0].get("texts") or [], reach, least)]

    return by_runs(rows, ("page_id",), ("top", "seq"), step, "page_id long, seq long", [pa.int64(), pa.int64()])


#: Kinds of table parts that are cleaned up together: pattern of the label, and the share that makes two of them one.
PART_KINDS = ((".* (row|header)", 0.6), (".*spanning", 0.6), ("table column$", 0.5))


def clean_parts(parts: DataFrame, reach: int = 5) -> DataFrame:
    """Table parts without those that stand for one already kept: rows and headers, spans, and columns by themselves.

    Rows and spans are scanned from top to bottom, columns from left to right.
    """

    def step(rows: list[dict]) -> list[tuple]:
        kept = []
        for pattern, least in PART_KINDS:
            own = [{**r, "type": None} for r in rows if re.match(pattern, r["label"])]
            own.sort(key=lambda r: (r["x0"] if "column$" in pattern else r["top"], r["seq"]))
            kept += [(r["table_id"], r["seq"]) for r in clean(own, [], reach, least)]
        return sorted(set(kept))

    narrow = parts.select("table_id", "seq", "label", "x0", "top", "x1", "bottom", "score")
    kept = by_runs(narrow, ("table_id",), ("seq",), step, "table_id long, seq long", [pa.int64(), pa.int64()])
    return parts.join(kept, ["table_id", "seq"], "left_semi")


def _ctc_kept(symbols: Column, blank: int) -> Column:
    """(x, i) of the steps that begin a run of a symbol other than the blank."""
    steps = F.transform(symbols, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.when(i == 0, True).otherwise(x != F.get(symbols, i - 1)).alias("new")))
    return F.filter(steps, lambda s: s["new"] & (s["x"] != blank))


def ctc_collapse(symbols: str, blank: int = 0) -> Column:
    """Repeats collapsed, then blanks dropped, of an array of class numbers."""
    return F.transform(_ctc_kept(F.col(symbols), blank), lambda s: s["x"])


def ctc_confidence(symbols: str, scores: str, blank: int = 0) -> Column:
    """The mean score of the steps that ``ctc_collapse`` keeps; 0 where it keeps none."""
    kept = F.transform(_ctc_kept(F.col(symbols), blank), lambda s: F.get(F.col(scores), s["i"]))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))
