"""Regions of probability rasters, held as pixels (page_id, y, x, p).

Pixels above a threshold form runs along their rows. Runs of neighbouring rows that
touch, at corners too, are linked: an equi-join on the page and the next row, with the
columns as a residual condition. The connected components of the runs are the
regions. A region's hull comes from the ends of its rows alone, so what meets in a task
is two points a row and region; its rectangle of least area lies along an edge of the
hull. The rectangle is widened on all sides by area * ratio / perimeter, as an
offset with round joins would widen it.

Mask rows for the band sweep come from the edges of boxes: +1 where a box begins, -1
below its end, summed along the page, so that no pixel is made.

Defined results: pixels without a page, place or probability, and those at or below
the threshold, belong to no region; a pixel given twice counts once, with its larger
probability; regions of one row or one pixel have a rectangle without area and fall
by ``min_side``; of rectangles of equal area the one along the earlier edge, from the
leftmost point on, stands; boxes without an edge or below their own end cover nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.storage import materialize

THRESHOLD, BOX_THRESHOLD, UNCLIP, MIN_SIDE = 0.3, 0.7, 2.0, 3.0


def runs(pixels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, y, first, last, total, run): the maximal runs of pixels above ``threshold``, with the sum of their probabilities."""
    lit = pixels.where((F.col("p") > threshold) & F.col("page_id").isNotNull()).groupBy("page_id", "y", "x").agg(F.max("p").alias("p")).where("y IS NOT NULL AND x IS NOT NULL")
    row = Window.partitionBy("page_id", "y").orderBy("x")
    island = F.col("x") - F.row_number().over(row)
    found = lit.withColumn("island", island).groupBy("page_id", "y", "island").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.sum("p").alias("total"))
    return found.drop("island").withColumn("run", F.struct("page_id", "y", "first"))


def links(found: DataFrame) -> DataFrame:
    """(a, b): runs of neighbouring rows that touch."""
    above = found.select("page_id", (F.col("y") + 1).alias("y"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("run").alias("b"))
    met = found.join(above, ["page_id", "y"]).where((F.col("first") <= F.col("l") + 1) & (F.col("f") <= F.col("last") + 1))
    return met.select(F.col("run").alias("a"), "b")


#: Rounds of ``components`` at most; each at least halves the paths that are left.
ROUNDS = 64


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label): the least node that each of ``nodes`` (node) reaches along ``pairs`` (a, b).

    Every round takes the least label around and then that label's own label, until
    nothing changes; what a round says is written, so no round is done twice.
    """
    both = materialize(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "raster-pairs")
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "raster-labels")
    for _ in range(ROUNDS):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node", "left").select("node", F.col("label").alias("had"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of = labels.join(around, "node", "left").select(F.col("node").alias("label"), F.least("label", F.coalesce("near", "label")).alias("next"))
        jumped = least.join(of, "label", "left").select("node", "had", F.coalesce("next", "label").alias("label"))
        jumped = materialize(jumped, "raster-labels")
        labels = jumped.select("node", "label")
        if not jumped.where("had <> label").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def regions(pixels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, region, y, first, last, total, n): the runs of every region, which is named by its first run."""
    found = materialize(runs(pixels, threshold), "raster-runs")
    label = components(found.select(F.col("run").alias("node")), links(found))
    return found.join(label.select(F.col("node").alias("run"), F.col("label").alias("region")), "run").select("page_id", "region", "y", "first", "last", "total", (F.col("last") - F.col("first") + 1).alias("n"))


def boxes(found: DataFrame) -> DataFrame:
    """(page_id, region, x0, top, x1, bottom, n, score): upright boxes of ``regions``, pixels counted and averaged."""
    return found.groupBy("page_id", "region").agg(
        F.min("first").alias("x0"), F.min("y").alias("top"), F.max("last").alias("x1"), F.max("y").alias("bottom"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("score")
    )


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of distinct points, from the leftmost one round."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def least_rectangle(corners: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(corners, shorter side, longer side) of the rectangle of least area around a hull: one of its sides lies along an edge."""
    edge = np.roll(corners, -1, 0) - corners
    edge = edge[(edge != 0).any(1)]
    if not len(edge):
        return np.repeat(corners[:1].astype(float), 4, 0), 0.0, 0.0
    along = edge / np.linalg.norm(edge, axis=1, keepdims=True)
    across = np.column_stack([-along[:, 1], along[:, 0]])
    u, v = corners @ along.T, corners @ across.T
    low, high = np.array([u.min(0), v.min(0)]), np.array([u.max(0), v.max(0)])
    size = high - low
    i = int(np.argmin(np.round(size[0] * size[1], 9)))
    at = [(low[0, i], low[1, i]), (high[0, i], low[1, i]), (high[0, i], high[1, i]), (low[0, i], high[1, i])]
    return np.array([a * along[i] + b * across[i] for a, b in at]), float(size[:, i].min()), float(size[:, i].max())


def ordered(quad: np.ndarray) -> np.ndarray:
    """Corners clockwise on the page: of the two leftmost the upper one first."""
    q = quad[np.lexsort((quad[:, 1], quad[:, 0]))]
    left, right = q[:2][np.argsort(q[:2, 1], kind="stable")], q[2:][np.argsort(q[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]])


def widened(quad: np.ndarray, distance: float) -> np.ndarray:
    """A rectangle moved outward by ``distance`` on every side."""
    a, b = quad[1] - quad[0], quad[3] - quad[0]
    unit = lambda x: x / n if (n := np.linalg.norm(x)) else np.zeros(2)
    a, b = unit(a) * distance, unit(b) * distance
    return quad + np.array([-a - b, a - b, a + b, -a + b])


def quads(found: DataFrame, box_threshold: float = BOX_THRESHOLD, unclip: float = UNCLIP, min_side: float = MIN_SIDE, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """(page_id, region, score, quad): the widened rectangle of every region that is large and sure enough, scaled and rounded; ``quad`` is x and y of four corners."""
    ends = found.groupBy("page_id", "region", "y").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("total").alias("total"), F.sum("n").alias("n"))

    def outline(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            quad = []
            for y, first, last in zip(part["ys"], part["firsts"], part["lasts"], strict=True):
                corners = hull(np.unique(np.concatenate([np.column_stack([first, y]), np.column_stack([last, y])]), axis=0))
                rectangle, short, long = least_rectangle(corners)
                if short < min_side:
                    quad.append(None)
                    continue
                distance = short * long * unclip / (2 * (short + long))
                if short + 2 * distance < min_side + 2:
                    quad.append(None)
                    continue
                turned = ordered(widened(rectangle, distance)) * [scale_x, scale_y]
                quad.append(np.round(turned, 6).ravel().tolist())
            yield pd.DataFrame({"page_id": part["page_id"], "y": part["y"], "first": part["first"], "score": part["score"], "quad": quad})

    # Rows of one region: two ends each.
    listed = ends.groupBy("page_id", "region").agg(F.collect_list("y").alias("ys"), F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"), (F.sum("total") / F.sum("n")).alias("score"))
    sure = listed.where(F.col("score") >= box_threshold).select("page_id", "region.y", "region.first", "ys", "firsts", "lasts", "score")
    types = dict(found.select("page_id", "region.y", "region.first").dtypes)
    out = sure.mapInPandas(outline, f"page_id {types['page_id']}, y {types['y']}, first {types['first']}, score double, quad array<double>")
    return out.where("quad IS NOT NULL").select("page_id", F.struct("page_id", "y", "first").alias("region"), "score", F.transform("quad", lambda v: F.round(v, 4)).alias("quad"))


def mask_bands(found: DataFrame, height: int) -> DataFrame:
    """(page_id, top, bottom, has_content): the stretches of a page's rows that boxes (page_id, top, bottom) cover or leave bare, from 0 to ``height``."""
    whole = found.where(F.col("top").isNotNull() & (F.col("bottom") >= F.col("top")) & (F.col("bottom") >= 0) & (F.col("top") < height))
    edge = lambda at, step: whole.select("page_id", at.cast("long").alias("y"), F.lit(step).alias("step"))
    pages = found.select("page_id").distinct()
    start, end = pages.select("page_id", F.lit(0).cast("long").alias("y"), F.lit(0).alias("step")), pages.select("page_id", F.lit(height).cast("long").alias("y"), F.lit(0).alias("step"))
    events = edge(F.greatest(F.col("top"), F.lit(0)), 1).unionAll(edge(F.least(F.col("bottom") + 1, F.lit(height)), -1)).unionAll(start).unionAll(end)
    along = Window.partitionBy("page_id").orderBy("y")
    depth = events.groupBy("page_id", "y").agg(F.sum("step").alias("step")).withColumn("depth", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = depth.select("page_id", F.col("y").alias("top"), (F.lead("y").over(along) - 1).alias("bottom"), (F.col("depth") > 0).alias("has_content")).where("bottom >= top")
    fresh = F.coalesce(F.lag("has_content").over(Window.partitionBy("page_id").orderBy("top")) != F.col("has_content"), F.lit(True)).cast("int")
    island = F.sum("fresh").over(Window.partitionBy("page_id").orderBy("top").rowsBetween(Window.unboundedPreceding, 0))
    numbered = pieces.withColumn("fresh", fresh).withColumn("island", island)
    return numbered.groupBy("page_id", "island", "has_content").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).select("page_id", "top", "bottom", "has_content")
