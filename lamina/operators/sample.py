"""Rasters sampled between their pixels: letter-boxing, resizing and perspective crops.

A raster is its pixels (page_id, y, x, p). A point between pixels is the mean of the
four around it, weighted by nearness; beyond the border the nearest pixel stands in.
Every wanted point names its four pixels, and one equi-join on page, row and column
finds them, so rasters of any number and size are sampled in one pass, dealt by
pixel. Only the sizes of rasters, a row a page, are joined besides.

Defined results: pixels that are missing inside a raster count 0; a raster begins
at (0, 0) and reaches to its largest row and column; quads of no area, with a null
corner, or of a page without pixels give no crop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grey that letter-boxing fills in, of 255.
PADDING = 114
#: A crop so much higher than wide is turned.
TALL = 1.5


def sizes(pixels: DataFrame) -> DataFrame:
    """(page_id, height, width) of every raster."""
    return pixels.groupBy("page_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def sampled(pixels: DataFrame, points: DataFrame, keys: tuple[str, ...], by_rows: bool = False) -> DataFrame:
    """(keys, p): the raster at each of ``points`` (page_id, keys, sy, sx, height, width).

    The four pixels are added in one order, so that the last bit does not hang on which
    row comes first: ``by_rows`` each row's two and then both rows, or else the right
    column's two, the upper left and the lower left.
    """

    def near(at: Column, most: Column) -> Column:
        low, share = F.floor(at), at - F.floor(at)
        inside = lambda i: F.greatest(F.lit(0).cast("long"), F.least(i.cast("long"), most - 1))
        return F.array(F.struct(F.lit(0).alias("n"), inside(low).alias("i"), (1 - share).alias("w")), F.struct(F.lit(1).alias("n"), inside(low + 1).alias("i"), share.alias("w")))

    wanted = points.withColumn("a", F.explode(near(F.col("sy"), F.col("height")))).withColumn("b", F.explode(near(F.col("sx"), F.col("width"))))
    wanted = wanted.select("page_id", *keys, F.col("a.i").alias("y"), F.col("b.i").alias("x"), (F.col("a.w") * F.col("b.w")).alias("w"), (2 * F.col("a.n") + F.col("b.n")).alias("corner"))
    met = wanted.join(pixels.select("page_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "p"), ["page_id", "y", "x"], "left")
    part = lambda n: F.sum(F.when(F.col("corner") == n, F.col("w") * F.coalesce("p", F.lit(0.0))))
    p = (part(0) + part(1)) + (part(2) + part(3)) if by_rows else part(1) + part(3) + part(0) + part(2)
    return met.groupBy(*dict.fromkeys(("page_id", *keys))).agg(p.alias("p"))


def _grid(rows: DataFrame, height: Column, width: Column) -> DataFrame:
    """``rows`` with v and u of every pixel of a target of that size."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return rows.where((height >= 1) & (width >= 1)).withColumn("v", F.explode(upto(height))).withColumn("u", F.explode(upto(width)))


def resized(pixels: DataFrame, height: Column, width: Column) -> DataFrame:
    """(page_id, v, u, p): every raster in another size, columns of ``sizes``; pixels are squares, so their centres are mapped."""
    grid = _grid(sizes(pixels), height, width)
    at = lambda i, had, new: (F.col(i) + 0.5) * F.col(had) / new - 0.5
    return sampled(pixels, grid.withColumn("sy", at("v", "height", height)).withColumn("sx", at("u", "width", width)), ("v", "u"))


def letter_boxed(pixels: DataFrame, height: int, width: int, padding: float = PADDING) -> DataFrame:
    """(page_id, v, u, p): rasters in one size, scaled as a whole and centred, the rest filled; p over 255."""
    scale = F.least(F.lit(height) / F.col("height"), F.lit(width) / F.col("width"))
    # Half a pixel goes to the lower and right side, halves are rounded to even.
    known = sizes(pixels).withColumn("h", F.bround(F.col("height") * scale).cast("long")).withColumn("w", F.bround(F.col("width") * scale).cast("long"))
    known = known.withColumn("top", F.bround((height - F.col("h")) / 2 - 0.1).cast("long")).withColumn("left", F.bround((width - F.col("w")) / 2 - 0.1).cast("long"))
    inside = resized(pixels, F.bround(F.col("height") * scale).cast("long"), F.bround(F.col("width") * scale).cast("long"))
    frame = _grid(known, F.lit(height), F.lit(width)).select("page_id", "v", "u", "top", "left")
    placed = inside.join(known.select("page_id", "top", "left"), "page_id").select("page_id", (F.col("v") + F.col("top")).alias("v"), (F.col("u") + F.col("left")).alias("u"), "p")
    return frame.join(placed, ["page_id", "v", "u"], "left").select("page_id", "v", "u", (F.coalesce("p", F.lit(float(padding))) / 255).alias("p"))


def homography(corners: list[tuple[Column, Column]]) -> list[Column]:
    """a, b, c, d, e, f, g, h that take (s, t) of the unit square to ((a s + b t + c) / (g s + h t + 1), (d s + e t + f) / (...)): its corners, clockwise, to ``corners``."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h]


def crops(pixels: DataFrame, quads: DataFrame, tall: float = TALL) -> DataFrame:
    """(page_id, seq, v, u, p): the part of a raster inside each of ``quads`` (page_id, seq, x0, y0 ... x3, y3: corners clockwise), straightened.

    It is as wide and high as the longer of the quad's opposite sides, cut to whole
    pixels, and turned to the left where it is ``tall`` times as high as wide.
    """
    corner = [(F.col(f"x{i}").cast("double"), F.col(f"y{i}").cast("double")) for i in range(4)]
    side = lambda i, j: F.sqrt((corner[i][0] - corner[j][0]) ** 2 + (corner[i][1] - corner[j][1]) ** 2)
    sized = quads.withColumn("w", F.floor(F.greatest(side(0, 1), side(2, 3)))).withColumn("h", F.floor(F.greatest(side(0, 3), side(1, 2))))
    names = [f"m{i}" for i in range(8)]
    det = (corner[1][0] - corner[2][0]) * (corner[3][1] - corner[2][1]) - (corner[3][0] - corner[2][0]) * (corner[1][1] - corner[2][1])
    mapped = sized.where(det != 0).withColumns(dict(zip(names, homography(corner), strict=True)))
    grid = _grid(mapped.join(sizes(pixels), "page_id"), F.col("h"), F.col("w"))
    a, b, c, d, e, f, g, h = (F.col(n) for n in names)
    s, t = F.col("u") / F.col("w"), F.col("v") / F.col("h")
    z = g * s + h * t + 1
    turned = F.col("h") >= tall * F.col("w")
    points = grid.where(z != 0).withColumns({"sx": (a * s + b * t + c) / z, "sy": (d * s + e * t + f) / z})
    points = points.withColumns({"v2": F.when(turned, F.col("w") - 1 - F.col("u")).otherwise(F.col("v")), "u2": F.when(turned, F.col("v")).otherwise(F.col("u"))})
    return sampled(pixels, points.select("page_id", "seq", F.col("v2").alias("v"), F.col("u2").alias("u"), "sy", "sx", "height", "width"), ("seq", "v", "u"), by_rows=True)
