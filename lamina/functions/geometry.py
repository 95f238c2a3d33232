"""Scalar geometry of boxes with columns x0, top, x1, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x0", "top", "x1", "bottom")


def edges(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + e) for e in EDGES)


def clamp(value: Column, most: Column | int) -> Column:
    return F.greatest(F.lit(0), F.least(value, F.lit(most) if isinstance(most, int) else most))


def clamped_box(width: int, height: int, prefix: str = "", pad: int = 0) -> list[Column]:
    """Rounded half to even, padded outward, and cut to the page."""
    x0, top, x1, bottom = (F.bround(e.cast("double")).cast("long") for e in edges(prefix))
    return [
        clamp(x0 - pad, width).alias("x0"),
        clamp(top - pad, height).alias("top"),
        clamp(x1 + pad, width).alias("x1"),
        clamp(bottom + pad, height).alias("bottom"),
    ]


def area(prefix: str = "") -> Column:
    x0, top, x1, bottom = edges(prefix)
    return F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), bottom - top)


def intersection(a: str, b: str) -> Column:
    ax0, at, ax1, ab = edges(a)
    bx0, bt, bx1, bb = edges(b)
    return F.greatest(F.lit(0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0), F.least(ab, bb) - F.greatest(at, bt))


def touching(a: str, b: str) -> Column:
    """Boxes that share at least an edge."""
    ax0, at, ax1, ab = edges(a)
    bx0, bt, bx1, bb = edges(b)
    return (ax1 >= bx0) & (ax0 <= bx1) & (ab >= bt) & (at <= bb)


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over the area of ``a``; 0 where ``a`` has no area."""
    own = area(a)
    return F.when(own > 0, intersection(a, b) / own).otherwise(F.lit(0.0))


def column_distance(a: str, b: str) -> Column:
    """Twice the least distance of left edges, right edges or centres: an integer."""
    ax0, _, ax1, _ = edges(a)
    bx0, _, bx1, _ = edges(b)
    return F.least(2 * F.abs(ax0 - bx0), 2 * F.abs(ax1 - bx1), F.abs(ax0 + ax1 - bx0 - bx1))


def degenerate(prefix: str = "") -> Column:
    x0, top, x1, bottom = edges(prefix)
    return (x0 > x1) | (top > bottom)


def from_center(cx: Column, cy: Column, w: Column, h: Column, pad_x: Column, pad_y: Column, scale: Column) -> list[Column]:
    """Centre and size in a letter-boxed frame to edges in the original image."""
    return [
        ((cx - w / 2 - pad_x) * scale).alias("x0"),
        ((cy - h / 2 - pad_y) * scale).alias("top"),
        ((cx + w / 2 - pad_x) * scale).alias("x1"),
        ((cy + h / 2 - pad_y) * scale).alias("bottom"),
    ]


def clockwise(quad: Column) -> Column:
    """Corners from the one nearest the origin: (least x + y, least y - x, most x + y, most y - x)."""
    total = lambda p: p["x"] + p["y"]
    lean = lambda p: p["y"] - p["x"]
    keyed = F.array_sort(F.transform(quad, lambda p, i: F.struct(total(p).alias("k"), i.alias("i"), p.alias("p"))))
    first, last = keyed[0]["p"], keyed[F.size(keyed) - 1]["p"]
    middle = F.array_sort(F.transform(F.slice(keyed, 2, 2), lambda s: F.struct(lean(s["p"]).alias("k"), s["i"].alias("i"), s["p"].alias("p"))))
    return F.array(first, middle[0]["p"], last, middle[1]["p"])


def clipped(quad: Column, width: int, height: int) -> Column:
    whole = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most - 1))).cast("long")
    return F.transform(quad, lambda p: F.struct(whole(p["x"], width).alias("x"), whole(p["y"], height).alias("y")))


def wide_enough(quad: Column, least: int = 3) -> Column:
    """Both sides from the first corner are longer than ``least`` whole pixels."""
    side = lambda a, b: F.floor(F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    return (side(quad[0], quad[1]) > least) & (side(quad[0], quad[3]) > least)


def quad_box(quad: Column) -> list[Column]:
    """Edges from the first, second and last corner."""
    return [quad[0]["x"].alias("x0"), quad[0]["y"].alias("top"), quad[1]["x"].alias("x1"), quad[3]["y"].alias("bottom")]


def detector_size(width: Column, height: Column, limit: int, kind: str = "max") -> list[Column]:
    """Sides in multiples of 32 after scaling to ``limit`` (max: only down, min: only up, resize_long: both)."""
    long, short = F.greatest(width, height), F.least(width, height)
    scale = {
        "max": F.when(long > limit, F.lit(float(limit)) / long).otherwise(1.0),
        "min": F.when(short < limit, F.lit(float(limit)) / short).otherwise(1.0),
        "resize_long": F.lit(float(limit)) / long,
    }[kind]
    side = lambda v: F.greatest(F.bround((v * scale).cast("long") / 32) * 32, F.lit(32)).cast("long")
    return [side(width).alias("width"), side(height).alias("height")]


def line_width(width: Column, height: Column, to_height: int = 32, least: int = 32, most: int = 512) -> Column:
    """Width at ``to_height``, rounded up to tens and clamped."""
    return F.least(F.greatest(F.ceil((to_height * width / height).cast("long") / 10) * 10, F.lit(least)), F.lit(most)).cast("long")


def ocr_line(quad: Column) -> list[Column]:
    """A recognised line's edges; its score counts as 1."""
    return [*quad_box(quad), F.lit(1.0).alias("score")]
