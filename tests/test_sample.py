"""Sampled rasters against sums written out, and hand-worked quads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import sample

SCHEMA = "page_id long, y long, x long, p double"


def raster(spark, m, page=1):
    return spark.createDataFrame([(page, y, x, float(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], SCHEMA)


def at(m, y, x):
    """Between four pixels, the border repeated."""
    y0, x0 = int(np.floor(y)), int(np.floor(x))
    get = lambda i, j: m[min(max(i, 0), m.shape[0] - 1), min(max(j, 0), m.shape[1] - 1)]
    fy, fx = y - y0, x - x0
    return (1 - fy) * ((1 - fx) * get(y0, x0) + fx * get(y0, x0 + 1)) + fy * ((1 - fx) * get(y0 + 1, x0) + fx * get(y0 + 1, x0 + 1))


def image(df, *keys):
    rows = df.collect()
    out = np.full((max(r["v"] for r in rows) + 1, max(r["u"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["v"], r["u"]] = r["p"]
    assert len(rows) == out.size
    return out


@pytest.mark.parametrize("size", [(3, 5), (7, 4), (14, 8), (1, 1)])
def test_resizing(spark, size):
    m = np.random.default_rng(1).random((7, 4))
    got = image(sample.resized(raster(spark, m), F.lit(size[0]), F.lit(size[1])))
    wanted = [[at(m, (v + 0.5) * 7 / size[0] - 0.5, (u + 0.5) * 4 / size[1] - 0.5) for u in range(size[1])] for v in range(size[0])]
    assert np.allclose(got, wanted)
    if size == (7, 4):
        assert np.allclose(got, m)


def test_letter_boxes(spark):
    """A wide and a high raster in one frame: centred, the odd row below, grey around."""
    wide, high = np.full((3, 10), 255.0), np.full((8, 2), 255.0)
    both = raster(spark, wide, 1).unionAll(raster(spark, high, 2))
    got = sample.letter_boxed(both, 8, 20)
    first, second = (image(got.where(F.col("page_id") == p)) for p in (1, 2))
    assert first.shape == second.shape == (8, 20)
    assert (first[1:7] == 1).all() and np.allclose(first[[0, 7]], 114 / 255)
    assert (second[:, 9:11] == 1).all() and np.allclose(np.delete(second, [9, 10], 1), 114 / 255)


def test_corners_go_to_corners(spark):
    rng = random.Random(3)
    for _ in range(20):
        quad = [(rng.uniform(0, 10), rng.uniform(0, 10)), (rng.uniform(20, 30), rng.uniform(0, 10)), (rng.uniform(20, 30), rng.uniform(20, 30)), (rng.uniform(0, 10), rng.uniform(20, 30))]
        row = spark.range(1).select(*[c.alias(f"m{i}") for i, c in enumerate(sample.homography([(F.lit(x), F.lit(y)) for x, y in quad]))]).first()
        a, b, c, d, e, f, g, h = row
        for (s, t), (x, y) in zip([(0, 0), (1, 0), (1, 1), (0, 1)], quad, strict=True):
            z = g * s + h * t + 1
            assert abs((a * s + b * t + c) / z - x) < 1e-9 and abs((d * s + e * t + f) / z - y) < 1e-9


def test_crops(spark):
    """An upright quad is a cut; a turned one is turned back; a tall one lies down; quads of no area give nothing."""
    m = np.arange(20 * 30, dtype=float).reshape(20, 30)
    quads = [(0, 2, 3, 12, 3, 12, 8, 2, 8), (1, 12, 3, 12, 8, 2, 8, 2, 3), (2, 5, 5, 5, 5, 5, 5, 5, 5), (3, None, 0, 4, 0, 4, 4, 0, 4)]
    df = spark.createDataFrame([(1, *q) for q in quads] + [(9, 0, 0, 0, 5, 0, 5, 5, 0, 5)], "page_id long, seq int, " + ", ".join(f"x{i} int, y{i} int" for i in range(4)))
    got = sample.crops(raster(spark, m), df)
    assert np.allclose(image(got.where("seq = 0")), m[3:8, 2:12])
    tall = [[at(m, 3 + 5 * u / 5, 12 - 10 * v / 10) for u in range(5)] for v in range(10)]
    assert np.allclose(image(got.where("seq = 1")), np.rot90(np.array(tall)))
    assert {r["seq"] for r in got.select("seq").distinct().collect()} == {0, 1}
    skewed = spark.createDataFrame([(1, 0, 1, 1, 11, 3, 13, 9, 3, 11)], df.schema)
    picture = image(sample.crops(raster(spark, m), skewed))
    assert picture.shape == (10, 10) and abs(picture[0, 0] - m[1, 1]) < 1e-9


def test_sums_do_not_hang_on_the_order_of_rows(spark):
    """The last bit is that of one order of the four pixels, however they come."""
    m = np.random.default_rng(5).integers(0, 11, (9, 9)) / 10
    points = [(1, i, 0.125 * (i % 60), 0.125 * (i * 7 % 60), 9, 9) for i in range(300)]
    df = spark.createDataFrame(points, "page_id long, n long, sy double, sx double, height long, width long")
    get = lambda y, x: float(m[min(y, 8), min(x, 8)])
    for seed in (1, 2):
        got = {r["n"]: r["p"] for r in sample.sampled(raster(spark, m).orderBy(F.rand(seed)).repartition(3), df, ("n",)).collect()}
        for _, i, sy, sx, _, _ in points:
            y, x = int(sy), int(sx)
            t = {(a, b): (sy - y if a else 1 - (sy - y)) * (sx - x if b else 1 - (sx - x)) * get(y + a, x + b) for a in (0, 1) for b in (0, 1)}
            assert got[i] == t[0, 1] + t[1, 1] + t[0, 0] + t[1, 0]


def test_crops_add_by_rows(spark):
    """Pixel (9, 6) of this quad has four parts whose sum is 0.7578125; begun with the right column it is a bit below, and is rounded down."""
    m = np.array([[((x // 4 * 5 + y // 3 * 7 + 587 * 3) % 11) / 10 for x in range(30)] for y in range(30)])
    quad = spark.createDataFrame([(587, 0, 4.0, 3.0, 22.0, 3.0, 24.0, 17.0, 3.0, 12.0)], "page_id long, seq int, " + ", ".join(f"x{i} double, y{i} double" for i in range(4)))
    for seed in (1, 2):
        got = sample.crops(raster(spark, m, 587).orderBy(F.rand(seed)).repartition(3), quad).where("v = 9 AND u = 6")
        assert [r[0] for r in got.select(F.round(F.col("p") * 1_000_000).cast("long")).collect()] == [757_813]
