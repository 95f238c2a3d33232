"""Regions of rasters against flood fill, rectangles against a sweep of angles, mask rows against pixels."""

import math
import random

import numpy as np
import pytest

from lamina.operators import raster


def flood(pixels, threshold=0.3):
    """Regions as sets of (x, y), by page."""
    lit = {}
    for page, y, x, p in pixels:
        if None not in (page, y, x, p) and p > threshold:
            lit[page, y, x] = max(p, lit.get((page, y, x), 0))
    left, out = set(lit), []
    while left:
        todo = [left.pop()]
        region = set(todo)
        while todo:
            page, y, x = todo.pop()
            for near in [(page, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    region.add(near)
                    todo.append(near)
        out.append({k: lit[k] for k in region})
    return out


def pixels(seed=1):
    rng = random.Random(seed)
    rows = [(p, y, x, rng.choice([0.1, 0.2, 0.9, 0.95])) for p in range(3) for y in range(25) for x in range(30)]
    rows += [(7, i, i, 0.8) for i in range(200)] + [(7, i, 199 - i + 300, 0.8) for i in range(200)]  # long diagonals
    spiral = [(8, y, x, 0.9) for y in range(21) for x in range(21) if (max(abs(y - 10), abs(x - 10)) % 2 == 0) or (x == 10 and y > 10)]
    return rows + spiral + [(0, 0, 0, 0.99), (0, 0, 0, 0.4), (None, 1, 1, 0.9), (9, None, 1, 0.9), (9, 1, 1, None), (9, 5, 5, 0.3), (9, 8, 8, 0.31)]


SCHEMA = "page_id long, y long, x long, p double"


def test_regions_by_flood_fill(spark):
    rows = pixels()
    got = raster.boxes(raster.regions(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    wanted = []
    for r in flood(rows):
        ys, xs = [k[1] for k in r], [k[2] for k in r]
        wanted.append((next(iter(r))[0], min(xs), min(ys), max(xs), max(ys), len(r), round(sum(r.values()) / len(r), 9)))
    assert sorted((r["page_id"], r["x0"], r["top"], r["x1"], r["bottom"], r["n"], round(r["score"], 9)) for r in got) == sorted(wanted)
    assert raster.regions(spark.createDataFrame([], SCHEMA)).count() == 0


def sweep(points, steps=3600):
    """Least area over many angles."""
    best = math.inf
    for i in range(steps):
        a = math.pi / 2 * i / steps
        u, v = points @ [math.cos(a), math.sin(a)], points @ [-math.sin(a), math.cos(a)]
        best = min(best, np.ptp(u) * np.ptp(v))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_rectangles_have_the_least_area(seed):
    rng = np.random.default_rng(seed)
    points = np.unique(rng.integers(0, 40, (30, 2)) @ np.array([[2, 1], [0, 1]]), axis=0)
    quad, short, long = raster.least_rectangle(raster.hull(points))
    assert short * long <= sweep(points) + 1e-6 and short * long > 0.98 * sweep(points)
    a, b = quad[1] - quad[0], quad[3] - quad[0]
    assert abs(a @ b) < 1e-6 and {round(float(np.linalg.norm(a)), 6), round(float(np.linalg.norm(b)), 6)} == {round(short, 6), round(long, 6)}
    inside = (points - quad[0]) @ np.column_stack([a / (a @ a), b / (b @ b)])
    assert inside.min() > -1e-9 and inside.max() < 1 + 1e-9


def test_quads(spark):
    """An upright block, a turned one, one too thin, one too unsure."""
    rows = [(1, y, x, 0.9) for y in range(10, 20) for x in range(5, 45)]
    rows += [(2, y, x, 0.9) for y in range(60) for x in range(60) if abs(x - y) <= 4 and 20 <= x + y <= 90]
    rows += [(3, y, x, 0.9) for y in range(2) for x in range(50)] + [(4, y, x, 0.5) for y in range(9) for x in range(50)]
    found = {r["page_id"]: r for r in raster.quads(raster.regions(spark.createDataFrame(rows, SCHEMA)), scale_x=2.0).collect()}
    assert set(found) == {1, 2}
    d = 9 * 39 * 2.0 / (2 * (9 + 39))
    assert found[1]["quad"] == [round(v, 4) for v in (2 * (5 - d), 10 - d, 2 * (44 + d), 10 - d, 2 * (44 + d), 19 + d, 2 * (5 - d), 19 + d)]
    q = np.array(found[2]["quad"]).reshape(4, 2) / [2, 1]
    a, b = q[1] - q[0], q[2] - q[1]
    assert abs(abs(a[0]) - abs(a[1])) < 0.01 and abs(a @ b) < 0.01  # along the diagonal


def test_mask_bands_by_pixels(spark):
    rng = random.Random(2)
    rows = [(p, t := rng.randrange(-5, 100), t + rng.randrange(-2, 12)) for p in range(20) for _ in range(6)] + [(50, None, 3), (51, 0, 200), (52, 90, 95)]
    got = sorted(tuple(r) for r in raster.mask_bands(spark.createDataFrame(rows, "page_id long, top long, bottom long"), 96).collect())
    wanted = []
    for page in {r[0] for r in rows}:
        mask = [any(r[0] == page and r[1] is not None and r[1] <= y <= r[2] for r in rows) for y in range(96)]
        at = 0
        for y in range(1, 97):
            if y == 96 or mask[y] != mask[at]:
                wanted.append((page, at, y - 1, mask[at]))
                at = y
    assert got == sorted(wanted)
