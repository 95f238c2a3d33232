"""Every registered query against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lamina.fixtures import relation
from lamina.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def groups(spark, name, key="page_id"):
    """The rows of a derived relation, a list a group, in order of seq."""
    found = {}
    for r in sorted(relation(spark, SF, name).collect(), key=lambda r: r["seq"]):
        found.setdefault(r[key], []).append(r.asDict())
    return found


def insertion(rows, first, second, slack):
    """Binary insertion by a comparator that looks at ``second`` where ``first`` is nearer than ``slack``: what a stable library sort does to a dozen rows."""
    before = lambda a, b: (a[first] - b[first] if abs(a[first] - b[first]) >= slack else a[second] - b[second]) < 0
    out = list(rows[:1])
    run = 1
    if len(rows) > 1:  # a run that goes up (or strictly down, turned round) comes first as it is
        down = before(rows[1], rows[0])
        while run < len(rows) and before(rows[run], rows[run - 1]) == down:
            run += 1
        out = list(reversed(rows[:run])) if down else list(rows[:run])
    for r in rows[run:]:
        low, high = 0, len(out)
        while low < high:
            middle = (low + high) // 2
            if before(r, out[middle]):
                high = middle
            else:
                low = middle + 1
        out.insert(low, r)
    return out


def placed(spark, sort):
    return [{"page_id": p, "seq": r["seq"], "place": i} for p, rows in groups(spark, "ocr_boxes").items() for i, r in enumerate(sort(rows))]


def line_order(rows):
    """By (top, x0); then each box in turn goes left past boxes less than 10 above it that begin further right."""
    out = []
    for r in sorted(rows, key=lambda r: (r["top"], r["x0"])):
        at = len(out)
        while at and abs(r["top"] - out[at - 1]["top"]) < 10 and r["x0"] < out[at - 1]["x0"]:
            at -= 1
        out.insert(at, r)
    return out


def common(a, b):
    return max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]))


def touch(a, b):
    return a["x1"] >= b["x0"] and a["x0"] <= b["x1"] and a["bottom"] >= b["top"] and a["top"] <= b["bottom"]


def cleaned(spark, by_text):
    """Clean-up with alive flags instead of a shrinking list."""
    texts, out = groups(spark, "ocr_boxes"), []
    for page, rows in groups(spark, "layout_boxes").items():
        rows = sorted(rows, key=lambda r: (r["top"], r["seq"]))
        gone, at = set(), 0
        while True:
            alive = [i for i in range(len(rows)) if i not in gone]
            if at + 1 >= len(alive):
                break
            me = rows[alive[at]]
            other = next((i for i in alive[at + 1 : at + 5] if rows[i]["type"] == me["type"] and touch(rows[i], me)), None)
            size = lambda r: (r["x1"] - r["x0"]) * (r["bottom"] - r["top"])
            if other is None or common(me, rows[other]) < 0.6 * min(size(me), size(rows[other])):
                at += 1
                continue
            weight = (lambda r: sum(common(t, r) for t in texts.get(page, []) if touch(t, r))) if by_text or not (me["score"] and rows[other]["score"]) else (lambda r: r["score"])
            if not by_text and not (me["score"] and rows[other]["score"]):
                weight = lambda r: 0
            gone.add(other if weight(me) > weight(rows[other]) else alive[at])
        out += [{"page_id": page, "seq": r["seq"]} for i, r in enumerate(rows) if i not in gone]
    return out


def rebuilt(spark):
    """Tables of the fixture by what it was made from: a grid of 6 by 4 with an empty cell, a cell over two columns, and one or two header rows."""
    out = []
    for table, cells in groups(spark, "table_cells", "table_id").items():
        at = {divmod(c["seq"], 4): c["text"] for c in cells}
        if table % 5 == 1:
            merged = (1, 1), (1, 2)
            both = [at[p] for p in merged]
            shown = at | {p: " ".join(both) for p in merged}
            said = at | {p: "".join(both) for p in merged}
        else:
            shown = said = at
        height = max(r for r, _ in at) + 1
        lines = ["| " + " | ".join(shown.get((r, c), "") for c in range(4)) + " |\n" for r in range(height)]
        markdown = lines[0] + "| --- | --- | --- | --- |\n" + "".join(lines[1:])
        head = 1 if table % 4 == 2 else None
        text = []
        for r in range(height):
            if r == head:
                continue
            cells_ = [(c, said[r, c]) for c in range(4) if said.get((r, c))]
            text.append("; ".join(f"{shown[head, c]}：{x}" if head is not None and r > head and shown[head, c] else x for c, x in cells_))
        out.append({"table_id": table, "markdown": markdown, "sentences": text})
    return out


def blocks(a, b):
    """Characters in the longest common block, then left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return k and k + blocks(a[:i], b[:j]) + blocks(a[i + k :], b[j + k :])


def ratios(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    return [{"p_partkey": r[0], "ratio": round(2 * blocks(r[1], r[2]) / (len(r[1]) + len(r[2])), 4)} for r in rows]


def wrapped(points):
    """Corners of the convex hull, found by walking round it from the leftmost point, each turn as far right as any point lies."""
    start = min(points)
    out, at = [], start
    while True:
        out.append(at)
        on = next(p for p in points if p != at)
        for p in points:
            turn = (on[0] - at[0]) * (p[1] - at[1]) - (on[1] - at[1]) * (p[0] - at[0])
            if p != at and (turn < 0 or turn == 0 and math.dist(p, at) > math.dist(on, at)):
                on = p
        at = on
        if at == start:
            return out


def quads(spark):
    """Regions of the pixels by flood fill; of the rectangles along each edge of their hull the least, widened and doubled."""
    left, out = {}, []
    for (e,) in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect():
        page, y, x = e // 900, e % 900 // 30, e % 30
        if (p := ((x // 4 * 5 + y // 3 * 7 + page * 3) % 11) / 10) > 0.65:
            left[page, y, x] = p
    while left:
        first = min(left)
        region, todo = {first: left.pop(first)}, [first]
        while todo:
            page, y, x = todo.pop()
            for k in [(page, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if k in left:
                    region[k] = left.pop(k)
                    todo.append(k)
        score = sum(region.values()) / len(region)
        corners = wrapped([(k[2], k[1]) for k in region])
        best = None
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
            n = math.dist(a, b)
            ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
            u, v = [ux * x + uy * y for x, y in corners], [ux * y - uy * x for x, y in corners]
            w, h = max(u) - min(u), max(v) - min(v)
            if best is None or round(w * h, 9) < best[0]:
                best = round(w * h, 9), w, h, ux, uy, min(u), max(u), min(v), max(v)
        _, w, h, ux, uy, u0, u1, v0, v1 = best
        if score < 0.7 or min(w, h) < 3:
            continue
        d = w * h * 2 / (2 * (w + h))
        quad = sorted((ux * u - uy * v, uy * u + ux * v) for u in (u0 - d, u1 + d) for v in (v0 - d, v1 + d))
        (a, b), (c, e) = sorted(quad[:2], key=lambda q: q[1]), sorted(quad[2:], key=lambda q: q[1])
        out.append({"page_id": first[0], "y": first[1], "x": first[2], "score": round(score, 6), "quad": [round(2 * z, 4) for q in (a, c, e, b) for z in q]})
    return out


#: What the queries without a counterpart in SQL must give.
BRUTE = {
    "o1_sort_rows": lambda spark: placed(spark, lambda rows: insertion(rows, "top", "x0", 10)),
    "o2_sort_columns": lambda spark: placed(spark, lambda rows: insertion(rows, "x0", "top", 10)),
    "o4_reading_order": lambda spark: placed(spark, line_order),
    "d3_clean_layouts": lambda spark: cleaned(spark, False),
    "d3_clean_by_text": lambda spark: cleaned(spark, True),
    "w9_rebuild_tables": rebuilt,
    "r4_similarity": ratios,
    "k7_quads": quads,
}


def plain(value):
    if isinstance(value, float):
        return None if value != value else str(round(value, 9))
    return [plain(v) for v in value] if isinstance(value, list | tuple) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert ours == sorted(repr([plain(row[c]) for c in columns]) for row in BRUTE[name](spark))
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert ours == theirs
