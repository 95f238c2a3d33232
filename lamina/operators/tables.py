"""Table reconstruction: aligned parts, tagged cells, grid, spans, Markdown and sentences.

Where every cell carries its row and column the grid is windows and
aggregations; single cells are moved, spans filled and sentences written per
table in a grouped Arrow function, since each step depends on the one before.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import BLOCK_TYPES, CAPTION, block_type, caption
from lamina.operators.runs import by_runs


def align_parts(parts: DataFrame) -> DataFrame:
    """Rows and headers reach to common left and right edges, columns to common top and bottom ones.

    Of more than four parts the mean (columns: the median) counts, else the outermost; edges only move outward.
    """
    horizontal, vertical = F.col("label").rlike(".+(row|header)"), F.col("label") == "table column"
    t = Window.partitionBy("table_id")
    many = lambda test: F.count_if(test).over(t) > 4
    of = lambda f, test, edge: f(F.when(test, F.col(edge))).over(t)
    left = F.when(many(horizontal), of(F.avg, horizontal, "x0")).otherwise(of(F.min, horizontal, "x0"))
    right = F.when(many(horizontal), of(F.avg, horizontal, "x1")).otherwise(of(F.max, horizontal, "x1"))
    top = F.when(many(vertical), of(F.median, vertical, "top")).otherwise(of(F.min, vertical, "top"))
    bottom = F.when(many(vertical), of(F.median, vertical, "bottom")).otherwise(of(F.max, vertical, "bottom"))
    return parts.select(
        *[c for c in parts.columns if c not in ("x0", "x1", "top", "bottom")],
        F.when(horizontal, F.least("x0", left)).otherwise(F.col("x0")).cast("double").alias("x0"),
        F.when(vertical, F.least("top", top)).otherwise(F.col("top")).cast("double").alias("top"),
        F.when(horizontal, F.greatest("x1", right)).otherwise(F.col("x1")).cast("double").alias("x1"),
        F.when(vertical, F.greatest("bottom", bottom)).otherwise(F.col("bottom")).cast("double").alias("bottom"),
    )


def grid(cells: DataFrame) -> DataFrame:
    """Tagged cells with row and column numbers ``rn``, ``cn``: a new row where R differs, a new column where C grows by one."""
    rows = Window.partitionBy("table_id").orderBy("R", "x0", "seq")
    cols = Window.partitionBy("table_id").orderBy("C", "top", "seq")
    step = lambda c, w: F.when(F.col(c) != F.lag(c).over(w), 1).otherwise(0)
    return (
        cells.withColumn("r_", step("R", rows)).withColumn("rn", F.sum("r_").over(rows))
        .withColumn("c_", F.when(F.col("C") - F.lag("C").over(cols) == 1, 1).otherwise(0)).withColumn("cn", F.sum("c_").over(cols))
        .drop("r_", "c_")
    )


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, rn, header): more than half of the row's places are headers.

    In a table of numbers a place whose first text is no number counts as header, one whose first text is a number never does.
    """
    typed = cells.withColumn("btype", block_type(F.col("text")))
    counted = typed.groupBy("table_id", "btype").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    most = counted.groupBy("table_id").agg(F.max_by("btype", F.struct("n", (-F.col("first")).alias("f"))).alias("most"))
    places = typed.groupBy("table_id", "rn", "cn").agg(F.bool_or(F.col("H") > 0).alias("tagged"), F.min_by(F.coalesce("btype", F.lit("")), F.struct("top", "x0", "seq")).alias("first"))
    number, numbers = F.col("first") == "Nu", F.coalesce(F.col("most") == "Nu", F.lit(False))
    is_header = F.when(numbers & number, False).otherwise(F.coalesce(F.col("tagged"), F.lit(False)) | numbers)
    return places.join(most, "table_id").groupBy("table_id", "rn").agg((2 * F.count_if(is_header) > F.count(F.lit(1))).alias("header"))


def captions(boxes: DataFrame) -> DataFrame:
    """(table_id, caption): the caption boxes of each table in order, joined."""
    items = F.array_sort(F.collect_list(F.struct("seq", "text")))
    found = boxes.where(caption(F.col("text"), F.col("layout_type")))
    return found.groupBy("table_id").agg(F.array_join(F.transform(items, lambda s: s["text"]), " ").alias("caption"))


def number_rows(boxes: list[dict]) -> None:
    """Row numbers of boxes in row order; untagged boxes open a row below the running bottom."""
    rn, bottom, last = 0, boxes[0]["bottom"], boxes[0]
    last["rn"] = 0
    for b in boxes[1:]:
        untagged = b.get("R") is None and last.get("R") is None
        if b.get("R") != last.get("R") or (untagged and b["top"] >= bottom - 3):
            rn, bottom = rn + 1, b["bottom"]
        else:
            bottom = (bottom + b["bottom"]) / 2
        b["rn"], last = rn, b


def number_columns(boxes: list[dict]) -> None:
    """Column numbers of boxes in column order; a missing column counts as 1."""
    number = lambda b: 1 if b.get("C") is None else int(b["C"])
    cn, right, last = 0, boxes[0]["x1"], boxes[0]
    last["cn"] = 0
    for b in boxes[1:]:
        differs = b.get("C") is None or b.get("C") != last.get("C")
        if (number(b) - number(last) == 1 and b.get("page_number") == last.get("page_number")) or (b["x0"] >= right and differs):
            cn, right = cn + 1, b["x1"]
        else:
            right = (right + b["x1"]) / 2
        b["cn"], last = cn, b


def relocate(boxes: list[dict], line: str, across: str, low: str, high: str) -> None:
    """Boxes alone in their line (column or row) join the nearer neighbouring line, and the line closes.

    Done only with four lines or more across. A box stays if the places beside it hold texts, or are the edge.
    """
    if len({b[across] for b in boxes}) < 4:
        return
    at = 0
    while at <= max(b[line] for b in boxes):
        places = defaultdict(list)
        for b in boxes:
            if b[line] == at:
                places[b[across]].append(b)
        last = max(b[line] for b in boxes)
        if len(places) != 1:
            at += 1
            continue
        (where, own), = places.items()
        beside = lambda to: any(b[line] == to and b[across] == where and b["text"] for b in boxes)
        before_full, after_full = at == 0 or beside(at - 1), at == last or beside(at + 1)
        if before_full and after_full:
            at += 1
            continue
        far = 100_000
        before = far if before_full else min([far, *(own[0][low] - b[high] for b in boxes if b[line] == at - 1)])
        after = far if after_full else min([far, *(b[low] - own[0][high] for b in boxes if b[line] == at + 1)])
        for b in boxes:
            if b[line] > at or (b[line] == at and before < after):
                b[line] -= 1


def fill_spans(boxes: list[dict]) -> dict[tuple[int, int], list[dict]]:
    """The grid's places; a spanning cell's merged texts stand in every place it covers."""
    places: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for b in boxes:
        places[b["rn"], b["cn"]].append(b)
    mean = lambda xs: sum(xs) / len(xs)
    get = lambda b, k, d: b[d] if b.get(k) is None else b[k]

    def middles(line: str, first: tuple[str, str], last: str) -> dict[int, float]:
        out = {}
        for k in {b[line] for b in boxes}:
            own = [b for b in boxes if b[line] == k]
            # The row's lower edge is always taken from the boxes themselves.
            out[k] = (mean([get(b, *first) for b in own]) + mean([get(b, "C_right", last) if line == "cn" else b[last] for b in own])) / 2
        return out

    cols, rows = middles("cn", ("C_left", "x0"), "x1"), middles("rn", ("R_top", "top"), "bottom")
    for b in boxes:
        if b.get("SP") is None:
            continue
        across = [c for c, m in cols.items() if b["H_left"] <= m <= b["H_right"]] + [b["cn"]]
        down = [r for r, m in rows.items() if b["H_top"] <= m <= b["H_bott"]] + [b["rn"]]
        covered = [(r, c) for r in range(min(down), max(down) + 1) for c in range(min(across), max(across) + 1)]
        if len(covered) < 2:
            continue
        merged: list[dict] = []
        for p in covered:
            said = "".join(x["text"] for x in merged)
            if places[p] and "".join(x["text"] for x in places[p]) != said:
                merged = merged + [x for x in places[p] if x not in merged]
        for p in covered:
            places[p] = merged
    return places


def sentences(places: dict[tuple[int, int], list[dict]], headers: set[int], title: str = "", english: bool = False) -> list[str]:
    """Rows as "header: value" texts; stacked headers are joined, the longer first; short tables are joined up to 64 characters."""
    height, width = max(r for r, _ in places) + 1, max(c for _, c in places) + 1
    of = " for " if english else "的"
    text = lambda r, c, sep="": sep.join(b["text"].strip() for b in places.get((r, c), []))
    heads: dict[int, list[str]] = {}
    for r in sorted(headers):
        own = [text(r, c, " ") for c in range(width)]
        if any(own):
            above = heads[max(heads)] if heads else [""] * width
            heads[r] = [o or a for o, a in zip(own, above, strict=True)]
    for r in sorted(heads):
        if r - 1 in heads:
            for c, (upper, own) in enumerate(zip(heads[r - 1], heads[r], strict=True)):
                if upper and upper not in own:
                    heads[r][c] = f"{own}{of}{upper}" if len(own) > len(upper) else f"{upper}{of}{own}"
    out: list[str] = []
    for r in range(height):
        if r in heads:
            continue
        above = [h for h in heads if h < r]
        head = heads[max(above)] if above else None
        cells = [(c, text(r, c)) for c in range(width) if text(r, c)]
        if not cells:
            continue
        if head is None and width <= 2:
            line = "：".join(t for _, t in cells)
            if out and len(out[-1]) + len(line) < 64:
                out[-1] += "\n" + line
            else:
                out.append(line)
        else:
            out.append("; ".join(f"{head[c]}：{t}" if head and head[c] else t for c, t in cells))
    return [f"{t}\t——{' in ' if english else '来自'}“{title}”" for t in out] if title else out


def kind_of(text: str) -> str:
    """The block type of a text; "" if it has none."""
    return next((kind for pattern, kind in BLOCK_TYPES if re.search(pattern, text.strip())), "")


def header_lines(boxes: list[dict]) -> set[int]:
    """Rows of which more than half of the places are headers, as ``header_rows`` has them: the first header part has number 0 and marks none."""
    kinds = Counter(kind_of(b["text"]) for b in boxes)
    numbers = max(kinds, key=kinds.get) == "Nu"
    places: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for b in boxes:
        places[b["rn"], b["cn"]].append(b)
    seen, found = Counter(), Counter()
    for (r, _), own in places.items():
        number = kind_of(own[0]["text"]) == "Nu"
        seen[r] += 1
        found[r] += not (numbers and number) and (numbers or any(b["H"] for b in own))
    return {r for r in seen if 2 * found[r] > seen[r]}


def rebuild(cells: DataFrame, english: bool = False) -> DataFrame:
    """(table_id, markdown, sentences) of tagged cells, with captions, relocation and spans."""
    from lamina.operators.order import by_tag, fuzzy

    def is_caption(b: dict) -> bool:
        return bool(re.match(CAPTION, b["text"].strip())) or "caption" in (b.get("layout_type") or "")

    def step(rows: list[dict]) -> list[tuple]:
        table = rows[0]["table_id"]
        said = [b["text"] for b in rows if is_caption(b)]
        boxes = [b for b in rows if not is_caption(b)]
        if not boxes:
            return [(table, "", [])]
        heights = [b["R_bott"] - b["R_top"] for b in boxes if b["R"] is not None]
        boxes = by_tag(boxes, "R", "x0", "top", "x0", min(heights, default=0) / 2)
        number_rows(boxes)
        widths = [b["C_right"] - b["C_left"] for b in boxes if b["C"] is not None]
        slack = min(widths, default=0) / 2
        # Columns of a table on several pages are told apart by place alone.
        pages = {b.get("page_number") for b in boxes}
        boxes = fuzzy(boxes, "x0", "top", slack) if len(pages) > 1 else by_tag(boxes, "C", "top", "x0", "top", slack)
        number_columns(boxes)
        relocate(boxes, "cn", "rn", "x0", "x1")
        relocate(boxes, "rn", "cn", "top", "bottom")
        headers = header_lines(boxes)
        places = fill_spans(boxes)
        height, width = max(r for r, _ in places) + 1, max(c for _, c in places) + 1
        lines = ["| " + " | ".join(" ".join(b["text"] for b in places.get((r, c), [])) for c in range(width)) + " |\n" for r in range(height)]
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |\n")
        title = " ".join(said)
        if title:
            lines.insert(0, f"**{title}**\n\n")
        return [(table, "".join(lines), sentences(places, headers, title, english))]


    return by_runs(cells, ("table_id",), ("seq",), step, "table_id long, markdown string, sentences array<string>", [pa.int64(), pa.string(), pa.list_(pa.string())])
