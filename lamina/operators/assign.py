"""Spatial joins: which region, row or column a box belongs to.

All joins are equi-joins on the page or table and, where boxes must touch, on bands
of its height, with the overlap as a residual condition. So a page's boxes meet only
those near them in height: a page of n boxes makes far fewer than n squared pairs, and
a page with very many boxes is dealt out by its bands. A box lies on its page, so it
reaches into as many bands as the page has, at most. Boxes without an edge touch nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g

#: Layout types in the order in which they are tried (fixed values).
TAG_ORDER = ("footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation")
GARBAGE_TYPES = ("footer", "header", "reference")
#: Pixels of a band: several lines of text, so most boxes reach into one or two.
BAND = 128


def prefixed(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def banded(boxes: DataFrame, band: int) -> DataFrame:
    """Each box once for every band of ``band`` rows of pixels that it reaches into, with ``band__`` and its first one, ``from__``."""
    of = lambda edge: F.floor(edge / band)
    first, last = of(F.least("top", "bottom")), of(F.greatest("top", "bottom"))
    return boxes.withColumn("from__", first).withColumn("band__", F.explode(F.sequence(first, last)))


def met(boxes: DataFrame, others: DataFrame, keys: tuple[str, ...], band: int = BAND) -> DataFrame:
    """Boxes (a_) and others (b_) of one key that share a band, once: in the first band that they share."""
    on = [*keys, "band__"]
    joined = prefixed(banded(boxes, band), "a_", tuple(on)).join(prefixed(banded(others, band), "b_", tuple(on)), on)
    return joined.where(F.col("band__") == F.greatest("a_from__", "b_from__")).drop("band__", "a_from__", "b_from__")


def pairs(boxes: DataFrame, others: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Boxes (a_) and others (b_) of one key that touch, with both overlap ratios."""
    joined = met(boxes, others, keys).where(g.touching("a_", "b_"))
    return joined.withColumn("ov", g.overlap_ratio("a_", "b_")).withColumn("ov2", g.overlap_ratio("b_", "a_"))


def best_overlap(boxes: DataFrame, others: DataFrame, least: float, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, seq, hit) of each box that some other covers by ``least``: most covered, then covering, then the later."""
    found = pairs(boxes, others, keys).where((F.col("ov") > least) | ((F.col("ov") == least) & (F.col("ov2") >= 0)))
    return found.groupBy(*keys, F.col("a_seq").alias("seq")).agg(F.max_by("b_seq", F.struct("ov", "ov2", "b_seq")).alias("hit"))


def most_overlap(boxes: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, seq, hit) of each box that shares an area with some other: the largest area, then the earlier."""
    found = pairs(boxes, others, keys).withColumn("common", g.intersection("a_", "b_")).where("common > 0")
    return found.groupBy(*keys, F.col("a_seq").alias("seq")).agg(F.max_by("b_seq", F.struct("common", -F.col("b_seq"))).alias("hit"))


def numbered_pages(pages: DataFrame, document: str = "doc_id", page: str = "page_id") -> DataFrame:
    """Pages with their number in the document, from 1."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy(document).orderBy(page)).cast("long"))


def nearest_column(boxes: DataFrame, columns: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, seq, hit): the column with the least edge or centre distance; the earlier of equals."""
    joined = prefixed(boxes, "a_", keys).join(prefixed(columns, "b_", keys), list(keys))
    return joined.groupBy(*keys, F.col("a_seq").alias("seq")).agg(F.min_by("b_seq", F.struct(g.column_distance("a_", "b_").alias("d"), "b_seq")).alias("hit"))


def tag_layout(boxes: DataFrame, layouts: DataFrame, least: float = 0.4, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, seq, layout_type, layout_seq): the first type in order with a region covering the box by ``least``."""
    order = F.array_position(F.array(*map(F.lit, TAG_ORDER)), F.col("b_type"))
    found = pairs(boxes, layouts, keys).withColumn("rank", order).where((F.col("rank") > 0) & (F.col("ov") >= least))
    best = found.groupBy(*keys, F.col("a_seq").alias("seq")).agg(
        F.max_by(F.struct(F.col("b_type").alias("t"), F.col("b_seq").alias("s")), F.struct((-F.col("rank")).alias("r"), "ov", "ov2", "b_seq")).alias("best")
    )
    kind = F.when(F.col("best.t") == "equation", "figure").otherwise(F.col("best.t"))
    return best.select(*keys, "seq", kind.alias("layout_type"), F.col("best.s").alias("layout_seq"))


def drop_page_edges(tagged: DataFrame, page_height: Column | int) -> DataFrame:
    """Without headers, footers and references that lie where such text lies."""
    h = F.lit(page_height) if isinstance(page_height, int) else page_height
    kept = (F.col("layout_type") == "footer") & (F.col("bottom") < h * 0.9) | (F.col("layout_type") == "header") & (F.col("top") > h * 0.1)
    return tagged.where(~F.coalesce(F.col("layout_type").isin(*GARBAGE_TYPES), F.lit(False)) | F.coalesce(kept, F.lit(False)))


def orphan_visuals(layouts: DataFrame, tags: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Figures and equations that no box was assigned to, as boxes without text."""
    used = tags.select(*keys, F.col("layout_seq").alias("seq")).distinct()
    return layouts.where(F.col("type").isin("figure", "equation")).join(used, [*keys, "seq"], "left_anti").withColumn("text", F.lit(""))


def repeated_garbage(boxes: DataFrame, dropped: DataFrame, text: str = "text") -> DataFrame:
    """Without every box whose text was dropped as page edge more than once."""
    often = dropped.groupBy("layout_type", F.trim(text).alias("t")).count().where("count > 1").select("t").distinct()
    return boxes.join(often, F.trim(F.col(text)) == F.col("t"), "left_anti")


def tag_cells(cells: DataFrame, parts: DataFrame, least: float = 0.3) -> DataFrame:
    """Cells with their row (R), header (H), column (C) and span (SP) and the extents these give.

    Spans overwrite the header's extents.
    """
    key = ("table_id",)
    order = Window.partitionBy("table_id").orderBy("top", "seq")
    columns = Window.partitionBy("table_id").orderBy("x0", "seq")
    kinds = {
        "R": parts.where(F.col("label").rlike(".+row|.+header")).withColumn("seq", F.row_number().over(order) - 1),
        "H": parts.where(F.col("label").rlike("header$")).withColumn("seq", F.row_number().over(order) - 1),
        "SP": parts.where(F.col("label").rlike(".+spanning")).withColumn("seq", F.row_number().over(order) - 1),
    }
    out = cells
    for name, found in kinds.items():
        hits = best_overlap(cells, found, least, key).withColumnRenamed("hit", name)
        extent = found.select("table_id", F.col("seq").alias(name), *[F.col(e).alias(f"{name}_{e}") for e in g.EDGES])
        out = out.join(hits.join(extent, ["table_id", name]), ["table_id", "seq"], "left")
    cols = parts.where("label = 'table column'").withColumn("seq", F.row_number().over(columns) - 1)
    hits = nearest_column(cells, cols, key).withColumnRenamed("hit", "C")
    extent = cols.select("table_id", F.col("seq").alias("C"), F.col("x0").alias("C_left"), F.col("x1").alias("C_right"))
    out = out.join(hits.join(extent, ["table_id", "C"]), ["table_id", "seq"], "left")
    pick = [F.coalesce(f"SP_{e}", f"H_{e}").alias(n) for e, n in zip(g.EDGES, ("H_left", "H_top", "H_right", "H_bott"), strict=True)]
    return out.select(*cells.columns, "R", F.col("R_top"), F.col("R_bottom").alias("R_bott"), "H", "C", "C_left", "C_right", "SP", *pick)
