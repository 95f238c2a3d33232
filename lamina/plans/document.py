"""Whole-document plans: operators chained from boxes and lines to tables, metadata and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.functions.text import ambiguous, checkbox, json_reply, risk_categories, sensitive, severity, slug
from lamina.operators import assign, memory, order, stats, suppress, tables

LINE_RISKS = (("sensitive_value", sensitive), ("ambiguous_characters", ambiguous), ("checkbox_or_selection", checkbox))
#: Transforms by name, for use with ``DataFrame.transform``.
REGISTRY = {
    "clean_layouts": lambda df: df.join(suppress.clean_layouts(df), ["page_id", "seq"], "left_semi"),
    "align_parts": tables.align_parts,
    "grid": tables.grid,
    "bands": order.bands,
}


def extract_tables(cells: DataFrame, parts: DataFrame, english: bool = False) -> DataFrame:
    """(table_id, markdown, sentences, confidence columns) of recognised lines in tables and table parts.

    Degenerate and empty lines are left out; overlapping parts are cleaned up;
    a table without lines left has the text "" and keeps its statistics.
    """
    confidence = stats.line_stats(cells, ["table_id"]).drop("score_sum")
    fit = cells.where(~g.degenerate() & (F.coalesce("text", F.lit("")) != ""))
    built = tables.rebuild(assign.tag_cells(fit, suppress.clean_parts(tables.align_parts(parts))), english)
    return confidence.join(built, "table_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


def text_risks(lines: DataFrame) -> DataFrame:
    """(page_id, seq, risk_id, category, severity, text): one row per line and category, text cut to 1000."""
    area = g.area() if "x0" in lines.columns else None
    found = lines.select("page_id", "seq", "text", F.posexplode(risk_categories(F.col("text"), area)).alias("nth", "category"))
    ranked = found.withColumn("seq", F.col("seq") * 8 + F.col("nth"))
    out = memory.numbered(ranked)
    return out.select("page_id", "seq", "risk_id", "category", severity(F.col("category")).alias("severity"), F.substring("text", 1, 1000).alias("text"))


def risks_by_group(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, severity, n_risks, n_docs) of the lines of ``docs`` (keys, text).

    A text is split into lines only where the whole text has the category at
    all; each document then adds one number a category, with no row a line.
    """
    lines = F.split("text", "\n")
    counts = [F.struct(F.lit(name).alias("category"), F.when(test(F.col("text")), F.size(F.filter(lines, test))).otherwise(0).cast("long").alias("n")) for name, test in LINE_RISKS]
    found = docs.select(*keys, F.explode(F.array(*counts)).alias("c")).where("c.n > 0").select(*keys, "c.category", "c.n")
    return found.groupBy(*keys, "category", severity(F.col("category")).alias("severity")).agg(F.sum("n").alias("n_risks"), F.count(F.lit(1)).alias("n_docs"))


def structural_risks(layouts: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, category, severity) of multi-column pages, tables and visual marks."""
    pages = stats.multi_column_pages(layouts, width, height).where("multi_column").select("page_id", F.lit("multi_column_page").alias("category"))
    of = lambda kinds, name: layouts.where(F.col("type").isin(*kinds)).select("page_id", F.lit(name).alias("category"))
    found = pages.unionByName(of(("table",), "table_or_form_block")).unionByName(of(("figure", "equation"), "signature_stamp_qr_or_visual_mark"))
    return found.withColumn("severity", severity(F.col("category")))


def review(lines: DataFrame, layouts: DataFrame, key: str = "page_id", gate: stats.Gate = stats.Gate(), trigger: str = "low_confidence") -> DataFrame:
    """(key, reasons, enabled, run, trigger, reason): the review gate on line and layout statistics and text risks."""
    ours = stats.line_stats(lines, [key])
    theirs = stats.layout_stats(layouts, [key])
    theirs = theirs.select(key, *[F.col(c).alias(f"l_{c}") for c in theirs.columns if c != key])
    has_text = layouts.groupBy(key).agg(F.bool_or(F.col("type").isin("text", "title", "table")).alias("has_text"))
    risks = lines.groupBy(key).agg(F.flatten(F.collect_list(risk_categories(F.col("text"), g.area()))).alias("risks"))
    both = ours.join(theirs, key, "full_outer").join(has_text, key, "left").join(risks, key, "left")
    both = both.fillna(0, ["line_count", "low_score_ratio", "l_region_count", "l_low_score_ratio"]).fillna(False, ["has_text"])
    out = both.withColumn("reasons", stats.gate_reasons(gate))
    count = F.coalesce(F.size("risks"), F.lit(0))
    return out.select(key, "reasons", stats.decision(F.lit(trigger), F.col("reasons"), count).alias("d")).select(key, "reasons", "d.*")


def assemble(regions: DataFrame) -> DataFrame:
    """(doc_id, markdown): regions by top within pages, pages in order, blank ones skipped."""
    pages = order.joined(regions, ["doc_id", "page_no"], ["top", "seq"], "text")
    return order.joined(pages, ["doc_id"], ["page_no"], "markdown")


def metadata(regions: DataFrame, headings: DataFrame, risks: DataFrame) -> DataFrame:
    """Per document: how many pages, regions, assets, headings and risks, and the headings and risks themselves in page order."""
    own = regions.groupBy("doc_id").agg(
        F.countDistinct("page_no").alias("pages"), F.count(F.lit(1)).alias("regions"), F.count_if(F.col("content_type") == "image").alias("assets")
    )

    def per(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in ("doc_id", "page_no", "seq")]
        items = F.array_sort(F.collect_list(F.struct("page_no", "seq", *fields)))
        return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name), items.alias(f"{name}_list"))

    return own.join(per(headings, "headings"), "doc_id", "left").join(per(risks, "risks"), "doc_id", "left").fillna(0, ["headings", "risks"])


def envelope(documents: DataFrame, inputs: str) -> DataFrame:
    """``documents`` (doc_id, output_path) with the fixed fields of a document's metadata; the time is the query's."""
    return documents.select(
        "doc_id", F.lit(inputs).alias("input"), F.regexp_extract("output_path", r"([^/]*)$", 1).alias("output_markdown"),
        F.lit("assets").alias("assets_dir"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    )


def risk_assets(risks: DataFrame, most: int, width: int, height: int) -> DataFrame:
    """The first ``most`` risks of each page with the name of their crop.

    A risk that has an asset keeps it, one without a box, or whose padded box is
    empty, gets none; a new file has the number of assets the page has by then, plus one.
    """
    order = Window.partitionBy("page_id").orderBy("seq")
    box = g.clamped_box(width, height, pad=24)
    x0, top, x1, bottom = (c for c in box)
    crop = (F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), bottom - top)) > 0
    own = F.coalesce("asset_path", F.lit("")) != ""
    new = ~own & F.col("x0").isNotNull() & crop & (F.col("nth") <= most)
    listed = risks.withColumn("nth", F.row_number().over(order))
    # All assets that the page came with count from the start; new ones in order.
    had = F.count_if(own).over(Window.partitionBy("page_id"))
    made = F.count_if(F.coalesce(new, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    name = F.format_string("page_%03d_risk_%03d_%s.png", F.col("page_id"), had + made, slug(F.col("category")))
    path = F.when(own, F.col("asset_path")).when(F.coalesce(new, F.lit(False)), name)
    return listed.withColumn("asset_path", path).drop("nth")


#: Why a review failed, where nothing else says so.
NO_KEY, NO_TEXT = "no key was given", "the reply holds no checked text"


def reviewed(decided: DataFrame, replies: DataFrame, required: bool = False) -> DataFrame:
    """(doc_id, status, error, text, checked): what becomes of each document's text.

    ``decided`` has doc_id, markdown, enabled, run and has_key, ``replies`` doc_id, reply and failure,
    one at most a document. A review that is enabled and due is completed by a reply whose JSON
    object has a checked text, which is then kept; any other outcome keeps the raw text,
    or, where reviews are ``required``, fails the query. A reply counts only where a
    review was due; documents without a reply count as replies without a text.
    """
    checked = F.get_json_object(json_reply(F.col("reply")), "$.checked_markdown")
    error = F.when(~F.col("has_key"), NO_KEY).when(F.col("failure").isNotNull(), F.col("failure")).when(checked.isNull(), NO_TEXT)
    due = F.col("enabled") & F.col("run")
    status = F.when(~F.col("enabled"), "disabled").when(~F.col("run"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    both = decided.join(replies.select("doc_id", "reply", "failure"), "doc_id", "left").withColumn("error", F.when(due, error)).withColumn("status", status)
    if required:
        both = both.withColumn("status", F.when(F.col("status") == "failed", F.raise_error(F.concat(F.lit("review of "), F.col("doc_id"), F.lit(": "), F.col("error")))).otherwise(F.col("status")))
    done = F.col("status") == "completed"
    return both.select("doc_id", "status", "error", F.when(done, checked).otherwise(F.col("markdown")).alias("text"), done.alias("checked"))
