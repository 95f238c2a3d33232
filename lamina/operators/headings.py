"""Heading classification: stateless classes by pattern, state by windows over the document's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import heading_candidate, passthrough, stripped

# Heading patterns, tried in this order, with the reason and level they give.
TITLE = r"(?iuU)^(quyết\s*định|thông\s*báo|hợp\s*đồng|tờ\s*trình|báo\s*cáo|biên\s*bản|công\s*văn)\b"
ARTICLE = r"(?iuU)^điều\s+\d+[.,:]?\s+.+"
RECEIVER = r"(?iuU)^nơi\s+nhận\b"
CHAPTER = r"(?iuU)^(chương|phần|mục)\s+([ivxlcdm]+|\d+)\b"
SUBSECTION = r"(?U)^(\d{1,2})\.(\d{1,2})\.?\s*\S+"
SECTION = r"(?U)^(\d{1,2})\.\s+\S+"
DENSE = r"(?U)^(\d{2})\.?\s*\D+"


def classify(lines: DataFrame, most: int = 140, scope: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, level, reason, heading) of heading lines.

    ``scope`` is the column whose groups share state. A title, article,
    receiver line or chapter clears the number that dense lines may continue.
    """
    t = F.col("t")
    fit = lines.withColumn("t", stripped(F.col("text"))).where(~passthrough(F.col("text")) & heading_candidate(F.col("text"), most))
    kind = (
        F.when(t.rlike(TITLE), "title")
        .when(t.rlike(ARTICLE), "article")
        .when(t.rlike(RECEIVER), "receiver_section")
        .when(t.rlike(CHAPTER), F.lower(F.regexp_extract(t, CHAPTER, 1)))
        .when(t.rlike(SUBSECTION), "numbered_subsection")
        .when(t.rlike(SECTION), "numbered_section")
        .when(t.rlike(DENSE), "dense")
    )
    number = (
        F.when(F.col("kind") == "numbered_subsection", F.regexp_extract(t, SUBSECTION, 1))
        .when(F.col("kind") == "numbered_section", F.regexp_extract(t, SECTION, 1))
        .when(F.col("kind") != "dense", "")
    )
    order = [F.col("doc_id"), F.col("line_no")]
    upto = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        fit.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .withColumn("number", number)
        .withColumn("parent", F.last("number", ignorenulls=True).over(upto))
        .withColumn("titles", F.coalesce(F.sum(F.when(F.col("kind") == "title", 1)).over(upto), F.lit(0)))
    )
    n = F.length("parent")
    rest = F.regexp_replace(F.expr("substring(t, length(parent) + 2)"), r"^[. ]+", "")
    child = F.expr("substring(t, length(parent) + 1, 1)")
    dense = (n > 0) & t.startswith(F.col("parent")) & child.rlike(r"^\p{Nd}$") & (rest != "")
    dense = F.coalesce(dense, F.lit(False))
    heading = F.when(F.col("kind") == "dense", F.concat("parent", F.lit("."), child, F.lit(". "), rest)).otherwise(t)
    level = (
        F.when(F.col("kind") == "title", F.when(F.col("titles") == 0, 1).otherwise(2))
        .when(F.col("kind").isin("numbered_section", "mục"), 3)
        .when(F.col("kind").isin("numbered_subsection", "dense"), 4)
        .otherwise(2)
    )
    reason = (
        F.when(F.col("kind") == "title", F.when(F.col("titles") == 0, "document_title").otherwise("document_section_title"))
        .when(F.col("kind") == "dense", "dense_numbered_subsection")
        .otherwise(F.col("kind"))
    )
    return marked.where((F.col("kind") != "dense") | dense).select("doc_id", "line_no", level.alias("level"), reason.alias("reason"), heading.alias("heading"))


def apply(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, markdown): each document's lines, headings marked by their level."""
    marked = lines.join(headings, ["doc_id", "line_no"], "left")
    text = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"))).otherwise(F.col("text"))
    items = F.array_sort(F.collect_list(F.struct("line_no", text.alias("out"))))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda s: s["out"]), "\n").alias("markdown"))
