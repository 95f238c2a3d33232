"""Confidence statistics from lines to regions, pages and documents, and the review gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import stripped


def rounded(value: Column, digits: int | None = 4) -> Column:
    """Rounded, as reported figures are; null stays null. Without ``digits`` the value itself."""
    return value if digits is None else F.round(value, digits)


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, rounded(part / whole, digits)).otherwise(F.lit(0.0))


def line_stats(lines: DataFrame, keys: list[str], low: float = 0.78, digits: int | None = 4) -> DataFrame:
    """Counts and score statistics of lines with text and a score; nulls where there are none."""
    fit = (stripped(F.col("text")) != "") & F.col("score").isNotNull()
    score = F.when(fit, F.col("score"))
    counted = lines.groupBy(*keys).agg(
        F.count(score).alias("line_count"),
        F.coalesce(F.sum(F.when(fit, F.length(stripped(F.col("text"))))), F.lit(0)).cast("long").alias("char_count"),
        F.lit(low).alias("low_score_threshold"),
        F.sum(score).alias("score_sum"),
        rounded(F.avg(score), digits).alias("avg_score"),
        rounded(F.min(score), digits).alias("min_score"),
        rounded(F.median(score), digits).alias("median_score"),
        F.count_if(score < low).alias("low_score_count"),
    )
    return counted.withColumn("low_score_ratio", ratio(F.col("low_score_count"), F.col("line_count"), digits))


def roll_up(stats: DataFrame, keys: list[str], low: float = 0.78, digits: int | None = 4) -> DataFrame:
    """Weighted averages of averages, minima and the weighted median of medians of finer statistics, which carry their averages."""
    n = F.col("line_count")
    scored = F.col("avg_score").isNotNull() & (n > 0)
    counted = stats.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("line_count"),
        F.coalesce(F.sum("char_count"), F.lit(0)).alias("char_count"),
        F.lit(low).alias("low_score_threshold"),
        F.sum(F.when(scored, F.col("avg_score") * n)).alias("weighted"),
        rounded(F.min(F.when(scored, F.col("min_score"))), digits).alias("min_score"),
        rounded(F.percentile(F.when(scored, F.col("median_score")), 0.5, F.greatest(F.lit(1), n)), digits).alias("median_score"),
        F.coalesce(F.sum("low_score_count"), F.lit(0)).alias("low_score_count"),
    )
    average = F.when(F.col("line_count") > 0, rounded(F.col("weighted") / F.col("line_count"), digits))
    return counted.withColumn("avg_score", average).withColumn("low_score_ratio", ratio(F.col("low_score_count"), F.col("line_count"), digits)).drop("weighted")


def layout_stats(regions: DataFrame, keys: list[str], low: float = 0.55, digits: int | None = 4) -> DataFrame:
    """Counts and score statistics of scored regions, from the raw scores at any grain."""
    counted = regions.groupBy(*keys).agg(
        F.count("score").alias("region_count"),
        F.lit(low).alias("low_score_threshold"),
        F.sum("score").alias("score_sum"),
        rounded(F.avg("score"), digits).alias("avg_score"),
        rounded(F.min("score"), digits).alias("min_score"),
        rounded(F.median("score"), digits).alias("median_score"),
        F.count_if(F.col("score") < low).alias("low_score_count"),
    )
    return counted.withColumn("low_score_ratio", ratio(F.col("low_score_count"), F.col("region_count"), digits))


def multi_column_pages(layouts: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, multi_column): two columns of two narrow regions each that span a quarter of the page."""
    fit = (
        F.col("type").isin("text", "title", "table")
        & (F.col("score") >= 0.15)
        & (F.col("x1") - F.col("x0") <= width * 0.68)
        & (F.col("bottom") - F.col("top") >= height * 0.04)
    )
    center = (F.col("x0") + F.col("x1")) / 2
    sides = {"left": fit & (center < width * 0.48), "right": fit & (center > width * 0.52)}
    found = F.lit(True)
    for side in sides.values():
        span = F.max(F.when(side, F.col("bottom"))) - F.min(F.when(side, F.col("top")))
        found = found & (F.count_if(side) >= 2) & F.coalesce(span > height * 0.25, F.lit(False))
    return layouts.groupBy("page_id").agg(found.alias("multi_column"))


@dataclass(frozen=True)
class Gate:
    """Thresholds of the review gate."""

    average: float = 0.86
    very_low: float = 0.60
    low_ratio: float = 0.20
    min_lines: int = 1
    layout_average: float = 0.60
    layout_low_ratio: float = 0.35


#: Risk categories that tell uncertain recognition.
UNCERTAIN = ("ambiguous_characters", "ocr_too_short_for_region")


def gate_reasons(gate: Gate = Gate()) -> Column:
    """Worded reasons, in order, of a row with line statistics, layout statistics (l_), has_text, and the categories of its risks (risks)."""
    four = lambda x: F.format_string("%.4f", x.cast("double"))
    limit = lambda x: F.lit(f"{x:.4f}")
    n, avg, least, low = (F.col(c) for c in ("line_count", "avg_score", "min_score", "low_score_ratio"))
    l_n, l_avg, l_low = (F.col(f"l_{c}") for c in ("region_count", "avg_score", "low_score_ratio"))
    doubtful = F.filter(F.coalesce("risks", F.array().cast("array<string>")), lambda c: c.isin(*UNCERTAIN))
    tests = (
        (F.col("has_text") & (n < gate.min_lines), F.concat(F.lit("recognized OCR lines "), n.cast("string"), F.lit(f" < minimum {gate.min_lines} on a document with text/table layout"))),
        (avg < gate.average, F.concat(F.lit("average OCR confidence "), four(avg), F.lit(" < threshold "), limit(gate.average))),
        (least < gate.very_low, F.concat(F.lit("minimum OCR line confidence "), four(least), F.lit(" < threshold "), limit(gate.very_low))),
        ((low >= gate.low_ratio) & (n > 0), F.concat(F.lit("low-confidence OCR line ratio "), four(low), F.lit(" >= threshold "), limit(gate.low_ratio))),
        (l_avg < gate.layout_average, F.concat(F.lit("average layout confidence "), four(l_avg), F.lit(" < threshold "), limit(gate.layout_average))),
        ((l_n > 0) & (l_low >= gate.layout_low_ratio), F.concat(F.lit("low-confidence layout region ratio "), four(l_low), F.lit(" >= threshold "), limit(gate.layout_low_ratio))),
        (F.size(doubtful) > 0, F.concat(F.size(doubtful).cast("string"), F.lit(" OCR uncertainty risk(s): "), F.array_join(F.array_sort(F.array_distinct(doubtful)), ", "))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), words) for t, words in tests]))


def decision(trigger: Column, reasons: Column, risks: Column, enabled: Column | bool = True) -> Column:
    """(enabled, run, trigger, reason) of the review of a document; an unknown trigger asks the gate alone."""
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    name = F.lower(stripped(F.coalesce(F.nullif(trigger, F.lit("")), F.lit("low_confidence"))))
    low = F.size(reasons) > 0
    row = lambda run, kind, why: F.struct(on.alias("enabled"), run.alias("run"), kind.alias("trigger"), why.alias("reason"))
    yes, no = F.lit(True), F.lit(False)
    either = F.when(risks > 0, "VLM risks present").when(low, "low confidence gate matched").otherwise("no VLM risk and OCR confidence passed")
    gate = F.when(low, F.array_join(reasons, "; ")).otherwise("OCR confidence passed; VLM post-check skipped")
    return (
        F.when(~on, row(no, F.lit("disabled"), F.lit("GEMINI_POSTCHECK=false")))
        .when(name == "always", row(yes, name, F.lit("VLM_POSTCHECK_TRIGGER=always")))
        .when(name == "never", row(no, name, F.lit("VLM_POSTCHECK_TRIGGER=never")))
        .when(name == "risk_or_low_confidence", row((risks > 0) | low, name, either))
        .otherwise(row(low, F.lit("low_confidence"), gate))
    )


def skip_reasons(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skipped): how many candidates each reason left out, as a map."""
    counted = candidates.where("reason <> ''").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))


def cross_page(boxes: DataFrame, keys: list[str], page: str = "page_number") -> DataFrame:
    """(keys, cross_page): whether the boxes of a table lie on more than one page."""
    return boxes.groupBy(*keys).agg((F.min(page) < F.max(page)).alias("cross_page"))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one met first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))
