"""Quality rules with adaptive thresholds (DataFrame functions only).

Base counts are taken over each whole text. The adaptive part keeps a KLL
quantile sketch per language and source and metric; sketches merge, so the
language and the whole corpus get theirs from the same pass. A document is
rejected where one of its metrics lies above the outer fence
``q75 + FENCE * max(q75 - q25, floor)`` of its group: thresholds follow the data
instead of being fixed. The quantiles of a group of n documents are mixed with its
language's, and those with the whole corpus', as n to ``SHRINK``, so a small group
leans on a larger one and no verdict jumps as a group grows. A
sketch's quantiles are exact up to a few hundred documents and off by about one
per cent of the ranks beyond. Sketches are summed before the shuffle, so a hot
group costs no more than others; the fences, a row a language and source, are
counted before they are broadcast.

Defined results: null text has no words and fails the base rule; a null
language or source is a group of its own; texts of any length count whole;
repeated rows are judged alike; a metric equal to its fence passes; an empty
table gives an empty result; NaN never occurs since ratios of texts without words
are 0; columns other than doc_id, text, lang and source are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, join_small, materialize, word_array

METRICS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_len")
#: Spreads below these are widened to them, so that a group of like documents has no needle-thin fence.
FLOOR = {"symbol_ratio": 0.01, "dup_line_ratio": 0.1, "repeat_ratio": 0.05, "word_len": 0.5}
FENCE = 6.0
QUANTILES = (0.25, 0.75)
#: A group of so many documents counts as much as the group above it.
SHRINK = 200


def _windows(words: Column) -> Column:
    """The hash of every 3-word window, in order."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(3)])))


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Most texts have none, which their distinct hashes tell. Else windows are
    sorted by (hash, place); equal neighbours mark repeats, and the union of the
    marked windows is summed along sorted places.
    """
    keys = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
    same = lambda a, i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
    marked = F.transform(
        F.array(keys),  # binds the sorted array once
        lambda a: F.array_sort(
            F.filter(
                F.transform(a, lambda x, i: F.when(same(a, i, i - 1) | same(a, i, i + 1), x["p"])),
                lambda p: p.isNotNull(),
            )
        ),
    )[0]
    union = F.aggregate(
        marked,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")),
    )["n"]
    none = hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes))
    return F.when(none, F.lit(0).cast("long")).otherwise(union)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.select("doc_id", "lang", "source", text.alias("text"))
        .withColumn("words", word_array(F.col("text")))
        .withColumn("windows", _windows(F.col("words")))
        .select(
            "doc_id", "lang", "source",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            _repeat_words(F.col("windows")).alias("n_repeat_words"),
        )
    )
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def _with_metrics(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.withColumns(
        {
            "symbol_ratio": per("n_symbols", "word_chars"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "word_len": per("word_chars", "n_words"),
        }
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with the upper fence of every metric."""
    passed = _with_metrics(measured).where(~F.col("base_failed"))
    fine = materialize(
        passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m).alias(m) for m in METRICS]),
        "quality-sketches",
    )
    merge = [F.kll_merge_agg_double(m).alias(m) for m in METRICS]

    def quantiles(df: DataFrame, keys: list, tag: str) -> DataFrame:
        q = lambda m, p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))
        return df.select(*keys, F.col("n").alias(f"n_{tag}"), *[q(m, p).alias(f"{m}_q{p * 100:.0f}_{tag}") for m in METRICS for p in QUANTILES])

    by_lang = fine.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    everything = quantiles(fine.agg(F.sum("n").alias("n"), *merge).where("n > 0"), [], "all")
    coarse = quantiles(by_lang, [F.col("lang").alias("lang2")], "lang").crossJoin(F.broadcast(everything))  # one row a language, and one row
    wide = join_small(quantiles(fine, ["lang", "source"], "fine"), materialize(coarse, "quality-coarse"), {"lang": "lang2"})
    lean = lambda own, tag, above: (F.col(f"n_{tag}") * F.col(own) + SHRINK * above) / (F.col(f"n_{tag}") + SHRINK)
    q = lambda m, p: lean(f"{m}_q{p * 100:.0f}_fine", "fine", lean(f"{m}_q{p * 100:.0f}_lang", "lang", F.col(f"{m}_q{p * 100:.0f}_all")))
    low, high = QUANTILES
    fence = lambda m: q(m, high) + FENCE * F.greatest(q(m, high) - q(m, low), F.lit(FLOOR[m]))
    return wide.select("lang", "source", *[fence(m).alias(f"max_{m}") for m in METRICS])


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, the metrics and ``kept`` of every document."""
    measured = materialize(measure(docs), "quality-measured")
    limits = materialize(thresholds(measured).withColumnRenamed("lang", "l2").withColumnRenamed("source", "s2"), "quality-limits")
    joined = join_small(_with_metrics(measured), limits, {"lang": "l2", "source": "s2"}, "left")
    fine = F.lit(True)
    for m in METRICS:
        fine = fine & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(float("inf"))))
    return joined.withColumn("kept", ~F.col("base_failed") & fine)
