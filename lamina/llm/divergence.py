"""How far the sources of a language differ in their terms, priced by inclusion-exclusion over supports.

A term's smoothed rate depends on its count alone, so a sum over all kept terms
need not visit the many terms that a source lacks. For sources s and t of a
language with V kept terms, and z the rate of a count of zero::

    sum f(p, q) = V f(zs, zt)                                        both zero
                + sum over support of s of f(p, zt) - f(zs, zt)      one-sided
                + sum over support of t of f(zs, q) - f(zs, zt)      one-sided
                + sum over both of f(p, q) - f(p, zt) - f(zs, q) + f(zs, zt)

The constant is one number a pair. One-sided sums come from histograms: per source
and count, how many terms have it. Only the overlap joins postings, (source,
count) by term; f is symmetric, so each pair of sources is met once. Everything is
whole numbers (decimals where a product may pass a long), so reruns agree.

Counting is combined inside tasks: a block of texts sends one row a term, language
and source, however often the term occurs. Rows are dealt by (language, term), where
a term has at most a row a source and block, so a hot source spreads over all terms;
the same dealing serves the counts, the sums of a language and the document
frequency. What is joined to postings is a row a group, broadcast only if counted.

Defined results: null text, lang and source are read as ''; texts without a term
belong to their group, which has a pair row with every other source of its language
even if no term is kept (value 0 where V = 0); a source alone in its language has no
pair rows; repeated rows are documents of their own; ties rank by item in order of
bytes; texts of any length count whole; an empty table gives an empty result; columns
other than text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, join_small, materialize, shuffle_partitions
from lamina.llm.tokens import LETTERS, blocks, words

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
GROUP = ("lang", "source")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df), a row a block of texts, group and term: occurrences and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in GROUP)
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            ids, names, text = words(t.column("text"), LETTERS)
            v = max(len(names), 1)
            each = np.unique(text * v + ids)  # a (text, term) once
            keys, n = np.unique(pair[text] * v + ids, return_counts=True)
            df = np.unique(pair[each // v] * v + each % v, return_counts=True)[1]
            group = keys // v
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))),
                 names.take(pa.array(keys % v)).cast(pa.large_string()), pa.array(n), pa.array(df)],
                schema=pa.schema([("lang", lang.type.value_type), ("source", source.type.value_type), ("term", pa.large_string()), ("n", pa.int64()), ("df", pa.int64())]),
            )

    return docs.select(*GROUP, "text").mapInArrow(run, "lang string, source string, term string, n long, df long")


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    over = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + 2 * terms).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); rates are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in (*GROUP, "text")])
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).repartition(shuffle_partitions(docs.sparkSession), "lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    postings = materialize(
        counted.withColumns({"lang_n": F.sum("n").over(by_term), "docs": F.sum("df").over(by_term)}).where(F.col("docs") >= min_docs).select(*GROUP, "term", "n", "lang_n"),
        "audit-postings",
    )
    # Sizes: a row a language, and a row a group.
    terms = postings.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    totals = postings.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = docs.select(*GROUP).distinct().join(totals, [*GROUP], "left").join(terms, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    zero = F.when(F.col("v") > 0, rate(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1)
    groups = materialize(groups.withColumn("zero", zero), "audit-groups")
    known = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "v", "lang_total", "zero")
    rated = join_small(postings, known, {"lang": "l", "source": "s"}).withColumn("p", rate(F.col("n"), F.col("total"), F.col("v")))
    rated = materialize(rated.select(*GROUP, "term", "n", "p", "zero", rate(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "audit-rated")
    drop(postings)

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"), F.col("v").alias("v_b"))
    both_zero = gap(F.col("zero"), F.col("zero_b"))
    constant = groups.join(other, "lang").where("source <> item").select(*GROUP, "item", (F.col("v") * both_zero).alias("value"))
    histogram = rated.groupBy(*GROUP, "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    priced = histogram.join(other, "lang").where("source <> item").withColumn("value", F.col("terms") * (gap(F.col("p"), F.col("zero_b")) - both_zero))
    one_sided = priced.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    a = rated.select(*GROUP, "term", "p", "zero")
    b = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("zero_b"))
    met = a.join(b, ["lang", "term"]).where("source < item")
    over = gap(F.col("p"), F.col("q")) - gap(F.col("p"), F.col("zero_b")) - gap(F.col("zero"), F.col("q")) + both_zero
    overlap = materialize(met.groupBy(*GROUP, "item").agg(F.sum(over).alias("value")), "audit-overlap")

    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    one_sided = materialize(one_sided, "audit-one-sided")
    parts = constant.unionAll(one_sided).unionAll(turned(one_sided)).unionAll(overlap).unionAll(turned(overlap))
    pairs = parts.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    telling = rated.where("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    shape = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionAll(shape(telling, "term"))
