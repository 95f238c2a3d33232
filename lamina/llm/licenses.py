"""License texts and notices found by diagonal voting (DataFrame functions only).

Templates are known texts. Their rolling word k-grams are hashed, and all k-gram
hashes of every document are joined to the template positions that share them. A
copy of a template puts all its matches on one diagonal (place in the document less
place in the template), so matches are counted by diagonal. Words put in or left
out shift the rest to a near diagonal: neighbouring diagonals, at most ``GAP``
apart, are merged to one candidate. Candidates are then verified on the words
themselves: a template word counts if the document has it on one of the candidate's
diagonals. Its similarity is the words that count over the template's words or the
span's, whichever are more; below ``MIN_SIMILARITY`` it falls. Of spans that overlap, that with
the most words stands, so a license is not taken for one that it contains. Hashes only
propose.

Texts are read once: a row keeps its counts, and its text only if one of its k-grams
is a template's. What is broadcast are template positions (their number is checked
against ``BROADCAST_ROWS``), nothing that grows with the texts. A document is known by
two hashes of its text; equal texts are brought together, vote once and are judged
alike, so copies cost one verification, and spans go back to them by a shuffled join
(hinted: small files of spans are large in memory, where Spark would broadcast them).

Labels are those of the phrases found (``PHRASES``, exact places of consecutive words)
and those of the verified templates. The score is the similarity of the best
verified template, and ``PHRASE_SCORE`` at least where a phrase is found, which may be
a mere mention; 0 where there is neither.

Defined results: null and empty texts, and texts without a word, have no places,
labels '' and score 0; words of any length and texts of any length count whole; a
template shorter than k words never votes; overlapping places all count; repeated
rows are judged alike; an empty table gives an empty result; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import BROADCAST_ROWS, materialize

K = 3
#: Diagonals so near each other are one candidate; so many words may be put in or left out at once.
GAP = 3
MIN_SIMILARITY = 0.9
PHRASE_SCORE = 0.5
#: Up to so many template k-grams are looked up while texts are read; beyond, every text is kept for the vote.
LISTED_GRAMS = 20_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases that are counted exactly, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts and notices by which licenses are given, under their SPDX identifiers in lower case.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words(text: Column) -> Column:
    """Letters, digits and all beyond ASCII; only A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    """The hash of every run of ``k`` words, in order."""
    last = F.size(w) - k
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(last >= 0, hashed)


def _places(w: Column, phrase: str, label: str) -> Column:
    """(at, label) of each place of one phrase: looked up backwards from where its last word stands."""
    *before, last = phrase.split()
    ends = F.filter(F.transform(w, lambda x, i: F.when(x == last, i)), lambda i: i.isNotNull())

    def stands(i: Column) -> Column:
        ok = i >= len(before)
        for j, word in enumerate(reversed(before), 1):
            ok = ok & (F.get(w, i - j) == word)
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter(ends, stands), lambda i: F.struct((i - len(before)).cast("long").alias("at"), F.lit(label).alias("label")))


def _starts(w: Column, phrases: dict[str, str]) -> Column:
    """(at, label) of each place of a phrase."""
    return F.concat(*[_places(w, phrase, label) for phrase, label in phrases.items()])


def _held(w: Column, spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> Column:
    """Whether one of the k-grams of ``w`` is a template's: texts without have no candidate."""
    _, grams = positions(spark, templates, k)
    listed = [r["gram"] for r in grams.select("gram").distinct().limit(LISTED_GRAMS + 1).collect()]
    if len(listed) > LISTED_GRAMS:
        return F.lit(True)
    return F.coalesce(F.exists(_grams(w, k), lambda g: g.isin(listed)), F.lit(False)) if listed else F.lit(False)


def positions(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> tuple[DataFrame, DataFrame]:
    """(template, label, tw) and (gram, template, tpos), the templates' words and all their k-grams."""
    table = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    table = table.select("template", "label", words(F.col("text")).alias("tw"))
    grams = table.select("template", F.posexplode(_grams(F.col("tw"), k)).alias("tpos", "gram"))
    return table, grams


def candidates(texts: DataFrame, spark: SparkSession, templates: list[tuple[str, str]], k: int = K, gap: int = GAP) -> DataFrame:
    """(k1, k2, template, diagonals, votes): merged diagonals of ``texts`` (k1, k2, w)."""
    _, grams = positions(spark, templates, k)
    n = grams.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"{n} template positions; at most {BROADCAST_ROWS} can be joined")
    rolled = texts.select("k1", "k2", F.posexplode(_grams(F.col("w"), k)).alias("pos", "gram"))
    votes = rolled.join(F.broadcast(grams), "gram").groupBy("k1", "k2", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.countDistinct("tpos").alias("votes"))
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True)).cast("int")
    numbered = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("k1", "k2", "template", "run").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.sum("votes").alias("votes"))


def verified(texts: DataFrame, found: DataFrame, templates: list[tuple[str, str]], min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(k1, k2, label, hits, wanted, first_place, last_place, similarity) of the candidates whose words agree; ``texts`` are one row a text."""
    table, _ = positions(texts.sparkSession, templates)
    kept = texts.join(found.hint("merge"), ["k1", "k2"]).join(F.broadcast(table), "template")
    same = lambda d, j: (d + j >= 0) & F.coalesce(F.get("w", d + j) == F.get("tw", j), F.lit(False))
    at = F.transform(F.sequence(F.lit(0), F.size("tw") - 1), lambda j: F.array_min(F.filter("diagonals", lambda d: same(d, j))) + j)
    matched = kept.withColumn("at", F.filter(at, lambda x: x.isNotNull())).where(F.size("at") > 0)
    ranged = matched.select("k1", "k2", "label", F.size("at").alias("hits"), F.size("tw").alias("wanted"), F.array_min("at").cast("long").alias("first_place"), F.array_max("at").cast("long").alias("last_place"))
    return ranged.withColumn("similarity", F.col("hits") / F.greatest(F.col("wanted"), F.col("last_place") - F.col("first_place") + 1)).where(F.col("similarity") >= min_similarity)


def _best(spans: Column) -> Column:
    """Of spans (hits, similarity, label, first_place, last_place) that overlap the one with more words, then more similarity, then the later label."""
    meets = lambda x, y: (x["first_place"] <= y["last_place"]) & (y["first_place"] <= x["last_place"])
    return F.filter(spans, lambda x: ~F.exists(spans, lambda y: (y > x) & meets(x, y)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (hits, similarity, label, first_place, last_place)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    keyed = docs.select("doc_id", F.col("text").alias("t"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("license"), "text").alias("k2"), words(F.col("text")).alias("w"))
    base = keyed.select(
        "doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), _starts(F.col("w"), phrases).alias("places"), "t", _held(F.col("w"), docs.sparkSession, templates).alias("held")
    )
    base = materialize(base.withColumn("t", F.when(F.col("held"), F.col("t"))), "license-base")
    texts = materialize(base.where("held").select("k1", "k2", "t").dropDuplicates(["k1", "k2"]), "license-texts").select("k1", "k2", words(F.col("t")).alias("w"))
    found = materialize(candidates(texts, docs.sparkSession, templates), "license-candidates")
    spans = verified(texts, found, templates).groupBy("k1", "k2")
    spans = spans.agg(F.sort_array(F.collect_set(F.struct("hits", "similarity", "label", "first_place", "last_place"))).alias("spans"))
    spans = materialize(spans.withColumn("spans", _best(F.col("spans"))), "license-spans")
    rows = base.drop("t")
    none_held = rows.where("NOT held").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    all_ = rows.where("held").join(spans.hint("merge"), ["k1", "k2"], "left").unionByName(none_held)
    label = lambda c: F.transform(c, lambda x: x["label"])
    none = F.array().cast("array<string>")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["similarity"])), F.lit(0.0))
    return all_.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["at"])).alias("last_word"),
        listed(label(F.col("places"))).alias("base_labels"),
        listed(F.concat(label(F.col("places")), F.coalesce(label(F.col("spans")), none))).alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<hits:int,similarity:double,label:string,first_place:bigint,last_place:bigint>>")).alias("spans"),
    )
