"""Term and vector scores by index against comparing everything, and how little the indexes compare."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import search
from lamina.queries import QUERIES
from lamina.storage import materialize

SF = "/root/testdata/sf0.001"


def words(text):
    return set((text or "").lower().split())


def all_scores(docs, queries, boost=1.0, share=lambda r: 0.0):
    """{query: {doc: score}} of every pair that shares a token."""
    held = [(r, words(r["text"])) for r in docs]
    df = Counter(t for _, w in held for t in w)
    n = len(held)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) / math.log(1 + (n - 0.5) / 1.5) for t, c in df.items()}
    return {q: [(sum(boost * idf[t] for t in w & words(text)) + share(r), r["doc_id"]) for r, w in held if w & words(text)] for q, text in queries}


def best_of(scores, k):
    out = set()
    for q, rows in scores.items():
        for place, (s, d) in enumerate(sorted(rows, key=lambda x: (-round(x[0], 9), x[1]))[:k], 1):
            out.add((q, d, round(s, 6), place))
    return out


@pytest.mark.parametrize("block", [4, 128])
@pytest.mark.parametrize("feature", [False, True])
def test_best_documents(spark, block, feature):
    """Ties, repeated ids, null texts and features, unknown tokens, fewer documents than k."""
    rng = np.random.default_rng(block)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    say = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    rows = [(i, say(int(rng.integers(0, 25))), int(rng.integers(0, 5000))) for i in range(300)]
    rows += [(3, rows[3][1], rows[3][2]), (400, None, 5), (401, "", 5), (402, say(9), None), (403, say(9), -7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    queries = [(i, say(6)) for i in range(12)] + [(50, "unknown words"), (51, None), (52, "w59 w59 W58")]
    index = search.TermIndex(docs, 3.0 * search.saturation(F.col("n_chars"), 2000.0) if feature else None, block)
    got = {(r["query_id"], r["doc_id"], round(r["score"], 6), r["place"]) for r in index.best(spark.createDataFrame(queries, "query_id long, query string"), 7, 1.5).collect()}
    share = lambda r: 3.0 * max(r["n_chars"] or 0, 0) / (max(r["n_chars"] or 0, 0) + 2000.0) if feature else 0.0
    asked = [(q, t) for q, t in queries if t]
    assert got == best_of(all_scores(docs.collect(), asked, 1.5, share), 7)


def test_few_pairs_are_scored(spark):
    """Less than a tenth of the pairs that share a token are scored in full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    queries = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = search.TermIndex(docs)
    terms = materialize(index.terms(queries), "test-terms")
    scored = index.candidates(terms, 10).count()
    pairs = terms.join(index.postings, "token").select("query_id", F.explode("found.place").alias("place")).distinct().count()
    assert 10 * scored < pairs, (scored, pairs)


def test_blocks_with_small_features_are_left_unread(spark):
    """With one token for all, only the blocks of the largest features can hold the best."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("n_chars"))
    index = search.TermIndex(docs, 10.0 * search.saturation(F.col("n_chars"), 4000.0))
    terms = materialize(index.terms(spark.createDataFrame([(1, "same")], "query_id long, query string")), "test-terms")
    assert index.candidates(terms, 5).count() <= 2 * search.BLOCK
    best = index.best(spark.createDataFrame([(1, "same")], "query_id long, query string"), 5).orderBy("place").collect()
    assert [r["doc_id"] for r in best] == [3999, 3998, 3997, 3996, 3995]


def moved(spark):
    """MB shuffled, spilled and written by all stages so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in (stages.apply(i) for i in range(stages.size()))) / 1e6


@pytest.mark.parametrize("name", ["x1_term_scores", "x4_rank_features"])
def test_postings_are_not_shuffled(spark, name):
    """What is shuffled, spilled and written stays below four times the table read."""
    path = "/root/testdata/sf0.01"
    before = moved(spark)
    assert len(QUERIES[name](spark, path).collect()) == 400
    assert moved(spark) - before < 4 * Path(f"{path}/documents.parquet").stat().st_size / 1e6


def test_passes_of_terms_and_small_blocks(spark, monkeypatch):
    """Many passes, blocks cut by their tokens and groups of copies give the same; a query's repeated rows are one query."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40, n))
    rows = [(i, say(int(rng.integers(0, 12))), i % 7) for i in range(120)] + [(200 + i, "w1 w2 w3", 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    asked = [(str(i), say(5)) for i in range(9)] + [("copies", "w1 w2 w3")]
    queries = spark.createDataFrame([*asked, asked[0]], "query_id string, query string")
    wanted = best_of(all_scores(docs.collect(), asked, 1.0, lambda r: r["n_chars"] / (r["n_chars"] + 2.0)), 5)
    monkeypatch.setattr(search, "TERMS_A_PASS", 20)
    monkeypatch.setattr(search, "TOKENS_A_BLOCK", 30)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 3)
    index = search.TermIndex(docs, search.saturation(F.col("n_chars"), 2.0))
    got = {(r["query_id"], r["doc_id"], round(r["score"], 6), r["place"]) for r in index.best(queries, 5).collect()}
    assert got == wanted


def test_index_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.TermIndex(docs).best(spark.createDataFrame([(1, "a")], "query_id long, query string")).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<double>")
    assert search.VectorIndex(none).nearest(asked).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert search.VectorIndex(one).nearest(asked.limit(0)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_vectors(spark, clustered):
    """Ties, copies, null and broken vectors; any number of centres gives the same, and clustered vectors are mostly left out."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(20, 8)) * 10
    m = (middle[rng.integers(0, 20, 2000)] if clustered else 0) + rng.normal(size=(2000, 8))
    m[5] = m[10] = m[50]
    m[60] = 3 * m[50]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8), (5004, [float("inf")] + [1.0] * 7), (5005, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    wanted = set()
    for q in range(0, 2000, 50):
        s = unit @ unit[q]
        for place, i in enumerate(np.lexsort((np.arange(2000), -np.round(s, 9)))[:10], 1):
            wanted.add((q, int(i), round(float(s[i]), 6), place))
    for centres in (None, 1, 7):
        asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        got = search.VectorIndex(vectors, centres).nearest(asked).collect()
        assert {(r["query_id"], r["vec_id"], round(r["score"], 6), r["place"]) for r in got} == wanted
        if clustered and centres is None:
            assert np.mean([r["compared"] for r in got]) < 400


def test_passes_of_queries(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda: {tuple(r)[:2] + (r["place"],) for r in search.VectorIndex(vectors).nearest(asked, 3).collect()}
    once = rows()
    monkeypatch.setattr(search, "QUERIES_A_PASS", 10)
    assert rows() == once
