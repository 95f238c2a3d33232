"""The thin queries over the synthetic tables; each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.suffix_dedup import removed_spans

    return removed_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.langid import held_out
    from lamina.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.warc import read_records, write_bundles

    return read_records(write_bundles(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack, op2_suffix_dedup, op3_mix_sources, op4_simhash, op5_shard, op6_toxicity, op7_top_k, op8_language_id, op9_warc, op10_quality_rules,
        op11_license_scan, op12_source_audit, op13_resample,
    )
}

#: The other queries rest on hashes, models, schedules or fixpoints that SQL cannot say; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_top_k": """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) x WHERE place <= 5""",
    "op9_warc": """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND last <> page_id THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages) p""",
    "op12_source_audit": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
lang_n AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY w.lang, w.source, w.term),
group_n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n,
  1 + CAST(1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (n.total + 2 * l.v) AS BIGINT) AS p,
  1 + CAST(1000000000 * (CAST(kept.n AS HUGEINT) + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM group_n n JOIN kept ON n.lang = kept.lang JOIN lang_n l ON n.lang = l.lang LEFT JOIN c ON n.lang = c.lang AND n.source = c.source AND kept.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON a.lang = f.lang AND a.source = f.source AND b.source = f.item),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= 10""",
}
