"""The corpus pipeline: language ID, near-dedup, exact dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars. Each works on all rows its
predecessor kept, and its decisions take effect.

Defined results, of every stage: rows are told apart by all their columns, not by
doc_id, so rows with a null or repeated doc_id are documents of their own; null
and empty texts are documents without a word; texts count whole, however long;
extra columns are left behind, whatever their names; an empty table gives an
empty result. The stages say what else holds for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid, mixing, packing, simhash, suffix_dedup
from lamina.llm.common import drop, written
from lamina.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those without a letter among them; the others carry the predicted language.

    Rows without lang or doc_id are judged like others, but not learned from.
    """
    model = langid.train(docs)
    seen = langid.predict(docs, model, keep=("text", "source", "n_chars"))
    return seen.where("NOT rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the smallest doc_id, nulls last, and of equal ones the smaller hash of the row."""
    return simhash.near_unique(docs.select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which nothing is left go, empty ones stay.

    The first occurrence stays: that in the smallest doc_id, nulls last, and of equal ones in the smaller hash of the text.
    A null text becomes an empty one.
    """
    cut = suffix_dedup.removed_spans(docs, extra=("lang", "source"), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    return (
        cut.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
        .select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which is never where it has no word; equal rows differ by one copy at most."""
    return mixing.take(docs, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see packing.SCHEMA. Every row is packed, in the order it is read."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but mixing's sizes can be said in SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is dropped when the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        before, docs = docs, written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
        drop(before)
    return last(spark, docs, sf_dir)
