"""File sources and sinks. Pixels stay opaque: decoding is an adapter that the caller passes in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import file_kind, safe_filename


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with its kind, without its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", "modificationTime", "length", name.alias("name"), file_kind(name).alias("kind"), safe_filename(name).alias("safe_name"))


def pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, page_no, output, content): page images, those of one file numbered; unreadable files are skipped.

    ``decode`` turns a file into its page images.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    images = decode(content)
                except ValueError:
                    continue
                stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(file, i, f"{stem}_{i}.jpg", image) for i, image in enumerate(images)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "output", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = file_kind(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(kind.isin("pdf", "visual")).select("path", "content").mapInPandas(run, "path string, page_no int, output string, content binary")


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines of each document below its own folder."""
    docs.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_markdown(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def read_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, blocked) of a correction memory; content of another shape counts as empty."""
    rule = "id: STRING, wrong: STRING, correct: STRING, blocked: BOOLEAN, seen_count: BIGINT, applied_count: BIGINT"
    text = spark.read.text(path, wholetext=True)
    shape = f"version INT, rules ARRAY<STRUCT<{rule}>>, blocked ARRAY<STRUCT<wrong: STRING, correct: STRING>>"
    both = text.select(F.from_json("value", shape).alias("m"))
    rules = both.select(F.posexplode("m.rules").alias("seq", "r")).select("seq", "r.*")
    return rules, both.select(F.explode("m.blocked").alias("b")).select("b.*")


def write_memory(rules: DataFrame, blocked: DataFrame, path: str, version: int = 1) -> None:
    """Save a correction memory as one JSON document, rules in order of seq; ``read_memory`` gives it back. It is one user's, so it fits a row."""
    fields = [c for c in rules.columns if c != "seq"]
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("r")))).alias("all")).select(F.transform("all", lambda x: x["r"]).alias("rules"))
    pairs = blocked.agg(F.array_sort(F.collect_list(F.struct("wrong", "correct"))).alias("blocked"))
    whole = listed.crossJoin(pairs).select(F.to_json(F.struct(F.lit(version).alias("version"), "rules", "blocked")).alias("value"))  # one row each
    whole.write.mode("overwrite").text(path)
