"""An extension: the text operators over a stream of recognised lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.functions.text import risk_categories

SCHEMA = "page_id bigint, seq bigint, text string, score double"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def risks(lines: DataFrame) -> DataFrame:
    return lines.select("page_id", "seq", F.explode(risk_categories(F.col("text"))).alias("category"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append risks of each batch of files once, then end."""
    return risks(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
