"""Greedy decoding of many rows at once, a step of all unfinished rows at a time.

A step joins the rows that have not met their end symbol with the best symbol of their
context, a table of one row a context that is broadcast only if counted. Rows that
have ended are left alone. Every few steps the state is written and asked whether a row
is open still, so plans stay short and no step is done twice.

Defined results: of equal scores the symbol first in code-point order is best; a
context that no score speaks of ends the row; a row that has not ended after ``most``
steps stops there; a null or empty start ends at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.storage import materialize

#: Steps at most, as the recogniser takes them, and how many go into one plan.
MOST, STEPS_A_WRITE = 129, 8
#: Contexts up to which their table is broadcast.
BROADCAST_ROWS = 200_000
END = "$"


def transitions(words: DataFrame, context: int = 2, end: str = END) -> DataFrame:
    """(context, symbol, score): how often each character, or the end, follows each ``context`` characters in words (word, n)."""
    marked = words.select(F.concat("word", F.lit(end)).alias("w"), "n").where(F.length("w") > context)
    places = marked.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - context)).alias("i"))
    parts = places.select(F.substring("w", F.col("i"), F.lit(context)).alias("context"), F.substring("w", F.col("i") + context, F.lit(1)).alias("symbol"), "n")
    return parts.groupBy("context", "symbol").agg(F.sum("n").alias("score"))


def greedy(starts: DataFrame, scores: DataFrame, context: int = 2, end: str = END, most: int = MOST) -> DataFrame:
    """(row_id, text, steps, ended) of every start (row_id, text), the end symbol left off."""
    order = Window.partitionBy("context").orderBy(F.col("score").desc(), "symbol")
    best = materialize(scores.withColumn("r", F.row_number().over(order)).where("r = 1").select("context", "symbol"), "decode-best")
    table = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    state = starts.select("row_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("steps"), (F.coalesce("text", F.lit("")) == "").alias("ended"))
    for first in range(0, most, STEPS_A_WRITE):
        for _ in range(min(STEPS_A_WRITE, most - first)):
            met = state.withColumn("context", F.when(~F.col("ended"), F.right("text", F.lit(context)))).join(table, "context", "left")
            symbol = F.coalesce("symbol", F.lit(end))
            state = met.select(
                "row_id",
                F.when(F.col("ended") | (symbol == end), F.col("text")).otherwise(F.concat("text", symbol)).alias("text"),
                F.when(F.col("ended"), F.col("steps")).otherwise(F.col("steps") + 1).alias("steps"),
                (F.col("ended") | (symbol == end)).alias("ended"),
            )
        state = materialize(state, "decode-state")
        if not state.where("NOT ended").take(1):
            break
    return state
