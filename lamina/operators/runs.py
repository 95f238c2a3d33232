"""Python steps over runs of sorted rows, for rules whose steps depend on the ones before.

Rows are dealt by key and sorted once; each task then reads its groups one after
another from Arrow batches of many groups, so a group costs no call of its own. A
task holds one group, which is a page, a table or a document's worth of boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame


def by_runs(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], step: Callable[[list[dict]], list[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """What ``step`` makes of each group's rows (in order), as rows of ``schema``."""
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(rows_of(batches), key=lambda r: tuple(r[k] for k in keys)):
            out += step(list(group))
            if len(out) >= 10_000:
                yield table(out)
                out = []
        yield table(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
