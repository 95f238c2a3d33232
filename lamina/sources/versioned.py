"""A keyed table of Parquet files with atomic versions, for records that are rewritten while others read and write.

A version is one small file in ``log``: the data files it adds, with their least and
greatest keys, and those it takes away. It is created under the next number only if
that is free, so a commit is there wholly or not at all, and of two writers one gets
the number. The other looks at what has come in between: if that took away a file
that its own work rests on, the work is done again, else it is committed under the
next number; pauses grow from try to try.

Files part the keys into ranges. ``upsert`` deals the new rows to the ranges they fall
in, reads and rewrites the files that are hit, and leaves all others as they are; so
it costs what it hits. A file that grows beyond ``FILE_ROWS`` is parted. The last of
equal keys wins, by ``seq`` where rows have it; columns named as kept come from the
row before. Readers see the version they began with; ``vacuum`` deletes data files
that no version from a given one on uses.

Lists of files, a row a file with two keys, are collected by the driver and sent to
tasks; rows are not.

Defined results: rows with a null key are refused; an empty table has no file; a new
key before all others goes to the first file; an upsert of no rows commits nothing;
columns that new rows lack become null, more columns are refused.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_ROWS = 1_000_000
#: Tries of a commit, and the first pause; each is twice the one before, and a part of it by chance.
TRIES, PAUSE_S = 12, 0.05


class Conflict(Exception):
    """The number of a version is taken."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.key, self.file_rows = spark, path.rstrip("/"), key, file_rows
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    # ---- the log

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def files(self, version: int | None = None) -> list[dict[str, Any]]:
        """The data files of a version (the last, if none is given), by their least keys."""
        upto = [v for v in self.versions() if version is None or v <= version]
        if not upto:
            return []
        rows = self.spark.read.text([self._name(v) for v in upto], wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
        here: dict[str, dict[str, Any]] = {}
        for _, value in sorted((r["f"].rpartition("/")[2], r["value"]) for r in rows):
            done = json.loads(value)
            for name in done["remove"]:
                del here[name]
            here |= {f["path"]: f for f in done["add"]}
        return sorted(here.values(), key=lambda f: f["low"])

    def _name(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _create(self, version: int, add: list[dict[str, Any]], remove: list[str]) -> None:
        """Make a version's file, whole and only if it is not there."""
        text = json.dumps({"add": add, "remove": remove}, ensure_ascii=False)
        fs, draft = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._name(version)
        try:
            if fs.getScheme() == "file":  # a local rename replaces; a link does not
                import os

                local = lambda p: unquote(urlparse(p).path)
                try:
                    os.link(local(draft.toString()), local(final))
                except FileExistsError as e:
                    raise Conflict(version) from e
            elif fs.exists(self._fs(final)[1]) or not fs.rename(draft, self._fs(final)[1]):
                raise Conflict(version)
        finally:
            fs.delete(draft, False)

    def _commit(self, work: Callable[[list[dict[str, Any]]], tuple[list[dict[str, Any]], list[str]] | None]) -> int:
        """Do ``work`` on the files of the last version until what it gives is committed; the version's number, the last one's if there is nothing to commit."""
        done, seen = None, 0
        for i in range(TRIES):
            last = (self.versions() or [0])[-1]
            if done is not None and last > seen:
                now = {f["path"] for f in self.files(last)}
                alone = not done[0] or not self._overlap(done[0], self.files(last), set(done[1]))
                if not now.issuperset(done[1]) or not alone:
                    done = None  # what it rests on has changed
            if done is None:
                done = work(self.files(last))
                if done is None:
                    return last
            seen = last
            try:
                self._create(last + 1, *done)
                return last + 1
            except Conflict:
                time.sleep(PAUSE_S * 2**i * (1 + random.random()))
        raise RuntimeError(f"no version could be committed in {TRIES} tries")

    @staticmethod
    def _overlap(add: list[dict[str, Any]], files: list[dict[str, Any]], gone: set[str]) -> bool:
        """Whether an added file's keys reach into a file that stays; ranges stay apart."""
        kept = [f for f in files if f["path"] not in gone]
        return any(a["low"] <= f["high"] and f["low"] <= a["high"] for a in add for f in kept)

    # ---- the data

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows([f["path"] for f in self.files(version)])

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _write(self, rows: DataFrame, at: list[str]) -> list[dict[str, Any]]:
        """Write rows as files of ``file_rows`` at most, one or more for each value of the columns ``at``; what was written."""
        folder = uuid.uuid4().hex
        inside = Window.partitionBy(*at).orderBy(self.key)
        parted = rows.withColumn("part__", F.floor((F.row_number().over(inside) - 1) / self.file_rows))
        parted.write.partitionBy(*at, "part__").parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").select(self.key, "_metadata.file_path")
        made = written.groupBy("file_path").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(F.lit(1)).alias("rows")).collect()  # a row a file
        name = lambda p: unquote(p).partition(f"/data/{folder}/")[2]
        return [{"path": f"{folder}/{name(r['file_path'])}", "low": r["low"], "high": r["high"], "rows": r["rows"]} for r in made]

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> int:
        """Insert ``rows``, or replace those of their keys but for the columns ``keep``; the version made."""
        if more := set(rows.columns) - {*self.columns, "seq"}:
            raise ValueError(f"unknown columns: {sorted(more)}")
        order = [F.col("seq").desc()] if "seq" in rows.columns and "seq" not in self.columns else []
        if rows.where(F.col(self.key).isNull()).take(1):
            raise ValueError("a key is null")
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t.dataType).alias(c) for c, t in zip(self.columns, self.schema, strict=True)], *[F.col("seq").alias("seq__") for _ in order])
        if order:
            newest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.col("seq__").desc()))
            full = full.withColumn("n__", newest).where("n__ = 1").drop("n__", "seq__")
        else:
            full = full.dropDuplicates([self.key])

        def work(files: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], list[str]] | None:
            if not files:
                add = self._write(self._first(full), ["target__"])
                return (add, []) if add else None
            dealt = self._dealt(full, [f["low"] for f in files])
            hit = sorted(r["target__"] for r in dealt.select("target__").distinct().collect())  # a row a file
            if not hit:
                return None
            names = [files[t]["path"] for t in hit]
            old = self._dealt(self._rows(names), [f["low"] for f in files])
            before = old.select(self.key, *[F.col(c).alias(f"{c}__old") for c in keep])
            merged = dealt.join(before, self.key, "left").select(*[F.coalesce(f"{c}__old", c).alias(c) if c in keep else F.col(c) for c in self.columns], "target__")
            rest = old.join(dealt.select(self.key), self.key, "left_anti")
            return self._write(rest.unionByName(merged), ["target__"]), names

        return self._commit(work)

    def _first(self, rows: DataFrame) -> DataFrame:
        """A first dealing into ranges: sorted by key, a range a task."""
        n = rows.count()
        dealt = rows.repartitionByRange(max(1, -(-n // self.file_rows)), self.key)
        return dealt.withColumn("target__", F.spark_partition_id())

    def _dealt(self, rows: DataFrame, lows: list[Any]) -> DataFrame:
        """``rows`` with target__, the number of the file in whose range their key falls."""
        shared, key = self.spark.sparkContext.broadcast(lows), self.key  # a key a file

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [max(bisect_right(shared.value, k) - 1, 0) for k in b.column(key).to_pylist()]
                yield b.append_column("target__", pa.array(at, pa.int32()))

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{types}, target__ int")

    def vacuum(self, since: int) -> int:
        """Delete data files that no version from ``since`` on uses; how many. Writers at work must have ended."""
        used = {f["path"] for v in self.versions() if v >= since for f in self.files(v)}
        fs, at = self._fs(f"{self.path}/data")
        found, gone = fs.listFiles(at, True), 0
        while found.hasNext():
            path = found.next().getPath()
            name = path.toUri().getPath().partition("/data/")[2]
            if name.endswith(".parquet") and name not in used:
                gone += bool(fs.delete(path, False))
        return gone
