"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Features are runs of 1 to ``LONGEST`` words. The dictionary counts every distinct
feature string over the whole corpus and hashes it once; counts are summed by
bucket, buckets of the corpus and of the target give each bucket a gain, and gains
go back to the documents through the dictionary: each feature of each document
learns its bucket from there.

Text stays where it is. Documents are written once as a table bucketed by block,
blocks being parts of the partitions that are read. A block sends each of its
distinct features once, with its count, to one of ``parts`` of the dictionary, chosen
by a hash of the words; so a frequent word, pair or passage sends one entry a block,
however often it occurs, and no part grows with a hot one. Features travel sorted,
as word numbers less what they share with the one before, in compressed cells that
bring their own words, a cell a block and part. A part holds
about ``PART_BYTES`` of text's worth: their number grows with the input, their sizes
do not. Back goes the bucket of each entry, in the order it came, and the block reads
its documents again next to them; a count that differs raises.

The draw adds Gumbel noise, a hash of the doc_id, to the weights and takes the
highest scores. Ranks come from a sort by ranges, so no task sees them all. What
reaches the driver is a number a bucket and a row a sorted range.

Defined results: null and empty texts, and texts without a word, have no features,
weight 0 and a score from the noise alone; a null doc_id takes its noise from
``42:null`` and ranks after others at ties; rows that repeat a doc_id have the same
noise and are drawn one by one, as many as fit; a text of fewer words than a run is
long has none of that length; texts of any length count whole (a block holds one at
least); with no target every bucket has t = 0; an empty table gives an empty result;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import math
import time
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, join_small, materialize, new_path, shuffle_partitions
from lamina.llm.tokens import LETTERS_AND_DIGITS, words

LONGEST = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK_BYTES = 16 << 20
PART_BYTES = 10 << 20
#: The dictionary is made a share of its parts after another, so that what is shuffled at once is as much less.
ROUNDS = 2
PACKED_BITS = 63 // LONGEST

CELLS = "kind int, blk long, part long, payload binary"


class Features:
    """The distinct features of one block of texts: per length a matrix of word numbers, in order of part and words, and with ``places`` which each run of words is."""

    def __init__(self, texts: pa.ChunkedArray, parts: int, places: bool):
        ids, self.names, self.text = words(texts, LETTERS_AND_DIGITS)
        ids = ids.astype(np.int32)
        own = np.fromiter(map(zlib.crc32, self.names.to_numpy(zero_copy_only=False)), np.uint64, len(self.names))
        self.rows: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        #: Where the features of each part begin, and the end.
        self.cuts: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        number, before = ids, np.empty((0, 0), np.int32)
        packed = not places and len(self.names) < 1 << PACKED_BITS
        for k in range(LONGEST):
            inside = self.text[k:] == self.text[: len(self.text) - k] if k else np.ones(len(ids), bool)
            # A run is the run before it, by number, and one word more.
            key = number[: len(inside)].astype(np.uint64) << np.uint64(32) | ids[k:].astype(np.uint64) if k else ids.astype(np.uint64)
            if packed:  # all numbers of a run fit one key, which a sort without places does
                key = ids[: len(inside)].astype(np.uint64)
                for j in range(1, k + 1):
                    key = key << np.uint64(PACKED_BITS) | ids[j : len(inside) + j].astype(np.uint64)
                unique, counts = np.unique(key[inside], return_counts=True)
                mask = np.uint64((1 << PACKED_BITS) - 1)
                rows = np.column_stack([(unique >> np.uint64(PACKED_BITS * (k - j)) & mask).astype(np.int32) for j in range(k + 1)])
            else:
                unique, inverse, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
                last = (unique & np.uint64(0xFFFFFFFF)).astype(np.int32)
                rows = np.column_stack([before[(unique >> np.uint64(32)).astype(np.int64)], last]) if k else last[:, None]
                before = rows
            if k < LONGEST - 1 and not packed:
                number = np.zeros(len(key), np.int32)
                number[inside] = inverse
            h = np.full(len(rows), k, np.uint64)
            for column in rows.T:
                h = (h ^ own[column]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            part = (h >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            self.cuts.append(np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)))
            self.rows.append(rows[order])
            self.n.append(counts[order])
            if places:
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                self.at.append(np.flatnonzero(inside).astype(np.int32))
                self.of.append(rank[inverse])

    def cells(self, turn: int, rounds: int) -> Iterator[tuple[int, bytes]]:
        """(part, payload) of the block, of the parts of one round."""
        pack = zstandard.ZstdCompressor(3)
        ended = pc.binary_join_element_wise(self.names, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
        for part in range(turn, len(self.cuts[0]) - 1, rounds):
            own = [slice(cuts[part], cuts[part + 1]) for cuts in self.cuts]
            if any(x.stop > x.start for x in own):
                yield part, pack.compress(_encode([rows[x] for rows, x in zip(self.rows, own, strict=True)], [n[x] for n, x in zip(self.n, own, strict=True)], ended))

    def sums(self, buckets: dict[int, np.ndarray], gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its features and the sum of their gains; ``buckets`` has those of each part, as its cell was ordered."""
        gain = [np.zeros(len(r), np.int64) for r in self.rows]
        for part in range(len(self.cuts[0]) - 1):
            sizes = np.cumsum([0, *(cuts[part + 1] - cuts[part] for cuts in self.cuts)])
            found = buckets.get(part, np.empty(0, np.int64))
            if len(found) != sizes[-1]:
                raise RuntimeError(f"part {part} gives {len(found)} buckets to {sizes[-1]} features")
            for g, cuts, i, j in zip(gain, self.cuts, sizes, sizes[1:], strict=False):
                g[cuts[part] : cuts[part + 1]] = gains[found[i:j]]
        count, weight = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for g, at, of in zip(gain, self.at, self.of, strict=True):
            bounds = np.searchsorted(self.text[at], np.arange(texts + 1))  # texts ascend
            upto = np.concatenate([[0], np.cumsum(g[of])])
            count += np.diff(bounds)
            weight += upto[bounds[1:]] - upto[bounds[:-1]]
        return count, weight


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, all low bytes first, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _encode(rows: list[np.ndarray], counts: list[np.ndarray], ended: pa.Array) -> bytes:
    """A cell: its words in order, each with a space after it; then per length how many features, their counts, how many leading words each shares with the one before, and the other words by number in the cell, the first of them as a step from the one above."""
    every = np.concatenate([r.ravel() for r in rows])
    if 8 * len(every) > len(ended):
        used = np.zeros(len(ended), bool)
        used[every] = True
        vocabulary, number = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1
        local = [number[r] for r in rows]
    else:
        vocabulary, inverse = np.unique(every, return_inverse=True)
        ends = np.cumsum([r.size for r in rows])
        local = [x.reshape(r.shape) for x, r in zip(np.split(inverse.astype(np.int32), ends[:-1]), rows, strict=True)]
    words_ = ended.take(pa.array(vocabulary))
    text = _text(words_)
    out = [np.array([len(text)], "<i8").tobytes(), text]
    for r, n in zip(local, counts, strict=True):
        same = np.zeros(r.shape, bool)
        same[1:] = r[1:] == r[:-1]
        lead = same.cumprod(1, dtype=np.uint8).sum(1, dtype=np.uint8)
        # A count beyond 32 bits is sent as two halves.
        out += [np.array([len(r)], "<i8").tobytes(), lead.tobytes(), _planes(n & 0xFFFFFFFF), _planes(n >> 32)]
        for c in range(r.shape[1]):
            step = np.diff(r[:, c], prepend=0)[lead == c]
            out += [_planes(step), _planes(r[:, c][lead < c])]
    return b"".join(out)


def _text(words_: pa.Array) -> bytes:
    """All bytes of a binary array."""
    if not len(words_):
        return b""
    offsets = np.frombuffer(words_.buffers()[1], np.int64)
    return bytes(memoryview(words_.buffers()[2])[int(offsets[words_.offset]) : int(offsets[words_.offset + len(words_)])])


def _decode(data: bytes) -> list[tuple[pa.Array, np.ndarray]]:
    """Per length the features of a cell, words joined by spaces, and their counts."""
    at = 0

    def numbers(n: int) -> np.ndarray:
        nonlocal at
        at += 4 * n
        return _unplanes(data[at - 4 * n : at])

    def size() -> int:
        nonlocal at
        at += 8
        return int(np.frombuffer(data, "<i8", 1, at - 8)[0])

    text = np.frombuffer(data, np.uint8, size(), at)
    at += len(text)
    ends = np.flatnonzero(text == 32)
    offsets = np.zeros(2 * len(ends) + 1, np.int64)  # words and the spaces between, in turn
    offsets[1::2], offsets[2::2] = ends, ends + 1
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text.tobytes())])
    vocabulary = every.take(pa.array(np.arange(0, 2 * len(ends), 2)))
    out = []
    for k in range(1, LONGEST + 1):
        n = size()
        lead = np.frombuffer(data, np.uint8, n, at)
        at += n
        counts = numbers(n) | numbers(n) << 32
        columns = []
        for c in range(k):
            x = np.zeros(n, np.int64)
            fresh = lead < c
            step = lead == c
            x[step] = numbers(int(step.sum()))
            x[fresh] = numbers(int(fresh.sum()))
            upto = np.cumsum(x)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            columns.append(vocabulary.take(pa.array(upto - (upto[begin] - x[begin]))) if n else vocabulary[:0])
        out.append((pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if k > 1 else columns[0], counts))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["kind", "blk", "part", "payload"])


def _look_up(cells: pa.Table) -> pa.Table:
    """One part of the dictionary: distinct strings are counted and hashed once. Back go the buckets of each cell, and the part's count by bucket."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
    part = cells.column("part")[0].as_py()
    decoded = [_decode(unpack.decompress(p)) for p in cells.column("payload").to_pylist()]
    total = np.zeros(BUCKETS, np.int64)
    back: list[list[np.ndarray]] = [[] for _ in decoded]
    for k in range(LONGEST):
        strings = pa.chunked_array([d[k][0] for d in decoded], pa.large_binary()).combine_chunks().dictionary_encode()
        codes = strings.indices.to_numpy(zero_copy_only=False)
        bucket = np.empty(len(strings.dictionary), np.int64)
        for i in range(0, len(bucket), 1 << 17):  # bounded lists
            some = strings.dictionary[i : i + (1 << 17)]
            bucket[i : i + (1 << 17)] = np.fromiter(map(zlib.crc32, some.to_numpy(zero_copy_only=False)), np.int64, len(some)) % BUCKETS
        counts = np.concatenate([d[k][1] for d in decoded])
        for half, low in ((counts & 0xFFFFFFFF, 0), (counts >> 32, 32)):  # sums of halves are exact as doubles
            total += np.bincount(bucket[codes], half, BUCKETS).astype(np.int64) << low
        for own, found in zip(back, np.split(bucket[codes], np.cumsum([len(d[k][1]) for d in decoded])[:-1]), strict=True):
            own.append(found)
    rows = [(0, blk, part, pack.compress(_planes(np.concatenate(own)))) for blk, own in zip(cells.column("blk").to_pylist(), back, strict=True)]
    out = _table([*rows, (1, -1, part, pack.compress(total.astype("<i8").tobytes()))])
    del decoded, back, strings, codes, counts
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest group took
    return out


def _forget(spark: SparkSession) -> None:
    """Shuffle files go with their plans; without this they stay until the driver is short of memory. The second call meets what the first one let go of."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _totals(answers: DataFrame) -> np.ndarray:
    """Count by bucket over all parts; ``BUCKETS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for p in b.column("payload").to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(p), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    summed = answers.where("kind = 1").select("payload").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in summed:
        out[r["bucket"]] = r["n"]
    return out


class Dictionary:
    """The texts of ``docs`` as blocks, and the answers of the dictionary to each."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data__"))
        size = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("data__")).alias("bytes")).agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
        total, each = size["total"] or 0, (size["most"] or 0) // BLOCK_BYTES + 1
        files = max(shuffle_partitions(spark), total // (2 * BLOCK_BYTES))
        self.parts = parts = int(max(1, total // PART_BYTES, shuffle_partitions(spark) if total > 8 * PART_BYTES else 1))
        # Dealt by place, not by content, so that copies spread; blocks stay in the partition that was read.
        rows = rows.withColumn("blk", F.spark_partition_id().cast("long") * each + F.pmod(F.monotonically_increasing_id(), F.lit(each)))
        name = f"lamina_features_{uuid.uuid4().hex}"
        rows.write.bucketBy(files, "blk").sortBy("blk").option("path", new_path(spark, name, name)).option("compression", "zstd").saveAsTable(name)
        self.table = spark.table(name)

        rounds = min(ROUNDS, parts)

        def answers(turn: int) -> DataFrame:
            def send(block: pa.Table) -> pa.Table:
                blk = block.column("blk")[0].as_py()
                out = _table([(0, blk, part, payload) for part, payload in Features(block.column("data__"), parts, False).cells(turn, rounds)])
                pa.default_memory_pool().release_unused()
                return out

            return materialize(self.table.groupBy("blk").applyInArrow(send, CELLS).groupBy("part").applyInArrow(_look_up, CELLS), "features-answers")

        self.made = []
        for i in range(rounds):
            self.made.append(answers(i))
            _forget(spark)
        self.answers = reduce(DataFrame.unionAll, self.made)
        self.totals = _totals(self.answers)

    def weights(self, gains: np.ndarray) -> DataFrame:
        """(doc_id, n_words, n_features, weight) of every row."""
        shared, parts = self.table.sparkSession.sparkContext.broadcast(gains), self.parts  # BUCKETS numbers

        def run(block: pa.Table, cells: pa.Table) -> pa.Table:
            unpack = zstandard.ZstdDecompressor()
            features = Features(block.column("data__"), parts, True)
            found = {p: _unplanes(unpack.decompress(x)) for p, x in zip(cells.column("part").to_pylist(), cells.column("payload").to_pylist(), strict=True)}
            count, weight = features.sums(found, shared.value, block.num_rows)
            n_words = np.bincount(features.text, minlength=block.num_rows)
            del features, found
            pa.default_memory_pool().release_unused()
            return pa.table([block.column("doc_id"), pa.array(n_words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

        answers = self.answers.where("kind = 0")
        return self.table.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, "doc_id long, n_words long, n_features long, weight long")

    def close(self) -> None:
        drop(*self.made)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + len(corpus))) / ((a + 1) * (t + len(corpus))))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, n_words, more) with rank: 1, 2, 3 ... of the ``percent`` highest scores among texts of ``MIN_WORDS`` words."""
    spark = scored.sparkSession
    scored = scored.withColumn("row__", F.monotonically_increasing_id())
    pool = F.col("n_words") >= MIN_WORDS
    order = [F.when(pool, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row__")]
    dealt = scored.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}), "resample-dealt")
    starts = dealt.groupBy("part__").agg(F.count(F.lit(1)).alias("n"), F.min("at__").alias("least"), F.count_if(pool).alias("pool"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = starts.select("part__", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least") + 1).alias("shift"), F.sum("pool").over(Window.partitionBy()).alias("pool"))
    ranked = join_small(dealt, materialize(starts.withColumnRenamed("part__", "p"), "resample-starts"), {"part__": "p"})
    place = F.col("at__") + F.col("shift")
    drawn_ = pool & (place <= F.floor(F.col("pool") * percent / 100))
    return ranked.withColumn("rank", F.when(drawn_, place)).drop("row__", "part__", "at__", "shift", "pool")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has the texts to resemble."""
    corpus = Dictionary(docs)
    wanted = Dictionary(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    weighed = corpus.weights(gains(corpus.totals, wanted.totals))
    wanted.close()
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(label.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "resample-scored")
    corpus.close()
    return drawn(scored, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
