"""Exact removal of repeated passages by a distributed difference-cover algorithm.

A byte goes if it lies in a ``LENGTH``-byte string that also starts earlier.
Suffixes need to be told apart by their first ``LENGTH`` bytes only, which
bounds the recursion, and only repeated ones matter, so unique names are
discarded as soon as they are known to be unique:

1. Suffixes at places congruent to the difference cover ``COVER`` modulo ``V``
   are sampled. For any two places one shift below ``V`` samples both, so two
   equal strings share a sampled tuple of ``TUPLE = LENGTH - V + 1`` bytes.
   Tuples are sorted by fingerprint; those that occur once get no name.
2. The remaining sampled suffixes are sorted by name and place; neighbours of
   one name are compared and each learns the place of its tuple before its own.
3. Names of sampled suffixes that follow one another are read together, as the
   recursion does: where the places before follow one another at the same
   distances, the tuples join into one longer match, and all strings inside it
   are settled without being sorted.
4. The remaining suffixes (those with a named sample within ``V`` that no such
   chain settles) are merged: sorted by their ``LENGTH``-byte prefix, unique
   ones discarded first as in 1, and adjacent prefixes compared as in 2. A
   settled string has an earlier equal one, the first of which is never
   settled, so comparing the remaining suffixes among themselves is enough.

Text stays where it is: documents are written once as a table bucketed by
block, and every pass reads a block next to what the sorts say about it.
Between blocks and sorts go packed arrays, deduplicated per block, so that a
passage of a thousand copies sends at most two entries per block. A block holds
about ``BLOCK_BYTES`` of text and a sort ``SORT_ENTRIES`` entries: their numbers
grow with the input, their sizes do not.

Two departures from the textbook, both since only equality of ``LENGTH``-byte
prefixes is asked for, not their order. Names are hashes, not ranks: a sort by
hash puts equal strings side by side, and adjacent ones are compared by 126 bits,
a 64-bit polynomial and two modulo the prime ``PRIME`` with random bases. For any
two given strings the latter two agree by chance with probability below 2**-48,
and strings that nobody made to collide with about 2**-126; bytes themselves are
not sent. And the recursion has one level: tuples of ``TUPLE`` bytes and the
distances between them already decide prefixes of ``LENGTH`` bytes.

Defined results: null and short texts (below ``LENGTH`` bytes) lose nothing; a
null doc_id counts as larger than any other; rows that repeat a doc_id, or have
none, are ordered by a hash of their texts, so of equal rows all but one lose
their repeated bytes; texts of any length count whole (a block holds one at
least); an empty table gives an empty result; other columns are ignored, and
those named as ``extra`` may have any name but those of the results.
"""

from __future__ import annotations

import gc
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, join_small, lean, materialize, new_path, shuffle_partitions

LENGTH = 100
V = 31
COVER = (0, 1, 3, 8, 12, 18)  # fixed values: a perfect difference set modulo 31
TUPLE = LENGTH - V + 1  # at least V: of two matching texts one sample in V places may be all they share
BLOCK_BYTES = 4 << 20
#: Bits of a fingerprint that the filter sorts in one bucket; more would only save false alarms.
FILTER_BITS = 26
SORT_ENTRIES = 2_000_000
SEGMENT = 1 << 18
NO_ID = np.iinfo(np.int64).max
#: Instead of an ord: no place before, and no other place.
FIRST, ALONE = (np.iinfo(np.int64).min + i for i in (0, 1))
PRIME = (1 << 31) - 1

ROWS = "kind int, blk long, bucket long, payload binary"


class Rolling:
    """Polynomial fingerprints of byte strings, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 62, 1 << 63)) | 1
        n = SEGMENT + LENGTH + 1
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
        self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))])

    def at(self, data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the ``length`` bytes at each of the sorted ``places``."""
        out = np.empty(len(places), np.uint64)
        cuts = np.searchsorted(places, np.arange(0, len(data) + SEGMENT, SEGMENT))
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i == j:
                continue
            part = data[k * SEGMENT : (k + 1) * SEGMENT + length]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[part] * self.power[: len(part)])])
            p = places[i:j] - k * SEGMENT
            out[i:j] = (sums[p + length] - sums[p]) * self.inverse[p]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out


class PrimeRolling:
    """Pairs of polynomial fingerprints modulo ``PRIME``, as one number."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        n = SEGMENT + LENGTH + 1
        self.parts = []
        for _ in range(2):
            base = int(rng.integers(1 << 20, PRIME - 1))
            self.parts.append((rng.integers(1, PRIME, 256, dtype=np.int64), self._powers(base, n), self._powers(pow(base, -1, PRIME), n)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) < n:  # each round doubles what is known
            out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
        return out[:n]

    def at(self, data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Of the ``length`` bytes at each of the sorted ``places``."""
        out = np.zeros(len(places), np.int64)
        cuts = np.searchsorted(places, np.arange(0, len(data) + SEGMENT, SEGMENT))
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i == j:
                continue
            part = data[k * SEGMENT : (k + 1) * SEGMENT + length]
            p = places[i:j] - k * SEGMENT
            for table, power, inverse in self.parts:
                sums = np.concatenate([[0], np.cumsum(table[part] * power[: len(part)] % PRIME)])
                out[i:j] = out[i:j] << 31 | (sums[p + length] - sums[p]) % PRIME * inverse[p] % PRIME
        return out


@lru_cache(1)
def _prime_rolling() -> PrimeRolling:
    return PrimeRolling(3)


@lru_cache(2)
def _rolling(seed: int) -> Rolling:
    return Rolling(seed)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Block:
    """The documents of one block, in order, as one run of bytes."""

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by("ord__")
        self.docs = docs
        self.ord = docs.column("ord__").to_numpy()
        texts = docs.column("data__").to_pylist()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size

    def _inside(self, keep: np.ndarray, length: int) -> np.ndarray:
        """Which places begin a string of ``length`` inside their document."""
        doc = np.searchsorted(self.start, keep, side="right") - 1
        return keep + length <= self.start[doc] + self.size[doc]

    def samples(self) -> np.ndarray:
        n = np.maximum(self.size - TUPLE + 1, 0)
        number = np.arange(len(COVER) * (-(-int(n.max()) // V) if len(n) else 0))
        offsets = number // len(COVER) * V + np.array(COVER)[number % len(COVER)]
        return np.concatenate([s + offsets[: np.searchsorted(offsets, k)] for s, k in zip(self.start, n, strict=True)] or [np.empty(0, np.int64)])

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.start, at, side="right") - 1
        # Empty documents share their start with the next one; the last of them is meant.
        return self.ord[doc], at - self.start[doc]


def _encode(values: np.ndarray) -> bytes:
    """Sorted values below 2**FILTER_BITS: how many share each high part, then their low 16 bits."""
    counts = np.bincount(values >> np.uint32(16), minlength=1 << (FILTER_BITS - 16))
    return counts.astype("<u4").tobytes() + (values & np.uint32(0xFFFF)).astype("<u2").tobytes()


def _decode(data: bytes) -> np.ndarray:
    slots = 1 << (FILTER_BITS - 16)
    counts = np.frombuffer(data, "<u4", slots)
    return np.repeat(np.arange(slots, dtype=np.uint32) << np.uint32(16), counts) | np.frombuffer(data, "<u2", offset=4 * slots)


class Sent:
    """Entries of a block that go to the sorts, grouped by bucket and deduplicated."""

    def __init__(self, block: Block, places: np.ndarray, length: int, buckets: int):
        self.block, self.places, self.length = block, places, length
        h = _rolling(1).at(block.data, places, length)
        self.bucket = _buckets(h, buckets)
        self.low = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.uint32)

    def filter_rows(self) -> list[tuple]:
        """(bucket, payload): the distinct low bits, those met twice sent twice."""
        return [(b, _encode(np.repeat(v, np.minimum(n, 2)))) for b, v, n, _ in self._distinct()]

    def _distinct(self):
        key = self.bucket << np.uint64(32) | self.low
        values, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(np.diff(values >> np.uint64(32))) + 1
        cuts = [0, *cuts.tolist(), len(values)]
        self.inverse = inverse
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield int(values[i] >> np.uint64(32)), values[i:j].astype(np.uint32), counts[i:j], (i, j)

    def repeated(self, flags: dict[int, bytes]) -> np.ndarray:
        """Which entries the filter found repeated; ``flags`` holds a bitmap per bucket."""
        marks = [np.unpackbits(np.frombuffer(flags[b], np.uint8), count=j - i) for b, _, _, (i, j) in self._distinct()]
        return np.concatenate(marks)[self.inverse].astype(bool) if marks else np.zeros(0, bool)

    def group_rows(self, keep: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray, list, np.ndarray]:
        """Rows of distinct (name, first place in the block), how they map back to entries, and the entry before of the same name."""
        at = self.places[keep]
        if not len(at):
            return [], at, np.empty(0, np.int64), [], np.empty(0, np.int64)
        name = _rolling(2).at(self.block.data, at, self.length).view(np.int64)
        prime = _prime_rolling().at(self.block.data, at, self.length)
        bucket = self.bucket[keep]
        order = np.lexsort((prime, name, bucket))  # stable, so the first of a name is the earliest in the block
        differs = lambda x: x[order][1:] != x[order][:-1]
        new = np.concatenate([[True], differs(prime) | differs(name) | differs(bucket)])
        first = order[new]
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        before = np.empty(len(at), np.int64)
        before[order] = np.where(new, -1, np.concatenate([[-1], order[:-1]]))
        ord_, place = self.block.place(at[first])
        fb, fn, fp = bucket[first], name[first], prime[first]
        twice = np.bincount(number) > 1
        cuts = [0, *(np.flatnonzero(np.diff(fb)) + 1).tolist(), len(fb)]
        rows = [(int(fb[i]), np.stack([fn[i:j], fp[i:j], ord_[i:j], place[i:j] << 1 | twice[i:j]]).astype("<i8").tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        return rows, at, number, [(int(fb[i]), i, j) for i, j in zip(cuts, cuts[1:], strict=False)], before


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["kind", "blk", "bucket", "payload"])


def _find_repeated(rows: pa.Table) -> pa.Table:
    """Sort one bucket's low bits; back to each block goes which of its distinct ones occur twice or more."""
    blks, bucket = rows.column("blk").to_pylist(), rows.column("bucket")[0].as_py()
    parts = [_decode(p) for p in rows.column("payload").to_pylist()]
    everything = np.sort(np.concatenate(parts))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for blk, p in zip(blks, parts, strict=True):
        own = p[np.concatenate([[True], p[1:] != p[:-1]])]
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        flags = twice[at] == own if len(twice) else np.zeros(len(own), bool)
        out.append((0, blk, bucket, np.packbits(flags).tobytes()))
    return _table(out)


def _sorted(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """One bucket's (both parts of the name, ord, place and met twice), their order, and which names begin and which occur once."""
    parts = [np.frombuffer(p, "<i8").reshape(4, -1) for p in rows.column("payload").to_pylist()]
    name, prime, ord_, place = np.concatenate(parts, 1)
    order = np.lexsort((place, ord_, prime, name))
    new = np.concatenate([[True], (np.diff(name[order]) != 0) | (np.diff(prime[order]) != 0)])
    alone = new & np.append(new[1:], True) & ~(place[order] & 1).astype(bool)
    return parts, order, new, alone


def _back(rows: pa.Table, parts: list[np.ndarray], pack) -> pa.Table:
    """To each block, what ``pack`` makes of its stretch of entries."""
    ends = np.cumsum([p.shape[1] for p in parts]).tolist()
    bucket = rows.column("bucket")[0].as_py()
    return _table([(0, blk, bucket, pack(i, j)) for blk, i, j in zip(rows.column("blk").to_pylist(), [0, *ends], ends, strict=False)])


def _find_before(rows: pa.Table) -> pa.Table:
    """Sort one bucket by (name, place) and compare neighbours; each entry learns the place before it of its name.

    Back go (ord, place) per entry; ord is FIRST where there is none before, and ALONE where the name occurs once.
    """
    parts, order, new, alone = _sorted(rows)
    _, _, ord_, place = np.concatenate(parts, 1)
    before = np.concatenate([[0], order[:-1]])
    back = np.empty((2, len(order)), np.int64)
    back[0, order] = np.where(alone, ALONE, np.where(new, FIRST, ord_[before]))
    back[1, order] = np.where(new, 0, place[before] >> 1)
    return _back(rows, parts, lambda i, j: back[:, i:j].astype("<i8").tobytes())


def _find_later(rows: pa.Table) -> pa.Table:
    """Sort as before; back goes one bit per entry: whether its name has an earlier place."""
    parts, order, new, _ = _sorted(rows)
    later = np.empty(len(order), bool)
    later[order] = ~new
    return _back(rows, parts, lambda i, j: np.packbits(later[i:j]).tobytes())


def _before(block: Block, side: dict[int, bytes], grouped: tuple) -> np.ndarray:
    """(2, entries): ord and place of the occurrence before each entry, inside the block or elsewhere."""
    _, at, number, where, before = grouped
    if not where:
        return np.empty((2, 0), np.int64)
    out = np.concatenate([np.frombuffer(side[b], "<i8").reshape(2, -1) for b, _, _ in where], 1)[:, number]
    inside = before >= 0
    out[0, inside], out[1, inside] = block.place(at[before[inside]])
    return out


def _later(side: dict[int, bytes], grouped: tuple) -> np.ndarray:
    _, _, number, where, before = grouped
    if not where:
        return np.empty(0, bool)
    bits = np.concatenate([np.unpackbits(np.frombuffer(side[b], np.uint8), count=j - i) for b, i, j in where])
    return bits[number].astype(bool) | (before >= 0)


def _runs(flags: np.ndarray) -> np.ndarray:
    """(n, 2) beginnings and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def _cover(n: int, spans: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, spans[:, 0], 1)
    np.add.at(d, spans[:, 1], -1)
    return np.cumsum(d[:-1]) > 0


def _settle(block: Block, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(settled, remaining) string beginnings of a block, as flags per byte, from its named samples."""
    n = len(block.data)
    named = before[0] != ALONE
    at, before = at[named], before[:, named]
    settled = np.zeros(n, bool)
    later = before[0] != FIRST
    s, o = at[later], before[0, later]
    if len(s):
        shift = before[1, later] - block.place(s)[1]
        doc = np.searchsorted(block.start, s, side="right") - 1
        breaks = (np.diff(s) > TUPLE) | (np.diff(shift) != 0) | (np.diff(o) != 0) | (np.diff(doc) != 0)
        cut = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(s)]])
        lo, hi = s[cut[:-1]], s[cut[1:] - 1] + TUPLE - LENGTH + 1  # beginnings in [lo, hi)
        ok = hi > lo
        settled = _cover(n, np.stack([lo[ok], hi[ok]], 1))
    near = np.zeros(n, bool)
    if len(at):
        doc = np.searchsorted(block.start, at, side="right") - 1
        near = _cover(n, np.stack([np.maximum(at - V + 1, block.start[doc]), at + 1], 1))
        places = np.flatnonzero(near)
        near[places[~block._inside(places, LENGTH)]] = False
    return settled, near & ~settled


def _side(rows: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: p for k, b, p in zip(rows.column("kind").to_pylist(), rows.column("bucket").to_pylist(), rows.column("payload").to_pylist(), strict=True) if k == kind}


def _shrink(text: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The marked bytes less those of characters that are marked in part."""
    number = np.cumsum((text & 0xC0) != 0x80)
    partly = np.bincount(number[~mark], minlength=int(number[-1]) + 1)[number] > 0 if len(text) else mark
    return mark & ~partly


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ord__, their rank by doc_id (nulls last), a hash of the text, and place in the input; sorted by ranges, so no id's rows meet in one task."""
    rows = materialize(rows.withColumn("row__", F.monotonically_increasing_id()), "suffix-rows")
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row__")]
    narrow = rows.select("doc_id", F.xxhash64("data__").alias("h"), "row__")
    dealt = narrow.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("row__", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "suffix-ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    starts = materialize(starts.select(F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")), "suffix-starts")
    ranks = join_small(dealt, starts, {"part": "p"}).select("row__", (F.col("at") + F.col("shift")).alias("ord__"))
    return materialize(rows.join(ranks, "row__").drop("row__"), "suffix-rows")


def removed_spans(docs: DataFrame, extra: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, ``extra``, n_bytes, spans (array of removed [start, end)), kept (the other bytes) of every row.

    With ``whole_characters`` the ends of removed runs shrink to character
    boundaries, so that what is left is UTF-8 again.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kinds, own = dict(docs.select(*extra).dtypes), [f"extra_{i}__" for i in range(len(extra))]
    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).alias(o) for c, o in zip(extra, own, strict=True)], data.alias("data__"))
    stats = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if stats["ids"] + min(stats["nulls"], 1) == stats["rows"]:
        rows = rows.withColumn("ord__", F.coalesce("doc_id", F.lit(int(NO_ID))))
    else:
        rows = ranked(rows)
    # Blocks are parts of the partitions that are read, so the text is not shuffled; written, they stay as they are.
    size = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("data__")).alias("bytes")).agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    total, each = size["total"] or 0, (size["most"] or 0) // BLOCK_BYTES + 1
    files = max(shuffle_partitions(spark), total // (4 * BLOCK_BYTES))
    sorts = max(1, total * len(COVER) // V // SORT_ENTRIES, shuffle_partitions(spark) if total > 64 * BLOCK_BYTES else 1)
    rows = rows.withColumn("blk", F.spark_partition_id().cast("long") * each + F.pmod(F.xxhash64("ord__"), F.lit(each)))
    name = f"lamina_suffix_{uuid.uuid4().hex}"
    rows.write.bucketBy(files, "blk").sortBy("blk").option("path", new_path(spark, name, name)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)

    def gone() -> None:
        # Shuffle files of passes that are over go with their plans; without this they stay until the driver is short of memory.
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def sorted_by_bucket(df: DataFrame, f) -> DataFrame:
        return df.groupBy("bucket").applyInArrow(lean(f), ROWS)

    def beside(side: DataFrame, f) -> DataFrame:
        return table.groupBy("blk").cogroup(side.groupBy("blk")).applyInArrow(lean(f), ROWS)

    gone()

    def sample(docs: pa.Table) -> pa.Table:
        blk = docs.column("blk")[0].as_py()
        block = Block(docs)
        return _table([(0, blk, b, p) for b, p in Sent(block, block.samples(), TUPLE, sorts).filter_rows()])

    named = materialize(sorted_by_bucket(table.groupBy("blk").applyInArrow(lean(sample), ROWS), _find_repeated), "suffix-named")
    gone()

    def send_named(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows or not side.num_rows:
            return _table([])
        block = Block(docs)
        sent = Sent(block, block.samples(), TUPLE, sorts)
        return _table([(0, docs.column("blk")[0].as_py(), b, p) for b, p in sent.group_rows(sent.repeated(_side(side, 0)))[0]])

    first = materialize(sorted_by_bucket(beside(named, send_named), _find_before), "suffix-first")
    gone()
    both = named.unionByName(first.withColumn("kind", F.lit(1)))

    def remaining(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows or not side.num_rows:
            return _table([])
        block, blk = Block(docs), docs.column("blk")[0].as_py()
        sent = Sent(block, block.samples(), TUPLE, sorts)
        grouped = sent.group_rows(sent.repeated(_side(side, 0)))
        settled, rest = _settle(block, grouped[1], _before(block, _side(side, 1), grouped))
        out = [(2, blk, 0, _runs(settled).astype("<i8").tobytes()), (3, blk, 0, _runs(rest).astype("<i8").tobytes())]
        return _table(out + [(0, blk, b, p) for b, p in Sent(block, np.flatnonzero(rest), LENGTH, sorts).filter_rows()])

    left = materialize(beside(both, remaining), "suffix-left")
    drop(named, first)
    gone()
    runs = left.where("kind > 0")
    again = materialize(sorted_by_bucket(left.where("kind = 0"), _find_repeated), "suffix-again").unionByName(runs)
    gone()

    def rest_of(docs: pa.Table, side: pa.Table) -> tuple[Block, np.ndarray, tuple]:
        block = Block(docs)
        flags = lambda k: _cover(len(block.data), np.frombuffer(_side(side, k).get(0, b""), "<i8").reshape(-1, 2))
        sent = Sent(block, np.flatnonzero(flags(3)), LENGTH, sorts)
        return block, flags(2), sent.group_rows(sent.repeated(_side(side, 0)))

    def send_rest(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows or not side.num_rows:
            return _table([])
        return _table([(0, docs.column("blk")[0].as_py(), b, p) for b, p in rest_of(docs, side)[2][0]])

    merged = materialize(sorted_by_bucket(beside(again, send_rest), _find_later), "suffix-merged")
    gone()
    final = again.unionByName(merged.withColumn("kind", F.lit(1)))

    schema = "doc_id long, " + "".join(f"`{c}` {kinds[c]}, " for c in extra) + "n_bytes long, spans array<array<long>>, kept binary"

    def cut(docs: pa.Table, side: pa.Table) -> pa.Table:
        begins, spans, kept = np.zeros(0, bool), [], []
        if docs.num_rows and side.num_rows:
            block, begins, grouped = rest_of(docs, side)
            begins[grouped[1][_later(_side(side, 1), grouped)]] = True
        else:
            block = Block(docs)
            begins = np.zeros(len(block.data), bool)
        runs = _runs(begins)
        removed = _cover(len(begins), np.stack([runs[:, 0], runs[:, 1] + LENGTH - 1], 1)) if len(runs) else begins
        for s, n in zip(block.start.tolist(), block.size.tolist(), strict=True):
            text, mark = block.data[s : s + n], removed[s : s + n]
            if whole_characters and mark.any():
                mark = _shrink(text, mark)
            spans.append(_runs(mark).tolist())
            kept.append(text[~mark].tobytes())
        names = ["doc_id", *extra]
        return pa.table([*(block.docs.column(c) for c in ["doc_id", *own]), pa.array(block.size), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    return table.groupBy("blk").cogroup(final.groupBy("blk")).applyInArrow(lean(cut), schema)
