"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and kept in blocks of rows. In a block each
dimension is shifted to start at 0 and cut to its ``SLICE_BITS`` highest bits,
and every bit is one bitmap over the block's rows. The index is written once,
from the rows as they are read: nothing is shuffled for it.

A query's score of all rows of a block is built by bitmap arithmetic alone: each
non-zero signed digit of a query component adds the dimension's slices, shifted
(complemented where the digit is negative), through carry-save adders. The rows
that can be among the best are selected from the most significant slice
downward: the value of the k-th row, less the widest error of the cut bits,
bounds them, and so does the k-th score that the task has met in its blocks
before. Those boundary rows are resolved with exact integers.

Queries go to the blocks, not blocks to queries: they are broadcast in chunks of
``CHUNK_BYTES``, and each chunk is one pass over the index, so neither the
driver nor a worker holds more than one chunk. Per task and query ``k`` rows are
passed on.

Defined results: vectors that are null or hold null or non-finite components take
no part; shorter vectors, and empty ones, count as padded with 0; components of
any finite size are exact: where products could leave 64 bits the block is scored
with unbounded integers, and only the reported score is cut to the range of a
long, not the rank; repeated rows are rows of their own, and only the query's own
row is left out; ties go to the smaller vec_id; a null vec_id is no query and
sorts last among ties; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import drop, materialize

SLICE_BITS = 6
ROWS = 32768
SCALE = 256.0
#: Bytes of query vectors in one broadcast.
CHUNK_BYTES = 32 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Quantised components up to this are kept as 64-bit integers.
PLAIN = 1 << 40


def _naf(n: int) -> list[tuple[int, int]]:
    """(place, sign) of the non-adjacent form of a positive number."""
    out, place = [], 0
    while n:
        if n & 1:
            d = 2 - (n & 3)
            out.append((place, d))
            n -= d
        n >>= 1
        place += 1
    return out


def exact(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as unbounded integers."""
    out = np.empty(x.shape, object)
    for i, v in np.ndenumerate(x):
        out[i] = (lambda n, d: n * 256 // d)(*float(v).as_integer_ratio())
    return out


def sort_key(n: int) -> str:
    """A text that sorts as the number does."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + "".join(chr(105 - ord(c)) for c in digits)  # 105: the codes of 0 and 9 added


class BitSlicedBlock:
    """The index of one block of rows; ``values`` is (rows, dims) of int64. ``slices`` come from the written index or are built."""

    def __init__(self, values: np.ndarray, stored: tuple[np.ndarray, np.ndarray] | None = None):
        self.values = values
        self.n, self.dims = values.shape
        self.low = values.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        self.all = self._pack(np.ones(self.n, bool))
        if stored is None:
            span = values - self.low
            top = span.max(axis=0) if self.n else span.sum(axis=0)
            bits = np.array([int(x).bit_length() for x in top], np.int64)
            stored = bits, np.concatenate([self._pack((span[:, d] >> (max(0, b - SLICE_BITS) + i)) & 1) for d, b in enumerate(bits.tolist()) for i in range(min(b, SLICE_BITS))] or [np.empty(0, np.uint64)])
        self.bits, flat = stored
        self.cut = [max(0, b - SLICE_BITS) for b in self.bits.tolist()]
        self.slices, at, size = [], 0, len(self.all)
        for b in self.bits.tolist():
            k = min(b, SLICE_BITS)
            self.slices.append([flat[at + i * size : at + (i + 1) * size] for i in range(k)])
            at += k * size
        self.flat = flat

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags.astype(bool), bitorder="little")
        return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """(slices, base, error): a row's score is base plus the value of its slices, least first, plus 0 to error."""
        columns: list[list[np.ndarray]] = []
        base, error = sum(int(q) * int(x) for q, x in zip(query, self.low, strict=False)), 0
        for d, q in enumerate(query[: self.dims].tolist()):
            if not q or not self.slices[d]:
                continue
            lost = abs(q) * ((1 << self.cut[d]) - 1)
            error += lost
            base -= lost if q < 0 else 0
            for place, digit in _naf(abs(q)):
                negative = (digit < 0) != (q < 0)
                for i, bitmap in enumerate(self.slices[d]):
                    at = place + self.cut[d] + i
                    while len(columns) <= at:
                        columns.append([])
                    columns[at].append(bitmap ^ self.all if negative else bitmap)
                    base -= (1 << at) if negative else 0
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            while len(column) > 1:
                carry = None
                if len(column) > 2:
                    a, b, c = column.pop(), column.pop(), column.pop()
                    x = a ^ b
                    carry = (a & b) | (x & c)
                    column.insert(0, x ^ c)
                else:
                    a, b = column.pop(), column.pop()
                    carry = a & b
                    column.append(a ^ b)
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1].append(carry)
            out.append(column[0] if column else np.zeros_like(self.all))
            at += 1
        return out, base, error

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.n))

    def candidates(self, query: np.ndarray, k: int, known: int | None = None) -> np.ndarray:
        """Rows that may be among the k best of the block and, if ``known`` is given, score at least that."""
        if self.n <= k and known is None:
            return np.arange(self.n)
        slices, base, error = self.score_slices(query)
        sure, open_, value = np.zeros_like(self.all), self.all, 0
        for i in range(len(slices) - 1, -1, -1):  # most significant first
            both = open_ & slices[i]
            if int(np.bitwise_count(sure | both).sum()) >= k:
                open_ = both
                value |= 1 << i
            else:
                sure = sure | both
                open_ = open_ & ~slices[i]
        least = max(0, value - error) if self.n > k else 0
        if known is not None:
            least = max(least, known - base - error)
        if least >> len(slices):
            return np.empty(0, np.int64)
        more, equal = np.zeros_like(self.all), self.all
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                more = more | (equal & slices[i])
                equal = equal & ~slices[i]
        return self._rows(more | equal)


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def _usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return embedding.isNotNull() & fine


def _matrix(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """Lists of doubles as rows, padded with 0."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dims = int(lens.max()) if dims is None and len(lens) else dims or 0
    m = np.zeros((len(lens), dims))
    m[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return m


def _plain(x: np.ndarray) -> bool:
    return not x.size or float(np.abs(x).max()) * SCALE <= PLAIN


INDEX = "dims long, rids binary, ids array<long>, m binary, bits binary, slices binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``ROWS`` rows, as they come. Rows with a component too large for slices are blocks of their own, so they leave the others to the bitmaps."""
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
    waiting = {True: 0, False: 0}

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = _matrix(rows.column("v").combine_chunks())
        bits, flat = np.empty(0, np.int64), np.empty(0, np.uint64)
        if _plain(x):
            made = BitSlicedBlock(np.floor(x * SCALE).astype(np.int64))
            bits, flat = made.bits, made.flat
        out = [
            pa.array([x.shape[1]], pa.int64()), pa.array([rows.column("rid").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([bits.astype("<i8").tobytes()], pa.binary()), pa.array([flat.astype("<u8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in INDEX.split(", ")])

    for b in batches:
        fits = (np.abs(_matrix(b.column("v"))).max(1, initial=0.0) * SCALE <= PLAIN) if b.num_rows else np.empty(0, bool)
        for kind in (True, False):
            part = b.filter(pa.array(fits == kind)) if len(fits) else b
            if part.num_rows:
                held[kind].append(part)
                waiting[kind] += part.num_rows
            while waiting[kind] >= ROWS:
                table = pa.Table.from_batches(held[kind])
                yield block(table.slice(0, ROWS))
                held[kind], waiting[kind] = table.slice(ROWS).to_batches(), waiting[kind] - ROWS
    for kind in (True, False):
        if waiting[kind]:
            yield block(pa.Table.from_batches(held[kind]))


def _pick(every: int):
    """The rows of the index whose vec_id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = [i for i, x in enumerate(r["ids"]) if x is not None and x % every == 0]
                x = np.frombuffer(r["m"], "<f8").reshape(len(r["ids"]), r["dims"])[at]
                out = [pa.array([r["ids"][i] for i in at], pa.int64()), pa.array(np.frombuffer(r["rids"], "<i8")[at]), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "rid", "v"])

    return run


def _search(k: int, shared):
    """Per task, the k best rows of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_rids, q = shared.value
        largest = np.abs(q).max(axis=1, initial=0.0) * SCALE
        small = largest <= PLAIN
        whole = np.floor(np.where(small[:, None], q, 0) * SCALE).astype(np.int64)
        best: list[list[tuple]] = [[] for _ in q_ids]  # (-score, no id, id), sorted

        for b in batches:
            for r in b.to_pylist():
                rids, dims = np.frombuffer(r["rids"], "<i8"), r["dims"]
                x = np.frombuffer(r["m"], "<f8").reshape(len(rids), dims)
                plain = _plain(x)
                index = wide = None
                if plain:
                    index = BitSlicedBlock(np.floor(x * SCALE).astype(np.int64), (np.frombuffer(r["bits"], "<i8"), np.frombuffer(r["slices"], "<u8")))
                    most = float(np.abs(x).max(initial=0.0)) * SCALE + 1
                for i, qrid in enumerate(q_rids.tolist()):
                    if plain and small[i] and (largest[i] + 1) * most * max(dims, 1) < 2.0**62:
                        v = np.zeros(dims, np.int64)
                        v[: min(dims, whole.shape[1])] = whole[i][:dims]
                        known = -best[i][-1][0] if len(best[i]) == k else None
                        at = index.candidates(v, k + 1, known)
                        at = at[rids[at] != qrid]
                        scores = (index.values[at] @ v).tolist()
                    else:
                        wide = exact(x) if wide is None else wide
                        v = exact(q[i][:dims])
                        at = np.flatnonzero(rids != qrid)
                        scores = [sum((a * c for a, c in zip(row, v, strict=False)), 0) for row in wide[at]]
                    found = [(-s, r["ids"][j] is None, r["ids"][j] or 0) for s, j in zip(scores, at.tolist(), strict=True)]
                    best[i] = sorted(best[i] + found)[:k]
        rows = [(qid, qrid, None if no else vid, min(max(-s, LEAST), MOST), sort_key(-s)) for qid, qrid, found in zip(q_ids.tolist(), q_rids.tolist(), best, strict=True) for s, no, vid in found]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "q_rid", "vec_id", "score", "key"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("rid"))
    index = materialize(rows.mapInArrow(_build, INDEX), "topk-index")
    queries = materialize(index.select("dims", "rids", "ids", "m").mapInArrow(_pick(every), "vec_id long, rid long, v array<double>"), "topk-queries")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    chunks = max(1, -(-(size["n"] * max(size["dims"] or 1, 1) * 8) // CHUNK_BYTES))
    found = None
    for c in range(chunks):
        part = queries.where(F.pmod(F.xxhash64("rid"), F.lit(chunks)) == c).toArrow()  # about CHUNK_BYTES
        vectors_ = _matrix(part.column("v").combine_chunks(), size["dims"] or 0)
        shared = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), part.column("rid").to_numpy(), vectors_))
        done = materialize(index.mapInArrow(_search(k, shared), "query_id long, q_rid long, vec_id long, score long, key string"), "topk-found")
        shared.destroy()
        found = done if found is None else found.unionAll(done)
    drop(index, queries)
    order = Window.partitionBy("query_id", "q_rid").orderBy(F.col("key").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
