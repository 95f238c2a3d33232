"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a
word of the perfect binary Golay code's space of 23 bits. A word's keys are the
codewords at distance 4 or less: one, or six where the nearest is at distance
3, since the nearest and the five at distance 4 then cover every bit exactly
once. Two words that differ in at most two bits share a key.

Fingerprints that differ in at most four bits have either a segment without
errors, and then another one with at most two (key: that segment, and a
codeword of the other), or one or two errors in every segment (key: a codeword
of each). So no link is lost. Fingerprints with a key in common meet in one
bucket, where differing bits are counted and only a spanning forest is passed
on: its links connect what the bucket's true links connect, and no bucket emits
its pairs. A key of more than ``LARGE`` fingerprints is cut into blocks, and every
two blocks meet in a task of their own. Equal fingerprints are one node
throughout, so a group of copies is one entry a key; entries have 16 bytes.

Defined results: null and empty texts, and texts without words, have the
fingerprint zero; texts of fewer words than a shingle are one shingle, and longer
ones count whole, however long; a null doc_id counts as larger than any other for
component_id, which is null where no member has an id; repeated rows share a
component; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialize, shuffle_partitions
from lamina.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101  # fixed value: x^11+x^10+x^6+x^5+x^4+x^2+1, of the Golay code (23, 12)
#: Keys of one bucket in memory, about.
BUCKET_KEYS = 1_000_000
#: Fingerprints of one key that are compared in one task, about.
LARGE = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - shingle])]
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :], strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[i : i + (1 << 16)], ">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for i in range(22, 10, -1):
        v = v ^ (((v >> i) & 1) * (GENERATOR << (i - 11)))
    return v


@lru_cache(1)
def _errors() -> np.ndarray:
    """For each syndrome, up to six error patterns of weight 4 or less; -1 where there are fewer."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, p in zip(_syndrome(patterns).tolist(), patterns.tolist(), strict=True):
            found[s].append(p)
    return np.array([x + [-1] * (6 - len(x)) for x in found], np.int64)


def codewords(v: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords at distance 4 or less; -1 where there are fewer."""
    e = _errors()[_syndrome(v)]
    return np.where(e < 0, -1, (v.astype(np.int64)[:, None] ^ e) >> 11)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): every key of every fingerprint, and the fingerprint's place in ``fps``."""
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [codewords(x) for x in seg]
    place = np.arange(len(fps))
    keys, places = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        for k in range(6):
            ok = near[j][:, k] >= 0
            keys.append(tag << 40 | seg[i][ok] << 12 | near[j][ok, k])
            places.append(place[ok])
    for a, b, c in product(range(6), repeat=3):
        ok = (near[0][:, a] >= 0) & (near[1][:, b] >= 0) & (near[2][:, c] >= 0)
        keys.append(6 << 40 | near[0][ok, a] << 24 | near[1][ok, b] << 12 | near[2][ok, c])
        places.append(place[ok])
    return np.concatenate(keys), np.concatenate(places)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (root, member) of a spanning forest of the links at ``max_bits`` or fewer differing bits."""
    left, out = fps, []
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(root, x) for x in found]
                todo += list(found)
    return out


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``nodes`` (fp) as all true links do."""
    spark = nodes.sparkSession
    n = nodes.count()
    buckets = max(shuffle_partitions(spark), n * 182 // BUCKET_KEYS + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 8192):
                part = fps[i : i + 8192]
                keys, places = golay_keys(part)
                bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, values, bucket = keys[order], part[places[order]], bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                rows = [(int(bucket[x]), keys[x:y].astype("<i8").tobytes(), values[x:y].astype("<u8").tobytes()) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["bucket", "keys", "fps"],
                )

    def meet(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, fps = keys[order], fps[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(new, len(keys)))
        two = new[size == 2]
        ok = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits
        found = [np.stack([fps[two], fps[two + 1]], 1)[ok]]
        some = (size > 2) & (size <= LARGE)
        for i, m in zip(new[some].tolist(), size[some].tolist(), strict=True):
            if pairs := forest(fps[i : i + m], max_bits):
                found.append(np.array(pairs, np.uint64))
        pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
        many = np.repeat(size > LARGE, size)
        out = [
            pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(keys[many])]),
            pa.array(np.concatenate([pairs[:, 0], fps[many].view(np.int64)])),
            pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(int(many.sum()), pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(out, names=["key", "a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, fps = None, [], []

        def flush() -> pa.RecordBatch:
            return meet(np.concatenate(keys), np.concatenate(fps))

        for b in batches:
            for bucket, k, f in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("fps"), strict=True):
                if bucket != at and keys:
                    yield flush()
                    keys, fps = [], []
                at = bucket
                keys.append(np.frombuffer(k.as_buffer(), "<i8"))
                fps.append(np.frombuffer(f.as_buffer(), "<u8"))
        if keys:
            yield flush()

    dealt = nodes.select("fp").mapInArrow(spread, "bucket long, keys binary, fps binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = materialize(dealt.mapInArrow(verify, "key long, a long, b long"), "simhash-met")
    return met.where("key IS NULL").select("a", "b").unionAll(block_links(met.where("key IS NOT NULL").select("key", "a"), max_bits)).distinct()


def block_links(members: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the fingerprints of each large key as all their true links do; ``members`` is (key, a)."""
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LARGE).alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks")))
    cells = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def run(table: pa.Table) -> pa.Table:
        pairs = np.array(forest(table.column("a").to_numpy().view(np.uint64), max_bits), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    return cells.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def labelled(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, first (its smallest doc_id), label (of its component) of the distinct fingerprints of ``prints`` (doc_id, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    labels = materialize(components(links(nodes, max_bits)), "simhash-labels")
    return nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    nodes = labelled(prints, max_bits)
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    found = materialize(nodes.join(least, "label").select("fp", "component_id"), "simhash-found")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_unique(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, by wider fingerprints and verified shingle sets; see ``near``."""
    from lamina.llm import near

    return near.near_unique(docs)
