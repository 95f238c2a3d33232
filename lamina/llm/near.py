"""SimHash near-dedup at a similarity of word shingles, for the pipeline.

Two texts are linked where the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. At 0.8 some 15 % of a SimHash fingerprint's bits differ,
ten of 64: the four bits of the operator's own contract would find one such pair
in forty. So fingerprints are wider here, ``SEGMENTS`` segments of 23 bits, and
each segment is read as a word of the perfect Golay code and decoded to the
indices of its nearby codewords, as in ``simhash``: words with two errors always
share one, words at similarity 0.8 do so six times in ten. Twelve bits alone
would fill buckets with strangers as the corpus grows; so a codeword counts
together with the segment's two least shingle hashes, which agree with a
probability of the similarity squared. A pair at 0.8 has 0.8^2 * 0.6 = 0.39 a
segment, and shares no key of ``SEGMENTS`` with probability 0.002; closer pairs
less often. Every link is verified on the sets themselves.

Equal sets are one node throughout. A key shared by few sets gives all its pairs;
of one shared by more than ``FEW`` a spanning forest of the true links is passed on. If
its sets hold more than ``BLOCK`` shingles together, they are first verified against a
few pivots; what is linked to one pivot is one group and need not meet itself, and only
sets of unlike groups, and those linked to none, meet, in blocks of about ``BLOCK``. The
nearest codewords of the first ``LEAD`` segments go first, as they tell most copies;
of the other keys only sets of unlike components meet, and a key whose sets are one
component already passes nothing on. Sets are read only for texts that have a key in
common with others.

Defined results: null and empty texts, and texts without words, have the empty set,
equal to itself; texts of fewer than five words are one shingle; texts count whole,
however long; of a group the row with the smallest doc_id stays, nulls last, then
the one with the smaller hash of the row, so of rows that are wholly equal one;
unlike rows that share a doc_id, or have none, are rows of their own; an empty
table gives an empty result; other columns are kept, but must not be called k1 or k2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import BROADCAST_ROWS, drop, lean, materialize, shuffle_partitions, survivors, with_row_key
from lamina.llm.graph import components
from lamina.llm.simhash import codewords

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Segments of a fingerprint, of ``BITS`` bits each, and the least hashes that anchor one.
SEGMENTS, BITS, ANCHORS = 13, 23, 2
LEAD = 2
SEED = 42
FEW = 4
BLOCK = 500_000
#: Members of a large key that all others are first verified against, and salts of that join.
PIVOTS, SALTS = 3, 16
#: Keys of one bucket in memory, about.
BUCKET_KEYS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(SEED)
_STREAMS = -(-SEGMENTS * BITS // 64)
_XOR = _RNG.integers(0, 1 << 64, SEGMENTS * ANCHORS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, SEGMENTS * ANCHORS, np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 64, _STREAMS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    return np.unique(np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :], strict=True)], np.uint64))


def words(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set that is not empty, as one word of ``BITS`` bits a segment."""
    counts = np.zeros(64 * _STREAMS, np.int64)
    for i in range(0, len(hashes), 2048):
        streams = _mix(hashes[i : i + 2048, None] + _SALT)
        counts += np.unpackbits(streams.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes))[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
    return bits @ (1 << np.arange(BITS))


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty: those of the nearest codewords of the first ``LEAD`` segments, then the others."""
    least = np.full(SEGMENTS * ANCHORS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048, None] ^ _XOR) * _ODD).min(0))
    anchor = np.arange(1, SEGMENTS + 1, dtype=np.uint64)
    for column in least.reshape(SEGMENTS, ANCHORS).T:
        anchor = _mix(anchor ^ column)
    near = codewords(words(hashes))
    keys = _mix(anchor[:, None] ^ (near + 1).astype(np.uint64))
    first = np.zeros(near.shape, bool)
    first[:LEAD, 0] = True
    return np.concatenate([keys[first], keys[~first & (near >= 0)]])


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` shingles with ``common`` of them in both are linked."""
    return SIMILAR[1] * common >= SIMILAR[0] * (a + b - common)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (root, member), by place, of a spanning forest of the true links among distinct sets."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(ids.max() + 1, bool)
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            x = todo.pop()
            mine = ids[starts[x] : starts[x + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[ids], starts[:-1], dtype=np.int64)
            mark[mine] = False
            found = np.flatnonzero(left & similar(common, size, size[x]))
            left[found] = False
            out += [(root, int(y)) for y in found]
            todo += found.tolist()
    return out


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, node (of the text's set), n (its shingles), keys (packed) of every row of ``docs`` (doc_id, k1, k2, text)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, keys = [], [], []
            for t in pc.fill_null(b.column("text"), "").cast(pa.binary()):
                s = shingles(t.as_py())
                nodes.append(xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                keys.append(keys_of(s).astype("<u8").tobytes() if len(s) else b"")
            out = [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "k1", "k2", "node", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, node long, n long, keys binary")


def candidates(nodes: DataFrame, each: int) -> DataFrame:
    """What shares a key and has unlike labels: (a, b) of a key with few sets, and else (key, a, n) of each set, for ``nodes`` (node, label, n, keys), about ``each`` keys apiece."""
    buckets = max(shuffle_partitions(nodes.sparkSession), nodes.count() * each // BUCKET_KEYS + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, sizes = (b.column(c).to_numpy().view(np.uint64) for c in ("node", "label", "n"))
            blobs = b.column("keys").to_pylist()
            for i in range(0, len(ids), 8192):
                some = blobs[i : i + 8192]
                keys = np.frombuffer(b"".join(some), "<u8")
                place = i + np.repeat(np.arange(len(some)), np.fromiter(map(len, some), np.int64, len(some)) // 8)
                bucket = (keys >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, place, bucket = keys[order], place[order], bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                # Most sets are their own label: as differences, labels are mostly 0 and small when compressed.
                parts = [keys.astype("<u8"), ids[place].astype("<u8"), (ids[place] ^ labels[place]).astype("<u8"), sizes[place].astype("<u4")]
                rows = [(int(bucket[x]), *(p[x:y].tobytes() for p in parts)) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
                columns = [pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "nodes", "labels", "sizes"])

    def meet(keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, keys))
        keys, ids, labels, sizes = keys[order], ids[order], labels[order] ^ ids[order], sizes[order]
        ids = ids.view(np.int64)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(new, len(keys)))
        open_ = np.minimum.reduceat(labels, new) != np.maximum.reduceat(labels, new)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, FEW + 1):
            at = new[open_ & (size == m)]
            for i in range(m):
                for j in range(i + 1, m):
                    unlike = labels[at + i] != labels[at + j]
                    a.append(ids[at + i][unlike])
                    b.append(ids[at + j][unlike])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        many = np.repeat(open_ & (size > FEW), size)
        none = lambda n: pa.nulls(n, pa.int64())
        out = [
            pa.concat_arrays([none(len(pairs)), pa.array(keys[many].view(np.int64))]),
            pa.array(np.concatenate([pairs[:, 0], ids[many]])),
            pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), none(int(many.sum()))]),
            pa.concat_arrays([none(len(pairs)), pa.array(sizes[many].astype(np.int64))]),
        ]
        return pa.RecordBatch.from_arrays(out, names=["key", "a", "b", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> pa.RecordBatch:
            return meet(*(np.concatenate([h[k] for h in held]) for k in range(4)))

        for b in batches:
            for bucket, *parts in zip(b.column("bucket").to_pylist(), *(b.column(c) for c in ("keys", "nodes", "labels", "sizes")), strict=True):
                if bucket != at and held:
                    yield flush()
                    held = []
                at = bucket
                held.append([np.frombuffer(p.as_buffer(), "<u8" if i < 3 else "<u4") for i, p in enumerate(parts)])
        if held:
            yield flush()

    dealt = nodes.mapInArrow(spread, "bucket long, keys binary, nodes binary, labels binary, sizes binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "key long, a long, b long, n long")


def _sets(texts: DataFrame) -> DataFrame:
    """node, hashes (its set, packed) of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).astype("<u8").tobytes() for t in pc.fill_null(b.column("text"), "").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def true_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(_unpack(b.column("x")), _unpack(b.column("y")), strict=True)]
            found = b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            del b
            pa.default_memory_pool().release_unused()
            yield found

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def pivot_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """True links (key, a, b) between the members of a key and its ``PIVOTS`` members b that hashes pick; ``members`` is (key, a)."""
    pick = [F.min_by("a", F.xxhash64("a", F.lit(f"pivot {i}"))).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = members.groupBy("key").agg(*pick).select("key", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("b"))
    of = chosen.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    # A pivot's set meets every member of its key: members are salted, pivots repeated.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    repeated = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(repeated, ["key", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(_unpack(batch.column("x")), _unpack(batch.column("y")), strict=True)]
            found = batch.select(["key", "a", "b"]).filter(pa.array(ok, pa.bool_()))
            del batch
            pa.default_memory_pool().release_unused()
            yield found

    return met.select("key", "a", "b", "x", "y").mapInArrow(run, "key long, a long, b long")


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets of each key as all their true links do; ``members`` is (key, a, n).

    Sets of a key with more than ``BLOCK`` shingles are first verified against a few
    pivots. What is linked to one pivot is one group already: its sets need not meet
    one another, only those of other groups and those linked to no pivot. So a
    key whose sets are copies of few texts makes few cells, however many it has.
    """
    sums = members.groupBy("key").agg(F.sum("n").alias("total"))
    sized = materialize(members.join(sums, "key"), "near-members")
    large = sized.where(F.col("total") > BLOCK)
    linked = materialize(pivot_links(large.select("key", "a"), sets), "near-pivots")
    group = linked.groupBy("key", "a").agg(F.min("b").alias("group"))
    grouped = materialize(large.join(group, ["key", "a"], "left").select("key", "a", "n", F.col("group")), "near-grouped")
    # A row a key, with its groups (one a pivot, and the rest) and how many blocks each has.
    blocks = grouped.groupBy("key", "group").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).groupBy("key")
    blocks = blocks.agg(F.collect_list(F.struct("group", "blocks")).alias("groups"))
    own = F.element_at(F.filter("groups", lambda g: g["group"].eqNullSafe(F.col("group"))), 1)["blocks"]
    numbered = grouped.join(blocks, "key").withColumn("mine", F.struct(F.coalesce("group", F.lit(0)).alias("g"), F.col("group").isNull().alias("rest"), F.pmod(F.xxhash64("a", F.lit("block")), own).alias("r")))
    others = F.filter("groups", lambda g: g["group"].isNull() | ~g["group"].eqNullSafe(F.col("group")))
    with_other = numbered.withColumn("other", F.explode(others)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other.blocks") - 1)))
    theirs = F.struct(F.coalesce("other.group", F.lit(0)).alias("g"), F.col("other.group").isNull().alias("rest"), F.col("r").alias("r"))
    pair = lambda end: F.concat_ws(".", *[F.col(f"{end}.{c}").cast("string") for c in ("g", "rest", "r")])
    cells = with_other.select("key", F.least("mine", theirs).alias("i"), F.greatest("mine", theirs).alias("j"), "a")
    cells = cells.select("key", pair("i").alias("i"), pair("j").alias("j"), "a")
    small = sized.where(F.col("total") <= BLOCK).select("key", F.lit("").alias("i"), F.lit("").alias("j"), "a")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("a").to_numpy()
        found = forest(_unpack(table.column("hashes").combine_chunks()))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    with_sets = small.unionAll(cells).join(sets, F.col("a") == F.col("node")).select("key", "i", "j", "a", "hashes")
    return linked.where("a <> b").select("a", "b").unionAll(with_sets.groupBy("key", "i", "j").applyInArrow(lean(run), "a long, b long"))


def labels(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; ``docs`` has k1, k2 and text, ``found`` is its ``prints``."""
    nodes = materialize(found.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-nodes")
    full = nodes.where("n > 0")
    first = F.substring("keys", 1, 8 * LEAD)

    def links(keyed: DataFrame, each: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(links, the sets that were read) of ``keyed`` (node, label, n, keys); ``known`` holds sets that were read before."""
        met = materialize(candidates(keyed, each), "near-met")
        pairs = met.where("key IS NULL").select("a", "b").distinct()
        many = met.where("key IS NOT NULL").select("key", "a", "n")
        wanted = met.select(F.col("a").alias("node")).unionAll(met.where("b IS NOT NULL").select("b")).distinct()
        if known is not None:
            wanted = wanted.join(known.select("node"), "node", "left_anti")
        places = materialize(nodes.join(wanted, "node").select("node", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")), "near-places")
        own = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        texts = docs.select("k1", "k2", "text").join(own, ["k1", "k2"]).dropDuplicates(["k1", "k2", "node"])
        sets = materialize(_sets(texts), "near-sets")
        every = sets if known is None else sets.unionAll(known)
        out = materialize(true_pairs(pairs, every).unionAll(block_links(many, every)), "near-links")
        drop(met, places)
        return out, sets

    lead, sets = links(full.select("node", F.col("node").alias("label"), "n", first.alias("keys")), LEAD, None)
    known = materialize(components(lead), "near-labels")
    rest = F.substring("keys", 8 * LEAD + 1, 1 << 20)
    labelled = full.join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n", rest.alias("keys"))
    more, others = links(labelled, 6 * SEGMENTS, sets)
    # Later links connect components: these are the nodes from here on.
    end = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joined = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    last = materialize(components(joined), "near-labels").withColumnRenamed("label", "least")
    moved = known.join(last.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    alone = last.join(known.select("node"), "node", "left_anti").select("node", F.col("least").alias("label"))
    out = materialize(moved.unionAll(alone), "near-labels")
    drop(lead, sets, known, more, others, nodes)
    return out


def near_unique(docs: DataFrame) -> DataFrame:
    """One row of each component, in the columns of ``docs``: the one with the smallest doc_id; see ``survivors``."""
    keyed = with_row_key(docs)
    found = materialize(prints(keyed), "near-prints")
    of = labels(keyed, found)
    label = found.join(of, "node", "left").select("doc_id", "k1", "k2", F.coalesce("label", "node").alias("label"))
    out = survivors(keyed, label)
    drop(found, of)
    return out
