"""Packing, suffix dedup, simhash, sharding and mixing against brute force, with nulls, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import graph, mixing, packing, sharding, simhash, suffix_dedup
from lamina.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdefghé"), RNG.integers(1, 9))) for _ in range(60)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def corpus():
    shared = prose(60)
    texts = [prose(int(n)) for n in RNG.integers(1, 200, 30)]
    texts += [texts[0], texts[0], shared + " " + prose(30), prose(20) + shared + prose(9), shared + shared, None, "", " \n\t ", "x" * 450, "naïve Σίσυφος <|endoftext|> don't 12,5\x1cend", prose(9000)]
    near = texts[3].split()
    texts += [" ".join([*near[:-1], "zzz"])]
    rows = [(i, x, "en", f"s{i % 4}" if i % 9 else None, len(x or ""), "extra") for i, x in enumerate(texts)]
    return [*rows, rows[5], (None, texts[1], None, None, None, None), (None, None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_holds_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer_path())
    wanted = Counter()
    for _, text, *_ in ROWS:
        ids = np.array([*bpe.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted[zlib.crc32(ids.tobytes()), len(ids)] += 1
    rows = packing.pack(docs, tokenizer_path()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    loose = [sum(x[1] for x in p) for p in sequences.values()]
    assert sum(1 for n in loose if n & (n - 1)) <= 3  # one padded sequence a partition at most
    assert sum(n for (_, n), c in wanted.items() for _ in range(c)) == sum(r["length"] for r in rows)
    whole = Counter((p[0][2], n) for (_, n), p in pieces.items() if len(p) == 1)
    assert not whole - wanted
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_step_groups_are_balanced(spark, monkeypatch):
    """Full groups of a tier have equal tokens and like cost; the mixed ones of a partition's end share the rest; gaps of long windows hold shorter items."""
    monkeypatch.setattr(packing, "FLUSH", 1 << 15)
    packer = packing.Packer(0)
    rng = np.random.default_rng(2)
    for i, n in enumerate(rng.choice([30, 200, 400, 700, 1500, 3000, 5000], 6000).tolist()):
        packer.add(i, np.zeros(n, np.uint32))
    packer.finish()
    windows = defaultdict(list)
    for doc_id, start, n, _, total, sequence, offset, tier, group in packer.out:
        windows[sequence].append((offset, n, tier, group))
    groups, mixed = defaultdict(list), defaultdict(int)
    for parts in windows.values():
        tier, group = parts[0][2:]
        groups[group].append((tier, sum(p[1] for p in parts), sum(p[1] ** 2 for p in parts)))
    cost = defaultdict(list)
    for group, members in sorted(groups.items()):
        if len({t for t, *_ in members}) == 1 and sum(t for t, *_ in members) == packing.STEP_TOKENS:
            assert sum(n for _, n, _ in members) == packing.STEP_TOKENS
            cost[members[0][0]].append(sum(c for *_, c in members))
        else:
            mixed[group] = sum(n for _, n, _ in members)
    assert len(mixed) <= len(packing.TIERS) and max(mixed.values()) - min(mixed.values()) <= packing.STEP_TOKENS // 4
    for of_tier in cost.values():
        for i in range(0, len(of_tier), packing.STEPS):
            batch = of_tier[i : i + packing.STEPS]
            assert max(batch) <= 1.1 * min(batch)
    assert any(len({n <= 512 for _, n, *_ in parts}) == 2 for parts in windows.values() if parts[0][2] == 4096)


def test_words_are_encoded_as_the_tokenizer_does():
    import pyarrow as pa

    texts = [x or "" for _, x, *_ in ROWS] + ["It's I'LL a's ÿ É İ 9a", "\x1f a\x1db", "é ﬁ 漢字 🙂a"]
    bpe = packing.WordBpe(tokenizer_path())
    ids, bounds = bpe.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == bpe.whole.encode(text, add_special_tokens=False).ids


def brute_spans(texts):
    seen, out = set(), []
    for b in texts:
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = True
            seen.add(b[p : p + 100])
        out.append(np.frombuffer(b, np.uint8)[~mark].tobytes())
    return out


def test_suffix_dedup(docs, empty):
    from xxhash import xxh64_intdigest

    signed = lambda b: int(np.uint64(xxh64_intdigest(b, 42)).astype(np.int64))
    rows = sorted([(i, (t or "").encode()) for i, t, *_ in ROWS], key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    wanted = Counter((i, hashlib.sha256(k).hexdigest()) for (i, _), k in zip(rows, brute_spans([b for _, b in rows]), strict=True))
    got = suffix_dedup.removed_spans(docs).select("doc_id", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == wanted
    assert suffix_dedup.removed_spans(empty).count() == 0


def test_cover_samples_every_pair():
    hit = {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert hit == set(range(suffix_dedup.V))


def test_cut_ends_at_characters(spark):
    shared = "é" * 60
    df = spark.createDataFrame([(1, "a" + shared), (2, "bb" + shared)], "doc_id long, text string")
    for r in suffix_dedup.removed_spans(df, whole_characters=True).collect():
        r["kept"].decode()


def test_golay_keys_meet_within_four_bits():
    base = RNG.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    for bits in (1, 2, 3, 4):
        other = base.copy()
        for i in range(len(base)):
            for b in RNG.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys, places = simhash.golay_keys(np.concatenate([base, other]))
        of = defaultdict(set)
        for k, p in zip(keys.tolist(), places.tolist(), strict=True):
            of[p].add(k)
        assert all(of[i] & of[i + len(base)] for i in range(len(base)))


def test_large_keys_are_cut_into_blocks(docs, monkeypatch):
    wanted = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "LARGE", 2)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == wanted


def test_simhash_components(docs, empty):
    fps = [(i, simhash.fingerprint((t or "").encode())) for i, t, *_ in ROWS]
    label = list(range(len(fps)))
    for _ in label:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    least = defaultdict(list)
    for n, (i, _) in zip(label, fps, strict=True):
        least[n].append(i)
    wanted = Counter((i, format(f, "016x"), min((x for x in least[n] if x is not None), default=None)) for n, (i, f) in zip(label, fps, strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == wanted
    assert simhash.near_duplicates(empty).count() == 0


def test_near_unique_with_null_and_repeated_ids(spark):
    texts = [prose(40) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (9, texts[4]), (None, None)]
    got = simhash.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (None, None)]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(wanted)


def test_components_of_a_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("a % 50 <> 49")
    got = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    groups = Counter()
    for _, text, *_ in ROWS:
        groups[text] += len((text or "").encode()) + 1
    # One job at a time, longest first, to the least loaded of eight.
    load = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        load[load.index(min(load))] += size
    got, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        got[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert sorted(got[s] for s in range(8)) == sorted(load)
    wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in where.items() if k[1] > 1)  # null and empty are groups apart
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_counts_are_dealt_as_the_heap_deals_jobs(seed):
    rng = np.random.default_rng(seed)
    jobs = [(i, int(rng.choice([1, 2, 3, 5, 50, 400]))) for i in range(int(rng.integers(0, 70)))]
    size, shards = dict(jobs), int(rng.choice([2, 3, 8]))
    wanted = Counter((size[j], s) for j, s in sharding.lpt(jobs, shards).items())
    got = {(x, s): n for x, given in sharding.lpt_counts(list(Counter(size.values()).items()), shards) for s, n in enumerate(given) if n}
    assert got == dict(wanted)


def test_longest_first_through_a_heap():
    assert sharding.lpt([(0, 5), (1, 4), (2, 3), (3, 3)], 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_mixing_targets_and_copies(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for _, text, _, source, *_ in ROWS:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    assert {round(r["target"], 6) for r in rows} == {round(x, 6) for x in target.values()}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("columns", [("doc_id", "text"), ("doc_id", "text", "source", "size")])
def test_copies_are_taken(docs, columns):
    """By source the words taken come near the target, and equal rows differ by at most one copy; rows that differ in any column are kept apart."""
    rows = Counter((i, t, s, x) for i, t, _, s, _, x in ROWS)
    targets = {r["source_size"]: r["target"] for r in mixing.mix(docs).select("source_size", "target").distinct().collect()}
    names = ("doc_id", "text", "source", "size")
    taken = Counter(tuple(r) for r in mixing.take(docs, columns).collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have = Counter()
    for r, n in rows.items():
        have[tuple(x for x, c in zip(r, names, strict=True) if c in columns)] += n
    assert all(n <= 3 * have[r] for r, n in taken.items())
    if "source" in columns:
        for source in {r[2] for r in rows}:
            sizes = [words(r[1]) for r in rows.elements() if r[2] == source]
            got = sum(words(r[1]) * n for r, n in taken.items() if r[2] == source)
            assert abs(got - targets[sum(sizes)]) <= max(sizes)


def test_copies_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "d e f", "x"), (None, "g h i", "x"), (None, "j k l", "y")] + [(7, "m n o", "y")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter(tuple(r) for r in mixing.take(docs, ("doc_id", "text", "source"), weights=(1, 2)).collect())
    assert set(taken) <= set(rows)
    assert all(n <= 3 * rows.count(r) for r, n in taken.items())
    by_source = Counter()
    for r, n in taken.items():
        by_source[r[2]] += 3 * n
    assert abs(by_source["x"] - 10) <= 3 and abs(by_source["y"] - 20) <= 3


def test_rates_that_do_not_settle_raise(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", mixing.STEPS_A_WRITE)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    with pytest.raises(RuntimeError, match="target"):
        mixing.mix(docs).collect()


def test_mixing_reruns_agree(docs):
    found = [Counter(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 5)]
    assert found[0] == found[1]


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    df = spark.createDataFrame([(1, 8), (2, 2), (3, 0)], "x long, n long")
    assert Counter(tuple(r) for r in mixing.each(df, "n", "i", ("x",)).collect()) == Counter([(1, 8, i) for i in range(8)] + [(2, 2, i) for i in range(2)])


def test_joins_by_counted_size(spark, monkeypatch):
    from lamina.llm import common

    large = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "x long, k string")
    small = spark.createDataFrame([("a", 10), (None, 20)], "k string, y long")
    for most in (100, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = sorted(tuple(r) for r in common.join_small(large, small, {"k": "k"}).select("x", "y").collect())
        assert got == [(1, 10), (2, 20), (4, 10)]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from lamina.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(session)
