"""Near-duplicates by shingle sets against brute force."""

import numpy as np

from lamina.llm import near, simhash


def test_near_unique_by_similarity(spark):
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(words, int(rng.integers(100, 400))))
        texts.append(base)
        for edits in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = str(rng.choice(words))
            texts.append(copy)
    base = list(rng.choice(words, 300))  # a group of more than FEW
    for _ in range(40):
        copy = list(base)
        copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", "  ", "one two", "One  two", None]
    sets = [set(near.shingles((t or "").encode()).tolist()) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label[max(top(a), top(b))] = min(top(a), top(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.near_unique(docs).select("doc_id").collect())
    assert got == sorted({top(i) for i in range(len(texts))})


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 300)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.sort(np.append(base[:-2], np.uint64(1000 + i))) for i in range(30)] + [base + np.uint64(5000)]
    nodes = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    members = nodes.selectExpr("1L AS key", "node AS a", "octet_length(hashes) div 8 AS n")
    label = {r["node"]: r["label"] for r in near.components(near.block_links(members, nodes)).collect()}
    assert label == {i: 0 for i in range(30)}


def test_groups_of_a_large_key_meet_the_rest_only(spark, monkeypatch):
    """Copies of one text, a chain that leads away from it and back to nothing, and strangers: the components of all true links, from few cells."""
    monkeypatch.setattr(near, "BLOCK", 400)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.sort(np.append(base[:-1], np.uint64(1000 + i))) for i in range(60)]
    for step in range(1, 7):  # each shares nine tenths with the one before, the last ones little with the first
        sets.append(np.sort(np.concatenate([base[8 * step :], np.arange(2000, 2000 + 8 * step, dtype=np.uint64)])))
    sets += [base + np.uint64(10_000 * k) for k in range(1, 9)]
    nodes = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    members = nodes.selectExpr("1L AS key", "node AS a", "octet_length(hashes) div 8 AS n")
    found = {r["node"]: r["label"] for r in near.components(near.block_links(members, nodes)).collect()}
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if near.similar(common, len(sets[a]), len(sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: found.get(i, i) for i in range(len(sets))} == dict(enumerate(label))
    assert label[65] == 0 and not near.similar(len(np.intersect1d(sets[65], sets[0])), 100, 100)
