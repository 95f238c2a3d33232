"""Every pipeline stage on its own input against brute force, on a small fixture of copies, passages, nulls and junk."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lamina.llm import near
from lamina.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABETS = {"en": "aeiothnrs", "de": "äöüchßenst", "fr": "éèàeuoxlm"}


def corpus():
    rng = np.random.default_rng(11)
    say = lambda lang, n: " ".join("".join(rng.choice(list(ALPHABETS[lang]), rng.integers(2, 8))) for _ in range(n))
    rows = []
    for i in range(120):
        lang = list(ALPHABETS)[i % 3]
        rows.append((i, say(lang, int(rng.integers(40, 120))), lang, f"s{i % 5}"))
    passage = say("fr", 40)
    rows += [(200 + i, say("fr", 50) + " " + passage + " " + say("fr", 50), "fr", "s1") for i in range(4)]
    rows += [(300 + i, rows[i % 3][1], rows[i % 3][2], "s0") for i in range(9)]
    rows += [(400, rows[4][1] + " ende", "de", "s2"), (401, None, "en", None), (402, "", None, "s1"), (403, "12 34 ## !!", "en", "s3"), (404, "short one", "en", "s3")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def staged(spark):
    docs = [spark.createDataFrame(corpus(), SCHEMA)]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], ""), f"test-{name}"))
    return [d.collect() for d in docs]


def test_columns_stay(staged):
    for rows in staged[:-1]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rejected_documents_go(staged):
    before, after = ({r["doc_id"]: r for r in rows} for rows in staged[:2])
    assert set(before) - set(after) == {401, 402, 403}
    assert all(after[i]["text"] == before[i]["text"] for i in after)
    assert np.mean([after[i]["lang"] == before[i]["lang"] for i in after]) > 0.98


def test_one_of_each_group_stays(staged):
    rows = sorted(staged[1])
    sets = [set(near.shingles(r["text"].encode()).tolist()) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert sorted(r["doc_id"] for r in staged[2]) == sorted(rows[i]["doc_id"] for i in set(label))


def test_repeated_passages_go_in_whole_characters(staged):
    seen, wanted = set(), {}
    for r in sorted(staged[2]):
        b = r["text"].encode()
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = True
            seen.add(b[p : p + 100])
        at, kept = 0, []
        for c in r["text"]:
            n = len(c.encode())
            kept.append("" if mark[at : at + n].all() else c)
            at += n
        wanted[r["doc_id"]] = "".join(kept)
    got = {r["doc_id"]: r["text"] for r in staged[3]}
    assert got == {i: t for i, t in wanted.items() if t}
    assert sum(len(t) for t in got.values()) < sum(len(r["text"]) for r in staged[2])
    assert all(r["n_chars"] == len(r["text"]) for r in staged[3])


def test_documents_come_as_often_as_taken(staged):
    """By source the words taken come near the target of an independent water filling."""
    words, have = Counter(), {tuple(r) for r in staged[3]}
    for r in staged[3]:
        words[r["source"]] += len(r["text"].split())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(words))}
    target, left, free = {}, float(sum(words.values())), set(words)
    while over := {s for s in free if left * weight[s] > 3 * words[s] * sum(weight[x] for x in free)}:
        target |= {s: 3.0 * words[s] for s in over}
        left, free = float(sum(words.values())) - sum(target.values()), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    copies = Counter(tuple(r) for r in staged[4])
    assert set(copies) <= have and max(copies.values()) <= 3
    taken = Counter()
    for r in staged[4]:
        taken[r["source"]] += len(r["text"].split())
    largest = max(len(r["text"].split()) for r in staged[3])
    assert all(abs(taken[s] - target[s]) <= largest for s in words)


def test_every_copy_is_packed(staged):
    copies = Counter(r["doc_id"] for r in staged[4])
    pieces = Counter()
    for r in staged[5]:
        pieces[r["doc_id"]] += r["length"]
    totals = {r["doc_id"]: r["doc_tokens"] for r in staged[5]}
    assert pieces == {i: n * totals[i] for i, n in copies.items()}


def test_run_chains_the_stages(spark, staged, tmp_path):
    """run() gives the pieces that the stages give one after another, whatever sequence they land in."""
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert tokens(got) == tokens(staged[5])
    assert sum(r["length"] for r in got) == sum(r["length"] for r in staged[5])


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_take_odd_tables(spark, kind):
    """Empty tables; null and repeated ids of unlike text, equal rows, ties, a very long text, columns with the names of results."""
    say = np.random.default_rng(5)
    text = lambda n: " ".join("".join(say.choice(list("aeinrst"), say.integers(2, 8))) for _ in range(n))
    long, same = text(30_000), text(60)
    rows = [(None, text(50), "en", "s"), (None, text(50), "en", "s"), (1, text(50), None, None), (1, text(50), "en", "s"), (2, same, "en", "s"), (2, same, "en", "s"), (3, same, "en", "t"), (4, None, "en", "s"), (5, "", "en", "s"), (6, long, "en", "s")]
    full = [(*r, len(r[1] or ""), 7, 8.5, b"x", "k", 1, 2) for r in rows] if kind == "odd" else []
    docs = spark.createDataFrame(full, SCHEMA + ", size long, score double, kept binary, k1 string, ord long, copies int").repartition(3)
    found = {name: stage(spark, docs, "").collect() for name, stage in corpus_pipeline.STAGES}
    if kind == "empty":
        assert not any(found.values())
        return
    ids = lambda name: Counter(r["doc_id"] for r in found[name])
    assert ids("language_id") == Counter({None: 2, 1: 2, 2: 2, 3: 1, 6: 1})
    assert ids("near_dedup") == Counter({None: 2, 1: 2, 2: 1, 4: 1, 6: 1})
    assert ids("suffix_dedup") == Counter({None: 2, 1: 2, 2: 1, 4: 1, 5: 1, 6: 1})
    assert not {4, 5} & set(ids("mixing"))
    assert sum(r["start"] == 0 for r in found["packing"]) == len(rows)
    assert all(r["text"] == long for name in ("language_id", "near_dedup", "suffix_dedup") for r in found[name] if r["doc_id"] == 6)
