"""License scans, the divergence audit and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import divergence, licenses, resampling

DOC = "doc_id long, text string, lang string, source string"
EXTRA = ", k1 string, w int, n int, p double, labels string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def scan_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def odd_rows(seed=3, n=160):
    """Texts of few words in four groups, one of them hot, with nulls, empty and repeated rows, a very long text and letters of all planes."""
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "a", "of", "été", "ñu", "𝒳x", "x1", "mit", "License", "general", "public", "APACHE", "word", "İs", "Kelvin", "B2b", "--", "," ]
    say = lambda k: " ".join(rng.choice(vocabulary, k))
    rows = [(i, say(int(rng.integers(0, 60))), ["en", "de"][i % 2], "hot" if i % 3 else f"s{i % 4}") for i in range(n)]
    rows += [rows[0], rows[0], (None, say(30), "en", None), (500, None, None, "hot"), (501, "", "fr", "alone"), (502, say(20_000), "de", "hot"), (503, "\x00\t!!", "en", "")]
    return [(*r, "k", 1, 2, 0.5, "l") for r in rows]


def test_license_base_counts(spark):
    rows = odd_rows()
    got = Counter(tuple(r)[:6] for r in licenses.scan(spark.createDataFrame(rows, DOC + EXTRA).repartition(3)).collect())
    wanted = Counter()
    for r in rows:
        w = scan_words(r[1])
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        wanted[r[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == wanted
    assert any(k[2] > 1 for k in got)
    assert licenses.scan(spark.createDataFrame([], DOC)).count() == 0


def test_license_spans(spark):
    """Whole notices, notices with a word more, fewer or other, one license inside another's name, and clean texts."""
    by = {}
    for label, text in licenses.TEMPLATES:
        by.setdefault(label, text)
    filler = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    long = max((t for _, t in licenses.TEMPLATES), key=len)
    words = long.split()
    changed = {
        "added": words[:20] + ["indeed"] + words[20:], "left out": words[:20] + words[21:], "other": [*words[:20], "thing", *words[21:]],
        "half": words[: len(words) // 2], "reversed": words[::-1],
    }
    texts = [f"{filler(i)}. {t}\n{filler(-i)}" for i, t in enumerate(by.values(), 1)] + [" ".join(x) for x in changed.values()] + [filler(99), f"{by['mit']} {by['cc-by-nc-4.0']} {by['mit']}"]
    rows = licenses.scan(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOC)).collect()
    found = {r["doc_id"]: r for r in rows}
    for i, label in enumerate(by):
        own = {s["label"] for s in found[i]["spans"]}
        assert own == {label} and found[i]["score"] == 1.0
        assert [s["first_place"] for s in found[i]["spans"]] == [30]
        assert label in found[i]["labels"].split(",")
    n = len(by)
    for k, kind in enumerate(changed):
        assert [s["label"] for s in found[n + k]["spans"]] == (["mit"] if kind in ("added", "left out", "other") else [])
        assert 0.9 < found[n + k]["score"] < 1 or kind in ("half", "reversed")
    assert found[n + 5]["labels"] == "" and found[n + 5]["score"] == 0
    assert [s["label"] for s in found[n + 6]["spans"]].count("mit") == 2 and found[n + 6]["labels"] == "cc-by-nc-4.0,mit"


def test_license_scan_broadcasts_no_texts(spark, monkeypatch):
    """Only template positions are sent whole, whatever the number of texts; without a list of k-grams rows are the same."""
    notice = licenses.TEMPLATES[2][1]
    rows = [(i, f"w{i % 40} x {notice}" if i % 3 else f"w{i} mit license", "en", "s") for i in range(200)] + [(7, None, "en", "s")]
    docs = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(licenses, "materialize", lambda df, name: df)
    whole = licenses.scan(docs)
    # Template grams and template words.
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan, plan
    got = Counter(str(r) for r in whole.collect())
    monkeypatch.setattr(licenses, "LISTED_GRAMS", 0)
    assert got == Counter(str(r) for r in licenses.scan(docs).collect())
    assert sum("label='mit'" in r for r in got.elements()) == sum(1 for i in range(200) if i % 3)


def test_license_candidates_are_all_diagonals(spark):
    """Votes by diagonal are those of a loop over all pairs of places."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(5)]
    templates = [("x", "a b c a b"), ("y", "c c c a")]
    df = spark.createDataFrame(list(enumerate(texts)), "k1 long, text string").selectExpr("k1", "k1 AS k2", "split(text, ' ') AS w")
    got = {(r["k1"], r["template"], tuple(r["diagonals"])): r["votes"] for r in licenses.candidates(df, spark, templates, gap=1).collect()}
    wanted = {}
    for i, text in enumerate(texts):
        w = text.split()
        for t, (_, known) in enumerate(templates):
            tw, votes = known.split(), Counter()
            for p in range(len(w) - 2):
                for q in range(len(tw) - 2):
                    votes[p - q] += w[p : p + 3] == tw[q : q + 3]
            runs: list[list[int]] = []
            for d in sorted(+votes):
                runs.append([d]) if not runs or d - runs[-1][-1] > 1 else runs[-1].append(d)
            wanted |= {(i, t, tuple(run)): sum(votes[d] for d in run) for run in runs}
    assert got == wanted


def brute_audit(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1]))
        groups.add((lang, source))
        counts[lang, source].update(w)
        docs[lang].update(set(w))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        total = {g: sum(counts[g][w] for w in kept) for g in own}
        everything = {w: sum(counts[g][w] for g in own) for w in kept}
        p = {g: {w: 1 + 10**9 * (counts[g][w] + 2) // (total[g] + 2 * len(kept)) for w in kept} for g in own}
        q = {w: 1 + 10**9 * (everything[w] + 2) // (sum(total.values()) + 2 * len(kept)) for w in kept}
        for g in own:
            pairs = sorted((-sum(f(p[g][w], p[h][w]) for w in kept), h[1].encode()) for h in own if h != g)
            terms = sorted((-f(p[g][w], q[w]), w.encode()) for w in kept if counts[g][w] and p[g][w] > q[w])[:10]
            out |= {(*g, part, s.decode(), -v, i) for part, x in (("pair", pairs), ("term", terms)) for i, (v, s) in enumerate(x, 1)}
    return out


@pytest.mark.parametrize("least", [1, 10, 1000])
def test_divergence(spark, least):
    rows = odd_rows()
    got = divergence.audit(spark.createDataFrame(rows, DOC + EXTRA).repartition(3), least).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, least) and len(got) == len({tuple(r) for r in got})


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, None, "en", "a"), (2, "!!", "en", "b"), (3, "x", "de", "a")]
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOC)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_rates_beyond_a_long(spark):
    """A count times the scale does not fit a long; the rate is exact all the same."""
    n, total, v = 9_000_000_000_000, 123_456_789_012_345, 777_777
    r = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.rate(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert r == 1 + 10**9 * (n + 2) // (total + 2 * v)


def brute_resample(rows, target, percent=5):
    def features(text):
        w = scan_words(text)
        return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for r in rows for f in features(r[1])[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for r in rows:
        w, f = features(r[1])
        h = int(hashlib.sha256(f"42:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    pool = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    taken = Counter()
    for i, x in enumerate(pool[: percent * len(pool) // 100], 1):
        taken[(*x[:4], i)] += 1
    for x in pool[percent * len(pool) // 100 :] + [x for x in out if x[4] < 20]:
        taken[(*x[:4], None)] += 1
    return taken


@pytest.mark.parametrize("small", [False, True])
def test_resampling(spark, monkeypatch, small):
    """Whole rows against brute force; also with blocks and parts of a few texts, and all rows the same."""
    if small:
        monkeypatch.setattr(resampling, "BLOCK_BYTES", 500)
        monkeypatch.setattr(resampling, "PART_BYTES", 700)
    rows, target = odd_rows(), ["the mit license of the word", None, "", "été été a B2b", "the The of a word x1"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resample(spark.createDataFrame(rows, DOC + EXTRA).repartition(3), bench, 20).collect()
    wanted = brute_resample(rows, target, 20)
    ties = lambda c: Counter({(*k[:4], k[4] is None): 0 for k in c}) + Counter(x for k, n in c.items() for x in [(*k[:4], k[4] is None)] * n)
    assert ties(Counter(map(tuple, got))) == ties(wanted)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(k[4] is not None for k in wanted.elements()) + 1))
    assert Counter(map(tuple, got)) == wanted


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "en", "s")] * 3, DOC)
    assert resampling.resample(none, some).count() == 0
    assert {tuple(r)[:3] for r in resampling.resample(some, none).collect()} == {(1, 3, sum(k[2] for k in brute_resample([(1, "a b")] * 3, [])) // 1)}


def test_large_counts_survive_the_cells():
    """Counts beyond 32 bits, parts read alone, words shared with the feature before."""
    names = pa.array([b"a ", b"bb ", "é ".encode(), b"d "], pa.large_binary())
    rows, counts = np.array([[0, 1, 1], [0, 1, 2], [0, 2, 0], [3, 0, 0]]), np.array([1, 2**40 + 5, 7, 2**32])
    for i, j in ((0, 2), (2, 4), (0, 0)):
        cell = resampling._encode([rows[i:j, :k] for k in (1, 2, 3)], [counts[i:j]] * 3, names)
        for k, (found, n) in enumerate(resampling._decode(cell), 1):
            assert found.to_pylist() == [b"".join(names[x].as_py() for x in row[:k]).rstrip() for row in rows[i:j]]
            assert n.tolist() == counts[i:j].tolist()
