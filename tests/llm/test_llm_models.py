"""Quality rules, top-k, WARC, language ID and toxicity against brute force and held-out rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import langid, quality, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def test_quality_counts(spark):
    texts = ["a b c a b c d", "x $ y\nx $ y\n\n \nz", None, "", " ".join(["w"] * 60), " ".join(map(str, range(70))), "é# |\tü"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", None if i == 3 else "s") for i, t in enumerate([*texts, texts[0]])], DOC)
    for r in quality.judge(df).collect():
        text = [*texts, texts[0]][r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        inside = {i + k for i, w in enumerate(grams) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == wanted
        assert not (failed and r["kept"])
    assert quality.judge(spark.createDataFrame([], DOC)).count() == 0


def test_quality_fences_follow_the_group(spark):
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, plain(i), "en", "s") for i in range(300)] + [(300, plain(0) + " ###" * 60, "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert not kept.pop(300)
    assert all(kept.values())


def test_fences_do_not_jump(spark):
    """One row more or less moves a fence by little, at the old switch of 200 rows too."""
    rows = [("en", "a", 100, 500, 0, 0, 10, 0, False)] * 300
    last = None
    for n in (198, 199, 200, 201, 202):
        own = [("en", "b", 100, 900, 0, 0, 10, 0, False)] * n
        df = spark.createDataFrame(rows + own, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean")
        fence = {r["source"]: r["max_word_len"] for r in quality.thresholds(df).collect()}["b"]
        assert last is None or abs(fence - last) < 0.05
        last = fence


def test_kept_against_exact_quantiles(spark):
    """Verdicts with fences from sketches are those with fences from exact quantiles, but for what lies within the sketch's error of a fence."""
    rng = np.random.default_rng(12)
    say = lambda n: ["".join(rng.choice(list("aeinrst"), rng.integers(2, 9))) for _ in range(n)]
    rows = []
    for i in range(900):
        words = say(int(rng.integers(60, 120)))
        for _ in range(int(rng.integers(0, 3)) if i % 30 else 40):
            words[int(rng.integers(len(words)))] = "$$#"
        lines = [" ".join(words[j : j + 8]) for j in range(0, len(words), 8)]
        rows.append((i, "\n".join(lines + ([lines[0]] * 9 if i % 45 == 1 else [])), "en" if i % 5 else "de", f"s{i % 3}"))
    got = quality.judge(spark.createDataFrame(rows, DOC)).toPandas()
    passed = got[~got.base_failed]
    quantiles = {}
    for m in quality.METRICS:
        quantiles[m, ()] = (len(passed), np.quantile(passed[m], [0.25, 0.75]))
        for group in (["lang"], ["lang", "source"]):
            for key, g in passed.groupby(group):
                quantiles[m, key] = (len(g), np.quantile(g[m], [0.25, 0.75]))

    def fence_of(m, lang, source):
        q = quantiles[m, ()][1]
        for key in ((lang,), (lang, source)):
            n, own = quantiles[m, key]
            q = (n * own + quality.SHRINK * q) / (n + quality.SHRINK)
        return q[1] + quality.FENCE * max(q[1] - q[0], quality.FLOOR[m])

    checked = 0
    for r in got.itertuples():
        kept, clear = not r.base_failed, True
        for m in quality.METRICS:
            fence = fence_of(m, r.lang, r.source)
            value = getattr(r, m)
            kept &= value <= fence
            clear &= abs(value - fence) > 0.15 * fence or r.base_failed
        if clear:
            checked += 1
            assert r.kept == kept, r
    assert checked > 850 and 10 < (~got.kept).sum() < 100


@pytest.mark.parametrize("dims", [3, 16])
def test_top_k(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(0, 0.3, (230, dims))
    vectors[7] = vectors[3] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (450, [float("nan")] * dims), (500, [None] * dims), (51, vectors[1].tolist())]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids = np.array([*range(230), 51])
    m = np.floor(256 * np.vstack([vectors, vectors[1]])).astype(np.int64)
    wanted = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q]
        best = [x for x in np.lexsort((ids, -s)) if x != q][:5]
        wanted |= {(ids[q], i + 1, ids[x], s[x]) for i, x in enumerate(best)}
    assert {tuple(r) for r in got} == wanted
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_over_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 64)
    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, (400, 4))
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(m)]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    wanted = set()
    for q in range(0, 400, 50):
        s = m @ m[q]
        wanted |= {(q, i + 1, int(x), int(s[x])) for i, x in enumerate([x for x in np.lexsort((np.arange(400), -s)) if x != q][:5])}
    assert got == wanted


def test_large_rows_are_blocks_of_their_own():
    """One row beyond the slices: the others of its batch keep their bitmaps."""
    import pyarrow as pa

    rows = [[1.0, 2.0]] * 5 + [[1e300, 0.0]] + [[3.0, 4.0]] * 4
    b = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(rows, pa.list_(pa.float64())), pa.array(range(10))], names=["vec_id", "v", "rid"])
    built = [r for x in topk._build([b]) for r in x.to_pylist()]
    assert [(r["ids"], bool(r["slices"])) for r in built] == [([0, 1, 2, 3, 4, 6, 7, 8, 9], True), ([5], False)]


def test_top_k_of_large_and_empty_vectors(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [3.0, 4.0]), (3, [-1e300, 1.0]), (4, []), (50, [2.0, -1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    exact = {i: [int(x) * 256 for x in v] + [0] * (2 - len(v)) for i, v in rows}
    for q in (0, 50):
        score = {i: sum(a * b for a, b in zip(exact[q], v, strict=True)) for i, v in exact.items() if i != q}
        for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), 1):
            assert got[q, rank] == (i, max(-(2**63), min(2**63 - 1, score[i])))


def test_numbers_sort_as_texts():
    n = [0, 5, -3, 10, -10, -2, 99, -99, 100, -100, 2**70, -(2**70)]
    assert sorted(n, key=topk.sort_key) == sorted(n)


def test_bundle_round_trip():
    writer = warc.BundleWriter()
    made = [warc.record(i, f"http://x/{i} y\n", b"p" * (i * 9000), hashlib.sha1(b"p" * (i * 9000)).hexdigest(), None) for i in range(60)]
    for rid, data in made:
        writer.add(rid, data)
    data = writer.finish()
    reader = warc.BundleReader(data)
    assert len(reader.frames) > 1
    head, payload = reader.find(made[41][0])
    assert payload == b"p" * (41 * 9000) and head["X-Page-ID"] == "41"
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == b"".join(d for _, d in made)
    with pytest.raises(ValueError):
        warc.BundleReader(data[:-1] + b"x")


def test_warc_pages(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", "x" * 1000)]
    bundles = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(bundles).collect()}
    for page_id, _, html in rows:
        b = (html or "").encode()
        revisit = html == big and page_id != 2
        assert got[page_id] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    assert warc.record_index(bundles).count() == len(rows)
    none = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_records(none).count() == 0


def test_kneser_ney_sums_to_one():
    counts = {"a": langid.grams(["abab", "abba", "cab"] * 5)[0]}
    keys, n = np.unique(counts["a"], return_counts=True)
    model = langid.Model({"a": (keys, n)})
    for ctx in np.unique(keys >> np.uint64(16)):
        total = np.exp2(model.score((ctx << np.uint64(16)) | model.chars, 0)).sum()
        assert 0.6 < total <= 1.0001  # the rest is left to unseen characters


def kneser_ney(words, chars):
    """Probability of a character after three others, by the formulas, from a language's words and the number of all characters."""
    tables = [Counter(("   " + w + " ")[j : j + 4] for w in words for j in range(len(w) + 1))]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))

    def p(gram, i=0):
        if i == 4:
            return 1 / (chars + 1)
        n = tables[i]
        ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        same = [v for g, v in n.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:], i + 1)
        return max(n.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:], i + 1)

    return p


def test_entropies_against_the_formulas(spark):
    rng = np.random.default_rng(8)
    say = lambda letters, n: ["".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(n)]
    texts = {"de": [" ".join(say("abcdß", 30)) for _ in range(3)], "en": [" ".join(say("abcef", 30)) for _ in range(3)]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)] + [(9, "abx cab ß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chars = len({c for ts in texts.values() for t in ts for c in t})  # with the space, which ends words
    brute = {lang: kneser_ney([w for t in ts for w in t.split()], chars) for lang, ts in texts.items()}
    got = langid.predict(docs, langid.train(docs, rest=-1)).collect()
    for r, (_, text, _) in zip(sorted(got), rows, strict=True):
        grams = [("   " + w + " ")[j : j + 4] for w in text.split() for j in range(len(w) + 1)]
        bits = {lang: -sum(np.log2(p(g)) for g in grams) / len(grams) for lang, p in brute.items()}
        assert r["lang_pred"] == min(bits, key=bits.get) and r["n_letters"] == len(grams)
        assert abs(r["bits"] - min(bits.values())) < 1e-5


def test_a_model_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    found = []
    for most in (8_000_000, 0):
        monkeypatch.setattr(langid, "MODEL_GRAMS", most)
        monkeypatch.setattr(langid, "SHARD_CELLS", 20_000)
        trained = langid.train(docs)
        assert (trained.model is None) == (most == 0)
        found.append({r["doc_id"]: r for r in langid.predict(docs, trained).collect()})
    for i, r in found[0].items():
        assert (r["lang_pred"], r["n_letters"], r["rejected"]) == tuple(found[1][i][c] for c in ("lang_pred", "n_letters", "rejected"))
        assert r["bits"] is None or abs(r["bits"] - found[1][i]["bits"]) < 1e-5


def test_limits_follow_language_and_length(spark):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 7))) for _ in range(n))
    rows = [(i, say(int(rng.integers(2, 300))), "en") for i in range(200)]
    trained = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rest=-1)
    assert set(trained.means) == {"en"} and trained.spread == sorted(trained.spread, reverse=True)
    probe = spark.createDataFrame([(1, say(3)), (3, "zzqx kwvy " * 60), (4, say(200))], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in langid.predict(probe, trained).collect()} == {1: False, 3: True, 4: False}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rows = langid.predict(docs, model, keep=("lang",)).where(langid.held_out(F.col("doc_id"), 4, 2)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "\U0001f642\U0001f642 \U0001f642", "en"), (None, "the and of", "en"), (5, "der die das " * 5000, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3, 4)} == {"und"}
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert got[5]["lang_pred"] == "de"
    nothing = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_marks_are_parts_of_words():
    """Vowel signs and decomposed accents stay in their words; a mark without a letter is none."""
    keys = lambda w: langid.grams([w])[0].tolist()
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"
    assert len(keys(hindi)) == len(hindi) + 1
    assert len(keys("e\u0301te\u0301")) == 6
    assert keys("\u0301") == keys("") == keys("1\u0301") and keys("a \u0301") == keys("a ")
    assert keys("stra\u00dfe") == keys("STRA\u00dfE")


@pytest.mark.parametrize("langs", [(None, None), ("en", "de")])
def test_language_id_with_nothing_to_learn(spark, langs):
    """No lang at all, or no letter in any text."""
    texts = ("one two three", "eins zwei") if langs == (None, None) else ("1 2 3", "!!")
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    rows = langid.predict(docs, langid.train(docs)).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in rows} == {("und", 0.0, True)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
    return new


def test_automaton_agrees_with_edit_distances():
    terms = ["loser", "idiot", "scum", "disgustingly", "lowe*"]
    trie = toxicity.Trie(terms)
    rng = np.random.default_rng(3)
    for _ in range(3000):
        word = list(terms[rng.integers(len(terms))].rstrip("*"))
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(word) + 1)
            kind = rng.integers(3)
            word[at : at + (kind > 0)] = list("abcdefghilostu"[rng.integers(14)]) if kind < 2 else []
        word = "".join(word)
        wanted = None
        for i, t in enumerate(terms):
            core = t.rstrip("*")
            d = min(edit_distance(word[:n], core) for n in range(len(word) + 1)) if t.endswith("*") else edit_distance(word, core)
            if d <= toxicity.allowed_edits(core):
                found = (d, -len(core), i)
                wanted = found if wanted is None or found < wanted else wanted
        assert trie.match(word) == (wanted and (wanted[2], wanted[0])), word


def test_toxicity_learns_misspells_and_quotes(spark):
    rng = np.random.default_rng(5)
    plain = lambda n: " ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 7))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, plain(30) + (" you blorgle snurfed " if bad else " ") + plain(30)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = [(1, f"{plain(9)} you blorgle {plain(9)}"), (2, plain(20)), (3, f"{plain(9)} you blorgel snurfd {plain(9)}"), (4, None), (5, ""), (6, f'{plain(9)} he said "blorgle" {plain(9)}')]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), scorer).collect()}
    assert got[1] > 0.5 > got[2]
    assert got[6] < got[1]
    assert got[4] == got[5] < 0.5
    unlabelled = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, unlabelled).collect()} == {0.0}


def test_learning_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = [toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (2, 5)]
    assert found[0].trie.terms == found[1].trie.terms and np.array_equal(found[0].weights, found[1].weights)
    assert np.array_equal(found[0].model[0], found[1].model[0]) and found[0].model[1] == found[1].model[1]


def test_copies_weigh_as_one_text(spark):
    rows = [("one two three four five six", 1)] * 4 + [("seven eight nine ten eleven twelve", 0), ("", 0)]
    got = {(r["text"], r["toxic"]): r["w"] for r in toxicity.weighted(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert got == {rows[0]: toxicity.UNIT // 4, rows[4]: toxicity.UNIT, rows[5]: toxicity.UNIT}


def test_scores_against_brute_force(spark):
    """The features of every text, word by word and by edit distances, give the query's scores."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(docs, labels)
    if scorer.model is None:
        scorer = toxicity.Scorer([("idiot", 3.0), ("moron", 2.5), ("disgusting", 4.0)])
        scorer.model = (np.arange(1.0, 7.0) / 10, -1.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    terms = [t.rstrip("*") for t in scorer.trie.terms]

    def hit(word):
        found = []
        for i, (term, core) in enumerate(zip(scorer.trie.terms, terms, strict=True)):
            if term.endswith("*"):
                d = min(edit_distance(word[:n], core) for n in range(len(word) + 1))
            else:
                d = edit_distance(word, core)
            if d <= toxicity.allowed_edits(core):
                found.append((d, -len(core), i))
        return min(found, default=None)

    cache = {}
    for r in docs.collect():
        words = (r["text"] or "").split()
        clean = [toxicity.normal(w) for w in words]
        for c in clean:
            if c not in cache:
                cache[c] = hit(c) if c else None
        f, seen = np.zeros(6), set()
        for at, c in enumerate(clean):
            if cache[c] is None:
                continue
            lo, hi = max(0, at - 8), min(len(words), at + 9)
            opens = any(w[0] in toxicity.QUOTES for w in words[lo : at + 1])
            closes = any((w.rstrip(".,;:!?") or " ")[-1] in toxicity.QUOTES for w in words[at:hi])
            quoted = (opens and closes) or any(x in toxicity.REPORTS for x in clean[lo:hi])
            edits, _, term = cache[c]
            w = scorer.weights[term, edits]
            new = (term, edits) not in seen
            seen.add((term, edits))
            f[0] += w * new * (not quoted)
            f[1] = max(f[1], 0 if quoted else w)
            f[2] += w * new * quoted
            f[3] += min(sum(cache[x] is not None for x in clean[lo:hi]) - 1, 2) * (not quoted)
            f[4] += any(x in toxicity.ADDRESS for x in clean[lo:hi]) and not quoted
            f[5] += 1
        f = np.array([np.log1p(f[0]), f[1], *np.log1p(f[2:5]), np.log1p(100 * f[5] / max(len(words), 1))])
        weight, bias = scorer.model
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(f @ weight + bias, -30, 30)))) < 1e-9
