"""Toxicity by Levenshtein automata on a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and word beginnings, that
stand far more often in toxic texts than in others. It is kept as a trie. Each
distinct word of a batch is intersected with the trie through its Levenshtein
automaton: the automaton's states run down the trie's edges and die with more
than the term's allowed edits, so misspelled terms are found without
comparing a word with every term.

A hit is weighed by how its term (spelled rightly or not) divides the labels,
and by its context window: quotation marks and reporting words around it mark a
quotation, which counts less; other hits and words of address close by count
more. A logistic model turns the logarithms of the text's sums into the score. All learning uses
at most about ``FIT_ROWS`` labelled rows, picked by a hash of their doc_id; scoring
takes whole texts.

Copies of one text, exact or near, would make its plain words look like terms. So
a labelled row weighs 1/n, where n is the most rows that share one of its
``COPY_KEYS`` least shingle hashes: a text without copies weighs 1 and a group of
copies about as much as one text. No row is left out. Weights are whole
millionths and sums of them exact, so what is learned does not depend on how rows
are partitioned or ordered.

Defined results: null and empty texts have no hits and get the base score; a
null doc_id is never learned from and counts as not held out; repeated labels
of one doc_id count once, as toxic if any is; with no labels to learn from
every score is 0; repeated rows are scored alike; texts of any length count whole;
terms of equal weight are taken in code-point order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import drop, materialize
from lamina.llm.langid import _words, held_out
from lamina.llm.near import shingles
from lamina.llm.packing import chunks

#: Labelled rows used for learning, about, at most.
FIT_ROWS = 40_000
#: Least rows (by weight) that hold a term, its least share of the toxic ones in per cent, and the weight of one row.
MIN_DOCS = 5
MIN_SHARE = 1
UNIT = 1_000_000
COPY_KEYS = 4
MIN_WEIGHT = 2.5
PREFIXES = (4, 5, 6)
WINDOW = 8
CACHED_WORDS = 200_000
QUOTES = "\"'“”„«»‘’‹›"
#: Words that report speech, and words of address, by default (fixed values); both are parameters of ``train``.
REPORTS = frozenset("said says say wrote writes quote quoted quotes called calls word words sagte sagt schrieb zitat wort dit écrit mot citation dijo dice escribió palabra cita".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir ihr tu te toi vous tú usted ustedes vosotros".split())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    return _EDGES.sub("", word.lower())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Trie:
    """Terms with their numbers; a term that ends in ``*`` matches word beginnings."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.root: dict = {}
        self.parts: dict[tuple[int, int], set[str]] = {}  # (place, length) -> what a near word may hold there
        for i, term in enumerate(terms):
            core = term.rstrip("*")
            k, node = allowed_edits(core), self.root
            node["most"] = max(node.get("most", 0), k)
            for c in core:
                node = node.setdefault(c, {})
                node["most"] = max(node.get("most", 0), k)
            node.setdefault("ends", []).append((i, term.endswith("*"), k))
            # A word within k edits of a term keeps one of the term's k + 1 parts unchanged, moved by k places at most.
            for j in range(k + 1):
                at, to = j * len(core) // (k + 1), (j + 1) * len(core) // (k + 1)
                for place in range(max(0, at - k), at + k + 1) if j else (0,):
                    self.parts.setdefault((place, to - at), set()).add(core[at:to])
        self.longest = max((len(t.rstrip("*")) for t in terms), default=0) + self.root.get("most", 0) + 1
        self.tests = [(p, p + n, found) for (p, n), found in sorted(self.parts.items())]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term: fewest edits, then the longest, then the first."""
        word = word[: self.longest]  # what follows changes no term's verdict
        for i, j, found in self.tests:
            if word[i:j] in found:
                break
        else:
            return None
        best: tuple | None = None
        n, most = len(word), self.root["most"]
        # The automaton's state is the row of edit distances to the word's beginnings, cut at most + 1.
        stack = [(self.root, tuple(range(min(n, most) + 1)) + (most + 1,) * (n - min(n, most)), 0)]
        while stack:
            node, row, depth = stack.pop()
            for i, prefix, k in node.get("ends", ()):
                edits = min(row) if prefix else row[n]
                if edits <= k:
                    best = min(best or (9, 0, 0), (edits, -depth, i))
            for c, child in node.items():
                if len(c) > 1:
                    continue
                limit = child["most"]
                first = row[0] + 1
                new, low = [first], first
                for j in range(1, n + 1):
                    x = row[j - 1] + (word[j - 1] != c)
                    y = row[j] + 1
                    z = new[j - 1] + 1
                    x = x if x < y else y
                    x = x if x < z else z
                    new.append(x)
                    low = x if x < low else low
                if low <= limit:
                    stack.append((child, tuple(new), depth + 1))
        return best and (best[2], best[0])


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` (text, toxic) with ``w``, the weight of each in units of 1 / ``UNIT``; materialized."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(COPY_KEYS)
        xor, odd = rng.integers(0, 1 << 64, (2, COPY_KEYS), np.uint64)
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text").cast(pa.binary())]
            least = [((s[:, None] ^ xor) * (odd | np.uint64(1))).min(0).view(np.int64).tolist() if len(s) else [0] * COPY_KEYS for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(least, pa.list_(pa.int64()))], names=["row", "keys"])

    fit = materialize(rows.select("text", "toxic", F.monotonically_increasing_id().alias("row")), "toxicity-rows")
    found = materialize(fit.select("row", "text").mapInArrow(keys, "row long, keys array<long>"), "toxicity-keys").select("row", F.posexplode("keys").alias("i", "key"))
    alike = found.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n"))
    most = found.join(alike, ["i", "key"]).groupBy("row").agg(F.max("n").alias("n"))
    return materialize(fit.join(most, "row").select("text", "toxic", F.round(F.lit(UNIT) / F.col("n")).cast("long").alias("w")), "toxicity-fit")


def _sizes(fit: DataFrame) -> tuple[float, float]:
    """The weight of toxic and of other rows."""
    sums = {r["toxic"]: r["w"] / UNIT for r in fit.groupBy("toxic").agg(F.sum("w").alias("w")).collect()}
    return sums.get(1, 0.0), sums.get(0, 0.0)


def lexicon(fit: DataFrame) -> list[tuple[str, float]]:
    """(term, weight) learned from ``fit`` (text, toxic, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            index, words, offsets = _words(b.column("text"))
            clean = [normal(w) for w in words]
            toxic = b.column("toxic").to_pylist()
            weight = b.column("w").to_pylist()
            number: dict[str, int] = {}
            of_word = [
                [number.setdefault(t, len(number)) for t in ([w, *(w[:p] + "*" for p in PREFIXES if len(w) > p)] if len(w) > 2 else [])] for w in clean
            ]
            counts = np.zeros((len(number), 2), np.int64)
            for i, (t, n) in enumerate(zip(toxic, weight, strict=True)):
                seen = np.unique(index[offsets[i] : offsets[i + 1]])
                terms = np.unique(np.fromiter((x for w in seen.tolist() for x in of_word[w]), np.int64))
                counts[terms, t] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(number)), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["term", "bad", "good"])

    counted = fit.select("text", "toxic", "w").mapInArrow(run, "term string, bad long, good long").groupBy("term")
    counted = counted.agg((F.sum("bad") / UNIT).alias("bad"), (F.sum("good") / UNIT).alias("good"))
    bad, good = _sizes(fit)
    if not bad:
        return []
    weight = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # A term stands in MIN_SHARE per cent of the toxic texts at least: at most 100 / MIN_SHARE times the words and beginnings of an average one.
    rows = (
        counted.where((F.col("bad") >= MIN_DOCS) & (F.col("bad") * 100 >= MIN_SHARE * bad))
        .withColumn("w", weight)
        .where(F.col("w") >= MIN_WEIGHT)
        .orderBy((F.col("w") * F.col("bad")).desc(), "term")
        .collect()
    )
    chosen: dict[str, tuple[float, int]] = {r["term"]: (r["w"], r["bad"]) for r in rows}
    out = []
    for term, (w, n) in chosen.items():
        core = term.rstrip("*")
        above = [core[:p] + "*" for p in PREFIXES if p < len(core) or (p == len(core) and not term.endswith("*"))]
        # A beginning stands for its longer terms where it divides the labels as well and is met clearly more often.
        if any(a in chosen and chosen[a][0] >= 0.8 * w and chosen[a][1] >= 1.2 * n for a in above):
            continue
        if term.endswith("*") and any(t != term and not t.endswith("*") and t.startswith(core) and v[1] >= 0.9 * n for t, v in chosen.items()):
            continue  # one word makes this beginning; the word itself says more
        out.append((term, w))
    return sorted(out)


class Scorer:
    def __init__(self, terms: list[tuple[str, float]], reports: frozenset[str] = REPORTS, address: frozenset[str] = ADDRESS):
        self.reports, self.address = reports, address
        self.trie = Trie([t for t, _ in terms])
        self.weights = np.array([[w, 0.5 * w, 0.25 * w] for _, w in terms]).reshape(-1, 3)
        self.model: tuple[np.ndarray, float] | None = None
        self.cache: dict[str, tuple[int, int] | None] = {}

    def hit(self, word: str) -> tuple[int, int] | None:
        if word in self.cache:
            return self.cache[word]
        found = self.trie.match(word)
        if found is not None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def features(self, texts: pa.Array) -> tuple[np.ndarray, list[dict]]:
        """(texts, 6) sums of every text, and the hits of each by (term, edits) for reweighing."""
        index, words, offsets = _words(texts)
        n = len(offsets) - 1
        clean = [normal(w) for w in words]
        hits = [self.hit(c) if c else None for c in clean]
        is_hit = np.array([h is not None for h in hits], bool)
        out, seen = np.zeros((n, 6)), [{} for _ in range(n)]
        places = np.flatnonzero(is_hit[index]) if len(words) else np.empty(0, np.int64)
        text_of = np.searchsorted(offsets, places, side="right") - 1
        for at, t in zip(places.tolist(), text_of.tolist(), strict=True):
            lo, hi = max(int(offsets[t]), at - WINDOW), min(int(offsets[t + 1]), at + WINDOW + 1)
            near = index[lo:hi].tolist()
            around = [clean[w] for w in near]
            quoted = self._quoted([words[w] for w in near], at - lo) or any(a in self.reports for a in around)
            address = any(a in self.address for a in around)
            others = sum(1 for w in near if is_hit[w]) - 1
            term, edits = hits[index[at]]
            w = self.weights[term, edits]
            key = (term, edits)
            new = key not in seen[t]
            seen[t][key] = seen[t].get(key, 0) + 1
            f = out[t]
            f[0] += w * new * (not quoted)
            f[1] = max(f[1], 0.0 if quoted else w)
            f[2] += w * new * quoted
            f[3] += min(others, 2) * (not quoted)
            f[4] += address and not quoted
            f[5] += 1
        length = np.maximum(np.diff(offsets), 1)
        out[:, [0, 2, 3, 4]] = np.log1p(out[:, [0, 2, 3, 4]])
        out[:, 5] = np.log1p(100 * out[:, 5] / length)
        return out, seen

    @staticmethod
    def _quoted(near: list[str], at: int) -> bool:
        """A quotation mark opens at or before the hit and one closes at or after it."""
        return any(w[:1] in QUOTES for w in near[: at + 1] if w) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in near[at:] if w.rstrip(".,;:!?"))

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(features))
        w, bias = self.model
        return 1 / (1 + np.exp(-np.clip(features @ w + bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression of rows that count ``times`` each, by Newton steps."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([*[1e-2] * x.shape[1], 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (times * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, reports: frozenset[str] = REPORTS, address: frozenset[str] = ADDRESS) -> Scorer:
    """Learn from labelled rows whose crc32(doc_id as text) modulo ``mod`` is not ``rest``."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, FIT_ROWS / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(marks, "doc_id").where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1))
    fit = weighted(rows.select("text", "toxic"))
    terms = lexicon(fit)
    scorer = Scorer(terms, reports, address)
    if not terms:
        return scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            f, seen = scorer.features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), b.column("w"), *(pa.array(f[:, i]) for i in range(6)), pa.array([[k[0] * 3 + k[1] for k in s] for s in seen], pa.list_(pa.int32()))],
                names=["toxic", "w", *(f"f{i}" for i in range(6)), "hits"],
            )

    schema = "toxic int, w long, " + ", ".join(f"f{i} double" for i in range(6)) + ", hits array<int>"
    # What every (term, edits) says about the labels replaces the first guess of the misspelled ones.
    found = fit.select("text", "toxic", "w").mapInArrow(run, schema)
    counts = (
        found.select("toxic", "w", F.explode("hits").alias("hit")).groupBy("hit")
        .agg((F.sum(F.col("toxic") * F.col("w")) / UNIT).alias("bad"), (F.sum("w") / UNIT).alias("n")).collect()
    )
    bad, good = _sizes(fit)
    for r in counts:  # at most three a term
        term, edits = divmod(r["hit"], 3)
        if edits:
            learned = np.log((r["bad"] + 0.5) / (bad + 1.0)) - np.log((r["n"] - r["bad"] + 0.5) / (good + 1.0))
            scorer.weights[term, edits] = max(0.0, min(learned, scorer.weights[term, 0]))
    # Plain cells, so that rows without hits are one group: the collected rows are fewer than FIT_ROWS.
    cells = [F.round(f"f{i}", 3).alias(f"f{i}") for i in range(6)]
    rows = sorted(found.groupBy("toxic", *cells).agg((F.sum("w") / UNIT).alias("w")).collect())
    drop(fit)
    x = np.array([r[1:7] for r in rows], float)
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        scorer.model = _logistic(x, y, np.array([r["w"] for r in rows]))
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of every row."""
    scorer.cache = {}
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the lexicon, bounded as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.scores(s.features(b.column("text"))[0]))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
