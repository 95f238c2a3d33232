"""Language ID by interpolated Kneser-Ney character models.

Texts are split at white space, lower-cased, and every character that is no
letter, nor a combining mark after one, becomes a word boundary. Four-grams of characters are counted per
language over all training texts; lower orders are continuation counts derived
from the distinct four-grams, as Kneser-Ney asks, and discounts from the whole
tables. The model keeps, per language and order, the sorted keys of its n-grams
with their log-probabilities, and the sorted contexts with their back-off
weights; unseen n-grams back off through these. Memory grows with the n-grams
of the languages, not with their product.

A text gets the language of the lowest cross-entropy per character. Its score is
the posterior of that language at equal priors, with the evidence counted as if
the text had ``EVIDENCE`` characters at most, so that scores of long texts differ.
It is rejected where it has no letter, or where its cross-entropy lies above a
limit: the mean of its language's training texts times ``1 + SLACK`` times the
``ACCEPT`` quantile, over all training texts of its length or longer, of a text's
cross-entropy over the mean of its language. Lengths are classes by powers of two,
so short texts, whose cross-entropy varies more, have a wider limit of their own. A
text shorter than any training text's class has nothing to be held against and is
kept. Every training text counts, in the means and in the quantiles.

A model of up to ``MODEL_GRAMS`` four-grams is broadcast. A larger one never
comes together in one place: the distinct four-grams of the texts meet the
counts in joins by key, all orders of the interpolation included, and the
log-probabilities so found are broadcast in shards of the key's hash, one pass
over the texts each, whose sums add up to the same cross-entropies.

Defined results: null text, and text without letters, is ``und`` with score 0;
letters beyond the first plane count as one letter; rows with a null lang or null
doc_id are never learned from; with nothing to learn from every text is ``und``;
between languages of equal cross-entropy the first in code-point order wins; texts
of any length count whole; repeated rows are judged alike; an empty table gives an
empty result; columns to keep may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import drop, materialize
from lamina.llm.packing import chunks

ORDER = 4
ACCEPT = 0.999
SLACK = 0.25
EVIDENCE = 50
#: Distinct four-grams, of all languages together, of a model that is broadcast; and those of one shard of a larger one, times languages.
MODEL_GRAMS = 8_000_000
SHARD_CELLS = 16_000_000
UNKNOWN = "und"
BOUNDARY = 32


#: What stands for every letter beyond the first plane: a code point that is no character.
OTHER = 0xFFFE


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> itself if it is a letter or a combining mark (beyond the first plane ``OTHER``), else the boundary; and which are marks."""
    mark = np.array([unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x110000)])
    return np.array([(c if c < 0x10000 else OTHER) if mark[c] or chr(c).isalpha() else BOUNDARY for c in range(0x110000)], np.uint64), mark


def _known(code: np.ndarray) -> np.ndarray:
    """Letters, and marks that follow one; all else is the boundary."""
    letters, mark = _letters()
    out, is_mark = letters[code], mark[code]
    if is_mark.any():
        base = np.maximum.accumulate(np.where(is_mark, 0, np.arange(len(code))))
        out[is_mark & (is_mark[base] | (out[base] == BOUNDARY))] = BOUNDARY
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): the four-grams of each word one after another, and how many each word has."""
    text = "".join(["   " + w + " " for w in words]).lower() if words else ""
    if len(text) != sum(map(len, words)) + 4 * len(words):  # lower-casing changed a length
        words = [w.lower() for w in words]
        text = "".join(["   " + w + " " for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    code = _known(code)
    n = len(code)
    if n < 4:
        return np.empty(0, np.uint64), np.zeros(len(words), np.int64)
    keys = code[: n - 3] << np.uint64(48) | code[1 : n - 2] << np.uint64(32) | code[2 : n - 1] << np.uint64(16) | code[3:]
    ok = (code[3:] != BOUNDARY) | (code[2 : n - 1] != BOUNDARY)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 4)
    # A four-gram belongs to the word that holds its last character; none but the boundary's crosses into a word.
    upto = np.concatenate([[0, 0, 0, 0], np.cumsum(ok)])
    counts = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
    return keys[ok], counts


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(word numbers in a row, the distinct words, where each text begins)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    d = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist(), offsets - offsets[0]


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, key, n) over all texts of ``train`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = merge(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for b in chunks(batches):
            index, words, offsets = _words(b.column("text"))
            keys, counts = grams(words)
            of = np.repeat(np.arange(len(words)), counts)
            langs = b.column("lang").dictionary_encode()
            row_lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
            unique, inverse = np.unique(keys, return_inverse=True)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                weight = np.bincount(index[row_lang == i], minlength=len(words))
                n = np.bincount(inverse, weight[of], len(unique)).astype(np.int64)
                parts = held.setdefault(lang, [])
                parts.append((unique[n > 0], n[n > 0]))
                if len(parts) >= 8:
                    held[lang] = [merge(parts)]
                    if len(held[lang][0][0]) > 2_000_000:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    counted = train.select("text", "lang").mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _estimate(keys: np.ndarray, n: np.ndarray) -> tuple[list, list]:
    """Per order, (keys, discounted share) and (contexts, weight of the lower order)."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.float64)
    shares, weights = [], []
    for i in range(ORDER):
        discount = _discount(float((n == 1).sum()), float((n == 2).sum()))
        c, first = np.unique(keys >> np.uint64(16), return_index=True)
        total = np.add.reduceat(n, first) if len(n) else n
        kinds = np.diff(np.append(first, len(keys)))
        shares.append((keys, np.maximum(n - discount, 0) / np.repeat(total, kinds)))
        weights.append((c, discount * kinds / total))
        if i < ORDER - 1:  # continuation counts: in how many ways a shorter n-gram is preceded
            keys, cont = np.unique(keys & _mask(i + 1), return_counts=True)
            n = cont.astype(np.float64)
    return shares, weights


def _discount(ones: float, twos: float) -> float:
    return min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))


def _mask(order: int) -> np.uint64:
    """The bits of an n-gram's last ``ORDER - order`` characters."""
    return np.uint64((1 << 16 * (ORDER - order)) - 1)


class Model:
    """Log-probabilities of n-grams in every language, as sorted arrays of each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        tables = [_estimate(*counts[x]) for x in self.langs]
        self.chars = np.unique(np.concatenate([t[0][-1][0] for t in tables])) if tables else np.empty(0, np.uint64)
        self.floor = -np.log2(len(self.chars) + 1.0)
        self.grams = [[(t[0][i][0], self._log(t, i)) for i in range(ORDER)] for t in tables]
        self.contexts = [[(c, np.log2(w).astype(np.float32)) for c, w in t[1]] for t in tables]

    def _log(self, table: tuple[list, list], order: int) -> np.ndarray:
        keys = table[0][order][0]
        p = np.full(len(keys), 1.0 / (len(self.chars) + 1))
        for i in range(ORDER - 1, order - 1, -1):
            k = keys & _mask(i) if i else keys
            p = _get(table[0][i], k, 0.0) + _get(table[1][i], k >> np.uint64(16), 1.0) * p
        return np.log2(p).astype(np.float32)

    def score(self, keys: np.ndarray, lang: int, order: int = 0) -> np.ndarray:
        """Log-probabilities of the last characters of n-grams in a language."""
        if order == ORDER:
            return np.full(len(keys), self.floor, np.float32)
        known, logs = self.grams[lang][order]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        found = known[at] == keys
        out = logs[at]
        if not found.all():
            miss = keys[~found]
            out[~found] = self.score(miss & _mask(order + 1), lang, order + 1) + _get(self.contexts[lang][order], miss >> np.uint64(16), 0.0)
        return out

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """(n, languages) of any keys."""
        if not self.langs:
            return np.zeros((len(keys), 0))
        unique, inverse = np.unique(keys, return_inverse=True)
        return np.stack([self.score(unique, j) for j in range(len(self.langs))], 1)[inverse]


class Shard:
    """Log-probabilities, in every language, of the four-grams of one shard of a larger model; others count 0."""

    def __init__(self, langs: list[str], keys: np.ndarray, logs: np.ndarray):
        self.langs, order = langs, np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def scores(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros((len(keys), len(self.langs)), np.float32)
        return np.where((self.keys[at] == keys)[:, None], self.logs[at], np.float32(0))


def log_sums(model: Model | Shard, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) sums of the log-probabilities of a text's characters, and how many it has."""
    index, words, offsets = _words(texts)
    keys, counts = grams(words)
    ends = np.concatenate([[0], np.cumsum(counts)])
    per_word = np.zeros((len(words), len(model.langs)))
    for i in range(0, len(keys), 1 << 20):  # bounded memory
        part = model.scores(keys[i : i + (1 << 20)]).astype(np.float64)
        upto = np.concatenate([np.zeros((1, part.shape[1])), np.cumsum(part, 0)])
        at = np.clip(ends - i, 0, len(part))
        per_word += upto[at[1:]] - upto[at[:-1]]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = np.bincount(text, counts[index], len(offsets) - 1)
    sums = [np.bincount(text, per_word[index, j], len(offsets) - 1) for j in range(len(model.langs))]
    return np.stack(sums, 1) if sums else np.zeros((len(n), 0)), n.astype(np.int64)


def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], default)


@dataclass
class Trained:
    """What is learned: the languages, their four-gram counts (lang, key, n), the model where it may be broadcast, and the limits."""

    langs: list[str]
    counted: DataFrame
    model: Model | None
    means: dict[str, float] = field(default_factory=dict)
    #: Widest accepted cross-entropy over the mean, by length class.
    spread: list[float] = field(default_factory=list)

    def limit(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The limits of texts of the languages numbered ``best`` with ``n`` characters."""
        if not self.langs:
            return np.full(len(n), np.inf)
        means = np.array([self.means.get(x, np.inf) for x in self.langs])
        spread = np.array([*(self.spread or [np.inf]), np.inf])
        at = np.minimum(np.log2(np.maximum(n, 1)).astype(int), len(spread) - 2)
        return means[np.minimum(best, len(means) - 1)] * spread[at] * (1 + SLACK)


def train(docs: DataFrame, mod: int = 4, rest: int = 2) -> Trained:
    """Learn from every row whose crc32(doc_id as text) modulo ``mod`` is not ``rest``."""
    fit = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    counted = materialize(gram_counts(fit), "langid-grams")
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}  # one row a language
    trained = Trained(sorted(sizes), counted, None)
    if sum(sizes.values()) <= MODEL_GRAMS:
        arrays: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in trained.langs:
            part = counted.where(F.col("lang") == lang).select("key", "n").toArrow()  # MODEL_GRAMS rows at most
            arrays[lang] = (part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy())
        trained.model = Model(arrays)
    seen = predict(fit.select("doc_id", "text", "lang"), trained, keep=("lang",)).where("lang_pred = lang AND n_letters > 0")
    seen = materialize(seen.select("lang", "bits", F.floor(F.log2("n_letters")).cast("int").alias("class")), "langid-seen")
    mean = seen.groupBy("lang").agg((F.sum(F.col("bits").cast("decimal(38,9)")).cast("double") / F.count("bits")).alias("mean"))
    trained.means = {r["lang"]: r["mean"] for r in mean.collect()}  # one row a language
    if trained.means:
        of_lang = F.coalesce(*[F.when(F.col("lang") == x, F.lit(m)) for x, m in trained.means.items()])
        found = seen.groupBy("class").agg(F.percentile_approx(F.col("bits") / of_lang, ACCEPT, 100_000).alias("q")).collect()  # a row a power of two
        widest, quantile = 0.0, {r["class"]: r["q"] for r in found}
        for c in range(max(quantile), -1, -1):
            widest = max(widest, quantile.get(c, 0.0))
            trained.spread.insert(0, widest if c >= min(quantile) else np.inf)
    drop(seen)
    return trained


def predict(docs: DataFrame, trained: Trained, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score, bits (per character), n_letters, rejected of every row."""
    types = dict(docs.dtypes)
    schema = "doc_id long" + "".join(f", `{c}` {types[c]}" for c in keep) + ", lang_pred string, score double, bits double, n_letters long, rejected boolean"
    lean = Trained(trained.langs, None, trained.model, trained.means, trained.spread)
    shared = docs.sparkSession.sparkContext.broadcast(lean)  # MODEL_GRAMS four-grams at most

    def judged(b: pa.RecordBatch, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        m: Trained = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        known = (n > 0) & (len(m.langs) > 0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            bits = -sums / n[:, None]
            best = np.where(known, bits.argmin(1) if len(m.langs) else 0, len(m.langs))
            least = np.where(known, bits.min(1) if len(m.langs) else np.nan, np.nan)
            score = np.where(known, 1 / np.exp2(-(bits - least[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1), 0.0)
            rejected = ~known | (least > m.limit(best, n))
        out = [b.column("doc_id"), *(b.column(c) for c in keep), pa.array(names[best]), pa.array(np.nan_to_num(score))]
        out += [pa.array(least, mask=~known), pa.array(n), pa.array(rejected)]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", *keep, "lang_pred", "score", "bits", "n_letters", "rejected"])

    if trained.model is None and trained.langs:
        kept = docs.select(*dict.fromkeys(("doc_id", "text", *keep)), F.monotonically_increasing_id().alias("row__"))
        summed = sharded_sums(materialize(kept, "langid-docs"), trained)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sums = b.column("sums__").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield judged(b, sums, b.column("n__").to_numpy())

        return summed.mapInArrow(run, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model or Model({})
        for b in chunks(batches):
            yield judged(b, *log_sums(model, b.column("text")))

    return docs.select(*dict.fromkeys(("doc_id", "text", *keep))).mapInArrow(run, schema)


def log_table(wanted: DataFrame, counted: DataFrame, langs: list[str]) -> DataFrame:
    """(key, logs): of each four-gram of ``wanted`` (key) its log-probability in every language, by joins with ``counted`` (lang, key, n)."""
    spark = wanted.sparkSession
    up = lambda c: F.shiftrightunsigned(c, 16)
    orders = [counted]
    for i in range(1, ORDER):
        shorter = F.col("key").bitwiseAND(F.lit(int(_mask(i))))
        orders.append(materialize(orders[-1].groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("n")), "langid-order"))
    chars = orders[-1].select("key").distinct().count()
    names = spark.createDataFrame([(x,) for x in langs], "lang string")  # a row a language
    p = wanted.crossJoin(F.broadcast(names)).withColumn("p", F.lit(1.0 / (chars + 1)))
    for i in range(ORDER - 1, -1, -1):
        table = orders[i]
        met = {r["lang"]: _discount(float(r["ones"]), float(r["twos"])) for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}  # a row a language
        discount = F.coalesce(*[F.when(F.col("lang") == x, F.lit(d)) for x, d in met.items()])
        contexts = table.groupBy("lang", up(F.col("key")).alias("c")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        own = F.col("key").bitwiseAND(F.lit(int(_mask(i)))) if i else F.col("key")
        p = p.withColumn("k", own).withColumn("c", up(F.col("k")))
        p = p.join(contexts, ["lang", "c"], "left").join(table.select("lang", F.col("key").alias("k"), "n"), ["lang", "k"], "left")
        share = F.coalesce(F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        weight = F.coalesce(discount * F.col("kinds") / F.col("total"), F.lit(1.0))
        p = p.withColumn("p", share + weight * F.col("p")).select("key", "lang", "p")
    logs = F.transform(F.array_sort(F.collect_list(F.struct("lang", F.log2("p").alias("x")))), lambda s: s["x"])
    return p.groupBy("key").agg(logs.alias("logs"))


def sharded_sums(docs: DataFrame, trained: Trained) -> DataFrame:
    """``docs`` (row__, text, more) with sums__ and n__ as ``log_sums`` has them, in one pass a shard of the log-probabilities."""
    spark, langs = docs.sparkSession, trained.langs

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams(_words(b.column("text"))[1])[0]).view(np.int64))], names=["key"])

    logs = materialize(log_table(docs.select("text").mapInArrow(met, "key long").distinct(), trained.counted, langs), "langid-logs")
    shards = logs.count() * len(langs) // SHARD_CELLS + 1
    parts = None
    for i in range(shards):
        part = logs.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == i).toArrow()  # SHARD_CELLS cells, about
        values = part.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs)).astype(np.float32)
        shared = spark.sparkContext.broadcast(Shard(langs, part.column("key").to_numpy().view(np.uint64), values))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                sums, n = log_sums(shared.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("row__"), pa.array(list(sums), pa.list_(pa.float64())), pa.array(n)], names=["row__", "s", "n__"])

        done = materialize(docs.select("row__", "text").mapInArrow(run, "row__ long, s array<double>, n__ long"), "langid-sums")
        shared.destroy()
        parts = done if parts is None else parts.unionAll(done)
    sums = F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(len(langs))])
    return docs.join(parts.groupBy("row__").agg(sums.alias("sums__"), F.max("n__").alias("n__")), "row__")
