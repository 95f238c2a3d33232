"""Hierarchical multi-length packing.

Documents become token ids plus an end id. Whole windows of the longest tier
are cut from long documents; what is left of each document is routed to the
smallest context tier that holds it. Tiers are packed from long to short: each
window opens with the longest item of its tier, its gap takes the longest
shorter item that fits, again and again, and the last gap takes a cut of the
shortest item at hand. So every window but the last of a partition is exactly
full. What remains at the end of a partition is cut into windows of powers of
two down to ``LEAST``, and fewer ids than that form one padded sequence.

Full windows of one tier wait until they make ``STEPS`` step groups of
``STEP_TOKENS`` ids; sorted by attention cost (the sum of squared piece lengths)
they are dealt to these in serpentine order, so the groups have equal tokens and
cost alike. At the end of a partition the windows left of each tier fill whole
groups in the same way, and what then remains of all tiers, less than a group of
each, is dealt evenly to as many mixed groups as its ids need.

A partition is packed on its own, in one pass over its rows: there is no
shuffle, memory is bounded by ``FLUSH`` ids and one document, and a lost task
is repeated with the same result, as sequence ids hold the partition's number.

Defined results: a null or empty text is one piece holding the end id alone; a
null doc_id is kept; repeated rows are packed each; a very long text fills whole
windows and waits alone in memory; ties go to the row that was read first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (512, 1024, 2048, 4096)
LEAST = 256
#: Ids that wait before windows are packed from them.
FLUSH = 1 << 20
#: Token ids of one optimiser step, and step groups of a tier that are balanced together.
STEP_TOKENS = 1 << 17
STEPS = 8
#: Bytes of text encoded at once, and words kept encoded in a worker.
CHUNK_BYTES = 8 << 20
CACHED_WORDS = 500_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
)

#: White space to the splitter but not to the tokenizer: texts with these are encoded whole.
ODD_SPACE = "[\x1c-\x1f]"
_LATIN = "a-zß-öø-ÿā-įı-ɏ"
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


class WordBpe:
    """Ids of a byte-level BPE with word ends, encoded once per distinct word.

    White space ends words, so a text's ids are its words' ids joined. A word's
    pieces go through a rank-based merger in which a byte that no UTF-8 text
    holds stands for the word end; words with unusual characters go through the
    tokenizer itself.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        suffix = model["model"]["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {}
        for token, rank in model["model"]["vocab"].items():
            if token not in special:
                end = token.endswith(suffix) and token != suffix
                ranks[bytes(of_char[c] for c in (token[: -len(suffix)] if end else token)) + self.END * end] = rank
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        if _PLAIN.fullmatch(w) and "<|" not in w:
            ids: list[int] = []
            for piece in _PIECES.findall(w.lower()):
                ids += self.core.encode_single_piece(piece.encode() + self.END)
        else:
            ids = self.whole.encode(w, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more entry at the end)."""
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        cache, get = self.cache, self.cache.get
        known = []
        for w in words.dictionary.to_pylist():
            b = get(w)
            if b is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                b = cache[w] = self.word(w)
            known.append(b)
        lens = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        starts = np.cumsum(lens) - lens
        table = np.frombuffer(b"".join(known), "<u4")
        each = lens[index]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(starts[index] - (ends - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if odd.any():
            parts = [
                np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4") if o else ids[bounds[i] : bounds[i + 1]]
                for i, o in enumerate(odd)
            ]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


class Packer:
    """Packs items of one partition; ``out`` holds finished pieces as rows."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.next_id = self.next_step = partition << 33
        self.pool: list[tuple] = []  # (length, number, doc_id, start, ids, doc_tokens), sorted
        self.waiting = self.number = 0
        self.done: dict[int, list[tuple[int, list[tuple]]]] = {}  # by tier, windows (cost, pieces) not in a step yet
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.longest
        for at in range(0, whole, self.longest):
            self._finished(self.longest, [(self.longest, 0, doc_id, at, ids[at : at + self.longest], n)])
        if n > whole:
            self._put(doc_id, whole, ids[whole:].copy(), n)
        if self.waiting >= FLUSH:
            self.pack()

    def _put(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.number += 1
        self.waiting += len(ids)
        insort(self.pool, (len(ids), self.number, doc_id, start, ids, doc_tokens), key=lambda x: x[:2])

    def _take(self, i: int) -> tuple:
        item = self.pool.pop(i)
        self.waiting -= item[0]
        return item

    def _cut(self, item: tuple, n: int) -> tuple:
        """The first n ids of an item; the rest goes back."""
        _, number, doc_id, start, ids, total = item
        if n < len(ids):
            self._put(doc_id, start + n, ids[n:], total)
        return (n, number, doc_id, start, ids[:n], total)

    def _fill(self, window: int) -> list[tuple]:
        """One exactly full window; the pool must hold that many ids."""
        parts = []
        while window:
            i = bisect_right(self.pool, window, key=lambda x: x[0])
            part = self._take(i - 1) if i else self._cut(self._take(0), window)
            parts.append(part)
            window -= part[0]
        return parts

    def pack(self) -> None:
        for below, tier in reversed(list(zip((0, *self.tiers), self.tiers, strict=False))):
            while self.waiting >= self.longest and bisect_right(self.pool, below, key=lambda x: x[0]) < len(self.pool):
                i = bisect_left(self.pool, tier + 1, key=lambda x: x[0])
                if not i or self.pool[i - 1][0] <= below:
                    break
                self._finished(tier, self._fill(tier))

    def finish(self) -> None:
        self.pack()
        size = self.longest
        while size >= LEAST:
            if self.waiting >= size:
                self._finished(size, self._fill(size))
            else:
                size //= 2
        if self.waiting:
            self._finished(self.longest, [self._take(0) for _ in range(len(self.pool))])
        left = []
        for tier, windows in sorted(self.done.items()):
            each = STEP_TOKENS // tier
            whole = len(windows) - len(windows) % each
            self._deal([(tier, w) for w in windows[:whole]], whole // each)
            left += [(tier, w) for w in windows[whole:]]
        self._deal(left, -(-sum(tier for tier, _ in left) // STEP_TOKENS))
        self.done = {}

    def _finished(self, tier: int, parts: list[tuple]) -> None:
        """A full (or the last) window; its ids are known only by their checksum from here on."""
        pieces = [(doc_id, start, n, zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total) for n, _, doc_id, start, ids, total in parts]
        windows = self.done.setdefault(tier, [])
        windows.append((sum(p[2] ** 2 for p in pieces), pieces))
        if len(windows) * tier >= STEPS * STEP_TOKENS:
            self._deal([(tier, w) for w in windows], STEPS)
            self.done[tier] = []

    def _deal(self, windows: list[tuple[int, tuple[int, list[tuple]]]], groups: int) -> None:
        """Deal windows, the costly ones of each tier first, to so many step groups in serpentine order, and write their rows."""
        for k, (tier, (_, pieces)) in enumerate(sorted(windows, key=lambda x: (-x[0], -x[1][0]))):
            turn, place = divmod(k, groups)
            group = self.next_step + (place if turn % 2 == 0 else groups - 1 - place)
            at = 0
            for doc_id, start, n, crc, total in pieces:
                self.out.append((doc_id, start, n, crc, total, self.next_id, at, tier, group))
                at += n
            self.next_id += 1
        self.next_step += groups


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``limit`` bytes, or one row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece; see ``SCHEMA``. ``tokenizer_path`` must exist on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for b in chunks(batches):
            ids, bounds = bpe.encode(pc.fill_null(b.column("text"), ""))
            n = b.num_rows
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(n + 1)
            for doc_id, i, j in zip(b.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                packer.add(doc_id, ids[i:j])
            if len(packer.out) >= 10_000:
                yield _batch(packer.out)
                packer.out = []
        packer.finish()
        yield _batch(packer.out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
