"""Words of whole Arrow columns as numbers: maximal runs of bytes of one class, found without a loop over texts.

Byte classes suffice for classes of code points that hold all or nothing beyond
ASCII, since every byte of such a code point in UTF-8 is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lamina.llm.packing import chunks

#: Text bytes that a task holds at once; a longer text is held alone.
BLOCK_BYTES = 24 << 20

LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LETTERS_AND_DIGITS = LETTERS | np.array([0x30 <= b <= 0x39 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows with about ``limit`` bytes of text together, or one longer row; cut by the rows alone, however they come in batches."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in chunks(batches, limit):
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            upto = have + np.cumsum(sizes[at:])
            n = int(np.searchsorted(upto, limit, side="right")) + 1
            part = b.slice(at, n)
            held.append(part)
            at += part.num_rows
            have = int(upto[part.num_rows - 1])
            if have > limit:
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def words(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word in a row, the distinct words as binary in order of bytes, the text of each word); A-Z lower-cased, null text empty."""
    texts = texts.cast(pa.large_binary())
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]] if last > first else np.empty(0, np.uint8)
    bounds = offsets - first
    inside = np.append(kind[data], False)
    begins = np.zeros(len(inside), bool)
    begins[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (begins | ~before))
    end = np.flatnonzero(before & (begins | ~inside))
    cuts = np.zeros(2 * len(start) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = start, end, len(data)
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    found = every.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    text_of = np.searchsorted(bounds, start, side="right") - 1
    return place[found.indices.to_numpy(zero_copy_only=False)], found.dictionary.take(pa.array(order)), text_of
