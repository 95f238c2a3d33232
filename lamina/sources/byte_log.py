"""A stream of growing log files by byte offsets, as a Python data source.

``spark.readStream.format("byte_log").load(folder)`` gives (file, start, end, text) for
all files below a folder that the driver and all executors see under one path. The
stream's offset is a byte position a file, so a restart goes on where the last batch
ended. What a file has grown by is cut into pieces of ``LIMIT`` bytes, a row each; a
task reads pieces that follow each other, ``TASK_BYTES`` together; nothing passes through the driver but sizes. A file that has shrunk begins
again at 0.

A piece ends before a character that its last bytes only begin, and so does a batch
while a writer is in the middle of one: no character is split, and every byte is
given once.

Defined results: bytes that are no UTF-8 become the replacement character; an
empty file gives no row; a file that has gone gives no more rows, and begins again if
it returns; names are relative to the folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LIMIT = 512 * 1024
#: Bytes, about, that a task reads.
TASK_BYTES = 8 * 1024 * 1024


def boundary(tail: bytes) -> int:
    """How many of the last bytes of ``tail``, three at most, begin a character that is not ended there."""
    for back in range(1, min(3, len(tail)) + 1):
        byte = tail[-back]
        if byte & 0xC0 == 0x80:
            continue  # goes on with a character
        length = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
        return back if length > back else 0
    return 0


def settled(path: str, at: int) -> int:
    """The last place at or before ``at`` that splits no character."""
    with open(path, "rb") as f:
        first = max(0, at - 3)
        f.seek(first)
        return at - boundary(f.read(at - first))


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        found = {}
        for top, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(top, name)
                if not name.startswith((".", "_")):
                    found[os.path.relpath(path, self.folder)] = settled(path, os.path.getsize(path))
        return {"files": dict(sorted(found.items()))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, upto in end["files"].items():
            at = start["files"].get(name, 0)
            at = 0 if at > upto else at
            cuts = [at]
            while cuts[-1] < upto:
                cuts.append(min(upto, max(settled(os.path.join(self.folder, name), min(upto, cuts[-1] + max(self.limit, TASK_BYTES))), cuts[-1] + 1)))
            out += [Piece(name, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.name), "rb") as f:
            f.seek(partition.start)
            at, data = partition.start, b""
            while at < partition.end:
                data += f.read(min(partition.end - at, self.limit) - len(data))
                if not data:
                    return
                last = at + len(data) == partition.end or len(data) < self.limit
                cut = len(data) if last else max(1, len(data) - boundary(data[-3:]))
                yield partition.name, at, at + cut, data[:cut].decode("utf-8", "replace")
                at, data = at + cut, data[cut:]


class ByteLog(DataSource):
    """Options: ``path``, a folder; ``limit``, the bytes of a piece."""

    @classmethod
    def name(cls) -> str:
        return "byte_log"

    def schema(self) -> str:
        return "file string, start long, end long, text string"

    def streamReader(self, schema) -> Reader:
        at = urlparse(self.options["path"])
        if at.scheme not in ("", "file"):
            raise ValueError(f"logs are read by byte offsets in a mounted folder, not in {at.scheme}://")
        limit = int(self.options.get("limit", LIMIT))
        if limit < 4:
            raise ValueError("a piece must hold a character of four bytes")
        return Reader(unquote(at.path), limit)
