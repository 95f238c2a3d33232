"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A bundle is its
frames, then a skippable frame that maps record identifiers, sorted, to (frame,
offset in the frame, length), then the seek table, a skippable frame whose footer ends
the bundle. A reader takes the table from the end, finds the frame of a record
and decompresses that frame alone.

Bundles are rows of a Parquet table in the shared folder, one binary value
each: any store that Spark reaches can hold them, and a lost task writes its
bundles anew. ``bundle`` bytes are complete ``.warc.zst`` files.

Defined results: null html is an empty payload; a null url writes no target
header; of equal payloads of ``MIN_PAYLOAD`` bytes or more, rows with the
largest page_id are responses (several, if that id is repeated) and the others
revisits; where all their ids are null, all are responses; an empty table gives
no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import BROADCAST_ROWS, drop, materialize

MIN_PAYLOAD = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the seekable format: magic numbers of skippable frames and of the footer.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of UUIDs


def record_id(page_id: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(_SPACE, f"page:{page_id}:{digest}")


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None) -> tuple[uuid.UUID, bytes]:
    rid = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit_of is not None else http + payload
    head = {
        "WARC-Type": "response" if revisit_of is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{rid}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url if url is None else _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if revisit_of is not None else None,
        "WARC-Refers-To": f"<urn:uuid:{record_id(revisit_of, digest)}>" if revisit_of is not None else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": revisit_of,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return rid, lines.encode() + block + b"\r\n\r\n"


class BundleWriter:
    def __init__(self) -> None:
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=3)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._index: list[bytes] = []
        self._open = bytearray()
        self.total = 0

    def add(self, rid: uuid.UUID, data: bytes) -> None:
        self._index.append(rid.bytes + struct.pack("<III", len(self._frames), len(self._open), len(data)))
        self._open += data
        self.total += len(data)
        if len(self._open) >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._zstd.compress(bytes(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), len(self._open)))
            self._open = bytearray()

    def finish(self) -> bytes:
        self._close()
        index = struct.pack("<I", len(self._sizes)) + b"".join(sorted(self._index))
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, FOOTER_MAGIC)
        skippable = lambda magic, body: struct.pack("<II", magic, len(body)) + body
        return b"".join(self._frames) + skippable(INDEX_MAGIC, index) + skippable(TABLE_MAGIC, table)


class BundleReader:
    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER_MAGIC or flags:
            raise ValueError("not a seekable bundle")
        table = len(data) - 9 - 8 * n
        if struct.unpack("<II", data[table - 8 : table]) != (TABLE_MAGIC, 8 * n + 9):
            raise ValueError("damaged seek table")
        self._data, self.frames, at = data, [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", data, table + 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        magic, size = struct.unpack_from("<II", data, at)
        if magic != INDEX_MAGIC:
            raise ValueError("no record index")
        self._index_at, self._index_to = at + 12, at + 8 + size

    def frame(self, i: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._data[at : at + packed], max_output_size=plain)

    def index(self) -> Iterator[tuple[uuid.UUID, int, int, int]]:
        for at in range(self._index_at, self._index_to, 28):
            yield uuid.UUID(bytes=self._data[at : at + 16]), *struct.unpack_from("<III", self._data, at + 16)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record in the order it was written, each frame decompressed once."""
        open_, frame = -1, b""
        for i, at, n in sorted(x[1:] for x in self.index()):
            if i != open_:
                open_, frame = i, self.frame(i)
            yield parse(frame[at : at + n])

    def find(self, rid: uuid.UUID) -> tuple[dict[str, str], bytes] | None:
        """A record by its identifier: bisection of the index, and one frame."""
        entry = lambda k: self._data[self._index_at + 28 * k : self._index_at + 28 * k + 28]
        n = (self._index_to - self._index_at) // 28
        k = bisect_left(range(n), rid.bytes, key=lambda k: entry(k)[:16])
        if k == n or entry(k)[:16] != rid.bytes:
            return None
        i, at, size = struct.unpack_from("<III", entry(k), 16)
        return parse(self.frame(i)[at : at + size])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; the payload is what follows the HTTP headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if first != "WARC/1.1" or len(rest) != n + 4:
        raise ValueError("damaged record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    headers["http-length"] = http.decode().rpartition("Content-Length: ")[2]
    return headers, payload


def write_bundles(pages: DataFrame) -> DataFrame:
    """(bundle_id, bundle): the written bundles, read back from the shared folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    groups = (
        base.where(F.col("n") >= MIN_PAYLOAD)
        .groupBy(F.col("digest").alias("g"), F.col("n").alias("gn"))
        .agg(F.max("page_id").alias("of"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    groups = materialize(groups, "warc-groups")
    # Few repeated payloads are broadcast, so that no payload is shuffled; many meet in a join whose hot keys Spark splits.
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    decided = base.join(side, (F.col("digest") == F.col("g")) & (F.col("n") == F.col("gn")), "left").select(
        "page_id", "url", "digest", F.when(~F.col("of").eqNullSafe(F.col("page_id")), F.col("of")).alias("of"), "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def done(w: BundleWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 33) + made]), pa.array([w.finish()], pa.binary())], names=["bundle_id", "bundle"])

        writer = BundleWriter()
        for b in batches:
            for page_id, url, digest, of, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                writer.add(*record(page_id, url, data, digest, of))
                if writer.total >= BUNDLE_BYTES:
                    yield done(writer)
                    writer, made = BundleWriter(), made + 1
        if writer.total:
            yield done(writer)

    out = materialize(decided.mapInArrow(run, "bundle_id long, bundle binary"), "warc")
    drop(groups)
    return out


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_records(bundles: DataFrame) -> DataFrame:
    """One row per record; digests of responses are taken from the payload read, and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for data in b.column("bundle"):
                out = []
                for head, payload in BundleReader(data.as_py()).records():
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
                    out.append(
                        (
                            number(head.get("X-Page-ID")),
                            int(head["http-length"]) if revisit else len(payload),
                            said,
                            head["WARC-Type"],
                            number(head.get("X-Refers-To-Page-ID")),
                            head.get("WARC-Target-URI"),
                        )
                    )
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in READ_SCHEMA.split(", ")]
                )

    return bundles.select("bundle").mapInArrow(run, READ_SCHEMA)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset, length of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle_id, data in zip(b.column("bundle_id").to_pylist(), b.column("bundle"), strict=True):
                rows = [(str(r), bundle_id, f, o, n) for r, f, o, n in BundleReader(data.as_py()).index()]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names=["record_id", "bundle_id", "frame", "offset", "length"]
                )

    return bundles.mapInArrow(run, "record_id string, bundle_id long, frame long, offset long, length long")
