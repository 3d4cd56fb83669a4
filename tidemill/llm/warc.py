"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME bytes. A bundle ends
in a seek table (a skippable frame with each frame's compressed and decompressed
size), so a reader finds any frame without reading those before it. The index maps
a record's identifier to bundle, frame and offset inside the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import HEAVY, lean, new_path, stored

FRAME = 256 << 10  # bytes of records in a frame, at least, but for the last
BUNDLE = 64 << 20  # compressed bytes after which a bundle is closed
LEAST_REVISIT = 1000  # payload bytes from which equal payloads are written once
#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2000-01-01T00:00:00Z"


class BundleWriter:
    def __init__(self, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's decompressed bytes) of a record."""
        if self.held >= FRAME:
            self._close()
        place = (len(self.frames), self.held)
        self.open.append(record)
        self.held += len(record)
        return place

    def _close(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.written += len(frame)
            self.open, self.held = [], 0

    def bytes(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(data) - 9 - n * width, []
    start = 0
    for k in range(n):
        packed, full = struct.unpack_from("<II", data, at + k * width)
        out.append((start, packed, full))
        start += packed
    return out


def frames(data: bytes):
    """Yield the decompressed frames of a bundle."""
    import zstandard

    pack = zstandard.ZstdDecompressor()
    for start, packed, full in seek_table(data):
        yield pack.decompress(data[start : start + packed], max_output_size=full)


def _line(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit holds the digest and length of the payload that it refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = head + b"\r\n" if revisit else head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else 'null'}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Payload-Length: {len(payload)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """Yield (headers, payload) of the records of a frame; a revisit's payload is None."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(body) + 4
        yield head, None if head["WARC-Type"] == "revisit" else body[body.index(b"\r\n\r\n") + 4 :]


def _page(urn: str):
    name = urn.strip("<>").rsplit(":", 1)[1]
    return None if name == "null" else int(name)


def write(pages: DataFrame, *, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write a record per row; returns the index (page_id, path, frame, offset, length, record_type).

    Of rows whose payloads are equal and of at least `least` bytes, those with the
    largest id are responses and the others revisit it; shorter payloads are always
    responses. Null html is an empty payload, a null url is left out; an empty table
    writes nothing, and payloads may have any length. Rows that
    repeat the largest id with the same payload are all responses; a null id is
    never the largest, and where all ids are null all rows are responses.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("size", F.octet_length(payload)).withColumn("name", F.when(F.col("size") >= least, F.sha2(payload, 256)))
    same = rows.where("name is not null").groupBy("name").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null").select(F.col("name").alias("of"), "top", "n")
    # a payload that very many pages share is joined by broadcast; small ones have no name and stay out of the join
    rows = rows.withColumn("name", F.coalesce("name", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    total = max(1, pages.count())
    heavy = F.broadcast(same.where(F.col("n") > total // HEAVY))  # at most HEAVY payloads
    joined = rows.join(heavy, rows["name"] == heavy["of"], "left")
    most = joined.where("of is not null").drop("of", "n")
    rest = joined.where("of is null").drop("of", "n", "top").join(same.where(F.col("n") <= total // HEAVY).drop("n"), F.col("name") == F.col("of"), "left").drop("of")
    marked = most.unionByName(rest).select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to"))
    schema = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])

    def run(batches):
        out = {n: [] for n in schema.names}
        bundle, name = BundleWriter(), None

        def close():
            files.put(name, bundle.bytes())
            done = pa.RecordBatch.from_pydict(out, schema=schema)
            for v in out.values():
                v.clear()
            return done

        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if name is None:
                    name = f"{files.folder(path)}/bundle-{uuid.uuid4().hex}.warc.zst"
                revisit = refers_to is not None
                data = record(page_id, url, (html or "").encode(), refers_to, revisit)
                frame, offset = bundle.add(data)
                for n, v in zip(schema.names, (page_id, name, frame, offset, len(data), "revisit" if revisit else "response")):
                    out[n].append(v)
                if bundle.written >= BUNDLE:
                    yield close()
                    bundle, name = BundleWriter(), None
        if name:
            yield close()

    return stored(marked.mapInArrow(lean(run), "page_id long, path string, frame int, offset long, length long, record_type string"), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Read archives back: (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Only bundles that the index names are read, frame by frame. A response's digest
    is taken from its payload and must equal the one written; a revisit's digest and
    length are those of the payload that it refers to, its payload is null.
    """
    spark = index.sparkSession
    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    folders = [r["folder"] for r in index.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect()]  # a row per write
    if not folders:
        return spark.createDataFrame([], schema)
    listed = index.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    content = spark.read.format("binaryFile").load([f"{p}/*.warc.zst" for p in sorted(folders)]).select("path", "content")
    content = content.join(listed, F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi").select("content")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                for frame in frames(data):
                    out = {n: [] for n in arrow.names}
                    for head, payload in parse(frame):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                        to = head.get("WARC-Refers-To")
                        values = (_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), None if payload is None else payload.decode(), int(head["WARC-Refers-To-Payload-Length"]) if payload is None else len(payload), digest, head["WARC-Type"], None if to is None else _page(to))
                        for n, v in zip(arrow.names, values):
                            out[n].append(v)
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return content.mapInArrow(lean(run), schema)


def fetch(index_row) -> tuple[dict, bytes | None]:
    """One record by its index row: the footer, its entry of the seek table and its frame are read, nothing else of the bundle."""
    import zstandard
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(index_row["path"])
    with system.open_input_file(path) as f:
        end = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = f.read_at((index_row["frame"] + 1) * width, end - 9 - n * width)  # up to the frame's own entry
        sizes = [struct.unpack_from("<II", table, k * width) for k in range(index_row["frame"] + 1)]
        start, (packed, full) = sum(c for c, _ in sizes[:-1]), sizes[-1]
        frame = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=full)
    return next(parse(frame, index_row["offset"]))
