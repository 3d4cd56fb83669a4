"""Token-ID files with directly addressable codes.

A file holds the ids of consecutive documents. Each id is split into chunks of
bits, lowest first. Level k holds chunk k of the ids that reach it, packed at the
level's width; a continuation bitmap beside it says which of them go on to level
k + 1, and a rank directory (set bits before every block of 512) turns a place in
one level into a place in the next. Reading token i touches one chunk per level
and at most 512 bits of each bitmap: nothing is decoded in blocks.

    magic 'TDAC' | u32 header length | header (JSON) | sections, each 8-byte aligned

The header gives the number of ids, the widths, and where the sections stand:
document ids (i64), first token of each document (i64), and per level chunks,
bitmap and directory (u64).
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import lean, new_path, partitions, stored, text_slices
from .tokens import SLICE, encoder

MAGIC = b"TDAC"
BLOCK = 512  # bits of a bitmap between entries of the rank directory
GROUP = 1 << 20  # ids packed at a time
ROLL = 1 << 23  # ids after which a file is closed, about


def level_widths(ids: np.ndarray) -> list[int]:
    """Widths that make the file smallest: one, two or three levels over the ids' bit lengths."""
    bits = np.zeros(len(ids), np.int64) if not len(ids) else np.maximum(1, np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int64))
    over = np.array([(bits > b).sum() for b in range(34)])
    top = int(bits.max()) if len(ids) else 1
    best = (len(ids) * top, [top])
    for a in range(1, top):
        cost = len(ids) * (a + 1) + over[a] * (top - a)
        best = min(best, (int(cost), [a, top - a]))
        for b in range(1, top - a):
            cost = len(ids) * (a + 1) + over[a] * (b + 1) + over[a + b] * (top - a - b)
            best = min(best, (int(cost), [a, b, top - a - b]))
    return best[1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of width bits, first value first, lowest bit first."""
    out = []
    step = GROUP - GROUP % 8
    for i in range(0, len(values), step):
        v = values[i : i + step].astype("<u4")
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: np.ndarray, width: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint32)
    step = GROUP - GROUP % 8
    for i in range(0, count, step):
        k = min(step, count - i)
        bits = np.unpackbits(data[i * width // 8 : (i * width + k * width + 7) // 8], bitorder="little")[: k * width].reshape(k, width)
        full = np.zeros((k, 32), np.uint8)
        full[:, :width] = bits
        out[i : i + k] = np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)
    return out


def write_codes(ids: np.ndarray, doc_ids: list, first: np.ndarray) -> bytes:
    """One file. first: each document's first token, with the total at the end; doc_ids may hold null."""
    widths = level_widths(ids)
    sections: list[bytes] = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes(),
        first.astype("<i8").tobytes(),
    ]
    rest, counts = ids.astype(np.uint32), []
    for k, width in enumerate(widths):
        counts.append(len(rest))
        sections.append(pack_bits(rest & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            more = (rest >> np.uint32(width)) > 0
            sections.append(np.packbits(more, bitorder="little").tobytes())
            per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            sections.append(np.append(0, np.cumsum(per_block)).astype("<u8").tobytes())
            rest = rest[more] >> np.uint32(width)
    at, places, body = 0, [], []
    for s in sections:
        places.append([at, len(s)])
        pad = -len(s) % 8
        body += [s, b"\0" * pad]
        at += len(s) + pad
    head = json.dumps({"docs": len(doc_ids), "ids": len(ids), "widths": widths, "counts": counts, "sections": places}).encode()
    head += b" " * (-len(head) % 8)
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(body)


class Codes:
    """A file's contents: token(i) by rank alone, all_ids() in bulk."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[4:8], "little")
        self.head = json.loads(data[8 : 8 + n])
        self.widths, self.counts, self.n = self.head["widths"], self.head["counts"], self.head["ids"]
        raw = [np.frombuffer(data, np.uint8, length, 8 + n + at) for at, length in self.head["sections"]]
        null = np.unpackbits(raw[1], bitorder="little")[: self.head["docs"]].astype(bool)
        self.doc_ids = [None if z else d for d, z in zip(raw[0].view("<i8").tolist(), null.tolist())]
        self.first = raw[2].view("<i8")
        self.levels = [(raw[3 + 3 * k], raw[4 + 3 * k], raw[5 + 3 * k].view("<u8")) for k in range(len(self.widths) - 1)] + [(raw[3 * len(self.widths)], None, None)]

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for (chunks, bitmap, ranks), width in zip(self.levels, self.widths):
            bit = i * width
            word = int.from_bytes(chunks[bit // 8 : (bit + width + 7) // 8].tobytes(), "little")
            value |= ((word >> bit % 8) & ((1 << width) - 1)) << shift
            shift += width
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bitmap[block * BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(inside.sum())
        return value

    def all_ids(self) -> np.ndarray:
        out, at, shift = np.zeros(self.n, np.uint32), None, 0
        for k, (width, count) in enumerate(zip(self.widths, self.counts)):
            chunk = unpack_bits(self.levels[k][0], width, count) << np.uint32(shift)
            if at is None:
                out |= chunk
            else:
                out[at] |= chunk
            shift += width
            if k + 1 < len(self.widths):
                more = np.unpackbits(self.levels[k][1], bitorder="little")[:count].astype(bool)
                at = np.flatnonzero(more) if at is None else at[more]
        return out


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, *, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", path: str | None = None, roll: int = ROLL) -> DataFrame:
    """Encode whole texts and write them as files in ascending order of id.

    Returns the files: (file, path, docs, tokens), in order. Null text counts as
    empty, null ids come first, equal ids come in the order of a hash of their texts; an
    empty table writes no file. Documents are dealt to tasks by ranges of id and text hash, so that
    one id may span several, and a task closes a file after roll ids, or after the
    document that goes beyond. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(partitions(spark), "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    schema = pa.schema([("file", pa.string()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        enc = encoder(vocabulary, kind)
        task, n_files = TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, held = [], [], [], 0

        def close():
            file = f"ids-{task:06d}-{n_files:06d}.tdac"
            where = f"{files.folder(path)}/{file}"
            flat, lens = np.concatenate(ids), np.concatenate(counts)
            files.put(where, write_codes(flat, doc_ids, np.append(0, np.cumsum(lens))))
            return pa.RecordBatch.from_pydict({"file": [file], "path": [where], "docs": [len(lens)], "tokens": [len(flat)]}, schema=schema)

        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, buf, off in text_slices(b.column(1), SLICE):
                got, first = enc.encode(buf, off)
                ids.append(np.insert(got, first[1:], np.uint32(end_id)))
                counts.append(np.diff(first) + 1)
                doc_ids += names[i:j]
                held += len(ids[-1])
                if held >= roll:
                    yield close()
                    n_files += 1
                    ids, doc_ids, counts, held = [], [], [], 0
        if doc_ids:
            yield close()

    return stored(sorted_rows.mapInArrow(lean(run), "file string, path string, docs long, tokens long"), "token-manifest").orderBy("file")


def header(path: str) -> dict:
    """A file's header, without reading what follows."""
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_input_file(p) as f:
        if f.read(4) != MAGIC:
            raise ValueError("not a token file")
        return json.loads(f.read(int.from_bytes(f.read(4), "little")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read files back, a row per document: id, start (ids of all documents before it), n_tokens, ids_crc32.

    manifest: file and path of each file, the order of files being that of their
    names. How many ids come before a file is added up from the files' headers.
    Null ids come back as null; without files there are no rows.
    """
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def heads(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"file": b.column(0), "path": b.column(1), "ids": [header(p)["ids"] for p in b.column(1).to_pylist()]}, schema=pa.schema([("file", pa.string()), ("path", pa.string()), ("ids", pa.int64())]))

    listed = sorted(manifest.select("file", "path").mapInArrow(heads, "file string, path string, ids long").collect())  # a row per file
    if not listed:
        return spark.createDataFrame([], schema)
    starts = dict(zip((r["file"] for r in listed), np.append(0, np.cumsum([r["ids"] for r in listed])).tolist()))
    folders = sorted({r["path"].rsplit("/", 1)[0] for r in listed})
    content = spark.read.format("binaryFile").load([f"{p}/*.tdac" for p in folders]).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                start = starts.get(name.rsplit("/", 1)[1])
                if start is None:
                    continue  # not of this manifest
                codes = Codes(data.as_py())
                first = codes.first
                raw = codes.all_ids().astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": codes.doc_ids, "start": first[:-1] + start, "n_tokens": np.diff(first), "ids_crc32": crc},
                    schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                )

    return content.mapInArrow(lean(run), schema)
