"""Shared pieces of the training-data operators.

Text is handled as Arrow buffers: a batch of documents is one byte array, words
are found and hashed by numpy over that array, and keys that documents have in
common are exchanged as packed arrays (one row per sub-batch and bucket) rather
than as one row per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import released

U64 = np.uint64
SLICE_BYTES = 1 << 20  # text bytes handled by numpy at a time; one longer document is a slice of its own
CHUNK_DOCS = 400  # documents of one reply chunk, on average
CHUNK_BYTES = 4 << 20  # and its bytes
BUCKET_BYTES = 16 << 20  # bytes of an exchange bucket, on average; a task holds one at a time
HEAVY = 2_000  # a key is heavy from this share (1 / HEAVY) of all rows on, so that there are never more than HEAVY such keys


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; one of our own only where none is set and all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemill-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and the exchanges that made it are freed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(number, row): the rows of a table, as structs, with numbers that are written once and thus stay the same in every read."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return stored(df.select(F.monotonically_increasing_id().alias("number"), row), name)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of ours that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator's run that are deleted once its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        with released(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            forget(self.spark, path)
        self.paths = []


_LIBC = None


def settle() -> None:
    """Give a worker's freed memory back to the system: workers are used again, beside others on the same machine."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library: nothing to trim
            _LIBC = False
    if _LIBC:
        _LIBC.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that settles at its end."""

    def settled(batches):
        yield from run(batches)
        settle()

    return settled


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """Buckets of an exchange of so many bytes: BUCKET_BYTES each on average, one for each partition at least."""
    return max(partitions(spark), -(-n_bytes // BUCKET_BYTES))


def chunk_count(n_rows: int, n_bytes: int = 0) -> int:
    """Reply chunks: neither more documents nor more bytes than CHUNK_DOCS and CHUNK_BYTES each, on average."""
    return max(1, -(-n_rows // CHUNK_DOCS), -(-n_bytes // CHUNK_BYTES))


def chunk_of(n_chunks: int, *cols: Column) -> Column:
    """Reply chunk of a row: any equal value of the columns always falls in the same chunk."""
    return F.pmod(F.xxhash64(*cols), F.lit(n_chunks)).cast("int")


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row for a key and the number of rows with that key as its weight.

    Keys that hold more than 1 / HEAVY of all rows are at most HEAVY, so that their
    part of the table is broadcast and their rows stay where they are; the rest is
    joined by a shuffle in which no key is large. how: inner or left. rows and table
    are read twice and should be stored.
    """
    limit = total // HEAVY
    heavy = F.broadcast(table.where(F.col(weight) > limit))
    light = rows.join(F.broadcast(table.where(F.col(weight) > limit).select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= limit), keys, how)
    return rows.join(heavy, keys).unionByName(light)


# ---------------------------------------------------------------- hashing

_BYTE = None
_POW = _INV = None
_P = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        m = max(n, SLICE_BYTES + 2)
        base = np.full(m, _P, U64)
        base[0] = 1
        inv = np.full(m, pow(_P, -1, 1 << 64), U64)
        inv[0] = 1
        _POW, _INV = np.cumprod(base, dtype=U64), np.cumprod(inv, dtype=U64)
    return _POW[:n], _INV[:n]


def byte_values() -> np.ndarray:
    global _BYTE
    if _BYTE is None:
        _BYTE = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0xD1342543DE82EF95))
    return _BYTE


def rolling(h: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Fingerprint of h[i:i+size] for all i, or for those in at."""
    n = len(h)
    if n < size:
        return np.empty(0, U64)
    pw, inv = powers(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum(h * pw[:n], out=c[1:])
    i = np.arange(n - size + 1) if at is None else at
    return mix64((c[i + size] - c[i]) * inv[i])


# ---------------------------------------------------------------- words

SPACE_WORDS = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a run of documents: starts, ends (bytes), first[d]:first[d+1] (words of document d)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, member: np.ndarray = SPACE_WORDS, lower: bool = False):
        self.buf = buf = LOWER[buf] if lower else buf
        n = len(buf)
        w = member[buf]
        edge = off[1:-1]
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        before[edge[edge < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        after[edge[edge > 0] - 1] = False
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.n_docs = len(off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix_sums(self) -> np.ndarray:
        n = len(self.buf)
        pw, _ = powers(n + 1)
        c = np.zeros(n + 1, U64)
        np.cumsum(byte_values()[self.buf] * pw[:n], out=c[1:])
        return c

    def hashes(self, sums: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its bytes up to ends."""
        c = self.prefix_sums() if sums is None else sums
        e = self.ends if ends is None else ends
        _, inv = powers(len(self.buf) + 1)
        s = self.starts
        return mix64((c[e] - c[s]) * inv[s] + (e - s).astype(U64))

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


# ---------------------------------------------------------------- packed exchange

PACKED = "bucket int, keys binary, more binary, chunks binary, weights binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("chunks", pa.binary()), ("weights", pa.binary())])


def packed(keys: np.ndarray, chunks: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct (key, chunk) of a sub-batch, one row per bucket; the weight says how often it came, up to 255."""
    chunks = chunks.astype(np.uint32)
    order = np.lexsort((keys, chunks)) if more is None else np.lexsort((more, keys, chunks))
    k, c = keys[order], chunks[order]
    m = None if more is None else more[order]
    new = np.ones(len(k), bool)
    if len(k):
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        if m is not None:
            new[1:] |= m[1:] != m[:-1]
    at = np.flatnonzero(new)
    weight = np.minimum(np.diff(np.append(at, len(k))), 255).astype(np.uint8)
    k, c, m = k[at], c[at], None if m is None else m[at]
    bucket = (k % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
    rows = {"bucket": bucket[cut].tolist(), "keys": [], "more": [], "chunks": [], "weights": []}
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        i = order[a:b]
        rows["keys"].append(k[i].tobytes())
        rows["more"].append(b"" if m is None else m[i].tobytes())
        rows["chunks"].append(c[i].tobytes())
        rows["weights"].append(weight[i].tobytes())
    return pa.RecordBatch.from_pydict(rows, schema=_PACKED_ARROW)


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def per_bucket(entries: DataFrame, reduce: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hand each bucket's rows to reduce, as lists by column, one bucket after another: a task holds one bucket at a time."""
    n = partitions(entries.sparkSession)

    def run(batches):
        now, held = None, {}
        for b in batches:
            which = b.column("bucket").to_numpy()
            cut = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
            for x, y in zip(cut, np.append(cut[1:], len(which))):
                if which[x] != now:
                    if now is not None:
                        yield from reduce(held)
                    now, held = which[x], {c: [] for c in b.schema.names}
                part = b.slice(x, y - x)
                for c in held:
                    held[c] += part.column(c).to_pylist()
        if now is not None:
            yield from reduce(held)

    return entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), schema)


SHARED = "chunk int, keys binary, leads binary, levels binary"
_SHARED_ARROW = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("leads", pa.binary()), ("levels", pa.binary())])


def shared_keys(entries: DataFrame) -> DataFrame:
    """(chunk, keys, leads, levels): for each chunk, those of its keys that come at least twice over all chunks.

    leads says for which of them the chunk is the smallest that has the key, levels
    grow with how often a key comes (8 a doubling). A task holds one bucket's
    entries at a time; a frequent key costs one entry per chunk that has it.
    """

    def reduce(held):
        keys, chunks, weights, more = _joined(held["keys"], U64), _joined(held["chunks"], np.uint32), _joined(held["weights"], np.uint8), _joined(held["more"], U64)
        if not len(keys):
            return
        two = len(more) == len(keys)
        order = np.lexsort((chunks, more, keys) if two else (chunks, keys))
        keys, chunks, weights = keys[order], chunks[order], weights[order]
        new = np.append(True, keys[1:] != keys[:-1])
        if two:
            more = more[order]
            new[1:] |= more[1:] != more[:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(weights.astype(np.int64), at)
        times = np.diff(np.append(at, len(keys)))
        keep = np.repeat(total >= 2, times)
        level = np.repeat(np.minimum(255, 8 * np.log2(total)).astype(np.uint8), times)
        keys, chunks, leads, level = keys[keep], chunks[keep], new[keep], level[keep]
        order = np.lexsort((~leads, keys, chunks))
        keys, chunks, leads, level = keys[order], chunks[order], leads[order], level[order]
        if not len(keys):
            return
        new = np.append(True, (chunks[1:] != chunks[:-1]) | (keys[1:] != keys[:-1]))
        keys, chunks, leads, level = keys[new], chunks[new], leads[new], level[new]
        cut = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1]))
        ranges = list(zip(cut, np.append(cut[1:], len(keys))))
        yield pa.RecordBatch.from_pydict(
            {"chunk": chunks[cut].astype(np.int32), "keys": [keys[a:b].tobytes() for a, b in ranges], "leads": [leads[a:b].tobytes() for a, b in ranges], "levels": [level[a:b].tobytes() for a, b in ranges]},
            schema=_SHARED_ARROW,
        )

    return per_bucket(entries, reduce, SHARED)


def key_set(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a chunk's replies, and those that the chunk leads."""
    keys, leads = _joined(table.column("keys").to_pylist(), U64), _joined(table.column("leads").to_pylist(), bool)
    return np.unique(keys), np.unique(keys[leads])


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are in the sorted keys."""
    if not len(keys) or not len(values):
        return np.zeros(len(values), bool)
    i = np.searchsorted(keys, values)
    i[i == len(keys)] = 0
    return keys[i] == values
