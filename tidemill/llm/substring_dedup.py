"""Removing repeated word windows by recompression.

Words are the first symbols. A round names each maximal run of a symbol, and each
pair of a left-class symbol (or run) and a right-class one after it, by a hash of
what it stands for, so that equal word sequences get equal names everywhere
without a table of names. A symbol also keeps the words its naming depended on;
where a window holds all of them, every copy of the window holds the same symbol.

Spark then counts the symbols over all documents:

1. Symbols of BASE rounds: a window can only repeat if all symbols that it fixes
   are shared. This leaves few windows to look at.
2. Symbols of higher rounds (HIGH) that stand for at least a window's words, and
   whole documents: where shared, all windows inside are repeated.
3. Windows that are neither refuted by 1 nor verified by 2 are compared by their
   own 128-bit fingerprints.

All counts are exact for the 64-bit names; a false "shared" in step 1 only costs
time. Names and documents travel as packed arrays, and what a frequent passage
sends is one entry per chunk of documents that has it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import PACKED, U64, Words, among, bucket_count, chunk_count, chunk_of, key_set, lean, mix64, packed, rolling, shared_keys, stored, text_slices

BASE = 5
HIGH = (12, 16, 20)
_TOP = U64(0x5851F42D4C957F2D)

KEY_BYTES = 2  # of an exchange for each byte of text, about: 13 for each word


def recompress(h: np.ndarray, first: np.ndarray, window: int):
    """Names of a run of documents.

    Yields (symbols, begin, end, low, high): round BASE with the words [low, high)
    that fix each symbol, then the HIGH rounds with low = high = None, holding
    only symbols of at least a window.
    """
    n = len(h)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    sym, beg = h, np.arange(n)
    end = beg + 1
    low, high = beg, end
    doc_low, doc_high = first[:-1] - 1, first[1:] + 1
    for r in range(max(HIGH) + 1):
        if r == BASE:
            yield sym, beg, end, low, high
            low = high = None
        elif r in HIGH:
            long = end - beg >= window
            yield mix64(sym[long] ^ U64(r)), beg[long], end[long], None, None  # a name of this round: one that stays over rounds counts once in each
        if r == max(HIGH) or not len(sym):
            return
        f = mix64(sym ^ U64(0xA0761D6478BD642F * (r + 1) & (2**64 - 1)))
        right = f >> U64(63) == 1
        join = (doc[1:] == doc[:-1]) & ((sym[1:] == sym[:-1]) | (~right[:-1] & right[1:]))
        start = np.flatnonzero(np.append(True, ~join))
        last = np.append(start[1:], len(sym)) - 1
        name = np.where(last > start, mix64(np.add.reduceat(f, start) + U64(r + 1)), sym[start])
        if low is not None:
            d = doc[start]
            left, rightmost = start - 1, last + 1
            new_low = np.where((left >= 0) & (doc[left] == d), low[left], doc_low[d])
            inside = rightmost < len(sym)
            at = np.where(inside, rightmost, 0)
            high = np.where(inside & (doc[at] == d), high[at], doc_high[d])
            low = new_low
        sym, beg, end, doc = name, beg[start], end[last], doc[start]


def _document_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A name for each document's whole word sequence."""
    from .common import powers

    pw, inv = powers(len(h) + 1)
    c = np.append(U64(0), np.cumsum(h * pw[: len(h)], dtype=U64))
    return mix64(((c[first[1:]] - c[first[:-1]]) * inv[first[:-1]] + np.diff(first).astype(U64)) ^ _TOP)


def _spread(at: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges [at, stop) cover each of n places."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, stop, -1)
    return np.cumsum(d[:n])


def _starts_ok(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which words begin a window inside their document."""
    counts = np.diff(first)
    ok = np.zeros(n, bool)
    left = np.repeat(first[1:], counts) - np.arange(n)
    ok[left >= window] = True
    return ok


def _emit(window: int, buckets: int):
    def run(batches):
        for b in batches:
            chunk = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, off in text_slices(b.column(0)):
                w = Words(buf, off)
                first = w.first
                if len(w.starts) == 0:
                    continue
                h = w.hashes()
                of = np.repeat(chunk[i:j], w.counts)
                names = []
                where = []
                for sym, beg, end, low, high in recompress(h, first, window):
                    if low is not None:
                        keep = high - low <= window
                        sym, beg = sym[keep], beg[keep]
                    names.append(sym)
                    where.append(of[beg])
                whole = w.counts >= window
                names.append(_document_names(h, first)[whole])
                where.append(chunk[i:j][whole])
                yield packed(np.concatenate(names), np.concatenate(where), buckets)

    return run


def _judge(h: np.ndarray, first: np.ndarray, shared: np.ndarray, leads: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(verified, open, told) window starts of a run of documents, given the shared names of its chunk.

    A verified window may be the copy of one that is open elsewhere. So that it
    counts there, one chunk tells it: the one that leads the lowest symbol that
    verifies it, which all its verified copies have in common.
    """
    n = len(h)
    ok = _starts_ok(first, n, window)
    refuted = np.zeros(n, bool)
    sure = np.zeros(n, bool)
    told = np.zeros(n, bool)
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for sym, beg, end, low, high in recompress(h, first, window):
        if not len(sym):
            continue
        known = among(sym, shared)
        if low is not None:
            use = (high - low <= window) & ~known & (low >= first[:-1][doc_of[beg]]) & (high <= first[1:][doc_of[beg]])
            a = np.maximum(high[use] - window, first[:-1][doc_of[beg[use]]])
            refuted = _spread(a, low[use] + 1, n) > 0
        else:
            lead = known & among(sym, leads)
            told |= (_spread(beg[lead], end[lead] - window + 1, n) > 0) & ~sure
            sure |= _spread(beg[known], end[known] - window + 1, n) > 0
    names = _document_names(h, first)
    told |= np.repeat(among(names, leads), np.diff(first)) & ~sure
    sure |= np.repeat(among(names, shared), np.diff(first))
    sure &= ok
    return sure, ok & ~sure & ~refuted, told & ok


def _finish(w: Words, repeated: np.ndarray, d: int, window: int) -> tuple[int, bytes, list]:
    """(words removed, kept text, removed spans of words) of one document; repeated: its window starts."""
    a, b = w.first[d], w.first[d + 1]
    n = int(b - a)
    raw = w.buf[w.starts[a] : w.ends[b - 1]].tobytes().split() if n else []
    at = np.flatnonzero(repeated[a:b])
    if not len(at):
        return 0, b" ".join(raw), []
    gone = _spread(at, at + window, n) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    spans = [[int(x), int(y)] for x, y in zip(edge[::2], edge[1::2])]
    return int(gone.sum()), b" ".join(itertools.compress(raw, (~gone).tolist())), spans


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int32())))]
_OUT_SQL = "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<int>>"


def dedup_substrings(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, verbatim: bool = False) -> DataFrame:
    """Remove every word inside a window of words that also starts anywhere else.

    Returns (doc_id, n_words, n_removed, kept_text, removed), a row per input row:
    the kept words joined by one space, and the removed spans of words [from, to).
    Windows are judged on the input, so that all copies of a passage go. Null and
    empty texts, and those of fewer words than a window, keep all they have; rows
    that come twice count as copies of each other. Other columns are ignored but
    for those named in keep, which follow in a struct `kept`. With verbatim, a text
    that loses nothing is returned as it is, white space included.
    """
    spark = docs.sparkSession
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<none: int>")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("kept"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_chunks, buckets = chunk_count(size["n"], size["bytes"]), bucket_count(spark, KEY_BYTES * size["bytes"])
    # texts too short for a window exchange nothing and go anywhere; others always to the same chunk, as both passes ask for it
    short = F.coalesce(F.length("text"), F.lit(0)) < 2 * window - 1
    base = base.withColumn("chunk", F.when(short, chunk_of(n_chunks, F.monotonically_increasing_id())).otherwise(chunk_of(n_chunks, F.col("doc_id"), F.col("text"))))
    shared = shared_keys(base.select("text", "chunk").mapInArrow(lean(_emit(window, buckets)), PACKED))

    kind = base.select("kept").schema["kept"].dataType
    kept_type, kept_sql = to_arrow_type(kind), kind.simpleString()
    first_schema = pa.schema([*_OUT, ("kept", kept_type), ("chunk", pa.int32()), ("sure", pa.binary()), *[(n, t) for n, t in (("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("chunks", pa.binary()), ("weights", pa.binary()))]])
    first_sql = f"{_OUT_SQL}, kept {kept_sql}, chunk int, sure binary, {PACKED}"

    def first_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return first_schema.empty_table()
        left = left.combine_chunks()
        (keys, leads), chunk = key_set(right), left.column("chunk")[0].as_py()
        ids = left.column("doc_id").to_pylist()
        texts = left.column("text")
        rows = {n: [] for n in first_schema.names}
        rows.pop("kept")
        open_keys, open_more = [], []

        def put(**x):
            for n in rows:
                rows[n].append(x.get(n))

        for i, j, buf, off in text_slices(texts):
            w = Words(buf, off)
            h = w.hashes()
            sure, unsure, told = _judge(h, w.first, keys, leads, window)
            unsure_docs = set(np.unique(np.searchsorted(w.first, np.flatnonzero(unsure), "right") - 1).tolist())
            at = np.flatnonzero(unsure | told)
            if len(at):
                open_keys.append(rolling(h, window, at))
                open_more.append(rolling(mix64(h ^ _TOP), window, at))
            for d in range(j - i):
                a, b = w.first[d], w.first[d + 1]
                if d in unsure_docs:
                    put(doc_id=ids[i + d], n_words=int(b - a), kept_text=texts[i + d].as_py(), chunk=chunk, sure=np.packbits(sure[a:b]).tobytes())
                else:
                    gone, kept, spans = _finish(w, sure, d, window)
                    put(doc_id=ids[i + d], n_words=int(b - a), n_removed=gone, kept_text=texts[i + d].as_py() or "" if verbatim and not gone else kept.decode(), removed=spans, chunk=chunk)
        rows["kept"] = left.column("kept").combine_chunks().cast(kept_type)  # a row for each row, in order
        out = [pa.Table.from_pydict(rows, schema=first_schema)]
        if open_keys:
            k = np.concatenate(open_keys)
            p = packed(k, np.full(len(k), chunk), buckets, np.concatenate(open_more))
            t = pa.Table.from_batches([p])
            out.append(pa.Table.from_arrays([t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in first_schema], schema=first_schema))
        return pa.concat_tables(out)

    passed = stored(base.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(first_pass, first_sql), "substring-windows")
    names = [n for n, _ in _OUT] + ["kept"] * bool(keep)
    done = passed.where("bucket is null and sure is null").select(*names)
    repeated = shared_keys(passed.where("bucket is not null").select("bucket", "keys", "more", "chunks", "weights"))
    undecided = passed.where("sure is not null").select("doc_id", "kept_text", "chunk", "sure", "kept")
    out_schema = pa.schema([*_OUT, ("kept", kept_type)])

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        left = left.combine_chunks()
        keys, ids, sures = key_set(right)[0], left.column("doc_id").to_pylist(), left.column("sure").to_pylist()
        rows = {n: [] for n, _ in _OUT}
        for i, j, buf, off in text_slices(left.column("kept_text")):
            w = Words(buf, off)
            h = w.hashes()
            n = len(h)
            hit = np.zeros(n, bool)
            at = np.flatnonzero(_starts_ok(w.first, n, window))
            hit[at] = among(rolling(h, window, at), keys)
            for d in range(j - i):
                a, b = w.first[d], w.first[d + 1]
                hit[a:b] |= np.unpackbits(np.frombuffer(sures[i + d], np.uint8))[: b - a].astype(bool)
                gone, kept, spans = _finish(w, hit, d, window)
                for name, x in zip(rows, (ids[i + d], int(b - a), gone, left.column("kept_text")[i + d].as_py() if verbatim and not gone else kept.decode(), spans)):
                    rows[name].append(x)
        rows["kept"] = left.column("kept").combine_chunks().cast(kept_type)
        return pa.Table.from_pydict(rows, schema=out_schema)

    rest = undecided.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(second_pass, f"{_OUT_SQL}, kept {kept_sql}")
    return done.unionByName(rest.select(*names))
