"""Packing documents into training windows by best-fit decreasing.

Overlong documents are first cut into full windows. The remainders of a unit (a
scan partition, or as much of it as UNIT ids) are placed longest first into the
open window with the least room that still takes them, found in a segment tree
indexed by remaining capacity. Then the emptiest windows are cut to fill the rest
of the fuller ones, so that one window of a unit stays short; it is split at
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices
from .tokens import SLICE, encoder

UNIT = 8_000_000  # ids whose remainders are packed together
LEAST_FILL = 16  # a gap below this stays as padding rather than cutting a document for it


class RoomTree:
    """Open windows by remaining capacity; tightest(size) is the least room >= size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()

    def tightest(self, size: int) -> int | None:
        if size >= len(self.open):
            return None
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(sizes: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, length) pieces; every item is covered exactly once."""
    tree, wins, room = RoomTree(window), [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        n = sizes[k]
        r = tree.tightest(n)
        if r is None:
            w = len(wins)
            wins.append([])
            room.append(window)
        else:
            w = tree.take(r)
        wins[w].append((k, 0, n))
        room[w] -= n
        if room[w]:
            tree.add(room[w], w)
    order = sorted((w for w in range(len(wins)) if room[w]), key=lambda w: (room[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        full, gap = order[i], room[order[i]]
        if gap < LEAST_FILL:
            i += 1
            continue
        give = wins[order[j]]
        item, at, n = give.pop()
        cut = min(n, gap)
        wins[full].append((item, at, cut))
        room[full] -= cut
        room[order[j]] += cut
        if cut < n:
            give.append((item, at + cut, n - cut))
        if not give:
            j -= 1
        if not room[full]:
            i += 1
    out = []
    for w in wins:
        total = sum(n for _, _, n in w)
        if not w:
            continue
        if window - total < LEAST_FILL:
            out.append(w)
            continue
        bits = [1 << b for b in range(total.bit_length()) if total >> b & 1][::-1]
        part, left = [], bits.pop(0)
        for item, at, n in w:
            while n:
                cut = min(n, left)
                part.append((item, at, cut))
                at, n, left = at + cut, n - cut, left - cut
                if not left:
                    out.append(part)
                    part, left = [], bits.pop(0) if bits else 0
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, *, window: int = 2048, kind: str = "word", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its whole text and an end id, so that an empty or null
    text is one id. Every row of the table is a document of its own, also where
    ids are null or come twice. A sequence belongs to one unit of one partition;
    its id is the partition's number in the high bits. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else []), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def unit(docs_in, base):
        """Rows of a unit and the number of its sequences."""
        out = {n: [] for n in schema.names}
        seq = base

        def put(d, start, ids, sequence, offset):
            out["doc_id"].append(docs_in[d][0])
            out["start"].append(start)
            out["length"].append(len(ids))
            if with_ids:
                out["ids"].append(ids.view(np.int32))
            out["ids_crc32"].append(zlib.crc32(ids))
            out["doc_tokens"].append(len(docs_in[d][1]))
            out["sequence_id"].append(sequence)
            out["offset"].append(offset)

        short, sizes = [], []
        for d, (_, ids) in enumerate(docs_in):
            whole = len(ids) // window
            for k in range(whole):
                put(d, k * window, ids[k * window : (k + 1) * window], seq, 0)
                seq += 1
            if len(ids) % window:
                short.append((d, whole * window))
                sizes.append(len(ids) % window)
        for pieces in best_fit(sizes, window):
            offset = 0
            for item, at, n in pieces:
                d, start = short[item]
                put(d, start + at, docs_in[d][1][start + at : start + at + n], seq, offset)
                offset += n
            seq += 1
        return pa.RecordBatch.from_pydict(out, schema=schema), seq

    def run(batches):
        enc = encoder(vocabulary, kind)
        base = TaskContext.get().partitionId() << 33
        held, n = [], 0
        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, buf, off in text_slices(b.column(1), SLICE):
                got, first = enc.encode(buf, off)
                got = np.insert(got, first[1:], np.uint32(end_id)).astype("<u4")
                first = first + np.arange(len(first))
                held += [(names[i + d], got[first[d] : first[d + 1]]) for d in range(j - i)]
                n += len(got)
                if n >= UNIT:
                    batch, base = unit(held, base)
                    yield batch
                    held, n = [], 0
        if held:
            yield unit(held, base)[0]

    return rows.mapInArrow(lean(run), "doc_id long, start long, length long, " + ("ids array<int>, " if with_ids else "") + "ids_crc32 long, doc_tokens long, sequence_id long, offset long")
