"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles; equal sets are one class. Shingles have a
hash order, and a set's prefix is so many of its first shingles that two linked sets
have at least `agreed` of them in common.

1. An exchange of prefixes tells each set which of its prefix shingles other sets
   have. Sets with too few such shingles link with nothing.
2. The rest are dealt to places by their first common shingle under two hash orders,
   so that similar sets meet. A place holds a bounded number of sets; a shingle with
   more has several places, and its most typical set, the hub, goes to all of them.
   Inside a place, links are found by the token-group matrix. Their components are
   the groups: what is already connected needs no further look.
3. An exchange of all shingles of these sets tells each which of its own sets of
   other components have, and how many do. Sets with too few such shingles need no
   further look. The others may still link where they share one of the rarest, as
   many as two linked sets cannot both miss, if each has enough known shingles from
   there on for the size of the other. Components are cut into groups of bounded
   number and similar size, and each group's token union is stored.
   A set's overlap with the union bounds its overlap with every member, so its
   shingles go only to groups that reach the bound. Those are opened and compared
   exactly, until one link joins the components.

The token-group matrix of a place holds the token unions of small groups of its sets:
a query opens only groups whose union reaches the bound and that can still join two
components. Links leave as spanning forests, never as all pairs. The search is exact
for the 64-bit shingle names; sets are told apart by 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, U64, Scratch, Words, bucket_count, chunk_count, chunk_of, lean, mix64, packed, per_bucket, rolling, shared_keys, split_join, stored, text_slices
from .components import components

PLACE = 256  # sets of a place
PLACE_BYTES = 8 << 20  # and bytes of their shingles, on average
UNITE = 128  # sets of a stored group
GROUP = 16  # sets whose tokens are united in a place's matrix
ASKED = 1_000  # queries that meet a group in one task
EARLY = 8  # shingles of a set that travel with the one after them in its order of rare ones, so that a pair is named once
OFFERED = 1 << 20  # shingles that numpy handles at a time; one larger set is handled alone
SEVERAL = -1  # owner of a shingle of several components; components have names from 0 on
SPREAD = 8  # of the shingles that linked sets share, one in so many must be in both prefixes
FILTER_BITS = range(17, 31)  # powers of two that the bitmap over wanted texts may have, 16 bits a text as far as they go (128 MB)
_SALTS = (U64(0), U64(0x9FB21C651E98DF25))
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Measure:
    """What a threshold num / den asks of sets of given sizes; sizes may be arrays."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den

    def least(self, n):
        """Shingles that a set of n has in common with any set it links with; also the smallest such set."""
        return -(-self.num * n // self.den)

    def agreed(self, n):
        """Shingles in common that the prefixes of linked sets must show, the smaller having n."""
        return np.maximum(1, self.least(n) // SPREAD)

    def prefix(self, n):
        return n - self.least(n) + self.agreed(n)

    def links(self, both, n, m):
        return self.den * both >= self.num * (n + m - both)

    def reach(self, both, n):
        """The largest set that links with one of n if they have so many shingles in common."""
        return (self.num + self.den) * both // self.num - n

    @lru_cache(maxsize=8)
    def bands(self, most: int) -> np.ndarray:
        """Lower bounds of size bands: sets that link are of one band or of neighbours."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each document; fewer words than n make one shingle, no words none."""
    h = w.hashes()
    grams = rolling(h, n) if len(h) >= n else np.empty(0, U64)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            x = h[a:b]
            out.append(mix64(rolling(x, b - a) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of sets, as two signed numbers; 0, 0 for an empty one."""
    n = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((2, len(sets)), U64)
    full = np.flatnonzero(n)
    if len(full):
        cat = np.concatenate([sets[k] for k in full])
        at = np.append(0, np.cumsum(n[full])[:-1])
        for row, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            out[row, full] = mix64(np.add.reduceat(mix64(cat ^ U64(salt)), at) + n[full].astype(U64))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sets(col: pa.Array, n: int):
    for i, j, buf, off in text_slices(col):
        yield i, j, shingle_sets(Words(buf, off, lower=True), n)


def link_forest(sets: list[np.ndarray], measure: Measure) -> list[tuple[int, int]]:
    """Links (place, place) of a spanning forest of the graph of links over non-empty sets, by a token-group matrix."""
    m = len(sets)
    order = sorted(range(m), key=lambda k: (sets[k][:3].tolist(), len(sets[k])))
    sets = [sets[k] for k in order]
    n = np.array([len(s) for s in sets])
    cat = np.concatenate(sets)
    _, ids = np.unique(cat, return_inverse=True)
    off = np.append(0, np.cumsum(n))
    group = np.arange(m) // GROUP
    matrix = np.zeros((int(ids.max()) + 1, int(group[-1]) + 1), bool)
    matrix[ids, np.repeat(group, n)] = True
    part = np.arange(m)
    out = []
    mark = np.zeros(len(matrix), bool)
    for q in range(m - 1):
        apart = np.flatnonzero(part[q + 1 :] != part[q]) + q + 1
        apart = apart[(n[apart] >= measure.least(n[q])) & (n[q] >= measure.least(n[apart]))]
        if not len(apart):
            continue
        mine = ids[off[q] : off[q + 1]]
        maybe = np.unique(group[apart])
        bound = matrix[np.ix_(mine, maybe)].sum(0)
        maybe = maybe[bound >= measure.least(n[q])]
        if not len(maybe):
            continue
        mark[mine] = True
        for g in maybe.tolist():
            for k in apart[group[apart] == g].tolist():
                if part[k] != part[q] and measure.links(int(mark[ids[off[k] : off[k + 1]]].sum()), n[q], n[k]):
                    part[part == part[k]] = part[q]
                    out.append((order[q], order[k]))
        mark[mine] = False
    return out


def _star(edges: list[tuple[int, int]], names: np.ndarray, hub: int | None) -> list[tuple[int, int]]:
    """Edges that connect what a forest does, each set with the smallest of its component but the hub, which gets one edge from there."""
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in edges:
        root[find(a)] = find(b)
    parts: dict[int, list[int]] = {}
    for k in {x for e in edges for x in e}:
        parts.setdefault(find(k), []).append(k)
    out = []
    for members in parts.values():
        members.sort(key=lambda k: (names[k] == hub, names[k]))
        out += [(int(names[k]), int(names[members[0]])) for k in members[1:]]
    return out


def _rows(table: pa.Table, ids: str, value: str) -> dict:
    """The first value of each id."""
    out: dict[int, bytes] = {}
    for name, s in zip(table.column(ids).to_pylist(), table.column(value).to_pylist()):
        out.setdefault(name, s)
    return out


_LIVE = [("sid", pa.int64()), ("size", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("hash", pa.int64()), ("homes", pa.list_(pa.int64())), ("typical", pa.float64()), ("prefix", pa.binary())]
_LIVE_SQL = "sid long, size long, hi long, lo long, hash long, homes array<long>, typical double, prefix binary"


def _common_sets(measure: Measure):
    """Of a chunk's sets, those with enough prefix shingles that other sets have."""
    schema = pa.schema(_LIVE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(b"".join(right.column("keys").to_pylist()), U64))
        if not left.num_rows or not len(keys):
            return schema.empty_table()
        out = {n: [] for n in schema.names}
        for r in left.select(["sid", "size", "hi", "lo", "hash", "prefix"]).to_pylist():
            own = np.frombuffer(r["prefix"], U64)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            known = keys[at] == own
            must = int(measure.agreed(measure.least(r["size"])))
            if known.sum() < must:
                continue
            common = own[known]
            homes = [int(mix64(common ^ salt).min().view(np.int64)) ^ k for k, salt in enumerate(_SALTS)]
            for n, v in zip(schema.names, (r["sid"], r["size"], r["hi"], r["lo"], r["hash"], homes, len(common) / len(own), common.tobytes())):
                out[n].append(v)
        return pa.Table.from_pydict(out, schema=schema)

    return run


def _bitmap(table: DataFrame, key: F.Column, n_rows: int):
    """Size and broadcast bytes of a bitmap with bit pmod(key, size) set for each row of a stored table."""
    power = next((p for p in FILTER_BITS if 1 << p >= 16 * n_rows), FILTER_BITS[-1])
    size = 1 << power
    slot = F.pmod(key, F.lit(size))
    bits = np.zeros(size // 8, np.uint8)
    for r in table.groupBy((slot / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(slot % 32768).alias("map")).toLocalIterator():
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return size, table.sparkSession.sparkContext.broadcast(bits)


def _flagged(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _wanted_sets(rows: DataFrame, live: DataFrame, n_live: int, n: int) -> DataFrame:
    """(sid, shingles) of the sets that may link, taken from the texts again; a bitmap keeps most other texts out."""
    size, shared = _bitmap(live, F.col("hash"), n_live)
    slot = F.pmod("hash", F.lit(size))
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        bits = shared.value
        for b in batches:
            at = b.column(1).to_numpy(zero_copy_only=False)
            some = b.column(0).filter(pa.array(_flagged(bits, at)))
            for _, _, sets in _sets(some, n):
                hi, lo = set_names(sets)
                fresh: dict[tuple[int, int], bytes] = {}
                for x, y, s in zip(hi.tolist(), lo.tolist(), sets):
                    if len(s) and (x, y) not in fresh:
                        fresh[x, y] = s.tobytes()
                yield pa.RecordBatch.from_pydict({"hi": [x for x, _ in fresh], "lo": [y for _, y in fresh], "shingles": list(fresh.values())}, schema=schema)

    found = rows.select("text", slot.alias("slot")).mapInArrow(lean(run), "hi long, lo long, shingles binary")
    return found.groupBy("hi", "lo").agg(F.first("shingles").alias("shingles")).join(live.select("hi", "lo", "sid"), ["hi", "lo"]).select("sid", "shingles")


def _links_at_homes(work: Scratch, live: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): links of sets that meet at a place, as stars."""
    at = work.store(live.select("sid", "size", "typical", F.explode("homes").alias("home")), "homes")
    best = F.max_by("sid", F.struct("typical", "size", "sid")).alias("hub")
    parts = F.greatest(F.ceil(F.col("n") / PLACE), F.ceil(F.col("bytes") / PLACE_BYTES)).cast("int")
    homes = work.store(at.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes"), best).where("n > 1").select("home", "n", "hub", parts.alias("parts")), "home-sizes")
    own = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    placed = split_join(at.select("sid", "home"), homes, ["home"], "n", at.count())
    placed = placed.select("sid", "home", "hub", F.explode(F.when(F.col("sid") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part"))

    def meet(table: pa.Table) -> pa.Table:
        held = _rows(table, "sid", "shingles")
        if len(held) < 2:
            return _PAIR.empty_table()
        names = np.array(list(held), np.int64)
        pairs = _star(link_forest([np.frombuffer(s, U64) for s in held.values()], measure), names, table.column("hub")[0].as_py())
        return pa.Table.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, schema=_PAIR)

    return placed.join(sets, "sid").groupBy("home", "part").applyInArrow(meet, "a long, b long")


_OWNED = [("bucket", pa.int32()), ("keys", pa.binary()), ("chunks", pa.binary()), ("owners", pa.binary()), ("weights", pa.binary())]
_OWNED_SQL = "bucket int, keys binary, chunks binary, owners binary, weights binary"
_MIXED = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("levels", pa.binary())])
_SCARCE = pa.schema([("sid", pa.int64()), ("known", pa.int64()), ("rare", pa.binary())])


def _offer_owned(buckets: int):
    """All shingles of sets, with the chunks that wait for a reply and the component that has them, or SEVERAL."""
    schema = pa.schema(_OWNED)

    def run(batches):
        for b in batches:
            size, chunk, comp, shingles = b.column("size").to_numpy(), b.column("chunk").to_numpy(), b.column("comp").to_numpy(), b.column("shingles")
            upto = np.append(0, np.cumsum(size))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + OFFERED, "right")) - 1)
                keys = np.frombuffer(b"".join(shingles[i:j].to_pylist()), U64)
                chunks, owners = np.repeat(chunk[i:j].astype(np.uint32), size[i:j]), np.repeat(comp[i:j], size[i:j])
                i = j
                order = np.lexsort((keys, chunks))
                keys, chunks, owners = keys[order], chunks[order], owners[order]
                at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])))
                weights = np.minimum(np.diff(np.append(at, len(keys))), 255).astype(np.uint8)
                least = np.minimum.reduceat(owners, at)
                owners = np.where(least == np.maximum.reduceat(owners, at), least, SEVERAL)
                keys, chunks = keys[at], chunks[at]
                bucket = (keys % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, cols = bucket[order], [x[order] for x in (keys, chunks, owners, weights)]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                parts = [[x[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(bucket)))] for x in cols]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [bucket[cut], *parts])), schema=schema)

    return run


def _mixed(held: dict):
    """For each chunk those of its shingles that sets of at least two components have; levels grow with the number of the sets."""
    keys, chunks, owners, weights = (np.frombuffer(b"".join(held[c]), kind) for c, kind in (("keys", U64), ("chunks", np.uint32), ("owners", np.int64), ("weights", np.uint8)))
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, chunks, owners, weights = keys[order], chunks[order], owners[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(at, len(keys)))
    least = np.minimum.reduceat(owners, at)
    keep = np.repeat((least == SEVERAL) | (least != np.maximum.reduceat(owners, at)), times)
    if not keep.any():
        return
    level = np.repeat(np.minimum(255, 8 * np.log2(np.add.reduceat(weights.astype(np.int64), at))).astype(np.uint8), times)
    keys, chunks, level = keys[keep], chunks[keep], level[keep]
    order = np.lexsort((keys, chunks))
    keys, chunks, level = keys[order], chunks[order], level[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1]))
    keys, chunks, level = keys[new], chunks[new], level[new]
    cut = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1]))
    ranges = list(zip(cut, np.append(cut[1:], len(keys))))
    yield pa.RecordBatch.from_pydict({"chunk": chunks[cut].astype(np.int32), "keys": [keys[a:b].tobytes() for a, b in ranges], "levels": [level[a:b].tobytes() for a, b in ranges]}, schema=_MIXED)


def _scarce_shingles(measure: Measure):
    """Of a chunk's sets, those with enough shingles that other components have: their number, and the rarest of them in the global order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(right.column("keys").to_pylist()), U64)
        if not left.num_rows or not len(keys):
            return _SCARCE.empty_table()
        level = np.frombuffer(b"".join(right.column("levels").to_pylist()), np.uint8)
        order = np.argsort(keys)
        keys, level = keys[order], level[order]
        out = {n: [] for n in _SCARCE.names}
        for sid, shingles in zip(left.column("sid").to_pylist(), left.column("shingles").to_pylist()):
            own = np.frombuffer(shingles, U64)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            known = keys[at] == own
            spare = int(known.sum()) - int(measure.least(len(own)))
            if spare < 0:
                continue
            common = own[known]
            rare = np.lexsort((common, level[at[known]]))[: spare + 1]  # shingles that no other component has come first in the order and are left out
            for n, v in zip(_SCARCE.names, (sid, len(common), common[rare].tobytes())):
                out[n].append(v)
        return pa.Table.from_pydict(out, schema=_SCARCE)

    return run


def _scarce(work: Scratch, tagged: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """(sid, known, rare): the sets that may link with another component."""
    n_rows, n_shingles = tagged.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_chunks = chunk_count(n_rows, 8 * n_shingles)
    chunked = sets.withColumn("chunk", chunk_of(n_chunks, F.col("sid")))
    offered = chunked.join(tagged.select("sid", "size", "comp"), "sid").select("chunk", "size", "comp", "shingles")
    replies = per_bucket(offered.mapInArrow(lean(_offer_owned(bucket_count(sets.sparkSession, 21 * n_shingles))), _OWNED_SQL), _mixed, "chunk int, keys binary, levels binary")
    found = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_scarce_shingles(measure), "sid long, known long, rare binary")
    return work.store(found, "scarce")


_RARE = [("bucket", pa.int32()), ("tokens", pa.binary()), ("sids", pa.binary()), ("groups", pa.binary()), ("comps", pa.binary()), ("weights", pa.binary()), ("bands", pa.binary()), ("smallest", pa.binary()), ("sizes", pa.binary()), ("reaches", pa.binary()), ("early", pa.binary())]
_RARE_SQL = "bucket int, tokens binary, sids binary, groups binary, comps binary, weights binary, bands binary, smallest binary, sizes binary, reaches binary, early binary"
_OPENED = pa.schema([("sid", pa.int64()), ("grp", pa.int64())])


def _before(rare: np.ndarray) -> np.ndarray:
    """For each shingle of a set's rare ones the EARLY nearest before it, 0 where there are fewer.

    Similar sets have most shingles in common, so that what they shared last lies a few places
    back, while the first ones of all may be shared with other sets alone.
    """
    out = np.zeros((len(rare), EARLY), U64)
    for k in range(min(EARLY, len(rare) - 1)):
        out[k + 1 :, k] = rare[: len(rare) - k - 1]
    return out


def _offer_rare(buckets: int, measure: Measure | None = None):
    """Entries of rare shingles; with a measure each says how large a set may be that links and shares no earlier shingle."""
    schema = pa.schema(_RARE)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = [np.frombuffer(x, U64) for x in b.column("rare").to_pylist()]
            k = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            early = np.concatenate([_before(p) for p in parts])
            bucket = (k % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            smallest = size = reach = np.zeros(len(k), np.int64)
            if measure is not None:
                smallest, size = (b.column(c).to_numpy()[owner] for c in ("smallest", "size"))
                reach = measure.reach(b.column("known").to_numpy()[owner] - np.concatenate([np.arange(len(p)) for p in parts]), size)
            k, owner, bucket, early, smallest, size, reach = (x[order] for x in (k, owner, bucket, early, smallest, size, reach))
            cols = [*(b.column(c).to_numpy()[owner] for c in ("sid", "grp", "comp", "weight", "band")), smallest, size, reach]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k) else np.empty(0, int)
            out = {n: [] for n in schema.names}
            for x, y in zip(cut, np.append(cut[1:], len(k))):
                out["bucket"].append(int(bucket[x]))
                out["tokens"].append(k[x:y].tobytes())
                out["early"].append(early[x:y].tobytes())
                for n, c in zip(schema.names[2:-1], cols):
                    out[n].append(c[x:y].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _named_before(token: np.ndarray, grp: np.ndarray, comp: np.ndarray, size: np.ndarray, reach: np.ndarray, early: np.ndarray):
    """A function of entries (i, g) of one shingle: has a set of g's group, of another component than i's and with i in reach, an early shingle of i's?"""
    _, run = np.unique(token, return_inverse=True)
    groups, member = np.unique(grp, return_inverse=True)
    shingles, there = np.unique(early, return_inverse=True)
    _, spot = np.unique(run[:, None] * len(shingles) + there.reshape(early.shape), return_inverse=True)  # a shingle and an earlier one
    spot = spot.reshape(early.shape) * len(groups)
    some = early != 0
    key, of = (spot + member[:, None])[some], np.broadcast_to(np.arange(len(comp))[:, None], early.shape)[some]
    order = np.lexsort((-reach[of], comp[of], key))
    key, of = key[order], of[order]
    if len(key):
        best = np.append(True, (key[1:] != key[:-1]) | (comp[of[1:]] != comp[of[:-1]]))  # of each component the set that reaches farthest
        key, of = key[best], of[best]
    order = np.lexsort((-reach[of], key))
    key, of = key[order], of[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    key, farthest = key[at], (of[at], of[np.minimum(at + 1, np.append(at[1:], len(of)) - 1)] if len(at) else of)  # two of different components, if there are

    def ask(i: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(EARLY if len(key) else 0):
            left = np.flatnonzero(~out & some[i, k])
            want = spot[i[left], k] + member[g[left]]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            mine = i[left]
            for other in (x[place] for x in farthest):
                out[left] |= (key[place] == want) & (comp[other] != comp[mine]) & (size[mine] <= reach[other])
        return out

    return ask


def _queries(held: dict):
    """Distinct (sid, grp) of a bucket: sets and groups that share a rare shingle, are not all of one component and may fit in size.

    Of two groups, the one with fewer sets asks and the other is asked; a group asks
    itself. Sets that link are in each other's reach at their first common shingle in
    the global order, rarest first. Reach falls along the order, so that a set and a
    group are not named where one of the group's sets of this shingle, of another
    component and with the set in reach, has one of the set's early shingles, as that
    one's bucket names them. Early shingles beyond EARLY are not known here; such a
    pair may be named again.
    """
    token = np.frombuffer(b"".join(held["tokens"]), U64)
    sid, grp, comp, weight, band, smallest, size, reach = (np.frombuffer(b"".join(held[c]), np.int64) for c in ("sids", "groups", "comps", "weights", "bands", "smallest", "sizes", "reaches"))
    early = np.frombuffer(b"".join(held["early"]), U64).reshape(-1, EARLY)
    order = np.lexsort((comp, grp, token))
    token, sid, grp, comp, weight, band, smallest, size, reach, early = (x[order] for x in (token, sid, grp, comp, weight, band, smallest, size, reach, early))
    if not len(token):
        return
    named_before = _named_before(token, grp, comp, size, reach, early)
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    end = np.append(at[1:], len(token))
    mixed = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
    heads = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])))  # the first entry of each group of a shingle
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(token))))
    best = comp[np.lexsort((-reach, run))[heads]]  # the component that reaches farthest, how far it and how far others do
    far, others = np.maximum.reduceat(reach, heads), np.maximum.reduceat(np.where(comp == best[run], -1, reach), heads)
    found, n = [], 0

    def flush():
        i, g = np.concatenate(found, axis=1)
        fresh = ~named_before(i, g)
        p = np.unique(np.stack([sid[i[fresh]], grp[g[fresh]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=_OPENED)

    for a, b in zip(at[mixed].tolist(), end[mixed].tolist()):
        r = slice(run[a], run[b - 1] + 1)
        head, which, farthest, next_far = heads[r], best[r], far[r], others[r]
        step = max(1, (1 << 20) // len(head))
        for x in range(a, b, step):
            i = np.arange(x, min(b, x + step))
            i, j = np.repeat(i, len(head)), np.tile(np.arange(len(head)), len(i))
            g = head[j]
            asks = (weight[i] < weight[g]) | ((weight[i] == weight[g]) & (grp[i] <= grp[g]))
            fits = size[i] <= np.where(which[j] != comp[i], farthest[j], next_far[j])
            ok = asks & fits & (smallest[g] <= reach[i]) & (np.abs(band[i] - band[g]) <= 1)
            if ok.any():
                found.append(np.stack([i[ok], g[ok]]))
                n += found[-1].shape[1]
            if n > 1 << 20:
                yield flush()
                found, n = [], 0
    if n:
        yield flush()


_UNION = pa.schema([("grp", pa.int64()), ("smallest", pa.int64()), ("largest", pa.int64()), ("tokens", pa.binary())])


def _unite(table: pa.Table) -> pa.Table:
    tokens = np.unique(np.concatenate([np.frombuffer(x, U64) for x in table.column("prefix").to_pylist()]))
    size = table.column("size").to_numpy()
    return pa.Table.from_pydict({"grp": [table.column("grp")[0].as_py()], "smallest": [int(size.min())], "largest": [int(size.max())], "tokens": [tokens.tobytes()]}, schema=_UNION)


def _links_across(work: Scratch, live: DataFrame, sets: DataFrame, known: DataFrame, measure: Measure, top: int) -> DataFrame | None:
    """(a, b): a link between any two components of known that have one, for the remaining pairs of sets; None if no pair remains."""
    spark = live.sparkSession
    edges = F.array(*[F.lit(int(x)) for x in measure.bands(top)])
    tagged = live.withColumn("home", F.col("homes")[0]).drop("homes", "typical", "hi", "lo", "hash").join(known.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    tagged = work.store(tagged.withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("size"))).cast("long")), "tagged")
    tagged = work.store(tagged.join(_scarce(work, tagged, sets, measure), "sid"), "tagged-scarce")
    n_live = tagged.count()
    if not n_live:
        return None
    kinds = tagged.groupBy("home", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("size")).alias("bytes"), F.min("size").alias("smallest"))
    kinds = kinds.withColumn("blocks", F.greatest(F.ceil(F.col("n") / UNITE), F.ceil(F.col("bytes") / PLACE_BYTES)))
    kinds = work.store(kinds.select("home", "band", "n", "blocks", "smallest", F.ceil(F.col("n") / F.col("blocks")).alias("weight")), "group-sizes")
    grp = F.xxhash64("home", "band", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    grouped = work.store(split_join(tagged, kinds, ["home", "band"], "n", n_live).withColumn("grp", grp).drop("n", "blocks", "home"), "grouped")

    buckets = bucket_count(spark, (72 + 8 * EARLY) * (tagged.agg(F.sum(F.octet_length("rare"))).first()[0] or 0) // 8)
    offered = grouped.select("sid", "grp", "comp", "weight", "band", "smallest", "size", "known", "rare").mapInArrow(lean(_offer_rare(buckets, measure)), _RARE_SQL)
    asked = work.store(per_bucket(offered, _queries, "sid long, grp long").distinct(), "asked")
    load = work.store(asked.groupBy("grp").agg(F.count(F.lit(1)).alias("q")).withColumn("parts", F.ceil(F.col("q") / ASKED).cast("int")), "asked-sizes")
    if load.isEmpty():
        return None
    unions = work.store(grouped.join(load.select("grp"), "grp", "left_semi").select("grp", "size", "prefix").groupBy("grp").applyInArrow(_unite, "grp long, smallest long, largest long, tokens binary"), "unions")

    def dealt(asked: DataFrame, load: DataFrame) -> DataFrame:
        """Queries with the part of their group's queries that they are in."""
        return split_join(asked, load.toDF(*load.columns), ["grp"], "q", n_asked).select("sid", "grp", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"))

    def spread(table: DataFrame, load: DataFrame) -> DataFrame:
        return table.join(load.toDF(*load.columns).select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "grp")

    n_asked = asked.count()
    queries = dealt(asked, load).join(tagged.toDF(*tagged.columns).select("sid", "size", "prefix"), "sid")

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OPENED.empty_table()
        u = left.to_pylist()[0]
        tokens = np.frombuffer(u["tokens"], U64)
        keep = []
        for k, (n, p) in enumerate(zip(right.column("size").to_pylist(), right.column("prefix").to_pylist())):
            low = max(int(measure.least(n)), u["smallest"])
            if u["largest"] < measure.least(n) or n < measure.least(u["smallest"]):
                continue
            own = np.frombuffer(p, U64)
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            if (tokens[at] == own).sum() >= measure.agreed(min(n, low)):
                keep.append(k)
        return right.select(["sid", "grp"]).take(pa.array(keep, pa.int64()))

    fit = spread(unions, load).groupBy("grp", "part").cogroup(queries.groupBy("grp", "part")).applyInArrow(bound, "sid long, grp long")
    fit = work.store(fit, "opened")
    load = work.store(fit.groupBy("grp").agg(F.count(F.lit(1)).alias("q")).withColumn("parts", F.ceil(F.col("q") / ASKED).cast("int")), "opened-sizes")
    if load.isEmpty():
        return None
    n_asked = fit.count()
    members = spread(grouped.select("sid", "grp", "comp").join(load.select("grp"), "grp", "left_semi").join(sets, "sid"), load)
    openers = dealt(fit, load).join(tagged.toDF(*tagged.columns).select("sid", "comp"), "sid").join(sets.toDF(*sets.columns), "sid")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIR.empty_table()
        names, comp = left.column("sid").to_numpy(), left.column("comp").to_numpy()
        inside = [np.frombuffer(x, U64) for x in left.column("shingles").to_pylist()]
        size = np.array([len(x) for x in inside])
        cat = np.concatenate(inside)
        union = np.unique(cat)
        at = np.append(0, np.cumsum(size)[:-1])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        found = [[], []]
        for name, mine, x in zip(right.column("sid").to_pylist(), right.column("comp").to_pylist(), right.column("shingles").to_pylist()):
            own = np.frombuffer(x, U64)
            place = np.minimum(np.searchsorted(union, own), len(union) - 1)
            if (union[place] == own).sum() < measure.least(max(len(own), int(size.min()))):
                continue
            place = np.minimum(np.searchsorted(own, cat), len(own) - 1)
            both = np.add.reduceat(own[place] == cat, at, dtype=np.int64)
            for k in np.flatnonzero(measure.links(both, len(own), size) & (comp != mine)).tolist():
                other = int(comp[k])
                if find(other) != find(mine):  # a forest over components, not all links
                    root[find(other)] = find(mine)
                    found[0].append(name)
                    found[1].append(int(names[k]))
        return pa.Table.from_pydict({"a": found[0], "b": found[1]}, schema=_PAIR)

    return members.groupBy("grp", "part").cogroup(openers.groupBy("grp", "part")).applyInArrow(compare, "a long, b long")


def _classified(docs: DataFrame, n: int, threshold: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, n_shingles, component, component_id), a row per input row.

    hash is the text's; component names a component of at least two rows, and is null
    for a row that links with nothing; component_id is its smallest id.
    """
    measure = Measure(*threshold)
    spark = docs.sparkSession
    work = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("prefix", pa.binary())])

    def describe(batches):
        for b in batches:
            for i, j, sets in _sets(b.column("text"), n):
                size = [len(s) for s in sets]
                none = pa.array([not k for k in size])
                hi, lo = (pa.array(x, mask=none.to_numpy(zero_copy_only=False)) for x in set_names(sets))
                prefix = pa.array([s[: int(measure.prefix(len(s)))].tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("hash")[i:j], pa.array(size, pa.int64()), hi, lo, prefix], schema=schema)

    described = work.store(rows.select("doc_id", "hash", "text").mapInArrow(lean(describe), "doc_id long, hash long, n_shingles long, hi long, lo long, prefix binary"), "jaccard-described")
    stats = described.agg(F.count("hi"), F.sum(F.octet_length("prefix")), F.max("n_shingles")).first()
    n_rows, n_bytes, top = stats[0], stats[1] or 0, stats[2] or 1
    n_chunks = chunk_count(n_rows, n_bytes)

    one = described.where("hi is not null").groupBy("hi", "lo").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix")
    )
    one = work.store(one.withColumn("sid", F.monotonically_increasing_id()).withColumn("chunk", F.pmod("hi", F.lit(n_chunks)).cast("int")), "jaccard-sets")
    buckets = bucket_count(spark, 13 * n_bytes // 8)

    def offer(batches):
        for b in batches:
            if b.num_rows:
                keys = [np.frombuffer(x, U64) for x in b.column("prefix").to_pylist()]
                yield packed(np.concatenate(keys), np.repeat(b.column("chunk").to_numpy(), [len(k) for k in keys]), buckets)

    replies = shared_keys(one.select("chunk", "prefix").mapInArrow(lean(offer), PACKED)).select("chunk", "keys")
    live = one.select("chunk", "sid", "size", "hi", "lo", "hash", "prefix").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_common_sets(measure), _LIVE_SQL)
    live = work.store(live, "jaccard-live")
    n_live = live.count()
    links = None
    if n_live:
        sets = work.store(_wanted_sets(rows, live, n_live, n), "jaccard-shingles")
        links = work.store(components(_links_at_homes(work, live, sets, measure)), "components")
        more = _links_across(work, live, sets, links, measure, top)
        if more is not None:
            links = components(links.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    # only sets with copies or links have a component other than their own document's id
    own = one.select("sid", "hi", "lo", "doc_id", "copies")
    named = own.withColumn("component", F.col("sid")) if links is None else own.join(links.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = work.store(named, "jaccard-named")
    least = work.store(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"), F.sum("copies").alias("docs")).where("docs > 1").drop("docs"), "jaccard-least")
    classes = work.store(split_join(named, least, ["component"], "n", named.count()).select("hi", "lo", "component", "component_id", "copies"), "jaccard-classes")
    base = described.drop("prefix")
    named = split_join(base.where("hi is not null"), classes, ["hi", "lo"], "copies", max(1, n_rows), "left").select("doc_id", "hash", "n_shingles", "component", "component_id")
    none = base.where("hi is null").select("doc_id", "hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("component_id"))
    found = stored(named.unionByName(none), "jaccard-classified")
    work.clear()
    return found


def jaccard_components(docs: DataFrame, *, n: int = 3, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per input row.

    Two documents link when their shingle sets' Jaccard similarity is at least
    threshold (numerator, denominator); component_id is the smallest id reachable
    over links. Texts without words, and null ones, have no shingle, link with
    nothing and are their own component. Equal ids and rows that come twice are
    documents of their own with one id; a null id is never a component's name
    unless all its members' ids are null. Other columns are ignored, an empty table
    gives no rows, and texts may have any length.
    """
    found = _classified(docs, n, threshold, id_col, text_col)
    return found.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component of rows that with the smallest id stays.

    Of rows of a component that share that id one stays; rows that only share an
    id do not compete. Rows without an id cannot be named as a component's first
    and stay. Texts without words have no duplicates and stay. All columns are
    returned as they are, whatever their names; an empty table stays empty.
    """
    found = _classified(docs, n, threshold, id_col, text_col).where("component is not null and doc_id is not null").select("component", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    keys = stored(found.groupBy("component", "_id", "_hash").agg(F.count(F.lit(1)).alias("n")), "jaccard-keys")
    first = keys.groupBy("component").agg(F.min(F.struct("_id", "_hash", "n")).alias("first")).select("first.*")
    twice = stored(first.where("n > 1").select("_id", "_hash"), "jaccard-twice")  # the first document stands in several rows
    gone = stored(keys.select("_id", "_hash").join(first.where("n = 1").select("_id", "_hash"), ["_id", "_hash"], "left_anti"), "jaccard-gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"))
    # only rows that the bitmap cannot clear are moved to be held against the list; the others stay where they are
    name = F.xxhash64("_id", "_hash")
    size, shared = _bitmap(gone, name, gone.count())

    @F.pandas_udf("boolean")
    def listed(at: pd.Series) -> pd.Series:
        return pd.Series(_flagged(shared.value, at.to_numpy()))

    rows = rows.withColumn("_listed", listed(F.pmod(name, F.lit(size))))
    kept = rows.where("not _listed").select("row.*").unionByName(rows.where("_listed").join(gone, ["_id", "_hash"], "left_anti").select("row.*"))
    if twice.isEmpty():
        return kept
    one = rows.where("_listed").join(twice, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row.*"))
