"""Nearest neighbours by inner product: an inverted file whose lists are scanned with adaptive dimensions.

Vectors get one more coordinate, so that the largest inner product is the least
distance, and are rotated by a random orthogonal matrix, so that any first
coordinates are a fair sample of a distance. A query first scores the few lists nearest
to it in full, which gives it a bound. Then its other probed lists are scanned, nearer
ones first to tighten the bound: squared distances are added up over blocks of columns,
and after each block a hypothesis test compares what a candidate's distance must be with
the bound and abandons it early. What is left is scored exactly on the original vectors.
So a query's cells hand out a few times k candidates, however many cells there are.

Centroids and the number of probed lists are fitted on a bounded sample (of at most
PER_LIST vectors a list and SAMPLE in all, by a hash of the row); every vector is indexed, and answers
come from lists alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

PER_LIST = 8  # vectors of the sample for each list
SAMPLE = 32_768  # vectors of the sample, at most
LISTS = 4_096  # lists, at most; below, eight times the root of the number of vectors
BLOCK = 2_048  # vectors of a list that one scan holds
QUERIES = 2_048  # queries of a scan, about
COLUMNS = 16  # rotated dimensions of a column block
EPSILON = 2.1  # of the test: a candidate is abandoned if its partial distance is above (1 + EPSILON / sqrt(d)) times its share of the bound
RECALL = 0.965  # of the sample's neighbours that probed lists must hold
CELL = 64  # lists of a cell, about; a query travels once to each cell that holds lists it probes
FIRST = 8  # probed lists are scanned in three steps, each up to so many times the lists of the one before


def _chunks(n: int, width: int):
    step = max(1, (1 << 22) // max(1, width))
    return ((a, min(n, a + step)) for a in range(0, n, step))


class Index:
    """Rotation, centroids and the number of probed lists."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.norm, self.k = norm, k
        d = sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.lift(np.unique(sample, axis=0))  # copies would pass for neighbours
        self.centroids = x[rng.permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
        for _ in range(5):
            near = self.nearest(x)
            order = np.argsort(near, kind="stable")
            mine, at = np.unique(near[order], return_index=True)
            self.centroids[mine] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
        self.cell = self._cells(rng)
        self.probes = self._fit_probes(x, rng)
        self.steps = sorted({-(-self.probes // FIRST**2), -(-self.probes // FIRST), self.probes})

    def _cells(self, rng) -> np.ndarray:
        """The cell of each list: lists are dealt to cells by their centroids."""
        c = self.centroids
        heads = c[rng.permutation(len(c))[: -(-len(c) // CELL)]].copy()
        for _ in range(5):
            near = ((heads * heads).sum(1)[None] - 2 * c @ heads.T).argmin(1)
            for k in np.unique(near):
                heads[k] = c[near == k].mean(0)
        return near.astype(np.int32)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rotated candidates: |lift(x) - ask(q)|^2 = norm^2 + |q|^2 - 2 x.q."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) @ self.turn

    def ask(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.turn

    def _far(self, q: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the query's own square."""
        return (self.centroids * self.centroids).sum(1)[None] - 2 * q @ self.centroids.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._far(x[a:b]).argmin(1) for a, b in _chunks(len(x), len(self.centroids))])

    def _fit_probes(self, x: np.ndarray, rng) -> int:
        """Lists to probe so that they hold RECALL of the neighbours of queries drawn from the sample."""
        at = rng.permutation(len(x))[:200]
        q = self.ask((x @ self.turn.T)[at, :-1])
        k = min(self.k, len(x) - 1)
        if k < 1:
            return 1
        far = (x * x).sum(1)[None] - 2 * q @ x.T
        far[np.arange(len(at)), at] = np.inf
        best = np.argpartition(far, k - 1, axis=1)[:, :k]
        rank = self._far(q).argsort(1).argsort(1)
        need = np.sort(rank[np.arange(len(at))[:, None], self.nearest(x)[best]].ravel())
        return int(need[min(len(need) - 1, math.ceil(RECALL * len(need)))]) + 1

    def route(self, q: np.ndarray, low: int, high: int) -> np.ndarray:
        """The lists of a query by nearness, from place low up to high."""
        return np.concatenate([np.argsort(self._far(q[a:b]), axis=1, kind="stable")[:, low:high] for a, b in _chunks(len(q), len(self.centroids))])


def scan(turned: np.ndarray, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places that the tests leave; bound: a squared distance for each query."""
    d, found = turned.shape[1], []
    for a, b in _chunks(len(asked), len(turned)):
        q, limit = asked[a:b], bound[a:b]
        w = min(COLUMNS, d)
        part = np.maximum((q[:, :w] ** 2).sum(1)[:, None] + (turned[:, :w] ** 2).sum(1)[None] - 2 * q[:, :w] @ turned[:, :w].T, 0)

        def test(done):
            share = (done / d) * (1 + EPSILON / math.sqrt(done)) ** 2 if done < d else 1.0
            return limit * share * (1 + 1e-9) + 1e-12

        i, j = np.nonzero(part <= test(w)[:, None])
        part = part[i, j]
        for low in range(w, d, COLUMNS):
            high = min(d, low + COLUMNS)
            part = part + ((q[i, low:high] - turned[j, low:high]) ** 2).sum(1)
            keep = part <= test(high)[i]
            i, j, part = i[keep], j[keep], part[keep]
        found.append(np.stack([i + a, j]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, int), np.empty(0, int))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    return np.cumsum(x * q, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that take part; null, zero, and those with null or non-finite components do not."""
    v = F.col("v")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(len(col), -1)


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "query long, query_id long, row long, vec_id long, score double"


def _best(left: pa.Table, x: np.ndarray, right: pa.Table, q: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> pa.Table:
    """The k best candidates j of each query i, scored exactly."""
    rows, ids, queries = left.column("row").to_numpy(), left.column("vec_id").to_numpy(), right.column("query").to_numpy()
    other = rows[j] != queries[i]
    i, j = i[other], j[other]
    if not len(i):
        return _FOUND.empty_table()
    s = np.concatenate([exact(x[j[a:b]], q[i[a:b]]) for a, b in _chunks(len(i), x.shape[1])])
    order = np.lexsort((rows[j], ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    rank = np.arange(len(i)) - np.repeat(at, np.diff(np.append(at, len(i))))
    i, j, s = i[rank < k], j[rank < k], s[rank < k]
    return pa.table([queries[i], right.column("query_id").to_numpy()[i], rows[j], ids[j], s], schema=_FOUND)


def _among_rarer(rows: DataFrame, most: int, k: int, every: int) -> DataFrame:
    """The k nearest of each query among the vectors of its own length, compared in blocks; most: vectors of one length."""
    n = max(1, -(-most // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(F.size("v").alias("d"), block.alias("b"), every_block.alias("a"), "row", "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.size("v").alias("d"), block.alias("a"), every_block.alias("b"), F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        x, q = _matrix(left.column("v")), _matrix(right.column("q"))
        out = []
        for a, b in _chunks(len(q), len(x)):
            i, j = np.divmod(np.arange((b - a) * len(x)), len(x))
            out.append(_best(left, x, right, q, i + a, j, k))
        return pa.concat_tables(out)

    keys = ["d", "a", "b"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, _FOUND_SQL)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, the vectors whose id is divisible by every.

    Candidates are all usable vectors of the query's length but its own row. The
    index is of the most common length; vectors of each rarer one are compared
    exactly among themselves. Ties go to the smaller id. Of
    equal vectors only the k + 1 with the smallest ids can be among any k nearest,
    and only they enter the lists. Fewer than k candidates give all of them; an
    empty table gives no rows. Rows that share an id are vectors,
    and queries, of their own: each of such queries has its ranks. Null ids take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(2).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_rows, length = common[0]["n"], common[0]["d"]
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    norm = math.sqrt(rows.where(F.size("v") == length).agg(F.max(square)).first()[0])
    lists = max(1, min(LISTS, int(8 * math.sqrt(n_rows))))
    sample = rows.where(F.size("v") == length).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(SAMPLE, PER_LIST * lists)).select("v").toArrow()
    index = Index(_matrix(sample.column("v")), norm, k, lists)
    shared = spark.sparkContext.broadcast(index)  # at most LISTS centroids

    def assign(batches):
        for b in batches:
            if b.num_rows:
                size = b.column(2).value_lengths().to_numpy()
                own = np.full(len(size), -1, np.int32)  # a rarer length has no list
                mine = size == length
                if mine.any():
                    x = _matrix(b.column(2).filter(pa.array(mine)))
                    own[mine] = shared.value.nearest(shared.value.lift(x))
                cell = np.where(own >= 0, shared.value.cell[own], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), *b.columns], names=["cell", "list", "row", "vec_id", "v"])

    indexed = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(lean(assign), "cell int, list int, row long, vec_id long, v array<double>")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    indexed = stored(indexed.withColumn("copy", copy), "vector-lists")  # the inverted file; rows keep their numbers
    listed = indexed.where((F.col("list") >= 0) & (F.col("copy") <= k + 1)).drop("copy")
    n_cells = int(index.cell.max()) + 1
    n_blocks = {r["cell"]: max(1, -(-r["count"] // BLOCK)) for r in listed.groupBy("cell").count().collect()}  # a row per cell
    blocks = F.array(*[F.lit(n_blocks.get(c, 1)) for c in range(n_cells)])
    queries = indexed.where((F.col("list") >= 0) & (F.col("vec_id") % every == 0)).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def probe(asked: DataFrame, low: int, high: int) -> DataFrame:
        """The k best of each query in its lists from place low up to high; asked: query, query_id, q, bound.

        A cell's queries are split into sets of about QUERIES, and its vectors are copied
        once for each: not at all where no query goes.
        """
        schema = pa.schema([("cell", pa.int32()), ("lists", pa.list_(pa.int32())), ("query", pa.int64()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("bound", pa.float64())])

        def route(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                to = shared.value.route(shared.value.ask(_matrix(b.column(2))), low, high)
                owner, to = np.repeat(np.arange(len(to)), to.shape[1]), to.ravel().astype(np.int32)
                cell = shared.value.cell[to]
                order = np.lexsort((to, cell, owner))
                owner, to, cell = owner[order], to[order], cell[order]
                at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(to)), pa.int32()), pa.array(to))
                who = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at]), lists, b.column(0).take(who), b.column(1).take(who), b.column(2).take(who).cast(pa.list_(pa.float64())), b.column(3).take(who)], schema=schema)

        def match(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _FOUND.empty_table()
            x, q, bound = _matrix(left.column("v")), _matrix(right.column("q")), right.column("bound").to_numpy()
            turned, asked = shared.value.lift(x), shared.value.ask(q)
            held, wanted = left.column("list").to_numpy(), right.column("lists").combine_chunks()
            who, wanted = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), np.asarray(wanted.flatten())
            i, j = [np.empty(0, int)], [np.empty(0, int)]
            for c in np.unique(wanted):
                mine, at = who[wanted == c], np.flatnonzero(held == c)
                a, b = scan(turned[at], asked[mine], bound[mine])
                i.append(mine[a])
                j.append(at[b])
            return _best(left, x, right, q, np.concatenate(i), np.concatenate(j), k)

        def reach(batches):
            cells = np.zeros(n_cells, np.int64)
            for b in batches:
                if b.num_rows:
                    to = shared.value.cell[shared.value.route(shared.value.ask(_matrix(b.column(0))), low, high)]
                    cells += sum(np.bincount(np.unique(row), minlength=n_cells) for row in to)
            yield pa.RecordBatch.from_pydict({"cell": np.arange(n_cells, dtype=np.int32), "n": cells})

        reached = asked.select("q").mapInArrow(lean(reach), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").collect()  # a row per cell
        n_sets = {r["cell"]: -(-r["n"] // QUERIES) for r in reached}
        sets = F.array(*[F.lit(n_sets.get(c, 0)) for c in range(n_cells)])
        block = F.pmod(F.xxhash64("row"), F.get(blocks, F.col("cell"))).cast("int")
        copies = F.when(F.get(sets, F.col("cell")) > 0, F.sequence(F.lit(0), F.get(sets, F.col("cell")) - 1))  # none without queries
        held = listed.select("cell", block.alias("block"), F.explode(copies).alias("part"), "list", "row", "vec_id", "v")
        routed = asked.mapInArrow(route, "cell int, lists array<int>, query long, query_id long, q array<double>, bound double")
        routed = routed.select("cell", "lists", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.get(sets, F.col("cell"))).cast("int").alias("part"), "query", "query_id", "q", "bound")
        keys = ["cell", "block", "part"]
        return held.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(match, _FOUND_SQL)

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= k)
    own = F.aggregate("q", F.lit(norm**2), lambda s, e: s + e * e)
    found, low, asked = None, 0, queries.withColumn("bound", F.lit(float("inf")))
    for high in index.steps:
        part = probe(asked, low, high)
        found = stored(best(part if found is None else found.drop("rank").union(part)), "nearest-found")
        last = found.where(F.col("rank") == k).select("query", "score")
        bound = F.when(F.col("score").isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), own - 2 * F.col("score")))
        low, asked = high, queries.join(last, "query", "left").select("query", "query_id", "q", bound.alias("bound"))
    found = found.drop("rank")
    if index.probes < len(index.centroids):  # queries whose probed lists hold less than k: the rest of the lists, in full
        short = queries.join(found.groupBy("query").count().where(F.col("count") >= k), "query", "left_anti")
        if not short.isEmpty():
            found = found.union(probe(short.withColumn("bound", F.lit(float("inf"))), index.probes, len(index.centroids)))
    if len(common) > 1:
        found = found.union(_among_rarer(indexed.where("list < 0"), common[1]["n"], k, every))
    return best(found).select("query_id", "rank", "vec_id", "score")
