"""Near-duplicate pairs of embeddings by cosine: exact in blocks, or in the buckets of sign projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_096  # vectors of a block of the exact join
ROWS = 512  # of them that are compared with another block at a time
TABLES = 32  # of sign projections, at most
SHARE = 0.25  # of all pairs that a search may compare; beyond that comparing all costs less than its tables
EXACT_UP_TO = 200  # rows up to which the automatic strategy compares all pairs
_PAIRS = "index_a long, index_b long, similarity double"


def normalized(v: Column) -> Column:
    """A vector over its length, in double precision; lengths below 1e-8 count as that."""
    norm = F.greatest(F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))
    return F.transform(v.cast("array<double>"), lambda x: x / norm)


def pairs_exact(vectors: DataFrame, threshold: float = 0.92, pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """All pairs index_a < index_b of cosine >= threshold.

    Vectors are dealt to blocks by a hash; a task holds two blocks and returns only
    pairs at the threshold. Null vectors and positions take no part.
    """
    rows = vectors.select(F.col(pos).cast("long").alias("i"), normalized(F.col(vec)).alias("v")).where("i is not null and v is not null")
    n = max(1, -(-rows.count() // BLOCK))
    own = rows.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    left = own.select("i", "v", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("b"))
    right = own.select(F.col("i").alias("j"), F.col("v").alias("u"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a"), F.col("block").alias("b"))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_meet(threshold), _PAIRS)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    lists = col.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    if len(set(lists.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _meet(threshold: float):
    """Compare two blocks of vectors (i, v, a, b) and (j, u); a block with itself once a pair."""
    schema = pa.schema([("index_a", pa.int64()), ("index_b", pa.int64()), ("similarity", pa.float64())])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        p, q = x.column("i").to_numpy(), y.column("j").to_numpy()
        same = x.column("a")[0].as_py() == x.column("b")[0].as_py()
        left, right = _matrix(x.column("v")), _matrix(y.column("u"))
        found = [[], [], []]
        for a in range(0, len(left), ROWS):
            s = left[a : a + ROWS] @ right.T
            i, j = np.nonzero(s >= threshold)
            m, o = p[a + i], q[j]
            keep = m < o if same else m != o
            for f, v in zip(found, (np.minimum(m, o)[keep], np.maximum(m, o)[keep], s[i, j][keep])):
                f.append(v)
        return pa.table([np.concatenate(f) for f in found], schema=schema)

    return meet


def hash_plan(n: int, threshold: float, recall: float = 0.95, row: int = 50) -> tuple[int, int, float]:
    """(bits, tables, share) of a search for pairs at a threshold among n unit vectors.

    Two vectors agree on the side of a random plane with probability 1 - angle / pi:
    so many tables are drawn for a width that pairs at the threshold share a bucket of
    one with the wanted probability, and the width is that of the least work: a vector
    in a table counts as row comparisons, and unrelated vectors agree by chance.
    share: of all pairs that are expected to be compared. Where TABLES tables are not
    enough for less work than all pairs (a low threshold), there are 0 bits, one
    table, and all pairs are compared, exactly.
    """
    agree = 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi
    pairs = n * (n - 1) / 2
    best = row * n + pairs, 0, 1, 1.0
    for bits in range(1, 31):
        hit = min(agree**bits, 1 - 1e-12)
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-hit))))
        share = tables * 0.5**bits
        work = row * tables * n + share * pairs
        if tables <= TABLES and share <= SHARE and work < best[0]:
            best = work, bits, tables, share
    return best[1:]


def pairs_lsh(vectors: DataFrame, threshold: float = 0.92, pos: str = "pos", vec: str = "embedding", *, recall: float = 0.95, seed: int = 7, n_neighbors: int | None = None) -> DataFrame:
    """Pairs that share a bucket of sign projections, a subset of the exact ones; recall: what is expected of those at the threshold.

    Width and number of tables follow from threshold, recall and size (hash_plan). A
    bucket is compared in blocks, so that one of any size spreads over tasks. Vectors
    of different lengths do not meet. n_neighbors: a pair stays if it is among the
    so many most similar ones found of either of its ends.
    """
    rows = vectors.select(F.col(pos).cast("long").alias("i"), normalized(F.col(vec)).alias("v")).where("i is not null and v is not null")
    bits, tables, _ = hash_plan(max(2, rows.count()), threshold, recall)
    schema = pa.schema([("i", pa.int64()), ("v", pa.list_(pa.float64())), ("t", pa.int32()), ("code", pa.int64())])

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            col = b.column("v")
            size = np.asarray(col.value_lengths())
            for d in np.unique(size):
                at = pa.array(np.flatnonzero(size == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                own, ids = col.take(at), b.column("i").take(at)
                side = (_matrix(pa.chunked_array([own])) @ planes[d] > 0).reshape(len(own), tables, bits)
                codes = (side * (1 << np.arange(bits, dtype=np.int64))).sum(2) | np.int64(d) << 32
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([ids, own, pa.array(np.full(len(own), t, np.int32)), pa.array(codes[:, t])], schema=schema)

    found = rows.mapInArrow(coded, "i long, v array<double>, t int, code long")
    sizes = found.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    own = found.join(sizes, ["t", "code"]).withColumn("block", F.pmod(F.xxhash64("i"), F.col("n")).cast("int"))
    fresh = [F.col(c).alias(c) for c in ("t", "code")]  # each side names its own columns
    left = own.select(*fresh, "i", "v", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("n") - 1)).alias("b"))
    right = own.select(*fresh, F.col("i").alias("j"), F.col("v").alias("u"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a"), F.col("block").alias("b"))
    keys = ["t", "code", "a", "b"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(threshold), _PAIRS)
    pairs = pairs.groupBy("index_a", "index_b").agg(F.max("similarity").alias("similarity"))
    return pairs if n_neighbors is None else neighbours(pairs, n_neighbors)


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that are among the k most similar of either end; ties go to the smaller other end."""
    ends = F.explode(F.array(F.struct(F.col("index_a").alias("x"), F.col("index_b").alias("y")), F.struct(F.col("index_b").alias("x"), F.col("index_a").alias("y")))).alias("e")
    w = Window.partitionBy("e.x").orderBy(F.desc("similarity"), "e.y")
    return pairs.select("*", ends).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("index_a", "index_b", "similarity").distinct()


def candidate_pairs(vectors: DataFrame, threshold: float = 0.92, use_ann: bool = True, exact_up_to: int = EXACT_UP_TO, **kw) -> DataFrame:
    """Exact for tables of up to exact_up_to rows or on request, hashed, and thus perhaps fewer, otherwise."""
    return pairs_exact(vectors, threshold, **kw) if not use_ann or vectors.count() <= exact_up_to else pairs_lsh(vectors, threshold, **kw)


def verified(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Join verifications (index_a, index_b, confirmed_duplicate, reason) to candidates; the answers' columns win."""
    clash = [c for c in answers.columns if c in pairs.columns and c not in ("index_a", "index_b")]
    return pairs.drop(*clash).join(answers, ["index_a", "index_b"], "left")


def drop_set(pairs: DataFrame) -> DataFrame:
    """Indices that go: index_b of each pair not refuted; no transitive closure."""
    if "confirmed_duplicate" in pairs.columns:
        pairs = pairs.where(F.coalesce("confirmed_duplicate", F.lit(True)))
    return pairs.select(F.col("index_b").alias("pos")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """(query, pos, similarity, rank): the k most similar vectors of each query, itself excluded; queries are met in blocks."""
    q = queries.select(F.col(pos).cast("long").alias("i"), normalized(F.col(vec)).alias("v")).where("i is not null and v is not null")
    rows = vectors.select(F.col(pos).cast("long").alias("i"), normalized(F.col(vec)).alias("v")).where("i is not null and v is not null")
    n, m = max(1, -(-q.count() // ROWS)), max(1, -(-rows.count() // BLOCK))
    asked = q.withColumn("a", F.pmod(F.xxhash64("i"), F.lit(n))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    held = rows.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(m)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    schema = pa.schema([("query", pa.int64()), ("pos", pa.int64()), ("similarity", pa.float64())])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        a, b = x.column("i").to_numpy(), y.column("i").to_numpy()
        s = _matrix(x.column("v")) @ _matrix(y.column("v")).T
        s[a[:, None] == b[None]] = -np.inf
        out = [[], [], []]
        for r in range(len(a)):
            top = np.lexsort((b, -s[r]))[:k]
            top = top[np.isfinite(s[r][top])]
            out[0].append(np.full(len(top), a[r]))
            out[1].append(b[top])
            out[2].append(s[r][top])
        return pa.table([np.concatenate(o) for o in out], schema=schema)

    found = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(meet, "query long, pos long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
