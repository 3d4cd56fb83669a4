"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget, lean, new_path, split_join

RUN = 1 << 19  # edges that a task contracts together
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) from each id to the smallest of its component among these edges."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        later = root.copy()
        np.minimum.at(later, root[x], low)
        np.minimum.at(later, root[y], low)
        later = later[later]
        if (later == root).all():
            break
        root = later
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def _contract(batches):
    """Stars of runs of edges: the same components, fewer and shorter paths."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= RUN:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*(np.concatenate(c) for c in zip(*held)))], schema=_EDGE)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*(np.concatenate(c) for c in zip(*held)))], schema=_EDGE)


def _to_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with the least id w that u knows; an id with very many edges is joined by broadcast."""
    return split_join(edges, least, ["u"], "n", rows)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id reachable, for each id on an edge.

    Edges are first contracted inside each task. Then two steps alternate until
    nothing changes. In the large star, each id hands its larger neighbours to its
    smallest; in the small star, an id hands its smaller neighbours to the smallest.
    Least neighbours are found by partial aggregation; ids with very many edges
    are joined by broadcast, so that none is gathered in a task. What a half-round
    makes is written to the shared folder once. Null ids and loops count as no edge;
    an empty table has no components.
    """
    spark = edges.sparkSession
    pairs = edges.toDF("a", "b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").mapInArrow(lean(_contract), "u long, v long").distinct()

    def save(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "edges")
        df.write.option("compression", "zstd").parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        return kept, path, tuple(kept.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    now, path, size = save(pairs)
    for _ in range(rounds):
        if not size[0]:
            break
        part = Scratch(spark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = part.store(both.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n")).withColumn("w", F.least("u", "w")), "least")
        large = _to_least(both.where("v > u"), least, 2 * size[0])
        large = part.store(large.select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct(), "large")
        least = part.store(large.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n")), "least")
        small = _to_least(large, least, 2 * size[0])
        small = small.select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").union(least.select("u", F.col("w").alias("v"))).distinct()
        later, later_path, later_size = save(small)
        part.clear()
        forget(spark, path)
        same = later_size == size
        now, path, size = later, later_path, later_size
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
