"""Dense positions, seeded permutations, head splits, hash samples and shards."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

ROUNDS = 6  # of the permutation's network
WALK = 32  # steps back into range; see permuted()
_LOCAL = (1 << 33) - 1  # bits of a monotonic id that count inside a partition


def with_position(df: DataFrame, *order: str | Column, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """Dense positions from 0 by an ordering, without one task for all rows.

    Rows are ranged over tasks, sorted there, and written once with their number
    inside the task: a range's bounds are sampled anew each time it is computed, and
    only a written table keeps them. The ranges' sizes, a row each, are added up and
    give each its first position. Rows of equal order come as in the input, and are
    told apart by it, so that a frequent key spreads over ranges. buckets: ranges, as
    many as the session's shuffle partitions if not given.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_input", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(buckets, *order, "_input").sortWithinPartitions(*order, "_input").drop("_input")
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "positions").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit(_LOCAL))
    return held.join(F.broadcast(starts), "_part").withColumn(name, place.cast("long")).drop("_part", "_at", "_start")


LONG = 1_000_000  # rows of a group from which on it is handled in blocks
BLOCK = 65_536  # rows of a block


def by_length(rows: DataFrame, by: list[str], plain, blocked, long: int = LONG) -> DataFrame:
    """plain(rows) for the groups that a task can hold, blocked(rows) for those of more than long rows."""
    large = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > long).drop("_n")
    if large.isEmpty():
        return plain(rows)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return plain(rows.join(large, same, "left_anti")).unionByName(blocked(rows.join(large, same, "left_semi")))


def in_blocks(rows: DataFrame, by: list[str], order: list[str], history: int = 0, size: int | None = None) -> DataFrame:
    """Add _pos, a place in the order of all groups, _block, and _own: rows that a block takes along from the one before it have false."""
    size = size or BLOCK
    placed = with_position(rows, *by, *order, name="_pos")
    block = F.floor(F.col("_pos") / size)
    if not history:
        return placed.withColumns({"_block": block, "_own": F.lit(True)})
    own = F.struct(block.alias("b"), F.lit(True).alias("own"))
    along = F.when(F.pmod("_pos", F.lit(size)) >= size - history, F.struct((block + 1).alias("b"), F.lit(False).alias("own")))
    dealt = placed.withColumn("_d", F.explode(F.filter(F.array(own, along), lambda d: d.isNotNull())))
    return dealt.withColumns({"_block": F.col("_d.b"), "_own": F.col("_d.own")}).drop("_d")


# ---------------------------------------------------------------- seeded permutations


def _draw(value: Column, key: str, turn: Column) -> Column:
    """60 bits of a hash of a number; the same on any engine."""
    digest = F.md5(F.concat(F.lit(f"{key}:"), turn.cast("string"), F.lit(":"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(place: Column, n: int, key: str) -> Column:
    """The image of a place in 0..n-1 under a permutation that a key names; no row needs to see another.

    A Feistel network over a grid of a * b cells, a * b >= n, each round adding a hash
    of one coordinate to the other. A cell out of range is mapped again until it is
    in range. It takes at most one step for each cell too many, of which there are
    fewer than the root of n; of more than WALK only WALK are tried, and the chance
    that any is left (then an error, never a wrong place) is below n ** (1 - WALK / 2).
    """
    if n < 2:
        return place.cast("long")
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def mapped(x: Column) -> Column:
        row = F.pmod(x, F.lit(b)).cast("long")
        cell = F.struct(((x - row) / b).cast("long").alias("l"), row.alias("r"))
        turned = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            cell,
            lambda c, t: F.when(t % 2 == 0, F.struct(F.pmod(c["l"] + F.pmod(_draw(c["r"], key, t), F.lit(a)), F.lit(a)).cast("long").alias("l"), c["r"].alias("r"))).otherwise(
                F.struct(c["l"].alias("l"), F.pmod(c["r"] + F.pmod(_draw(c["l"], key, t), F.lit(b)), F.lit(b)).cast("long").alias("r"))
            ),
            lambda c: c["l"] * b + c["r"],
        )
        return turned.cast("long")

    out, spare = mapped(place.cast("long")), a * b - n
    if not spare:
        return out
    out = F.aggregate(F.sequence(F.lit(1), F.lit(min(spare, WALK))), out, lambda x, _: F.when(x < n, x).otherwise(mapped(x)))
    return out if spare <= WALK else F.when(out < n, out).otherwise(F.raise_error(F.lit("a place of the permutation was not found")).cast("long"))


def with_epoch_order(df: DataFrame, epoch: int, *, seed: int = 0, n: int | None = None, pos: str = "pos", name: str = "order") -> DataFrame:
    """Add each row's place in an epoch's shuffled order, from dense positions; n: their number, counted if not given."""
    return df.withColumn(name, permuted(F.col(pos), df.count() if n is None else n, f"{seed}:{epoch}"))


def epoch_shards(df: DataFrame, world: int, epoch: int, *, seed: int = 0, batch: int = 1, drop_last: bool = True, n: int | None = None, pos: str = "pos") -> DataFrame:
    """Add rank, step and batch of an epoch: rows are shuffled and dealt to ranks in turn.

    drop_last: an incomplete last round of ranks is left out, and so is a rank's
    incomplete last batch; otherwise the round is filled with the epoch's first rows
    again, as often as it takes, and the last batch is short.
    """
    n = df.count() if n is None else n
    rows = with_epoch_order(df, epoch, seed=seed, n=n, pos=pos, name="_order")
    if drop_last:
        rows = rows.where(F.col("_order") < n // (world * batch) * world * batch)
    elif n:
        rows = rows.withColumn("_order", F.explode(F.sequence(F.col("_order"), F.lit(-(-n // world) * world - 1).cast("long"), F.lit(n).cast("long"))))
    step = F.floor(F.col("_order") / world).cast("long")
    return rows.withColumns({"rank": F.pmod("_order", F.lit(world)).cast("int"), "step": step, "batch": F.floor(step / batch).cast("long")}).drop("_order")


# ---------------------------------------------------------------- splits and samples


def head_split(df: DataFrame, test_percent: int, pos: str = "pos") -> DataFrame:
    """Mark the first round(n * percent / 100) rows (half to even) as test, the rest as train."""
    n = df.agg(F.bround(F.count(F.lit(1)) * F.lit(test_percent) / 100).cast("long").alias("n_test"))
    return df.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col(pos) < F.col("n_test"), "test").otherwise("train")).drop("n_test")


def hash_sample(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows without replacement in the order of md5(key:seed); the same rows on any engine."""
    return df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))).orderBy("_h", key).limit(k).drop("_h")


def shards(df: DataFrame, world: int, pos: str = "pos") -> DataFrame:
    """Deal rows to ranks by position; an incomplete last round is dropped."""
    n = df.agg((F.floor(F.count(F.lit(1)) / world) * world).alias("whole"))
    return df.crossJoin(F.broadcast(n)).where(F.col(pos) < F.col("whole")).drop("whole").withColumn("rank", F.pmod(F.col(pos), F.lit(world)))
