"""Loss events as a stream: stateful forecast checks, and their batch twin."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.curves import Z90, by_run, decide, forecasts, lists
from ..runtime import stored

EVERY, LEAST = 3, 3
UPDATES = "run_id long, epoch int, val_loss double, median double, lower_5 double, upper_95 double, noise double, action string, notify_user boolean, error string"


def _noise(y: np.ndarray) -> float:
    n = len(y)
    if n < 3:
        return 0.0
    x, v = np.arange(1, n + 1) - (n + 1) / 2, y - y.mean()
    sxy = float(x @ v)
    return max(0.0, (float(v @ v) - sxy * sxy / float(x @ x)) / n) ** 0.5


def due(n: int) -> bool:
    """Whether a check is made at an epoch."""
    return n % EVERY == 0 and n >= LEAST


def _tried(seen: list[np.ndarray]) -> list:
    """For each run of losses the forecast of its next epoch, (middle, spread), or the error that it raised."""
    try:
        middle, spread, _ = forecasts(seen, [1] * len(seen))
        return list(zip(middle[:, 0].tolist(), spread.tolist()))
    except Exception as e:  # a failed check never ends the stream, nor the checks beside it
        return [e] if len(seen) == 1 else [x for y in seen for x in _tried([y])]


def updates_of(runs: list[tuple]) -> list[tuple]:
    """Updates of many runs (run_id, losses, how many of them are known): one for each new loss; every third epoch carries a check or the error that it raised.

    The forecasts of all runs are made together.
    """
    out, at, seen = [], [], []
    for run_id, y, known in runs:
        for k in range(known + 1, len(y) + 1):
            if due(k):
                at.append(len(out))
                seen.append(y[:k])
            out.append([run_id, k, float(y[k - 1]), None, None, None, None, None, None, None])
    for k, y, found in zip(at, seen, _tried(seen) if seen else []):
        try:
            if isinstance(found, Exception):
                raise found
            middle, spread = found
            noise = _noise(y)
            d = decide(y.tolist(), {"median": [middle]}, noise)
            out[k][3:9] = [middle, middle - Z90 * spread, middle + Z90 * spread, noise, d["action"], d["notify_user"]]
        except Exception as e:  # a failed check never ends the stream
            out[k][9] = f"{type(e).__name__}: {e}"
    return [tuple(r) for r in out]


def updates(run_id, before: list[float], new: list[float]) -> list[tuple]:
    """The updates of one run's new losses, see updates_of."""
    return updates_of([(run_id, np.array([*before, *new], float), len(before))])


_TYPES = (pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.string(), pa.bool_(), pa.string())
_SLICE = 100_000  # losses of the runs that are checked together, a longer one alone


def _checked(batches):
    """Updates of batches of (run_id, known, losses)."""
    for b in batches:
        runs = list(zip(b.column("run_id").to_pylist(), lists(b.column("losses")), b.column("known").to_pylist()))
        part, size = [], 0
        for k, r in enumerate(runs):
            part.append(r)
            size += len(r[1])
            if size >= _SLICE or k == len(runs) - 1:
                rows = updates_of(part)
                part, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_TYPES)], names=[c.split()[0] for c in UPDATES.split(", ")])


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 1_024  # of runs: a state and a call for each, as either costs more than a run's losses


class _Checks(StatefulProcessor):
    """The losses of a bucket of runs as a list that only grows: a batch appends one row with its new losses, run by run."""

    def init(self, handle) -> None:
        self.losses = handle.getListState("losses", "runs array<long>, sizes array<int>, losses array<double>")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values(["run_id", "seq"])
        ids, at = np.unique(new["run_id"].to_numpy(), return_index=True)
        values = new["val_loss"].to_numpy(float)
        runs, before = ids.tolist(), {r: [] for r in ids.tolist()}
        there = self.losses.exists()
        for then, sizes, known in self.losses.get() if there else ():
            k = 0
            for r, n in zip(then, sizes):
                if r in before:
                    before[r] += known[k : k + n]
                k += n
        sizes = np.diff(np.append(at, len(values))).tolist()
        (self.losses.appendList if there else self.losses.put)([(runs, sizes, values.tolist())])
        grown = [np.append(before[r], values[k : k + n]) for r, k, n in zip(runs, at.tolist(), sizes)]
        yield pd.DataFrame({"run_id": [None] if key[0] < 0 else runs, "known": [len(before[r]) for r in runs], "losses": grown})

    def close(self) -> None:
        pass


def stream_checks(events: DataFrame) -> DataFrame:
    """Updates of a stream of (run_id, seq, val_loss); within a batch losses come in the order of seq.

    The state is a list for each bucket of runs in RocksDB, to which a batch appends:
    what it writes grows with its own rows, not with the runs' histories.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # lists need it
    run = F.col("run_id").cast("long")
    bucket = F.when(run.isNull(), -1).otherwise(F.pmod(F.xxhash64(run), F.lit(BUCKETS))).cast("int")  # a run without a name has one of its own
    rows = events.where("val_loss is not null").select(bucket.alias("bucket"), F.coalesce(run, F.lit(0)).alias("run_id"), F.col("seq").cast("long").alias("seq"), F.col("val_loss").cast("double").alias("val_loss"))
    grown = rows.groupBy("bucket").transformWithStateInPandas(_Checks(), "run_id long, known long, losses array<double>", "Append", "None")
    return grown.mapInArrow(_checked, UPDATES)  # the runs of a task are fitted together, not one after another


def replayed_stream(events: DataFrame, folder: str, batches: int = 4) -> DataFrame:
    """The updates of a table of (run_id, seq, val_loss) that arrives as a stream in so many batches, by ranges of seq.

    Each batch is a run of the query of its own, which ends and starts again from its checkpoint.
    """
    spark = events.sparkSession
    events = stored(events.select("run_id", "seq", "val_loss"), "stream-losses")  # made once, read for each batch
    last = events.agg(F.max("seq")).first()[0] or 0
    source = spark.readStream.schema("run_id long, seq long, val_loss double").option("recursiveFileLookup", "true")
    rows = events.select(F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("long").alias("seq"), F.col("val_loss").cast("double").alias("val_loss"))
    for k in range(batches):
        rows.where((F.col("seq") > last * k // batches) & (F.col("seq") <= last * (k + 1) // batches)).write.parquet(f"{folder}/in/batch={k}")
        follow(stream_checks(source.parquet(f"{folder}/in")), merge_progress(f"{folder}/out"), f"{folder}/checkpoint", every=None).awaitTermination()
    return latest(spark, f"{folder}/out")


def batch_checks(events: DataFrame) -> DataFrame:
    """The same updates from a table."""

    return by_run(events, "seq", "val_loss").select("run_id", F.lit(0).cast("long").alias("known"), "losses").mapInArrow(_checked, UPDATES)


def banners(rows: DataFrame, num_epochs: int) -> DataFrame:
    """Updates that the user is told about: notified, and at or after the last planned epoch."""
    return rows.where(F.coalesce("notify_user", F.lit(False)) & (F.col("epoch") >= num_epochs))


COMPACT = 16  # batches between two snapshots


def _folders(spark, path: str, prefix: str, complete: bool = False) -> list[int]:
    """The numbers of the folders `prefix=number` of a path, only those written to the end if asked."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    found = [f.getPath() for f in system.listStatus(top) if f.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if not complete or system.exists(hadoop.Path(p, "_SUCCESS")))


def _merged(spark, path: str, upto: int, keys: tuple[str, ...], before: int | None = None) -> DataFrame | None:
    """Each step's fields from the newest snapshot below a batch and the log since then up to upto: the last value of each that is not null."""
    snapshots = [k for k in _folders(spark, f"{path}/snapshots", "upto", complete=True) if before is None or k < before]
    start = snapshots[-1] if snapshots else -1
    parts = [spark.read.parquet(f"{path}/snapshots/upto={start}").withColumns({"_batch": F.lit(-1).cast("long"), "_arrival": F.lit(0).cast("long")})] if snapshots else []
    for k in _folders(spark, f"{path}/log", "batch_id", complete=True):
        if start < k <= upto:
            parts.append(spark.read.parquet(f"{path}/log/batch_id={k}").withColumn("_batch", F.lit(k).cast("long")))
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    stamp = F.struct("_batch", "_arrival")
    values = [c for c in rows.columns if c not in (*keys, "_batch", "_arrival")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in values])


def merge_progress(path: str, keys: tuple[str, ...] = ("run_id", "epoch"), arrival: str | None = None, compact: int = COMPACT):
    """For foreachBatch: an upsert by field. A step keeps the last value of each field that is not null, by batch and arrival.

    A batch is a folder of the log, named by its number and written whole, so that a
    batch that is played again replaces itself. Inside a batch the column arrival says
    which row is later, or without one the order of rows. Every so many batches all
    steps are merged into a snapshot, from the one before it and the log since then;
    latest() reads the newest snapshot and fewer log folders than that.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.monotonically_increasing_id() if arrival is None else F.col(arrival).cast("long")
        batch.withColumn("_arrival", at).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        if (batch_id + 1) % compact == 0:
            _merged(spark, path, batch_id, keys, before=batch_id).write.mode("overwrite").parquet(f"{path}/snapshots/upto={batch_id}")

    return sink


def latest(spark, path: str, keys: tuple[str, ...] = ("run_id", "epoch")) -> DataFrame:
    """The merged progress: a row for each step, with the last value that is not null of each field."""
    out = _merged(spark, path, 1 << 62, keys)
    if out is None:
        raise ValueError(f"no batch has been kept in {path}")
    return out


def tail(spark, folder: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the JSON lines that are appended to a folder as files."""
    reader = spark.readStream.schema(schema)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).json(folder)


def follow(rows: DataFrame, sink, checkpoint: str, every: str | None = "2 seconds"):
    """Start a query that hands new rows to a sink at an interval; with None, what is there and then no more."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop_when(query, wanted, every: float = 0.2) -> None:
    """Stop a query between batches once wanted() says so; returns when it has ended."""
    while query.isActive:
        if wanted() and not query.status["isTriggerActive"]:
            query.stop()
            break
        query.awaitTermination(every)


def simulated_losses(spark, runs: int, epochs: int, seed: int = 7) -> DataFrame:
    """(run_id, seq, val_loss): max(0.3, 2.5 * 0.82^epoch + noise of 0.03)."""
    rows = spark.range(runs).withColumnRenamed("id", "run_id").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return rows.withColumn("val_loss", F.greatest(F.lit(0.3), 2.5 * F.pow(F.lit(0.82), F.col("seq")) + (F.rand(seed) - 0.5) * 0.06))
