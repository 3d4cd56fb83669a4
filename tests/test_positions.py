"""Dense positions, permutations, epochs, order statistics and terciles against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import curves as K
from tidemill.operators import runs as U
from tidemill.operators import split as S
from tidemill.sources import readers


@pytest.mark.parametrize("buckets", [3, 40])
def test_positions_are_dense_beyond_the_range_sample(spark, buckets):
    """Far more rows than bounds are sampled from, a key that a third of them share, and two reads of one frame."""
    n = 60_000
    rows = spark.range(n, numPartitions=7).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id") % 1_000).alias("k"))
    placed = S.with_position(rows, "k", buckets=buckets)
    got = placed.agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
    assert tuple(got) == (n, 0, n - 1)
    first, second = ({r["id"]: r["pos"] for r in placed.collect()} for _ in range(2))
    assert first == second
    keys = [r["k"] for r in placed.orderBy("pos").select("k").collect()]
    assert keys == sorted(keys)
    largest = placed.groupBy(F.floor(F.col("pos") * buckets / n)).count().agg(F.max("count")).first()[0]
    assert largest <= 1.01 * n / buckets + 1


def test_positions_of_small_tables(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c"), (2, "d")], "k int, v string").coalesce(1)
    assert [(r["pos"], r["v"]) for r in S.with_position(rows, "k").orderBy("pos").collect()] == [(0, "a"), (1, "c"), (2, "b"), (3, "d")]
    assert [r["v"] for r in S.with_position(rows, F.desc("k"), name="at").orderBy("at").collect()] == ["b", "d", "c", "a"]
    assert S.with_position(rows.limit(0), "k").count() == 0
    split = S.head_split(S.with_position(spark.range(10), "id"), 25)
    assert sorted(r["id"] for r in split.where("split = 'test'").collect()) == [0, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 97, 1_000, 1_023, 4_099])
def test_every_epoch_is_a_permutation(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "pos")
    orders = [tuple(r["order"] for r in S.with_epoch_order(rows, e, seed=3).orderBy("pos").collect()) for e in (0, 1)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n >= 97:
        assert orders[0] != orders[1]
        moved = [abs(a - k) for k, a in enumerate(orders[0])]
        assert 0.2 * n < sum(moved) / n < 0.5 * n  # a third of n for a random order
        ups = sum(b > a for a, b in zip(orders[0], orders[0][1:]))
        assert abs(ups - (n - 1) / 2) < 5 * math.sqrt(n / 12)


def test_epochs_are_dealt_to_ranks(spark):
    rows = spark.range(1_003).withColumnRenamed("id", "pos")
    dealt = S.epoch_shards(rows, 4, 2, seed=1, batch=8).collect()
    assert len(dealt) == 1_003 // 32 * 32 and len({r["pos"] for r in dealt}) == len(dealt)
    assert {(r["rank"], r["step"]) for r in dealt} == {(k, s) for k in range(4) for s in range(1_003 // 32 * 8)} and {r["batch"] for r in dealt} == set(range(31))
    padded = S.epoch_shards(rows, 4, 2, seed=1, batch=8, drop_last=False).collect()
    assert len(padded) == 1_004 and {r["pos"] for r in padded} == set(range(1_003)) and {(r["rank"], r["step"]) for r in padded} == {(k, s) for k in range(4) for s in range(251)}
    few = S.epoch_shards(rows.where("pos < 3"), 8, 0, drop_last=False).collect()
    assert len(few) == 8 and {r["rank"] for r in few} == set(range(8))
    assert S.epoch_shards(rows.limit(0), 8, 0, drop_last=False).count() == 0 and S.epoch_shards(rows.limit(0), 8, 0).count() == 0


def test_order_statistics(spark):
    rng = random.Random(4)
    groups = {"few": [1.5, 1.5, 1.5], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)], "flat": [2.0] * 50 + [2.0 + 1e-15], "ints": [float(rng.randrange(40)) for _ in range(999)], "ends": [-1.7e308, 1.7e308, 0.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("few", None), ("few", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.5, 0.9):
        got = {r["g"]: (r["least"], r["most"], r["n"], r["chosen"]) for r in U.order_statistic(frame, "g", value="v", place=lambda n: F.floor((n - 1) * share)).collect()}
        assert got == {g: (min(v), max(v), len(v), sorted(v)[math.floor((len(v) - 1) * share)]) for g, v in groups.items()}
    whole = sorted(v for vs in groups.values() for v in vs)
    assert U.order_statistic(frame, value="v", place=lambda n: F.floor(n / 2)).first()["chosen"] == whole[len(whole) // 2]
    assert U.order_statistic(frame.limit(0), value="v", place=lambda n: n).count() == 0


def test_terciles_need_no_single_task(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 100, 101):
        scores = [(k, rng.choice([0.1, 0.2, 0.3, 0.4])) for k in range(n)]
        ranked = [k for _, k in sorted((s, k) for k, s in scores)]
        size, more = divmod(n, 3)
        cut = [size + (more > 0), 2 * size + (more > 0) + (more > 1)]
        want = {k: "Easy" if p < cut[0] else "Medium" if p < cut[1] else "Hard" for p, k in enumerate(ranked)}
        got = K.terciles(spark.createDataFrame(scores, "run int, score double"), "score", "run").collect()
        assert {r["run"]: r["difficulty"] for r in got} == want


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_local_datasets_are_numbered_by_file(spark, tmp_path, kind):
    n = 3_000
    rows = spark.range(n, numPartitions=1).select(F.concat(F.lit("i"), F.col("id")).alias("instruction"), F.lit("o").alias("output"))
    getattr(rows.repartitionByRange(5, F.col("instruction")).write, kind)(str(tmp_path / "hub"))
    got = readers.read_local_dataset(spark, str(tmp_path / "hub"), kind)
    assert got.columns == ["pos", "instruction", "input", "output"]
    placed = got.orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(n)) and len({r["instruction"] for r in placed}) == n
    files = sorted(str(p) for p in (tmp_path / "hub").glob(f"part-*.{kind}*"))
    read = [r["instruction"] for f in files for r in getattr(spark.read, kind)(f).coalesce(1).collect()]
    assert [r["instruction"] for r in placed] == read


def test_long_runs_are_filled_and_averaged_in_blocks(spark, monkeypatch):
    """Runs above the limit against the plain windows, with blocks that hold no known value, and a null run."""
    from tidemill.operators import experiments as X

    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(6)
    rows = []
    for run, n in ((1, 200), (2, 3), (3, 130), (None, 90), (4, 30), (5, 64)):
        at = 0
        for k in range(n):
            at += rng.randint(1, 4)
            known = rng.random() < (0.05 if run != 4 else 0.0)
            rows.append((run, at, rng.uniform(-5, 5) if known else None, float(k * k % 31)))
    frame = spark.createDataFrame(rows, "run int, i int, v double, x double").repartition(5)
    exact = lambda df, c: sorted((str(r["run"]), r["i"], None if r[c] is None else round(r[c], 9)) for r in df.collect())
    assert exact(K.interpolate(frame, "run", "i", "v", long=40), "value_filled") == exact(K.interpolate(frame, "run", "i", "v"), "value_filled")
    assert exact(X.rolling_mean(frame, ["run"], ["i"], "x", 5, long=40), "rolling") == exact(X.rolling_mean(frame, ["run"], ["i"], "x", 5), "rolling")


def test_one_long_run_uses_all_tasks(spark):
    from tidemill.operators import experiments as X

    n = 300_000
    frame = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    out = X.rolling_mean(frame, ["run"], ["i"], "x", 8, long=n // 2)
    got = out.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("rolling") - F.when(F.col("i") >= 7, F.col("x") - 3.5).otherwise(F.col("x") / 2))).alias("off")).first()
    assert tuple(got) == (n, 0.0)
    assert S.in_blocks(frame, ["run"], ["i"]).groupBy("_block").count().agg(F.max("count"), F.count(F.lit(1))).first()[:] == (S.BLOCK, -(-n // S.BLOCK))


def test_archives_are_read_entry_by_entry(spark, tmp_path):
    import io
    import json
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.jsonl", '{"a": "inner"}\nnot json\n')
        z.writestr("deep/none.txt", "x")
    for name, n in (("one.zip", 12), ("two.zip", 3)):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("__MACOSX/y.json", '[{"a": 1}]')
            z.writestr("empty.json", "[]")
            for k in range(n):
                z.writestr(f"part-{k}.jsonl", "\n".join(json.dumps({"a": f"{name}:{k}:{i}", "t": "é" * 50}) for i in range(k * 400)))
            z.writestr("t.tsv", "a\tb\n1\t2\n")
            z.writestr("inner.zip", inner.getvalue())
            z.writestr("broken.zip", b"no archive")
            z.writestr("read.me", "x")
    got = readers.read_archives(spark, str(tmp_path / "*.zip"))
    by = {}
    for r in got.collect():
        by.setdefault(r["src_file"].rsplit("/", 1)[1], {})[r["pos"]] = (r["src_entry"], json.loads(r["raw"]))
    for name, n in (("one.zip", 12), ("two.zip", 3)):
        want = readers.archive_rows((tmp_path / name).read_bytes())
        assert [by[name][k] for k in range(len(want))] == want and len(by[name]) == len(want)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("read.me", "x")
    with pytest.raises(Exception, match="no data file"):
        readers.read_archives(spark, str(tmp_path / "bad.zip")).collect()
