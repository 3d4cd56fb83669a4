"""Experiment analytics: backtests, grouped errors, pivots, worst cases, benchmark summaries, cost rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_billions
from .split import LONG, by_length, in_blocks


def mape(actual: Column, predicted: Column) -> Column:
    return 100 * F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(1e-8))


def backtest(curves: DataFrame, cutoffs: list[int], horizons: list[int]) -> DataFrame:
    """(run_id, cutoff, horizon, arm, actual, pred, mape) for two simple arms, last value and linear trend.

    A cutoff needs a longer run, and a horizon an epoch that exists. Everything of
    a run and cutoff comes from one window pass and a join on the epoch it predicts.
    """
    spark = curves.sparkSession
    grid = spark.createDataFrame([(c, h) for c in cutoffs for h in horizons], "cutoff int, horizon int")
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.col("epoch").cast("double"), F.col("loss")
    seen = curves.select("run_id", "epoch", "loss", F.count(F.lit(1)).over(w).alias("n"), F.sum(x).over(w).alias("sx"), F.sum(y).over(w).alias("sy"), F.sum(x * x).over(w).alias("sxx"), F.sum(x * y).over(w).alias("sxy"))
    at = seen.join(F.broadcast(grid), F.col("epoch") == F.col("cutoff"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    trend = F.coalesce(F.col("sy") / F.col("n") + slope * (F.col("cutoff") + F.col("horizon") - F.col("sx") / F.col("n")), F.col("loss"))
    arms = at.select("run_id", "cutoff", "horizon", F.explode(F.array(F.struct(F.lit("last_value").alias("arm"), F.col("loss").alias("pred")), F.struct(F.lit("linear").alias("arm"), trend.alias("pred")))).alias("p"))
    truth = curves.select(F.col("run_id").alias("r"), F.col("epoch").alias("e"), F.col("loss").alias("actual"))
    out = arms.join(truth, (F.col("run_id") == F.col("r")) & (F.col("cutoff") + F.col("horizon") == F.col("e")))
    return out.select("run_id", "cutoff", "horizon", "p.arm", "actual", "p.pred", mape(F.col("actual"), F.col("p.pred")).alias("mape"))


def error_stats(rows: DataFrame, *by: str, value: str = "mape") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def head_to_head(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a_wins, b_wins, ties) over (run, cutoff, horizon) where both arms have a value."""
    p = rows.groupBy("run_id", "cutoff", "horizon").pivot("arm", [a, b]).agg(F.avg("mape")).dropna(subset=[a, b])
    return p.agg(F.count_if(F.col(a) < F.col(b)).alias("a_wins"), F.count_if(F.col(b) < F.col(a)).alias("b_wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"))


def worst(rows: DataFrame, arm: str, k: int = 15) -> DataFrame:
    """The k largest errors of an arm; ties by run, cutoff and horizon."""
    return rows.where(F.col("arm") == arm).orderBy(F.desc(F.round("mape", 9)), "run_id", "cutoff", "horizon").limit(k)


def worst_sets(rows: DataFrame, a: str, b: str, k: int = 15) -> DataFrame:
    """(run_id, found) of the runs among the worst of both arms, of one only, or of the other only."""
    x, y = worst(rows, a, k).select("run_id").distinct(), worst(rows, b, k).select("run_id").distinct()
    tag = lambda df, name: df.withColumn("found", F.lit(name))
    return tag(x.intersect(y), "both").union(tag(x.subtract(y), a)).union(tag(y.subtract(x), b))


def fixed_budget(curves: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, mean, std): the loss at min(budget, length), its mean and population deviation over runs."""
    grid = curves.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    n = curves.groupBy("run_id").agg(F.max("epoch").alias("n")).join(F.broadcast(grid), F.lit(True)).select("run_id", "budget", F.least("budget", "n").alias("epoch"))
    return n.join(curves, ["run_id", "epoch"]).groupBy("budget").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"))


def rolling_mean(rows: DataFrame, by: list[str], order: list[str], value: str, size: int = 8, long: int = LONG) -> DataFrame:
    """Add rolling, the mean over a row and the size - 1 before it; groups of more than long rows are averaged in blocks that take along the rows before them."""
    frame = lambda w: F.avg(value).over(w.rowsBetween(-(size - 1), 0))

    def blocked(large: DataFrame) -> DataFrame:
        dealt = in_blocks(large, by, order, history=size - 1)
        return dealt.withColumn("rolling", frame(Window.partitionBy(*by, "_block").orderBy("_pos"))).where("_own").select(*rows.columns, "rolling")

    return by_length(rows, by, lambda r: r.withColumn("rolling", frame(Window.partitionBy(*by).orderBy(*order))), blocked, long)


def benchmark_summary(logs: DataFrame, by: list[str], order: list[str], *, skip: int = 3, last: int = 10) -> DataFrame:
    """Throughput without the first rows, peak memory, loss over the last steps, number of steps.

    Rank both ways is a sort by group; groups that outgrow a task are the caller's to split.
    """
    up, down = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    rows = logs.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    return rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_up") > skip, F.col("tokens_per_sec"))).alias("mean_tok_s"),
        F.max("peak_memory_mb").alias("peak_mem_mb"),
        F.avg(F.when(F.col("_down") <= last, F.col("loss"))).alias("final_loss_smoothed"),
        F.count(F.lit(1)).alias("n_steps_logged"),
    )


def step_merge(events: DataFrame, key: list[str], arrival: str, values: list[str]) -> DataFrame:
    """Upsert by key: the last known value of each column in order of arrival."""
    return events.groupBy(*key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(arrival))).alias(v) for v in values])


def spread_validation(train: DataFrame, val: DataFrame, by: str = "run_id") -> DataFrame:
    """Put the i-th validation loss (from 0, the last being n) on training step round(i * last step / n), half to even, by run.

    A single one lands on step 0, and so do those of a run of one step; without any
    training step the i-th keeps place i. Of several on one step the last stays.
    """
    size = train.groupBy(by).agg(F.max("step").alias("n_steps"))
    count = val.groupBy(by).agg(F.max("i").alias("n_val"))
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    place = F.when(F.col("n_steps").isNull(), F.col("i")).otherwise(F.bround(F.col("i") * least("n_steps") / least("n_val")))
    placed = val.join(size, by, "left").join(count, by).withColumn("step", place.cast("int")).groupBy(by, "step").agg(F.max_by("val_loss", "i").alias("val_loss"))
    return train.join(placed, [by, "step"], "full")


def qlora_rule(models: DataFrame, name: str = "model_name", *, gpus: int = 1, memory_gb: float = 16.0, margin: float = 0.8, overhead: float = 1.3) -> DataFrame:
    """Add params_b, use_qlora and verdict: bf16 fits, only 4 bits fit, or neither.

    Parameters come from the name, else from layers, hidden size and vocabulary if
    those columns exist; without either the row has null results.
    """
    dims = {"num_hidden_layers", "hidden_size", "vocab_size"} <= set(models.columns)
    built = (12 * F.col("num_hidden_layers") * F.pow(F.col("hidden_size"), 2) + 2 * F.col("vocab_size") * F.col("hidden_size")) / 1e9 if dims else F.lit(None).cast("double")
    have = gpus * memory_gb * margin
    p = F.col("params_b")
    verdict = F.when(p * 2 * overhead <= have, "lora").when(p * 0.5 * overhead <= have, "qlora").when(p.isNotNull(), "qlora_may_not_fit")
    return models.withColumn("params_b", F.coalesce(model_billions(F.col(name)), built)).withColumn("verdict", verdict).withColumn("use_qlora", F.col("verdict") != "lora")
