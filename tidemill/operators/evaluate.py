"""Judged base-versus-tuned pairs: join, summary, regressions, cross-check with the loss curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGRESSION = 1.5  # a margin of minus this or less is a regression


def score_mean(scores: Column) -> Column:
    """Mean of a score map's values, null for a null or empty map."""
    return F.when(F.size(scores) > 0, F.aggregate(F.map_values(scores), F.lit(0.0), lambda s, x: s + x) / F.size(scores))


def zip_outputs(base: DataFrame, tuned: DataFrame, pos: str = "pos") -> DataFrame:
    """Join outputs by position; tables of unequal length are an error at run time, a null output is none."""
    left = base.select(pos, "question", "reference", F.col("output").alias("base_output"), F.lit(True).alias("_base"))
    both = left.join(tuned.select(pos, F.col("output").alias("ft_output"), F.lit(True).alias("_tuned")), pos, "full")
    bad = F.col("_base").isNull() | F.col("_tuned").isNull()
    return both.withColumn("ft_output", F.when(bad, F.raise_error(F.lit("outputs differ in length")).cast("string")).otherwise(F.col("ft_output"))).drop("_base", "_tuned")


def with_margin(judged: DataFrame) -> DataFrame:
    """Add margin: tuned mean minus base mean, null for failed rows and missing scores."""
    return judged.withColumn("margin", F.when(F.col("winner") != "JUDGE_FAILED", score_mean(F.col("score_b")) - score_mean(F.col("score_a"))))


def summary(judged: DataFrame, *by: str) -> DataFrame:
    """Counts, average quality margin and number of regressions; winners count also where scores are missing."""
    rows = with_margin(judged)
    count = lambda c: F.count_if(c).cast("long")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_examples"),
        count(F.col("winner") == "JUDGE_FAILED").alias("judge_failures"),
        count(F.col("winner") == "B").alias("wins"),
        count(F.col("winner") == "A").alias("losses"),
        count(F.col("winner") == "tie").alias("ties"),
        F.avg("margin").alias("avg_quality_margin"),
        count(F.col("margin") <= -REGRESSION).alias("n_regressions"),
    )


def regressions(judged: DataFrame) -> DataFrame:
    return with_margin(judged).where(F.col("margin") <= -REGRESSION)


def cross_check(curves: DataFrame, margins: DataFrame, run: str = "run_id") -> DataFrame:
    """Whether loss and judged quality agree, by run. curves: (run, epoch, loss); margins: (run, avg_quality_margin)."""
    ends = curves.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.min_by("loss", "epoch").alias("first"), F.max_by("loss", "epoch").alias("last"))
    both = ends.join(margins, run, "left")
    known = (F.col("n") >= 2) & F.col("avg_quality_margin").isNotNull()
    loss, quality = F.col("last") < F.col("first"), F.col("avg_quality_margin") > 0
    note = F.when(F.col("n") < 2, "too few losses").when(F.col("avg_quality_margin").isNull(), "no margin").when(loss == quality, F.when(loss, "both improved").otherwise("neither improved")).otherwise("mismatch")
    return both.select(run, F.when(known, loss).alias("loss_improved"), F.when(known, quality).alias("quality_improved"), F.when(known, loss == quality).alias("signals_agree"), note.alias("note"))
