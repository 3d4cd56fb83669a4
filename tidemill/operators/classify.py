"""Thresholds, three-way classification, overrides and dataset health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESETS = {"weak": 5.0, "medium": 6.0, "strong": 6.7}
BINS = 50


def bin_of(score: Column) -> Column:
    """Bin of a score in 50 bins over 0 to 10, edges as numpy draws them, the last bin closed; null outside."""
    b = F.least(F.floor(score * 5), F.lit(BINS - 1)).cast("int")
    fixed = F.when(score < b * F.lit(0.2), b - 1).when((score >= (b + 1) * F.lit(0.2)) & (b != BINS - 1), b + 1).otherwise(b)
    return F.when((score >= 0) & (score <= 10), fixed)


def histogram(scored: DataFrame, score: str = "avg_score") -> DataFrame:
    """(bin, n), all 50 bins."""
    counts = scored.select(bin_of(F.col(score)).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = scored.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def otsu(scored: DataFrame, score: str = "avg_score", failed: str = "curation_failed") -> DataFrame:
    """One row (threshold): the lowest bin centre of the largest variance between two classes.

    Failed rows do not count. Without any split it is the first centre, 0.1; where
    all scores lie outside 0 to 10 it is their median.
    """
    valid = scored.where(~F.col(failed) & F.col(score).isNotNull())
    bins = histogram(valid, score).withColumn("centre", (F.col("bin") * 0.2 + (F.col("bin") + 1) * 0.2) / 2)
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 50 rows
    every = Window.partitionBy(F.lit(1))
    cum = bins.select("bin", "centre", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("centre")).over(up).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("centre")).over(every).alias("s"))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2)
    # a variance's last bits depend on the order of additions: equal splits are told apart after rounding
    best = cum.where("w0 > 0 and w0 < w").withColumn("v", F.round(between, 6)).where("v > 0").orderBy(F.desc("v"), "bin").limit(1).select("centre")
    whole = valid.agg(F.count_if(F.col(score).between(0, 10)).alias("inside"), F.percentile(score, 0.5).alias("middle"))
    return whole.join(best, F.lit(True), "left").select(F.when(F.col("inside") == 0, F.col("middle")).otherwise(F.coalesce("centre", F.lit(0.1))).alias("threshold"))


def percentile_threshold(scored: DataFrame, percentile: float = 40.0, score: str = "avg_score", failed: str = "curation_failed") -> DataFrame:
    return scored.where(~F.col(failed)).agg(F.percentile(score, percentile / 100).alias("threshold"))


def auto_threshold(scored: DataFrame, method: str = "otsu", percentile: float = 40.0) -> DataFrame:
    """One row (threshold); rows without any valid score are an error at run time."""
    if method not in ("otsu", "percentile"):
        raise ValueError(f"unknown method: {method}")
    out = otsu(scored) if method == "otsu" else percentile_threshold(scored, percentile)
    return out.select(F.when(F.col("threshold").isNull(), F.raise_error(F.lit("no valid scores")).cast("double")).otherwise(F.col("threshold")).alias("threshold"))


def classify(scored: DataFrame, threshold: DataFrame | float, *, mode: str = "normal", width: float = 1.0, duplicate: Column | None = None) -> DataFrame:
    """Add final_status: failed, then rejected_duplicate, then kept or rejected_quality.

    normal: score >= threshold. hyper: inside the band around the threshold the
    judge's keep decides; a missing keep (keep_present false) keeps, a null one rejects.
    """
    if mode not in ("normal", "hyper"):
        raise ValueError(f"unknown mode: {mode}")
    t = F.col("_threshold")
    rows = scored.withColumn("_threshold", F.lit(float(threshold))) if not isinstance(threshold, DataFrame) else scored.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_threshold"))))
    s = F.col("avg_score")
    if mode == "normal":
        passes = s >= t
    else:
        keep = F.when(~F.col("keep_present"), True).otherwise(F.coalesce("keep", F.lit(False)))
        passes = F.when(s >= t + width / 2, True).when(s < t - width / 2, False).otherwise(keep)
    status = F.when(F.col("curation_failed"), "failed").when(F.coalesce(duplicate, F.lit(False)) if duplicate is not None else F.lit(False), "rejected_duplicate").when(passes, "kept").otherwise("rejected_quality")
    return rows.withColumn("final_status", status).drop("_threshold")


def apply_overrides(classified: DataFrame, overrides: DataFrame, key: str = "_id") -> DataFrame:
    """Apply (key, decision) to a base classification; applying the same overrides again changes nothing."""
    d = overrides.select(F.col(key), F.col("decision").alias("_decision"))
    by_hand = F.col("_decision").isin("accept", "reject")
    base = F.coalesce(F.col("automatic_status"), F.col("final_status")) if "automatic_status" in classified.columns else F.col("final_status")
    joined = classified.join(d, key, "left")
    status = F.when(F.col("_decision") == "accept", "manually_accepted").when(F.col("_decision") == "reject", "manually_rejected").otherwise(base)
    return joined.withColumns({"automatic_status": F.when(by_hand, base), "final_status": status}).drop("_decision")


def threshold_sweep(scored: DataFrame, steps: int = 6) -> DataFrame:
    """(step, threshold, kept, rejected) for evenly spaced thresholds from the least to the largest score."""
    valid = scored.where(~F.col("curation_failed")).select("avg_score")
    ends = valid.agg(F.min("avg_score").alias("a"), F.max("avg_score").alias("b"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "a", "b").select("step", (F.col("a") + (F.col("b") - F.col("a")) * F.col("step") / (steps - 1)).alias("threshold"))
    counted = valid.groupBy("avg_score").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(grid), F.lit(True)).groupBy("step", "threshold").agg(F.sum(F.when(F.col("avg_score") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("avg_score") < F.col("threshold"), F.col("n")).otherwise(0)).alias("rejected"))


def dataset_health(classified: DataFrame, *by: str, least: int = 20, least_rate: float = 0.3) -> DataFrame:
    """kept, total, warning and reasons, over all rows or by columns."""
    kept = F.count_if(F.col("final_status").isin("kept", "manually_accepted"))
    counts = classified.groupBy(*by).agg(kept.cast("long").alias("kept"), F.count(F.lit(1)).alias("total"))
    few = F.when(F.col("kept") < least, F.lit("few_examples"))
    low = F.when((F.col("total") > 0) & (F.col("kept") / F.col("total") < least_rate), F.lit("low_keep_rate"))
    reasons = F.filter(F.array(few, low), lambda r: r.isNotNull())
    return counts.withColumn("reasons", reasons).withColumn("warning", F.size("reasons") > 0)


def override_buckets(classified: DataFrame) -> DataFrame:
    """Counts by final and automatic status: where manual decisions came from."""
    return classified.groupBy("final_status", "automatic_status").agg(F.count(F.lit(1)).alias("n"))


def section_samples(classified: DataFrame, k: int = 5, pos: str = "pos") -> DataFrame:
    """The first k rows of each status."""
    w = Window.partitionBy("final_status").orderBy(pos)
    return classified.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
