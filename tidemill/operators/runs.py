"""Run metrics, selections and display projections of experiments and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..runtime import stored

# ---------------------------------------------------------------- metrics


BINS = 256  # of a pass of the selection


def order_statistic(rows: DataFrame, *by: str, value: str, place) -> DataFrame:
    """(by, least, most, n, chosen): the element at a place of each group's sorted values, without sorting any group.

    place: a function from the column of a group's size to that of a place from 0. A
    pass counts the values between two bounds in bins, keeps the bin that holds the
    place, and takes its least and largest value as the next bounds, until they meet:
    two to four passes for most data. A task sends a count for each group and bin.
    Null and NaN are no values; groups without any have no row.
    """
    number = F.col(value).cast("double")
    held = stored(rows.select(*by, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "order-values")
    ends = held.groupBy(*by).agg(F.min("_v").alias("least"), F.max("_v").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 0")
    state = stored(ends.select(*by, "least", "most", "n", F.col("least").alias("_lo"), F.col("most").alias("_hi"), place(F.col("n")).cast("long").alias("_k")), "order-state")
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves: no difference overflows
    inside = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows
    while not (still := state.where("_lo < _hi")).isEmpty():
        bounds = still.select(*by, "_lo", "_hi")
        open_ = held.join(bounds, list(by)) if by else held.crossJoin(F.broadcast(bounds))
        bins = open_.where("_v between _lo and _hi").groupBy(*by, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        counted = bins.withColumn("_to", F.sum("_c").over(inside))
        met = counted.join(still, list(by)) if by else counted.crossJoin(F.broadcast(still))
        met = met.where("_k < _to and _k >= _to - _c")
        state = stored(met.select(*by, "least", "most", "n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), (F.col("_k") - F.col("_to") + F.col("_c")).alias("_k")).unionByName(state.where("_lo >= _hi")), "order-state")
    return state.select(*by, "least", "most", "n", F.col("_lo").alias("chosen"))


def score_spread(rows: DataFrame, *by: str, score: str = "avg_score") -> DataFrame:
    """(by, least, most, upper_median): extremes and the element at half the length of the sorted scores, not interpolated."""
    return order_statistic(rows, *by, value=score, place=lambda n: F.floor(n / 2)).select(*by, "least", "most", F.col("chosen").alias("upper_median"))


def latency_by_model(calls: DataFrame, model: str = "model", latency: str = "latency_s") -> DataFrame:
    return calls.groupBy(model).agg(F.avg(latency).alias("avg_latency"), F.count(latency).alias("n"))


def run_throughput(rows: Column, epochs: Column, seconds: Column) -> Column:
    """Examples a second of a training run, null where no time went by."""
    return rows * epochs / F.nullif(seconds.cast("double"), F.lit(0.0))


def step_throughput(steps: DataFrame, *by: str, step: str = "step", tokens: str = "tokens", seconds: str = "step_time", warm_up: int = 10) -> DataFrame:
    """(by, mean_tok_s, n): tokens a second over the steps after the warm-up."""
    rate = F.col(tokens) / F.nullif(F.col(seconds).cast("double"), F.lit(0.0))
    return steps.where(F.col(step) > warm_up).groupBy(*by).agg(F.avg(rate).alias("mean_tok_s"), F.count(rate).alias("n"))


def best_checkpoint(evals: DataFrame, *by: str, step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """(by, step, eval_loss) of the least loss; ties go to the first step."""
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s"))).alias("_b")
    return evals.where(F.col(loss).isNotNull()).groupBy(*by).agg(best).select(*by, F.col("_b.s").alias(step), F.col("_b.l").alias(loss))


def ratios(rows: DataFrame, by: str, group: str, value: str, over: str, under: str) -> DataFrame:
    """(by, ratio): a group's mean over another's, null where either is missing or the second is 0."""
    p = rows.groupBy(by).pivot(group, [over, under]).agg(F.avg(value))
    return p.select(by, (F.col(f"`{over}`") / F.nullif(F.col(f"`{under}`"), F.lit(0.0))).alias("ratio"))


def errors_by_arm(rows: DataFrame, arms: list[str]) -> DataFrame:
    """(run_id, cutoff, a column for each arm): mean errors."""
    return rows.groupBy("run_id", "cutoff").pivot("arm", arms).agg(F.avg("mape"))


def with_difficulty(rows: DataFrame, labels: DataFrame, run: str = "run_id") -> DataFrame:
    """Add each run's difficulty label, null for a run without one."""
    return rows.join(labels.select(run, "difficulty").dropDuplicates([run]), run, "left")


def with_absolute_errors(rows: DataFrame, actual: str, *predictions: str) -> DataFrame:
    """Add abs_err_<prediction> columns; nulls stay null."""
    return rows.withColumns({f"abs_err_{p}": F.abs(F.col(p) - F.col(actual)) for p in predictions})


def peak_memory(devices: DataFrame, *by: str, stats: str = "stats") -> DataFrame:
    """(by, peak_bytes): the most of all devices of the first statistic that each has; NaN if none has any."""
    names = ("peak_bytes_in_use", "bytes_in_use", "bytes_reserved")
    first = F.coalesce(*[F.try_element_at(F.col(stats), F.lit(n)) for n in names]).cast("double")
    return devices.groupBy(*by).agg(F.coalesce(F.max(first), F.lit(float("nan"))).alias("peak_bytes"))


def summary_json(rows: DataFrame, labels: DataFrame | None = None, arms: list[str] | None = None) -> DataFrame:
    """One row `summary`: the experiment's aggregates as nested JSON, by arm, by cutoff and arm, head to head, and by difficulty."""
    from .experiments import error_stats, head_to_head

    def packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        value = F.struct(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", *keys).alias("key"), value.alias("value"))))).alias(name))

    parts = [packed(error_stats(rows, "arm"), ["arm"], "overall"), packed(error_stats(rows, "cutoff", "arm"), ["cutoff", "arm"], "by_cutoff")]
    if arms and len(arms) == 2:
        parts.append(head_to_head(rows, *arms).select(F.struct("a_wins", "b_wins", "ties").alias("head_to_head")))
    if labels is not None:
        parts.append(packed(error_stats(with_difficulty(rows, labels).where("difficulty is not null"), "difficulty"), ["difficulty"], "by_difficulty"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # a row each
    return out.select(F.to_json(F.struct("*")).alias("summary"))


# ---------------------------------------------------------------- selections


def keep_positions(rows: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows that a user checked, in order of position."""
    return rows.join(positions.select(pos).distinct(), pos, "left_semi").orderBy(pos)


def batch_of_step(rows: DataFrame, step: int, size: int, key: str = "pos", seed: int = 42) -> DataFrame:
    """A step's global batch: size rows without replacement, by a hash of key, seed and step."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(step))).cast("binary"))
    return rows.orderBy(order, key).limit(size)


def long_curves(curves: DataFrame, least: int = 5, run: str = "run_id") -> DataFrame:
    """The curves of at least so many epochs."""
    return curves.join(curves.groupBy(run).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(run), run, "left_semi")


def traces_of(traces: DataFrame, module: str | None = None, function: str | None = None) -> DataFrame:
    if module is not None:
        traces = traces.where(F.col("module") == module)
    return traces if function is None else traces.where(F.col("function") == function)


def evaluation_source(test: DataFrame | None, curated: DataFrame | None, constant: DataFrame, n: int = 5, pos: str = "pos") -> DataFrame:
    """The first n rows of the test set; without any, of the curated rows; without those, of the constant ones."""
    for rows in (test, curated):
        if rows is not None and not rows.isEmpty():
            return rows.orderBy(pos).limit(n)
    return constant.orderBy(pos).limit(n)


def evaluation_set(uploaded: DataFrame | None, validation: DataFrame, scored, threshold: float) -> DataFrame:
    """(pos, question, answer): the validation rows if nothing was uploaded, else the uploaded rows that are kept once scored.

    scored: a function that adds avg_score and curation_failed to rows.
    """
    if uploaded is None:
        return validation.select("pos", "question", "answer")
    rows = scored(uploaded)
    return rows.where(~F.coalesce("curation_failed", F.lit(False)) & (F.col("avg_score") >= threshold)).select("pos", "question", "answer")


# ---------------------------------------------------------------- display


def preview(rows: DataFrame, size: int = 200, pos: str = "pos") -> DataFrame:
    """(pos, question, answer) with texts cut for display."""
    return rows.select(pos, F.substring("question", 1, size).alias("question"), F.substring("answer", 1, size).alias("answer"))


def trace_view(traces: DataFrame) -> DataFrame:
    """(timestamp, module, function, model, success, latency_s): latency rounded to 2 places, half to even."""
    return traces.select("timestamp", "module", "function", "model", "success", F.bround("latency_s", 2).alias("latency_s"))


def shown(value: Column, places: int = 2) -> Column:
    """A number for display; null and NaN are a dash."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "—").otherwise(F.format_number(value, places))


# ---------------------------------------------------------------- dataset warnings


def warning_reasons(health: DataFrame, least: int = 20) -> DataFrame:
    """Add message, the reasons of rows of dataset_health (kept, total, reasons) as sentences; empty without any."""
    share = F.bround(100 * F.col("kept") / F.nullif(F.col("total"), F.lit(0))).cast("int")
    few = F.when(F.array_contains("reasons", "few_examples"), F.format_string(f"Only %d examples were kept ({least} or more are recommended).", "kept"))
    low = F.when(F.array_contains("reasons", "low_keep_rate"), F.format_string("Only %d of %d raw examples (%d%%) were kept.", "kept", "total", share))
    return health.withColumn("message", F.concat_ws("; ", few, low))


def parse_warning(reply: Column, message: Column) -> Column:
    """warn_user and message of a reply; a reply that is no JSON object warns with the reasons, and so does one that leaves a field out."""
    v = F.try_parse_json(strip_fence(reply))
    fine = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    told = F.try_variant_get(v, "$.warn_user", "boolean")
    said = F.try_variant_get(v, "$.message", "string")
    return F.struct(F.when(fine, F.coalesce(told, F.lit(True))).otherwise(F.lit(True)).alias("warn_user"), F.when(fine, F.coalesce(said, message)).otherwise(message).alias("message"))


def decide_warnings(checked: DataFrame, replies) -> DataFrame:
    """Add warn_user and replace message; rows without a warning need no call and warn nobody.

    checked: rows of warning_reasons with warning. replies: a function from the rows
    with a warning to the same rows with reply; it sees no others.
    """
    quiet = checked.where(~F.col("warning")).withColumns({"warn_user": F.lit(False), "message": F.lit("")})
    asked = replies(checked.where("warning")).withColumn("_w", parse_warning(F.col("reply"), F.col("message")))
    return quiet.unionByName(asked.withColumns({"warn_user": F.col("_w.warn_user"), "message": F.col("_w.message")}).select(*quiet.columns))


# ---------------------------------------------------------------- offline models


def text_embedding(rows: DataFrame, text: str = "text", size: int = 384, name: str = "embedding") -> DataFrame:
    """Add a vector of hashed term counts of unit length, in place of a sentence model; texts without words get zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), size), lambda v, s: F.concat(F.slice(v, 1, s), F.array(F.get(v, s) + 1.0), F.slice(v, s + 2, size)))
    norm = F.sqrt(F.aggregate(F.col("_c"), F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_c", counts).withColumn(name, F.transform("_c", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).drop("_c")


def generated(prompts: DataFrame, responses: DataFrame, adapter: bool, prompt: str = "prompt") -> DataFrame:
    """Add output and latency_s from stored responses (prompt, adapter, output, latency_s), null where there is none."""
    mine = responses.where(F.col("adapter") == adapter).select(prompt, "output", "latency_s").dropDuplicates([prompt])
    return prompts.join(mine, prompt, "left")
