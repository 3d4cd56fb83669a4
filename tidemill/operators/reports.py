"""Markdown reports from small aggregates; only counts and a few sample rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import override_buckets, section_samples

SECTIONS = (
    ("rejected_quality", None, "Sample quality rejections"),
    ("rejected_duplicate", None, "Sample duplicates"),
    ("manually_accepted", ("rejected_quality", "rejected_duplicate"), "Accepted by hand after rejection"),
    ("manually_accepted", ("failed",), "Accepted by hand after failure"),
    ("manually_rejected", ("kept",), "Rejected by hand after keeping"),
    ("manually_rejected", ("failed",), "Rejected by hand after failure"),
    ("failed", None, "Failed examples"),
)


def _sample(r) -> str:
    score = "none" if r["avg_score"] is None else r["avg_score"]
    return f"- {r['q'] or ''}\n  - answer: {'none' if r['a'] is None else r['a']}\n  - score {score}: {r['reason']}\n  - automatic {r['automatic_status'] or 'none'}, final {r['final_status']}"


def curation_report(classified: DataFrame, threshold: float, mode: str = "normal", samples: int = 5, pos: str = "pos") -> str:
    """Counts by final status and samples of each section; columns that the frame lacks count as null."""
    absent = [c for c in ("automatic_status", "question", "answer", "reason") if c not in classified.columns]
    classified = classified.withColumns({c: F.lit(None).cast("string") for c in absent})
    n: dict[tuple, int] = {(r["final_status"], r["automatic_status"]): r["n"] for r in override_buckets(classified).collect()}
    count = lambda status: sum(v for (s, _), v in n.items() if s == status)
    lines = ["# Curation Report", "", f"- Raw examples: {sum(n.values())}", f"- Threshold: {threshold}", f"- Mode: {mode}"]
    for title, status in (("Kept", "kept"), ("Quality rejected", "rejected_quality"), ("Duplicates", "rejected_duplicate"), ("Manually accepted", "manually_accepted"), ("Manually rejected", "manually_rejected"), ("Failed (unresolved)", "failed")):
        lines.append(f"- {title}: {count(status)}")
    for status, before, title in SECTIONS:
        rows = classified.where(F.col("final_status") == status)
        if before:
            rows = rows.where(F.col("automatic_status").isin(*before))
        shown = section_samples(rows, samples, pos).orderBy(pos).select(F.substring("question", 1, 80).alias("q"), F.substring("answer", 1, 80).alias("a"), "avg_score", "reason", "automatic_status", "final_status").collect()
        if shown:
            lines += ["", f"## {title}", ""] + [_sample(r) for r in shown]
    return "\n".join(lines) + "\n"


def training_report(result: dict, checks: list[dict]) -> str:
    """A run's metrics, losses by epoch, forecast checks or their errors, and the last recommendation that notified."""
    shown = lambda v, f: "n/a" if v is None else format(v, f)
    lines = ["# Training Report", "", f"- Training time: {shown(result.get('training_time_s'), '.2f')} s", f"- Throughput: {shown(result.get('throughput_examples_per_sec'), '.2f')} examples/s", f"- Peak memory: {shown(result.get('peak_gpu_memory_gb'), '.2f')} GB", f"- Final loss: {shown(result.get('final_loss'), '.4f')}", "", "## Validation loss", ""]
    lines += [f"- Epoch {k}: {v:.4f}" for k, v in enumerate(result.get("val_loss_history") or [], 1)]
    lines += ["", "## Forecast checks", ""]
    for c in checks:
        lines.append(f"- Epoch {c['epoch']}: error: {c['error']}" if c.get("error") else f"- Epoch {c['epoch']}: {c['decision']['action']}: {c['decision']['reason']}")
    told = [c for c in checks if not c.get("error") and c["decision"]["notify_user"]]
    if told:
        lines += ["", f"Recommendation: {told[-1]['decision']['action']} ({told[-1]['decision']['reason']})"]
    return "\n".join(lines) + "\n"


def evaluation_report(summary: dict, check: dict | None = None) -> str:
    margin = summary["avg_quality_margin"]
    word = "no valid margin" if margin is None else f"{'better' if margin > 0 else 'worse' if margin < 0 else 'level'} by {abs(margin):.2f} points"
    lines = ["# Evaluation Summary", "", f"- Examples: {summary['total_examples']}", f"- Wins, losses, ties: {summary['wins']}, {summary['losses']}, {summary['ties']}", f"- Judge failures: {summary['judge_failures']}", f"- The tuned model is {word}", f"- Regressions: {summary['n_regressions']}"]
    return "\n".join(lines + ([f"- Cross-check: {check['note']}"] if check else [])) + "\n"


def detailed_blocks(judged: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, block): a Markdown block for each judged row; write it sorted, it is as long as the input."""
    return judged.select(pos, F.concat(F.lit("## "), F.col("question"), F.lit("\n\nWinner: "), F.col("winner"), F.lit("\n\nBase: "), F.coalesce("base_output", F.lit("")), F.lit("\n\nTuned: "), F.coalesce("ft_output", F.lit("")), F.lit("\n\n"), F.coalesce("reason", F.lit("")), F.lit("\n")).alias("block"))


def final_report(counts: dict, training: str, evaluation: str, calls: int) -> str:
    head = f"# Final Report\n\n- Kept: {counts.get('kept', 0)}\n- Rejected: {counts.get('rejected', 0)}\n- Failed: {counts.get('failed', 0)}\n- Model calls: {calls}\n"
    return "\n".join([head, training, evaluation])


def notebook_curation(classified: DataFrame, samples: int = 3, pos: str = "pos") -> str:
    """A short curation report: counts by status, the scores' range and upper median, and a few kept samples."""
    from .runs import score_spread

    counts = {r["final_status"]: r["n"] for r in classified.groupBy("final_status").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = score_spread(classified).first()
    lines = ["# Curation", "", *[f"- {k}: {v}" for k, v in sorted(counts.items())]]
    if spread and spread["least"] is not None:
        lines.append(f"- Scores: {spread['least']:.2f} to {spread['most']:.2f}, median {spread['upper_median']:.2f}")
    kept = classified.where("final_status = 'kept'").orderBy(pos).limit(samples).select(F.substring("question", 1, 80).alias("q"), "avg_score").collect()
    return "\n".join(lines + ["", "## Samples", ""] + [f"- {r['q']} ({r['avg_score']})" for r in kept]) + "\n"


def notebook_evaluation(summary: dict, latency: DataFrame, judged: DataFrame, samples: int = 5, pos: str = "pos") -> str:
    """A short evaluation report: the summary, mean latency by model, and a few judged samples."""
    lines = [evaluation_report(summary), "## Latency", ""]
    lines += [f"- {r[0]}: {r['avg_latency']:.2f} s" for r in latency.orderBy(latency.columns[0]).collect()]
    shown = judged.orderBy(pos).limit(samples).select(F.substring("question", 1, 80).alias("q"), "winner").collect()
    return "\n".join(lines + ["", "## Samples", ""] + [f"- {r['q']}: {r['winner']}" for r in shown]) + "\n"
