"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all documents that the one before it kept; a stage's result is
written and read again before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import registry
from tidemill.llm.common import stored
from tidemill.llm.decontamination import drop_contaminated
from tidemill.llm.jaccard_join import keep_first
from tidemill.llm.packing import pack
from tidemill.llm.substring_dedup import dedup_substrings
from tidemill.llm.toxicity import drop_toxic, fit
from tidemill.runtime import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model is fitted on the labels that op1 may use."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(docs, labels, usable=~registry.held_out()), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    ship(spark)
    return keep_first(docs, n=5, threshold=(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that stand anywhere else; other texts stay as they are."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = dedup_substrings(docs, window=35, keep=others, verbatim=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(made[c] if c in made else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stands in 13-word windows of the benchmark."""
    return drop_contaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), size=13, share=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows of 2,048 ids."""
    ship(spark)
    return pack(docs, registry.vocabulary("word_bpe_49k.json"), 1, window=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Boosted trees, tokenizer ids and best-fit packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
