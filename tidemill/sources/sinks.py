"""Writers of logs, exports and token arrays."""

from __future__ import annotations

import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = ("id", "question", "answer", "clarity", "correctness", "value", "avg_score", "automatic_status", "final_status", "reason")


def now_text():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def override_log(classified: DataFrame, overrides: DataFrame, key: str = "_id") -> DataFrame:
    """A log row for each decision, with the status that it overrode."""
    d = overrides.select(key, "decision", *([F.col("reason").alias("user_reason")] if "reason" in overrides.columns else [F.lit(None).cast("string").alias("user_reason")]))
    return classified.join(d, key).select(F.col(key).alias("id"), "question", "answer", F.struct("clarity", "correctness", "value", "avg_score").alias("haiku_score"), F.col("final_status").alias("automatic_status"), F.col("decision").alias("user_decision"), "user_reason", now_text().alias("timestamp"))


def decisions(classified: DataFrame, key: str = "_id") -> DataFrame:
    """The ten export columns; the automatic status defaults to the final one."""
    return classified.select(F.col(key).alias("id"), "question", "answer", "clarity", "correctness", "value", "avg_score", F.coalesce("automatic_status", "final_status").alias("automatic_status"), "final_status", "reason")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_archives(rows: DataFrame, path: str, archive: str, line: str, entry_lines: int = 200) -> None:
    """ZIP archives `archive=value.zip` of JSON lines, in entries of so many lines; an archive is written as a stream by one task.

    The folder must be one that pyarrow opens. A file is moved to its name when it is
    whole, so that a task that is run again leaves no half archive. Null lines are left out.
    """
    import pyarrow as pa

    done = pa.schema([("archive", pa.string())])

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name, out, z, held, entries = None, None, None, [], 0

        def entry():
            nonlocal held, entries
            if held:
                z.writestr(f"part-{entries}.jsonl", "\n".join(held))
                held, entries = [], entries + 1

        def close():
            entry()
            z.close()
            out.close()
            system.move(part, f"{folder}/{archive}={name}.zip")

        for b in batches:
            for which, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if which != name:
                    if name is not None:
                        close()
                        yield pa.RecordBatch.from_pydict({"archive": [name]}, schema=done)
                    name, part, entries = which, f"{folder}/_{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(part)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                held.append(text)
                if len(held) >= entry_lines:
                    entry()
        if name is not None:
            close()
            yield pa.RecordBatch.from_pydict({"archive": [name]}, schema=done)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.coalesce(F.col(archive).cast("string"), F.lit("")).alias("archive"), F.col(line).alias("line")).where("line is not null")
    keyed.repartition(n, "archive").sortWithinPartitions("archive").mapInArrow(run, "archive string").count()


def export_run(spark: SparkSession, path: str, dataset_source: str, curation: dict, training: dict, result: dict) -> dict:
    """Write a run's configuration as one JSON document and return it."""
    out = {"dataset_source": dataset_source, "curation_config": curation, "training_config": training, "actual_seed_used": result.get("seed"), "final_loss": result.get("final_loss"), "val_loss_history": result.get("val_loss_history")}
    out["exported_at"] = spark.range(1).select(now_text()).first()[0]
    spark.createDataFrame([(json.dumps(out, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def append_outcome(spark: SparkSession, path: str, stats: dict, config: dict, result: dict) -> None:
    row = {"curation_stats": stats, "training_config": config, "final_result": {k: v for k, v in result.items() if k != "model"}}
    df = spark.createDataFrame([tuple(json.dumps(v) for v in row.values())], "curation_stats string, training_config string, final_result string")
    append_log(df.withColumn("timestamp", now_text()), path)


def write_tokens(rows: DataFrame, path: str) -> None:
    """Token arrays as Parquet."""
    rows.select("input_ids", "attention_mask", "labels").write.mode("overwrite").parquet(path)


def benchmark_documents(logs: DataFrame) -> DataFrame:
    """(hardware, framework, document): header and ordered steps of each run as JSON; a run's steps are bounded."""
    step = F.struct("step", "timestamp", "step_time_sec", "tokens_per_sec", "peak_memory_mb", "loss")
    return logs.groupBy("hardware", "framework").agg(F.array_sort(F.collect_list(step)).alias("logs")).select("hardware", "framework", F.to_json(F.struct("hardware", "framework", "logs")).alias("document"))
