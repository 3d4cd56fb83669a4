"""Readers of examples, logs and archives."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stored

ROWS = 200  # examples of an Arrow batch; texts are long
SKIPPED = ("__MACOSX", ".git", ".DS_Store")  # archive parts that hold no data
SUFFIXES = (".json", ".jsonl", ".csv", ".tsv", ".zip")
TRACE = "module string, function string, model string, prompt string, timestamp string, response_text string, success boolean, error string, latency_s double"
OVERRIDES = "id string, question string, answer string, haiku_score struct<clarity: double, correctness: double, value: double, avg_score: double>, automatic_status string, user_decision string, user_reason string, timestamp string"


def parse_lenient(text: str) -> list[dict]:
    """JSON first: a list's objects; an object's first list of objects, else itself. Otherwise line by line, what cannot be read left out."""
    try:
        whole = json.loads(text)
    except ValueError:
        out = []
        for line in text.split("\n"):
            try:
                row = json.loads(line) if line.strip() else None
            except ValueError:
                continue
            if isinstance(row, dict):
                out.append(row)
        return out
    if isinstance(whole, dict):
        inner = next((v for v in whole.values() if isinstance(v, list)), None)
        whole = [whole] if inner is None else inner
    return [r for r in whole if isinstance(r, dict)] if isinstance(whole, list) else []


def parse_strict(text: str) -> list[dict]:
    """JSON first, an object being one row; otherwise every line that is not blank must be JSON."""
    try:
        whole = json.loads(text)
        return [whole] if isinstance(whole, dict) else list(whole)
    except ValueError:
        return [json.loads(line) for line in text.split("\n") if line.strip()]


def parse_table(text: str, delimiter: str = ",") -> list[dict]:
    import csv

    return [dict(r) for r in csv.DictReader(io.StringIO(text), delimiter=delimiter)]


def archive_rows(data: bytes, depth: int = 0) -> list[tuple[str, dict]]:
    """(entry, row) of an archive in order; archives inside are opened one level deep.

    An archive without any data file is an error; data files without rows give none.
    """
    out, names, found = [], [], False
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            name = info.filename
            names.append(name)
            if info.is_dir() or any(part in SKIPPED for part in name.split("/")):
                continue
            low = name.lower()
            if low.endswith((".json", ".jsonl")):
                rows = parse_lenient(z.read(info).decode("utf-8", "replace"))
            elif low.endswith((".csv", ".tsv")):
                rows = parse_table(z.read(info).decode("utf-8", "replace"), "\t" if low.endswith(".tsv") else ",")
            elif low.endswith(".zip") and depth < 1:
                try:
                    out += [(f"{name}!{e}", r) for e, r in archive_rows(z.read(info), depth + 1)]
                    found = True
                except (ValueError, zipfile.BadZipFile):
                    pass
                continue
            else:
                continue
            found = True
            out += [(name, r) for r in rows]
    if not found:
        raise ValueError(f"no data file in the archive; it has {', '.join(names[:20])}")
    return out


def _files(spark: SparkSession, path: str, rows_of) -> DataFrame:
    """(src_file, src_entry, pos, raw): a JSON object per example, in each file's order."""
    schema = pa.schema([("src_file", pa.string()), ("src_entry", pa.string()), ("pos", pa.int64()), ("raw", pa.string())])

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                got = rows_of(content.as_py())
                for a in range(0, len(got), ROWS):
                    some = got[a : a + ROWS]
                    yield pa.RecordBatch.from_pydict({"src_file": [file] * len(some), "src_entry": [e for e, _ in some], "pos": list(range(a, a + len(some))), "raw": [json.dumps(r, ensure_ascii=False) for _, r in some]}, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "src_file string, src_entry string, pos long, raw string")


def _opened(uri: str):
    """A file that can be read from any place; file:/x is file:///x to Spark alone."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return system.open_input_file(path)


def archive_entries(file) -> list[tuple[int, str, int]]:
    """(number, name, bytes) of the entries with data, from an archive's directory at its end; archives inside are looked into, one level deep.

    An archive without any is an error.
    """
    out, names = [], []
    with zipfile.ZipFile(file) as z:
        for number, info in enumerate(z.infolist()):
            names.append(info.filename)
            if info.is_dir() or any(part in SKIPPED for part in info.filename.split("/")) or not info.filename.lower().endswith(SUFFIXES):
                continue
            if info.filename.lower().endswith(".zip"):
                try:
                    with zipfile.ZipFile(io.BytesIO(z.read(info))) as inner:
                        files = [i.filename for i in inner.infolist() if not i.is_dir() and not any(p in SKIPPED for p in i.filename.split("/"))]
                except zipfile.BadZipFile:
                    continue
                if not any(f.lower().endswith(tuple(s for s in SUFFIXES if s != ".zip")) for f in files):
                    continue
            out.append((number, info.filename, info.file_size))
    if not out:
        raise ValueError(f"no data file in the archive; it has {', '.join(names[:20])}")
    return out


def entry_rows(z: zipfile.ZipFile, number: int) -> list[tuple[str, dict]]:
    """(entry, row) of one entry, or of all data in it if it is an archive."""
    info = z.infolist()[number]
    name, data = info.filename, z.read(info)
    low = name.lower()
    if low.endswith(".zip"):
        return [(f"{name}!{e}", r) for e, r in archive_rows(data, 1)]
    if low.endswith((".csv", ".tsv")):
        return [(name, r) for r in parse_table(data.decode("utf-8", "replace"), "\t" if low.endswith(".tsv") else ",")]
    return [(name, r) for r in parse_lenient(data.decode("utf-8", "replace"))]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, src_entry, pos, raw): the examples of ZIP archives, numbered from 0 in each.

    Tasks read the archives' directories, a few bytes at their ends, and the entries
    are dealt over tasks that read only the bytes of theirs: an archive of any size is
    nobody's whole. Archives in a store that only Spark opens are read whole instead, one a task.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # without their content
    first = files.first()
    try:
        if first is not None:
            _opened(first[0]).close()
    except pa.ArrowInvalid:
        return _files(spark, path, archive_rows)
    listed = pa.schema([("src_file", pa.string()), ("number", pa.int32())])
    schema = pa.schema([("src_file", pa.string()), ("number", pa.int32()), ("src_entry", pa.string()), ("k", pa.int64()), ("raw", pa.string())])

    def plan(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                with _opened(uri) as f:
                    entries = archive_entries(f)
                yield pa.RecordBatch.from_pydict({"src_file": [uri] * len(entries), "number": [n for n, _, _ in entries]}, schema=listed)

    def read(batches):
        for b in batches:
            for uri, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _opened(uri) as f, zipfile.ZipFile(f) as z:
                    got = entry_rows(z, number)
                for a in range(0, len(got), ROWS):
                    some = got[a : a + ROWS]
                    yield pa.RecordBatch.from_pydict({"src_file": [uri] * len(some), "number": [number] * len(some), "src_entry": [e for e, _ in some], "k": list(range(a, a + len(some))), "raw": [json.dumps(r, ensure_ascii=False) for _, r in some]}, schema=schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = files.mapInArrow(plan, "src_file string, number int").repartition(n, "src_file", "number")
    rows = stored(entries.mapInArrow(read, "src_file string, number int, src_entry string, k long, raw string"), "archive-rows")
    before = Window.partitionBy("src_file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each entry
    starts = rows.groupBy("src_file", "number").agg(F.count(F.lit(1)).alias("_n")).select("src_file", "number", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["src_file", "number"]).select("src_file", "src_entry", (F.col("_start") + F.col("k")).alias("pos"), "raw")


def read_examples(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """JSON or JSONL files; lenient leaves out what cannot be read, strict fails on it."""
    parse = {"lenient": parse_lenient, "strict": parse_strict}[mode]
    return _files(spark, path, lambda data: [("", r) for r in parse(data.decode("utf-8", "replace" if mode == "lenient" else "strict"))])


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines at scale: files are split and parsed by the engine."""
    reader = spark.read.option("mode", mode)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, all values strings."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=True, escape="\"")  # a quote in a value is doubled


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log; a missing one is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document, such as a run's configuration."""
    return spark.read.json(path, multiLine=True)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, epoch, loss) of a JSON object of arrays."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("run_id", "losses"))
    return raw.select("run_id", F.posexplode("losses").alias("k", "loss")).select("run_id", (F.col("k") + 1).cast("int").alias("epoch"), "loss")


def read_benchmarks(spark: SparkSession, files: dict[tuple[str, str], str]) -> DataFrame:
    """Step logs of benchmark files by (hardware, framework); missing files are left out."""
    step = "array<struct<step int, timestamp double, step_time_sec double, tokens_per_sec double, peak_memory_mb double, loss double>>"
    out = None
    for (hardware, framework), path in files.items():
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        logs = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), step) for k in ("logs", "log", "steps")])
        one = text.select(F.lit(hardware).alias("hardware"), F.lit(framework).alias("framework"), F.inline(logs))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "hardware string, framework string, step int, timestamp double, step_time_sec double, tokens_per_sec double, peak_memory_mb double, loss double")


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """(best_metric, best_global_step, epoch, step, loss, eval_loss, ...) of checkpoint states."""
    entry = "struct<epoch double, step int, loss double, eval_loss double, grad_norm double, learning_rate double, eval_runtime double, eval_samples_per_second double, eval_steps_per_second double>"
    return spark.read.schema(f"best_metric double, best_global_step int, log_history array<{entry}>").json(path, multiLine=True).select("best_metric", "best_global_step", F.inline("log_history"))


def read_local_dataset(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(pos, instruction, input, output) of a local copy of a hub dataset; pos follows the files' names and the rows in them.

    Rows of Parquet files know their number in the file, so that only the files' sizes
    are added up (a row for each file) and no row moves; others are sorted by file and block.
    """
    from ..operators.split import with_position

    rows = spark.read.format(kind).load(path)
    texts = [(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("")).alias(n) for n in ("instruction", "input", "output")]
    if kind != "parquet":
        placed = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), *texts)
        return with_position(placed, "_file", "_block").select("pos", "instruction", "input", "output")
    placed = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *texts)
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_file").select((F.col("_start") + F.col("_row")).alias("pos"), "instruction", "input", "output")


def read_token_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(pos, input_ids, labels) of tokenized examples kept as Parquet arrays; missing labels are the ids."""
    rows = spark.read.parquet(path)
    labels = F.col("labels") if "labels" in rows.columns else F.col("input_ids")
    return rows.select("pos", F.col("input_ids").cast("array<int>").alias("input_ids"), labels.cast("array<int>").alias("labels"))
