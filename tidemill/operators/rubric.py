"""Model calls as a column: prompts, a pluggable responder, parsing, and explicit failure rows.

A responder maps a prompt and a temperature to a reply (None for a failed call).
Replies can be kept by the hash of their prompt, so that a repeated task never calls
twice, or come from a table keyed by it, as in tests and reruns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence

Responder = Callable[[str, float], str | None]
RUBRIC = ("clarity", "correctness", "value")


def score_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Rate this training example from 0 to 10 for clarity, correctness and value. Reply with JSON: clarity, correctness, value, keep, reason.\n\nQuestion: "), question, F.lit("\n\nAnswer: "), answer)


def pair_prompt(a: Column, b: Column) -> Column:
    return F.concat(F.lit("Do these two questions ask for the same thing? Reply with JSON: confirmed_duplicate, reason.\n\n1: "), a, F.lit("\n\n2: "), b)


def judge_prompt(question: Column, reference: Column, base: Column, tuned: Column) -> Column:
    return F.concat(F.lit("Judge two answers. Reply with JSON: score_a, score_b (objects of numbers), winner (A, B or tie), reason.\n\nQuestion: "), question, F.lit("\n\nReference: "), reference, F.lit("\n\nA: "), base, F.lit("\n\nB: "), tuned)


class ReplyStore:
    """Replies as files named by the hash of their prompt, in a folder that all tasks share (any that pyarrow opens)."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _open(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.uri}/{name[:2]}/{name}.json")

    def get(self, name: str) -> dict | None:
        system, path = self._open(name)
        try:
            with system.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, name: str, kept: dict) -> None:
        """Written whole, then moved to its name: a task that is killed leaves no half reply."""
        system, path = self._open(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(json.dumps(kept).encode())
        system.move(part, path)


_CALLS = "reply string, success boolean, error string, latency_s double"
_CALLS_ARROW = [("reply", pa.string()), ("success", pa.bool_()), ("error", pa.string()), ("latency_s", pa.float64())]


def _ask(responder: Responder, text: str | None, retries: int, retry_temperature: float) -> tuple:
    """reply, success, error and latency of a call and its retries; never an exception."""
    began, error = time.monotonic(), "no prompt"
    for attempt in range(retries + 1 if text is not None else 0):
        try:
            reply = responder(text, 0.0 if attempt == 0 else retry_temperature)
            if reply is not None:
                return reply, True, None, time.monotonic() - began
            error = "no reply"
        except Exception as e:  # the failure is the row
            error = f"{type(e).__name__}: {e}"
    return None, False, error, time.monotonic() - began


def _asked(rows: DataFrame, key: str, prompt: str, responder: Responder, workers: int, pause: float, retries: int, retry_temperature: float, store: ReplyStore | None) -> DataFrame:
    """(key, prompt, reply, success, error, latency_s) of rows (key, prompt); with a store the key names the reply in it."""
    schema = pa.schema([(key, pa.string()), (prompt, pa.string()), *_CALLS_ARROW])

    def ask(name, text):
        kept = store and store.get(name)
        if kept:
            return kept["reply"], True, None, kept["latency_s"]
        got = _ask(responder, text, retries, retry_temperature)
        if store and got[1]:
            store.put(name, {"reply": got[0], "latency_s": got[3]})
        return got

    def run(batches):
        with ThreadPoolExecutor(workers if not pause else 1) as pool:
            for b in batches:
                keys, prompts = b.column(0).to_pylist(), b.column(1).to_pylist()
                got = []
                for r in pool.map(ask, keys, prompts):
                    got.append(r)
                    if pause:
                        time.sleep(pause)
                reply, success, error, latency = zip(*got) if got else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({key: keys, prompt: prompts, "reply": reply, "success": success, "error": error, "latency_s": latency}, schema=schema)

    return rows.mapInArrow(run, f"{key} string, {prompt} string, {_CALLS}")


def called(rows: DataFrame, responder: Responder, *, key: str, prompt: str = "prompt", workers: int = 10, pause: float = 0.0, retries: int = 1, retry_temperature: float = 0.3, store: str | None = None) -> DataFrame:
    """(key, prompt, reply, success, error, latency_s): a call and its retries at a higher temperature, never an exception.

    store: a folder of replies by the hash of their prompt. Equal prompts are then
    called once, whatever rows ask them, and a reply is kept as soon as it is there: a
    task that is run again, a second use of the result or a later job reads it instead
    of calling. Failed calls are rows too and are not kept, so that they are tried
    again. Without a store each row is a call and the result should be stored before
    it is used twice. A null prompt is a failure without a call.
    """
    asked = rows.select(F.col(key).cast("string").alias(key), F.col(prompt).cast("string").alias(prompt))
    if store is None:
        return _asked(asked, key, prompt, responder, workers, pause, retries, retry_temperature, None)
    named = asked.withColumn("_name", F.coalesce(F.sha2(F.col(prompt).cast("binary"), 256), F.lit("none")))
    once = named.groupBy("_name").agg(F.first(prompt).alias("_prompt"))
    replies = _asked(once, "_name", "_prompt", responder, workers, pause, retries, retry_temperature, ReplyStore(store)).drop("_prompt")
    return named.join(replies, "_name").drop("_name")


def replayed(rows: DataFrame, replies: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Join stored replies (prompt_hash, reply) by the prompt's hash."""
    return rows.withColumn("prompt_hash", F.sha2(F.col(prompt).cast("binary"), 256)).join(replies, "prompt_hash", "left")


def parse_scores(reply: Column) -> Column:
    """clarity, correctness, value, avg_score, keep, keep_present, reason, curation_failed of a reply.

    A reply must be a JSON object with three numbers and a reason that is a string and
    not empty; anything else, a missing reply included, is a failure row of nulls.
    keep counts only where it is a truth value.
    """
    body = strip_fence(reply)
    v = F.try_parse_json(body)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    number = lambda k: F.when(kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{k}", "double"))
    reason = F.when(kind("reason") == "STRING", F.try_variant_get(v, "$.reason", "string"))
    fine = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)) & F.coalesce(F.length(reason) > 0, F.lit(False))
    for k in RUBRIC:
        fine = fine & number(k).isNotNull()
    keep = F.when(kind("keep") == "BOOLEAN", F.try_variant_get(v, "$.keep", "boolean"))
    present = F.coalesce(F.array_contains(F.json_object_keys(body), "keep"), F.lit(False))
    mean = (number("clarity") + number("correctness") + number("value")) / 3
    return F.struct(*[F.when(fine, number(k)).alias(k) for k in RUBRIC], F.when(fine, mean).alias("avg_score"), F.when(fine, keep).alias("keep"), F.when(fine, present).otherwise(F.lit(False)).alias("keep_present"), F.when(fine, reason).otherwise("evaluation failed").alias("reason"), (~fine).alias("curation_failed"))


def parse_verification(reply: Column) -> Column:
    """confirmed_duplicate and reason; a reply that cannot be read refutes."""
    v = F.try_parse_json(strip_fence(reply))
    sure = F.try_variant_get(v, "$.confirmed_duplicate", "boolean")
    return F.struct(F.coalesce(sure, F.lit(False)).alias("confirmed_duplicate"), F.when(sure.isNull(), "verification_parse_failed").otherwise(F.try_variant_get(v, "$.reason", "string")).alias("reason"))


def parse_judgement(reply: Column) -> Column:
    """winner, score_a, score_b and reason; a winner outside A, B and tie, or a bad reply, is JUDGE_FAILED."""
    body = strip_fence(reply)
    winner = F.get_json_object(body, "$.winner")
    fine = F.coalesce(winner.isin("A", "B", "tie"), F.lit(False))
    scores = lambda k: F.when(fine, F.from_json(F.get_json_object(body, f"$.{k}"), "map<string,double>"))
    return F.struct(F.when(fine, winner).otherwise("JUDGE_FAILED").alias("winner"), scores("score_a").alias("score_a"), scores("score_b").alias("score_b"), F.get_json_object(body, "$.reason").alias("reason"))


def parse_action(reply: Column) -> Column:
    """action, notify_user and reason; a bad reply continues without notice, a missing flag notifies."""
    from .curves import ACTIONS

    body = strip_fence(reply)
    action = F.get_json_object(body, "$.action")
    fine = F.coalesce(action.isin(*ACTIONS), F.lit(False))
    return F.struct(F.when(fine, action).otherwise("CONTINUE").alias("action"), F.when(fine, F.coalesce(F.get_json_object(body, "$.notify_user").cast("boolean"), F.lit(True))).otherwise(F.lit(False)).alias("notify_user"), F.when(fine, F.get_json_object(body, "$.reason")).otherwise("reply could not be used").alias("reason"))


def traces(calls: DataFrame, module: str, function: str, model: str) -> DataFrame:
    """Trace rows of calls, failed ones included."""
    return calls.select(F.lit(module).alias("module"), F.lit(function).alias("function"), F.lit(model).alias("model"), "prompt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.col("reply").alias("response_text"), "success", "error", "latency_s")
