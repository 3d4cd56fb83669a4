"""Shape detection and normalization of instruction and chat examples to (question, answer)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, has_key, is_empty, strip

#: Known shapes in order of priority, with the keys each needs.
SHAPES = (("qa", ("question", "answer")), ("alpaca", ("instruction", "output")), ("prompt_completion", ("prompt", "completion")), ("instruction_response", ("instruction", "response")))
#: The default system line of the chat template. A fixed value.
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."


def shape(raw: Column) -> Column:
    """Name of a JSON example's shape, or null."""
    out = None
    for name, keys in SHAPES:
        test = has_key(raw, keys[0]) & has_key(raw, keys[1])
        out = F.when(test, name) if out is None else out.when(test, name)
    messages = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.messages", "variant"))
    return out.when(F.startswith(messages, F.lit("ARRAY")), "chat")


SAMPLE_CHARS = 3_000  # of the sample that a model is shown


def mapping_prompt(sample: dict) -> str:
    """What a model is asked about an example of no known shape."""
    shown = json.dumps(sample, indent=2)[:SAMPLE_CHARS]
    return f'Which top-level fields of this training example hold the question (several, in order, if it is split), and which one the answer? Reply with JSON only: {{"question_fields": [...], "answer_field": "..."}}\n\nExample:\n{shown}'


def parse_mapping(reply: str | None, fields: list[str]) -> dict:
    """question_fields and answer_field of a reply, which must be fields of the example; a reply that is not of this form is a ValueError."""
    body = (reply or "").strip().strip("`").removeprefix("json").strip()
    try:
        said = json.loads(body)
    except ValueError:
        raise ValueError(f"the reply is no JSON: {body[:80]!r}") from None
    if not isinstance(said, dict):
        raise ValueError("the reply is no JSON object")
    asked, answer = said.get("question_fields"), said.get("answer_field")
    if not isinstance(asked, list) or not asked or not all(isinstance(f, str) for f in asked) or not isinstance(answer, str):
        raise ValueError("the reply does not name question_fields and answer_field")
    unknown = [f for f in [*asked, answer] if f not in fields]
    if unknown:
        raise ValueError(f"the example has no field {', '.join(unknown)}")
    return {"question_fields": asked, "answer_field": answer}


def detect(raw_rows: DataFrame, raw: str = "raw", pos: str = "pos", responder: Callable[[str, float], str | None] | None = None) -> dict:
    """The dataset's report, by its first row; one row comes to the driver.

    Without a known shape a responder, if given, is asked once which fields hold the
    question and the answer. A reply that cannot be used leaves the schema open, with
    the error in the report, and never guesses.
    """
    first = raw_rows.orderBy(pos).limit(1).select(shape(F.col(raw)).alias("schema"), F.array_sort(F.json_object_keys(raw)).alias("fields"), F.col(raw).alias("raw")).collect()
    if not first:
        return {"schema": None, "confidence": None, "mapping": None, "sample_fields": None}
    row = first[0]
    report = {"schema": row["schema"], "confidence": "heuristic" if row["schema"] else None, "mapping": None, "sample_fields": row["fields"]}
    if row["schema"] or responder is None or row["fields"] is None:
        return report
    try:
        mapping = parse_mapping(responder(mapping_prompt(json.loads(row["raw"])), 0.0), row["fields"])
    except Exception as e:  # a failed call is part of the report
        return {**report, "error": f"{type(e).__name__}: {e}"}
    return {**report, "schema": "llm_mapping", "confidence": "llm", "mapping": mapping}


def _messages(raw: Column) -> Column:
    return F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<role string, content string>>")


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role, empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))


def with_input(instruction: Column, extra: Column, join: str = "\n\n") -> Column:
    return F.when(strip(extra) != "", F.concat(instruction, F.lit(join), extra)).otherwise(instruction)


def normalize(raw_rows: DataFrame, schema: str, mapping: dict | None = None, raw: str = "raw") -> DataFrame:
    """Add question, answer and error. The one shape holds for all rows; a row that lacks what a verbatim shape needs is an error row."""
    r = F.col(raw)
    text = lambda key: strip(as_text(r, key))
    error = F.lit(None).cast("string")
    if schema == "qa":
        question, answer = F.get_json_object(r, "$.question"), F.get_json_object(r, "$.answer")
        error = F.when(~(has_key(r, "question") & has_key(r, "answer")), "missing question or answer")
    elif schema == "alpaca":
        question, answer = with_input(text("instruction"), text("input")), text("output")
    elif schema == "prompt_completion":
        question, answer = text("prompt"), text("completion")
    elif schema == "instruction_response":
        question, answer = text("instruction"), text("response")
    elif schema == "chat":
        question, answer = last_of(_messages(r), "user"), last_of(_messages(r), "assistant")
    elif schema == "llm_mapping":
        value = lambda key: F.when(~is_empty(r, key), text(key))
        fields, target = mapping.get("question_fields") or [], mapping.get("answer_field")
        question = F.concat_ws("\n\n", *[value(k) for k in fields]) if fields else F.lit("")
        answer = F.lit("") if target is None else text(target)
    else:
        raise ValueError(f"unknown shape: {schema}")
    return raw_rows.withColumns({"question": question, "answer": answer, "error": error})


def chat_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, question, answer) of a table of turns: the last user and the last assistant turn, empty if none."""
    last = lambda role: F.coalesce(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    return turns.groupBy("conv_id").agg(last("user").alias("question"), last("assistant").alias("answer"))


def alpaca_prompt(instruction: Column, extra: Column, output: Column) -> Column:
    """The training prompt, with an input block where there is input."""
    block = F.when(strip(extra) != "", F.concat(F.lit("\n### Input:\n"), extra)).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n"), block, F.lit("\n### Response:\n"), output)


def chat_template(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """Render messages (role, content) without tools; a default system line leads unless the first message is one."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    lead = F.when(F.coalesce(F.try_element_at(messages, F.lit(1))["role"], F.lit("")) == "system", "").otherwise(f"<|im_start|>system\n{system}<|im_end|>\n")
    return F.concat(lead, F.array_join(F.transform(messages, turn), ""))


def tokenized(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], *, text: str = "text", size: int = 512, pad: int = 0) -> DataFrame:
    """Add input_ids, attention_mask and labels by a tokenizer of the caller's; a null text is empty.

    encoder: a function without arguments that makes one from texts to ids; it is called once a task.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for t in texts:
            yield pd.Series([list(i) for i in encode(t.fillna("").tolist())], dtype=object)

    return rows.withColumn("_ids", ids(F.col(text))).withColumns(pad_tokens(F.col("_ids"), size, pad)).drop("_ids")


def pad_tokens(ids: Column, size: int = 512, pad: int = 0) -> dict[str, Column]:
    """input_ids cut and padded to size, their attention_mask, and labels with -100 where the mask is 0.

    ids comes several times in them: it should be a column, as an expression would be computed as often.
    """
    cut = F.slice(ids, 1, size)
    known = F.size(cut)
    behind = lambda value: F.array_repeat(F.lit(value), size - known)
    return {"input_ids": F.concat(cut, behind(pad)), "attention_mask": F.concat(F.array_repeat(F.lit(1), known), behind(0)), "labels": F.concat(cut, behind(-100))}
