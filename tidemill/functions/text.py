"""Column helpers with the string semantics of the ingestion code's host language."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Cut white space of any kind, the four separator controls included, off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def strip_fence(c: Column) -> Column:
    """The body of a reply's first code fence without a leading `json`, or the reply itself; stripped."""
    body = F.regexp_replace(F.try_element_at(F.split(c, "```"), F.lit(2)), "^json", "")
    return strip(F.when(F.startswith(strip(c), F.lit("```")), body).otherwise(c))


def json_path(key: str) -> str:
    """The path of a top-level key, whatever characters it has; no path can name a key with both kinds of quotes."""
    if "'" in key and '"' in key:
        raise ValueError(f"no path names the key {key}")
    quote = '"' if "'" in key else "'"
    return f"$[{quote}{key}{quote}]"


def is_empty(raw: Column, key: str) -> Column:
    """Whether a key is missing or its value null, "", 0, false, [] or {}; texts such as "0" and "false" are not."""
    value = F.try_variant_get(F.try_parse_json(raw), json_path(key), "variant")
    kind = F.schema_of_variant(value)
    text, number = value.try_cast("string"), value.try_cast("double")
    return F.coalesce((kind == "VOID") | ((kind == "STRING") & (text == "")) | (kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number == 0)) | ((kind == "BOOLEAN") & (text == "false")) | F.to_json(value).isin("[]", "{}") & (kind != "STRING"), F.lit(True))


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has a key, also where its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


@F.pandas_udf(T.StringType())
def _shown(raw: pd.Series, key: pd.Series) -> pd.Series:
    """A key's value as the host language prints it; null for null rows."""
    return pd.Series([None if r is None else str(json.loads(r)[k]) for r, k in zip(raw, key)], dtype=object)


def as_text(raw: Column, key: str) -> Column:
    """A key's value as text: a missing key is empty, a null one is the word None, truth values are capitalised.

    Fractions, lists and objects are shown as the ingestion code's host language
    prints them; only rows that have such a value are handed to Python.
    """
    parsed = F.try_parse_json(raw)
    value = F.try_variant_get(parsed, json_path(key), "string")
    kind = F.schema_of_variant(F.try_variant_get(parsed, json_path(key), "variant"))
    other = kind.rlike("^(DOUBLE|FLOAT|DECIMAL|ARRAY|OBJECT)")
    shown = F.when(kind == "BOOLEAN", F.initcap(value)).when(other, _shown(F.when(other, raw), F.lit(key))).otherwise(value)
    return F.when(~has_key(raw, key), "").otherwise(F.coalesce(shown, F.lit("None")))


def ends_cleanly(c: Column) -> Column:
    return F.rlike(rstrip(c), F.lit('[.!?"]$'))


def model_billions(name: Column) -> Column:
    """Parameter count in billions that a model's name states, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+(?:\.\d+)?)\s*[bB](?:illion)?", 1), F.lit("")), F.lit("999999.999")).cast("double")
