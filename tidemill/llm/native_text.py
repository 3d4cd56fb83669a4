"""Word columns made of built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_words(df: DataFrame, text: str, name: str = "words") -> DataFrame:
    """Add the array of lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; null counts as empty.

    Only the ends of the split can be empty; they are cut off by a slice.
    """
    raw = df.withColumn(name, F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), _NOT_WORD))
    a = F.when(F.element_at(name, 1) == "", 1).otherwise(0)
    b = F.when((F.element_at(name, -1) == "") & (F.size(name) > 1), 1).otherwise(0)
    return raw.withColumn(name, F.slice(F.col(name), a + 1, F.size(name) - a - b))


def in_list(column: str, values: list) -> str:
    """SQL for membership in a set of numbers or plain words; a long list becomes a hash set."""
    if not values:
        return "false"
    shown = [str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return f"{column} IN ({', '.join(shown)})"
