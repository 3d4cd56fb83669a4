"""Interaction audit of filters: what each removes, alone, behind others, and in every order.

A document fails a set of filters, a mask of few bits; everything the audit says
follows from the counts of masks. The filter of repeated texts needs all documents:
partition refinement splits them by their length in code points, then by hashes of
one block after another, and drops what is left alone after each split, so that a
round handles only what the one before could not tell apart. The full texts that
survive are compared, and all but the smallest id of equal ones fail.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored
from .jaccard_join import _bitmap, _flagged

BLOCKS = (256, 4_096)  # code points of the first blocks; the rest of a text is the last one
DUPLICATE = "E"

_SPACE = r"[\x20\x09-\x0D]+"


def row_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of a text and its words: too short, repetitive, capitals, signs."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def _keys(text: Column) -> dict[str, Column]:
    """The length of a text and a hash of each block."""
    out, at = {"n_chars": F.length(text)}, 1
    for k, size in enumerate((*BLOCKS, None), 1):
        out[f"block_{k}"] = F.xxhash64(F.substring(text, at, size if size else 2**31 - 1 - at))
        at += size or 0
    return out


class _Listed:
    """Rows whose key is among those of a stored table, and a few more: a bitmap of bounded size clears the others where they lie."""

    def __init__(self, table: DataFrame, keys: list[str]):
        self.keys = keys
        self.size, shared = _bitmap(table, F.xxhash64(*keys), table.count())

        @F.pandas_udf("boolean")
        def listed(at: pd.Series) -> pd.Series:
            return pd.Series(_flagged(shared.value, at.to_numpy()))

        self.listed = listed

    def column(self) -> Column:
        return self.listed(F.pmod(F.xxhash64(*self.keys), F.lit(self.size)))


def repeated(work: Scratch, facts: DataFrame, texts: DataFrame) -> tuple[DataFrame, _Listed, list[str]]:
    """(keys, least): the smallest id of each text that the refinement leaves, beside the keys it shares with its copies and with texts of equal hashes.

    A row of these keys that is not a smallest one stands behind an equal text; a
    text that is left alone is its own smallest. facts: a stored table with the
    keys. texts: (doc_id, text, keys). Copies are merged before each exchange, so
    that a large group of them is one row a task.
    """
    keys = [c for c in facts.columns if c == "n_chars" or c.startswith("block_")]
    alive, listed = facts, None
    for k in range(1, len(keys) + 1):
        classes = alive.groupBy(*keys[:k]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        listed = _Listed(work.store(classes, f"audit-classes-{k}"), keys[:k])
        alive = facts.where(listed.column())
    same = texts.where(listed.column()).groupBy(*keys, "text").agg(F.min("doc_id").alias("least"))
    return work.store(same.select(*keys, "least"), "audit-repeated"), listed, keys


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and by the filters they fail, A being 1 and E the highest bit.

    A null text is empty, a null language the empty part. A document without id is
    no smaller than any other and has none smaller: it never fails E and makes none
    fail. Rows that share id and text are equal, none of them smaller. A label without
    id marks nothing. Of several
    labels of one id any that is 1 counts. Extra columns are ignored.
    """
    work = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    keyed = rows.withColumns(_keys(F.col("text")))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    failed = row_filters(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed.values())), F.lit(0))
    facts = keyed.withColumn("words", words).withColumn("mask", mask).drop("words", "text")
    facts = work.store(facts, "audit-facts")
    same, listed, keys = repeated(work, facts, keyed.drop("part"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = facts.withColumn("_listed", listed.column()).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    alone = marked.where("not _listed").groupBy("part", "mask").agg(*sums)
    first = same.select(*keys, F.col("least").alias("doc_id"), F.lit(True).alias("_first")).distinct()
    # counted before they meet the groups they belong to: a group of any size is a few rows
    held = marked.where("_listed").join(first, [*keys, "doc_id"], "left").withColumn("free", F.col("_first").isNotNull() | F.col("doc_id").isNull())
    held = held.groupBy(*keys, "part", "mask", "free").agg(*sums).join(same.select(*keys, F.lit(True).alias("_same")).distinct(), keys, "left")
    bit = F.when(F.col("_same") & ~F.col("free"), 1 << len(failed)).otherwise(0)
    held = held.select("part", (F.col("mask") + bit).alias("mask"), "n", "good", "toxic")
    out = stored(alone.unionByName(held).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "audit-masks")
    work.clear()
    return out


def _steps(names: str) -> list[dict]:
    """filter_order, step, the filter's bit and the bits of those before it, of all orders."""
    bit = {c: 1 << k for k, c in enumerate(names)}
    return [{"filter_order": "".join(p), "step": k + 1, "bit": bit[c], "before": sum(bit[x] for x in p[:k])} for p in itertools.permutations(names) for k, c in enumerate(p)]


def interactions(masks: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of mask counts, zeros included.

    shapley: what the step's filter removes, summed over all orders: a document that
    fails m filters falls to each of them in the same number of orders.
    """
    orders = 1
    for k in range(2, len(names) + 1):
        orders *= k
    steps = F.from_json(F.lit(json.dumps(_steps(names))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")  # a literal
    wide = masks.withColumn("s", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, value="n": F.sum(F.when(cond, F.col(value)).otherwise(0)).cast("long")
    share = (F.col("n") * orders / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    return wide.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over whole documents, by language; an empty table has no parts and gives no rows."""
    return interactions(mask_counts(docs, labels))
