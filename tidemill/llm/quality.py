"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of bytes: the n-grams are the ORDER last bytes of lower-cased
text, with NUL before a document's first byte, and each language has counts of
its own. (The corpus' words are productive compounds, so that word n-grams are
mostly unseen even in good text.)

Counts are gathered from all trusted documents, summed by key over shards, and
joined across orders: continuation counts from the next higher order, totals and
discount masses per context, probabilities with those of the shorter context. The
result, the interpolated probability of every seen n-gram and the weight of every
seen context, is written as sorted shards. A scoring task gathers its n-grams'
distinct keys and joins them with one shard after another, so that its memory is
bounded by a shard and its own buffer, however large the model.

Thresholds are quantiles, per language, over trusted documents that the model has
not seen.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .common import LOWER, U64, lean, new_path, stored, text_slices

ORDER = 5
SHARD = 1_000_000  # entries of a model shard, about
BUFFER = 8 << 20  # bytes of text that a scoring task joins at a time
BROADCAST_IDS = 1_000_000  # trusted ids up to which their table is broadcast (16 MB)
LANG_BITS = 20
CALIBRATION = 3  # one trusted document in so many is kept from the model, for the thresholds
BROADCAST_LANGS = 100_000  # languages up to which their thresholds are broadcast (4 MB)


def lang_code(lang: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(lang, F.lit(""))), F.lit(1 << LANG_BITS))


def gram_keys(buf: np.ndarray, off: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): a key of language and the ORDER last bytes for each byte."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    padded = np.zeros(len(buf) + (ORDER - 1) * n, np.uint8)
    at = np.arange(len(buf)) + (ORDER - 1) * doc  # where the key's first byte stands
    padded[at + ORDER - 1] = LOWER[buf]
    wide = padded.astype(U64)
    key = np.zeros(max(0, len(padded) - ORDER + 1), U64)
    for j in range(ORDER):
        key = key << U64(8) | wide[j : j + len(key)]
    return key[at] | code.astype(U64)[doc] << U64(8 * ORDER), doc


def _counts(batches):
    keys, counts, held = [], [], 0

    def merged():
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return k[at], np.add.reduceat(c, at)

    for b in batches:
        code = b.column(1).to_numpy(zero_copy_only=False)
        for i, j, buf, off in text_slices(b.column(0)):
            if len(buf):
                k, c = np.unique(gram_keys(buf, off, code[i:j])[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 1_500_000:
                    k, c = merged()
                    keys, counts, held = [k], [c], 0
                    if len(k) > 750_000:
                        yield _count_batch(k, c)
                        keys, counts = [], []
    if keys:
        yield _count_batch(*merged())


def _count_batch(k, c):
    return pa.RecordBatch.from_pydict({"key": k.view(np.int64), "c": c.astype(np.int64)}, schema=pa.schema([("key", pa.int64()), ("c", pa.int64())]))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the numbers of types with counts 1 to 4."""
    n1, n2, n3, n4 = n
    out = [0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(out)]


def train(trusted: DataFrame) -> DataFrame:
    """Model entries (key, value) from trusted (text, code).

    key: 4 bits of kind (1 to ORDER: probability of an n-gram of that order; 8 + k:
    weight that a context of k bytes leaves to shorter ones), language, bytes.
    """
    spark = trusted.sparkSession
    body = (1 << 8 * ORDER) - 1
    top = trusted.select("text", "code").mapInArrow(lean(_counts), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    top = stored(top.select(F.shiftright("key", 8 * ORDER).alias("code"), F.col("key").bitwiseAND(F.lit(body)).alias("g"), "c"), "ngram-counts")
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = stored(orders[k + 1].groupBy("code", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"ngram-types-{k}")
    entries, shorter = [], None
    for k in range(1, ORDER + 1):
        t = orders[k]
        seen = t.groupBy("code").agg(*[F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()  # a row per language
        rows = [(r["code"], *discounts([r[f"n{j}"] for j in (1, 2, 3, 4)])) for r in seen]
        d = F.broadcast(spark.createDataFrame(rows, "code long, d1 double, d2 double, d3 double"))
        context = t.groupBy("code", F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), *[F.count_if(cond).alias(f"m{j}") for j, cond in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
        context = context.join(d, "code").withColumn("left", (F.col("m1") * F.col("d1") + F.col("m2") * F.col("d2") + F.col("m3") * F.col("d3")) / F.col("total"))
        own = F.greatest(F.lit(0.0), F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        joined = t.withColumn("h", F.shiftright("g", 8)).join(context, ["code", "h"])
        if shorter is None:
            p = joined.select("code", "g", (own + F.col("left") / 256).alias("p"))
        else:
            low = shorter.select(F.col("code").alias("code2"), F.col("g").alias("s"), F.col("p").alias("below"))
            p = joined.join(low, (F.col("code") == F.col("code2")) & (F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("s"))).select("code", "g", (own + F.col("left") * F.col("below")).alias("p"))
        shorter = stored(p, f"ngram-p-{k}")

        def key(kind, g):
            return F.shiftleft(F.lit(kind).cast("long"), 60).bitwiseOR(F.shiftleft("code", 8 * ORDER)).bitwiseOR(g)

        entries.append(shorter.select(key(k, F.col("g")).alias("key"), F.col("p").alias("value")))
        entries.append(context.select(key(8 + k - 1, F.col("h")).alias("key"), F.col("left").alias("value")))
    out = entries[0]
    for e in entries[1:]:
        out = out.union(e)
    return out


def write_shards(entries: DataFrame) -> list[str]:
    """Files of the model, each sorted by key."""
    spark = entries.sparkSession
    entries = stored(entries, "model-entries")
    path = new_path(spark, "model")
    n = max(1, -(-entries.count() // SHARD))

    def run(batches):
        keys, values = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy().view(U64))
            values.append(b.column(1).to_numpy().astype(np.float32))
        if not keys or not sum(map(len, keys)):
            return
        k, v = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(k)
        k, v = k[order], v[order]
        name = f"{files.folder(path)}/shard-{int(k[0]):016x}-{len(k)}.bin"
        files.put(name, len(k).to_bytes(8, "little") + k.tobytes() + v.tobytes())
        yield pa.RecordBatch.from_pydict({"path": [name]}, schema=pa.schema([("path", pa.string())]))

    named = stored(entries.repartition(n, "key").mapInArrow(lean(run), "path string"), "model-shards")
    return sorted(r["path"] for r in named.collect())


@lru_cache(maxsize=6)
def _shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_input_file(p) as f:
        data = f.read()
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, U64, n, 8), np.frombuffer(data, np.float32, n, 8 + 8 * n)


def probabilities(keys: np.ndarray, shards: list[str]) -> np.ndarray:
    """Interpolated probability of each (distinct, sorted) key's last byte after the bytes before it."""
    lang = keys >> U64(8 * ORDER) << U64(8 * ORDER)
    wants = []
    for k in range(1, ORDER + 1):
        g = keys & U64((1 << 8 * k) - 1)
        wants.append(lang | g | U64(k << 60))
        wants.append(lang | g >> U64(8) | U64((8 + k - 1) << 60))
    ask, back = np.unique(np.concatenate(wants), return_inverse=True)
    got = np.full(len(ask), np.nan)
    for path in shards:
        k, v = _shard(path)
        i = np.searchsorted(k, ask)
        i[i == len(k)] = 0
        hit = k[i] == ask
        got[hit] = v[i[hit]]
    got = got[back].reshape(2 * ORDER, len(keys))
    p = np.full(len(keys), 1 / 256)
    for k in range(ORDER):
        seen, weight = got[2 * k], got[2 * k + 1]
        p = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * p, seen)
    return p


def surprise(docs: DataFrame, shards: list[str]) -> DataFrame:
    """(doc_id, lang, n_bytes, nats) of (doc_id, lang, code, text): bytes of the text and minus their log probability."""

    def run(batches):
        held, size = [], 0

        def flush():
            every = np.unique(np.concatenate([u for _, _, u, _, _ in held]))
            cost = -np.log(probabilities(every, shards)) if len(every) else np.empty(0)
            for ids, langs, u, back, off in held:
                c = np.append(0.0, np.cumsum(cost[np.searchsorted(every, u)][back]))
                yield pa.RecordBatch.from_arrays([ids, langs, pa.array(np.diff(off)), pa.array(c[off[1:]] - c[off[:-1]])], names=["doc_id", "lang", "n_bytes", "nats"])

        for b in batches:
            code = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, off in text_slices(b.column(3)):
                u, back = np.unique(gram_keys(buf, off, code[i:j])[0], return_inverse=True)
                held.append((b.column(0)[i:j], b.column(1)[i:j], u, back.astype(np.int32), off))
                size += len(buf)
                if size >= BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "lang", "code", "text").mapInArrow(lean(run), "doc_id long, lang string, n_bytes long, nats double")


def classify(docs: DataFrame, labels: DataFrame, *, trusted: str = "quality = 1", quantile: float = 0.999, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep), a row per input row.

    trusted: which labels mark trusted text. The threshold is the quantile of the
    perplexities, per byte, of its language's trusted documents that the model has not
    seen; a document stays if its perplexity is at most that. Null and empty texts
    have no perplexity and do not stay; where a language has no trusted text to set
    a threshold, all its other documents stay. A null language is one of its own;
    rows may repeat, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), lang_code(F.col(lang_col).cast("string")).alias("code"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(trusted).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(CALIBRATION)))
    few = good.count() <= BROADCAST_IDS  # checked; a longer list is joined by a shuffle
    seen = good.where("fold > 0")
    shards = write_shards(train(rows.join(F.broadcast(seen) if few else seen, F.col("doc_id") == F.col("id"), "left_semi")))
    scored = stored(surprise(rows, shards), "surprise").withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(F.col("nats") / F.col("n_bytes"))))
    held = scored.where("n_bytes > 0").join(good.where("fold = 0"), F.col("doc_id") == F.col("id"), "left_semi").withColumn("of", F.coalesce("lang", F.lit("")))
    cut = stored(held.groupBy("of").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"), F.count(F.lit(1)).alias("n")), "thresholds")
    scored = scored.withColumn("of", F.coalesce("lang", F.lit("")))
    small = cut.count() <= BROADCAST_LANGS  # checked; a language code column has few values, and one may hold most rows
    out = scored.join(F.broadcast(cut) if small else cut, "of", "left")
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", ((F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("keep"))
