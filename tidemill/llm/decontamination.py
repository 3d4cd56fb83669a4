"""Benchmark decontamination with built-in functions only.

A window is a number of consecutive words of a benchmark item. The 64-bit hashes
of all windows are a hash set that travels with the plan; a scan of the training
words looks each position up, first by its first two words, then by the whole
window. Hits are verified word for word against the windows in a broadcast join.
The set's size is checked: a larger benchmark is scanned in blocks of BLOCK
windows, each small enough to broadcast, so that nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .native_text import in_list, with_words

BLOCK = 20_000  # windows that one scan looks for


def windows(benchmark: DataFrame, size: int = 13, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, n, pair, hash, items): distinct windows of items with words; an item of fewer words is one window."""
    items = with_words(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")), "text").where("size(words) > 0")
    n = F.least(F.size("words"), F.lit(size))
    grams = items.withColumn("n", n).select("item", "n", F.explode(F.expr("transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))")).alias("w"))
    grams = grams.groupBy("w", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.select(F.array_join("w", " ").alias("gram"), "n", F.expr("xxhash64(w[0], if(n > 1, w[1], w[0]))").alias("pair"), F.xxhash64("w").alias("hash"), "items")


def _hits(rows: list, grams: bool = True) -> str:
    """SQL for the array of hits (i, n, gram) of the words of a row; rows: windows with n, pair, hash and, to verify in place, gram."""
    found = []
    for n in sorted({r["n"] for r in rows}):
        mine = [r for r in rows if r["n"] == n]
        pair = in_list("xxhash64(words[i - 1], words[i])" if n > 1 else "xxhash64(words[i - 1], words[i - 1])", sorted({r["pair"] for r in mine}))
        whole = in_list(f"xxhash64(slice(words, i, {n}))", sorted({r["hash"] for r in mine}))
        same = "" if grams else " AND " + in_list(f"array_join(slice(words, i, {n}), ' ')", sorted(r["gram"] for r in mine))
        gram = f", array_join(slice(words, i, {n}), ' ') AS gram" if grams else ""
        found.append(f"transform(filter(if(size(words) >= {n}, sequence(1, size(words) - {n} + 1), array()), i -> {pair} AND {whole}{same}), i -> struct(i AS i, {n} AS n{gram}))")
    return f"concat({', '.join(found)})" if found else f"cast(array() AS array<struct<i int, n int{', gram string' if grams else ''}>>)"


COVERED = "aggregate(hits, struct(0L AS n, 0 AS upto), (s, h) -> struct(s.n + greatest(0, h.i - 1 + h.n - greatest(s.upto, h.i - 1)) AS n, greatest(s.upto, h.i - 1 + h.n) AS upto)).n"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns as they are, that mark() does not call contaminated.

    A benchmark of up to block windows is verified in the scan itself and no row is
    moved; for a larger one the rows are numbered in a stored table and marked block
    by block, and the numbers that it names go. Either way a row is judged by its own
    hits, whatever its id.
    """
    grams = stored(windows(benchmark, size, item_col=item_col, text_col=item_text), "benchmark-windows")
    if grams.count() > block:
        rows = numbered(docs, "benchmark-documents")
        texts = rows.select("number", F.col("row").getField(text_col).alias("text"))
        gone = mark(texts, benchmark, size=size, share=share, id_col="number", item_col=item_col, item_text=item_text, block=block).where("contaminated").select("number")
        return rows.join(gone, "number", "left_anti").select("row.*")
    rows = grams.select("n", "pair", "hash", "gram").orderBy("gram", "n").collect()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    # the row number keeps the filter above the arrays: pushed below them, it would split the text anew for every word
    seen = with_words(held, "text").select("row", F.size("words").alias("n_words"), F.array_sort(F.expr(_hits(rows, grams=False))).alias("hits"), F.monotonically_increasing_id().alias("number"))
    seen = seen.select("row", "n_words", F.expr(COVERED).alias("n_hit"), "number")
    return seen.where((F.col("number") >= 0) & ~((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))).select("row.*")


def mark(docs: DataFrame, benchmark: DataFrame, *, size: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per input row: id, kept columns, n_words, n_hit, n_items, items, spans, contaminated.

    n_hit counts words inside any occurrence of a benchmark window, spans gives
    them as word ranges [from, to), items the ids (as sorted strings) whose windows
    occur. A document is contaminated if share * n_hit >= n_words and something was
    hit. Null and empty texts have no words; null item ids count as no item's id but
    their words are hit; rows and ids may repeat.
    """
    keep = keep or []
    grams = stored(windows(benchmark, size, item_col=item_col, text_col=item_text), "benchmark-windows")
    known = grams.select("n", "pair", "hash").orderBy("hash", "n").collect() if grams.count() <= block else None
    number = F.monotonically_increasing_id()
    if known is None:  # every block's scan must see the same numbers, also of an input that is computed anew each time
        rows = numbered(docs, "benchmark-documents")
        docs, number = rows.select(F.col("number").alias("_row_number"), "row.*"), F.col("_row_number")
    base = docs.select(number.alias("row"), F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    if known is not None:
        blocks = [(grams, known)]
    else:
        parts = -(-grams.count() // block)
        cut = [stored(grams.where(F.pmod(F.xxhash64("gram", "n"), F.lit(parts * 2)) == k), "benchmark-block") for k in range(parts * 2)]
        blocks = [(g, g.select("n", "pair", "hash").orderBy("hash", "n").collect()) for g in cut]
    words = with_words(base, "text").drop("text")
    hits = None
    for at, (part, rows) in enumerate(blocks):
        seen = F.expr(_hits(rows))
        kept = [c for c in words.columns if c != "words"] if at == 0 else ["row"]
        scanned = words.select(*kept, F.size("words").cast("long").alias("n_words"), seen.alias("hits")).select(*kept, "n_words", F.explode_outer("hits").alias("hit"))
        if at:
            scanned = scanned.where("hit is not null")
        scanned = scanned.select(*kept, "n_words", F.col("hit.i").alias("i"), F.col("hit.n").alias("n"), F.col("hit.gram").alias("gram"))
        joined = scanned.join(F.broadcast(part.select("gram", "n", "items")), ["gram", "n"], "left")  # at most block windows
        joined = joined.select(*kept, "n_words", F.when(F.col("items").isNotNull(), F.struct("i", "n", "items")).alias("hit"))
        hits = joined if hits is None else hits.unionByName(joined, allowMissingColumns=True)
    carried = [c for c in words.columns if c not in ("words", "row")]
    per_doc = hits.groupBy("row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in carried], F.max("n_words").alias("n_words"), F.array_sort(F.collect_list("hit")).alias("hits"))
    spans = F.expr(
        "aggregate(hits, cast(array() AS array<struct<a int, b int>>), (s, h) -> if(size(s) > 0 AND element_at(s, -1).b >= h.i - 1,"
        " concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).a AS a, greatest(element_at(s, -1).b, h.i - 1 + h.n) AS b))),"
        " concat(s, array(struct(h.i - 1 AS a, h.i - 1 + h.n AS b)))))"
    )
    covered = F.expr(COVERED)
    items = F.array_sort(F.array_distinct(F.flatten(F.col("hits.items"))))
    out = per_doc.select(*carried, "n_words", covered.cast("long").alias("n_hit"), items.alias("items"), spans.alias("spans"))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )
