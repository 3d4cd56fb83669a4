"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Everything is learnt from labelled rows: a lexicon of words and word beginnings
that occur in toxic documents far more often than in others, trees on the features
of other labelled rows, and the calibration on rows that the trees did not see.
A fit uses at most MAX_ROWS labelled documents, chosen by a hash of their id; the
features of those rows are what the driver holds. Scoring covers whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, Words, among, lean, mix64, text_slices

MAX_ROWS = 24_000  # labelled documents of a fit, at most
MAX_LEXICON = 4_000  # words or word beginnings of the lexicon, at most
MIN_DOCS, MIN_SHARE = 3, 100  # toxic documents that must hold a word for the lexicon: this many, and one in so many
CALIBRATION_FOLDS = 3
PREFIXES = (4, 5, 6)  # bytes of a word's beginning
NEAR = 6  # words between a second person and a lexicon word
#: Second-person words in the languages of the corpus; a fixed list.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os vuestro su".split()
FEATURES = ("hits", "stem_hits", "density", "stem_density", "weight", "near_second", "caps", "punct", "obfuscated", "mid_digits", "repeat", "log_words")

_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case or beyond ASCII, 3 digit, 4 sign
_CLASS[65:91] = 1
_CLASS[97:123] = _CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_PLAIN = np.arange(256, dtype=np.uint8)  # digits and signs that stand for letters
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _PLAIN[_a] = _b
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _word_hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    return Words(buf, off, _LETTERS, lower=True).hashes()


def _views(buf: np.ndarray, off: np.ndarray):
    """Letter words of the text, and hashes of the words and of their beginnings."""
    w = Words(buf, off, _LETTERS, lower=True)
    sums = w.prefix_sums()
    names = [w.hashes(sums)]
    size = w.ends - w.starts
    for k in PREFIXES:
        h = mix64(w.hashes(sums, np.minimum(w.starts + k, w.ends)) ^ U64(k))
        names.append(np.where(size > k, h, U64(0)))
    return w, names


def lexicon_counts(batches):
    """(name, toxic, other): labelled documents of a batch that hold a word or beginning. Columns: text, label."""
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, buf, off in text_slices(b.column(0)):
            w, names = _views(buf, off)
            doc = w.docs()
            keys = np.concatenate(names)
            owner = np.tile(doc, len(names))
            owner, keys = owner[keys != 0], keys[keys != 0]
            if not len(keys):
                continue
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
            keys, toxic = keys[new], label[i:j][owner[new]]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            pos = np.add.reduceat(toxic, at)
            total = np.diff(np.append(at, len(keys)))
            yield pa.RecordBatch.from_pydict({"name": keys[at].view(np.int64), "toxic": pos, "other": total - pos}, schema=pa.schema([("name", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())]))


@dataclass
class Model:
    lexicon: np.ndarray  # sorted names
    weights: np.ndarray  # their log odds
    trees: list = field(default_factory=list)
    base: float = 0.0
    rate: float = 0.2
    steps: tuple = ((), ())

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        w, names = _views(buf, off)
        doc = w.docs()
        words = np.maximum(w.counts, 1)

        def per_doc(values):
            return np.bincount(doc, weights=values, minlength=n)

        def looked_up(h):
            if not len(self.lexicon):
                return np.zeros(len(h))
            i = np.searchsorted(self.lexicon, h)
            i[i == len(self.lexicon)] = 0
            return np.where(self.lexicon[i] == h, self.weights[i], 0.0)

        word = looked_up(names[0])
        stem = np.maximum.reduce([looked_up(h) for h in names[1:]])
        hit, stem_hit = word > 0, stem > 0
        any_hit = hit | stem_hit
        second = among(names[0], _second_person())
        near = np.zeros(len(doc), bool)
        at = np.flatnonzero(second)
        if len(at) and any_hit.any():
            h = np.flatnonzero(any_hit)
            i = np.searchsorted(at, h)
            for k in (np.minimum(i, len(at) - 1), np.maximum(i - 1, 0)):
                near[h] |= (np.abs(at[k] - h) <= NEAR) & (doc[at[k]] == doc[h])
        raw = np.append(np.zeros(1, np.int64), np.cumsum(np.ones(len(buf), np.int64)))
        size = np.maximum(raw[off[1:]] - raw[off[:-1]], 1)
        kind = _CLASS[buf]

        def share(mask):
            c = np.append(0, np.cumsum(mask))
            return (c[off[1:]] - c[off[:-1]]) / size

        # words in disguise: letters with digits or signs among them that read as a lexicon word
        tokens = Words(buf, off, SPACE_WORDS)
        inner = np.append(0, np.cumsum((kind == 3) | (kind == 4)))
        letters = np.append(0, np.cumsum((kind == 1) | (kind == 2)))
        size_t = tokens.ends - tokens.starts
        mixed = np.zeros(len(size_t), bool)
        long = size_t > 2
        s, e = tokens.starts[long], tokens.ends[long]
        mixed[long] = (inner[e - 1] - inner[s + 1] > 0) & (letters[e] - letters[s] > 1) & (kind[s] != 4)
        plain = Words(_PLAIN[buf], off, SPACE_WORDS, lower=True)
        disguised = mixed & (looked_up(plain.hashes()) > 0)
        t_doc = tokens.docs()
        t_words = np.maximum(tokens.counts, 1)
        same = np.append(False, (names[0][1:] == names[0][:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, bool)
        hits, stems = per_doc(hit), per_doc(stem_hit)
        return np.stack(
            [
                hits,
                stems,
                hits / words,
                stems / words,
                per_doc(np.maximum(word, stem)),
                per_doc(near),
                share(kind == 1),
                share(kind == 4),
                np.bincount(t_doc, weights=disguised, minlength=n),
                np.bincount(t_doc, weights=mixed, minlength=n) / t_words,
                per_doc(same) / words,
                np.log1p(w.counts),
            ],
            axis=1,
        )

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree_values(tree, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if not len(self.steps[0]):
            return 1 / (1 + np.exp(-m))
        return np.clip(np.interp(m, *self.steps), 0.0, 1.0)


_SECOND = None


def _second_person() -> np.ndarray:
    global _SECOND
    if _SECOND is None:
        _SECOND = np.sort(_word_hash(SECOND_PERSON))
    return _SECOND


# ---------------------------------------------------------------- trees and calibration


def tree_values(tree: list, x: np.ndarray) -> np.ndarray:
    """Leaf values; a node is (feature, cut, left, right) or a number."""
    out = np.empty(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        node = tree[k]
        if isinstance(node, float):
            out[rows] = node
            continue
        f, cut, left, right = node
        go = x[rows, f] <= cut
        todo += [(left, rows[go]), (right, rows[~go])]
    return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> tuple[float, list]:
    """Histogram gradient boosting for the logistic loss: (base margin, trees)."""
    rate_y = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = math.log(rate_y / (1 - rate_y))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
    # rare features: quantiles alone would miss their positive values
    cuts = [np.unique(np.concatenate([c, [0.0], np.quantile(x[x[:, f] > 0, f], [0.1, 0.3, 0.5, 0.7, 0.9]) if (x[:, f] > 0).any() else []])) for f, c in enumerate(cuts)]
    codes = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree: list = [None]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            k, rows, level = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    code = codes[f][rows]
                    cg = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1]
                    ch = np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                    cn = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
                    gain = cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge)
                    gain[(cn < least) | (len(rows) - cn < least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j))
            if best[1] is None:
                tree[k] = float(sg / (sh + ridge))
                continue
            f, j = best[1]
            go = codes[f][rows] <= j
            tree += [None, None]
            tree[k] = (f, float(cuts[f][j]), len(tree) - 2, len(tree) - 1)
            todo += [(len(tree) - 2, rows[go], level + 1), (len(tree) - 1, rows[~go], level + 1)]
        margin += rate * tree_values(tree, x)
        trees.append(tree)
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[tuple, tuple]:
    """Pool adjacent violators: places and values of the calibration, for linear interpolation."""
    if not len(y):
        return (), ()
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, t in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([t, 1.0, m, m])
        if len(pools) > 1 and pools[-2][3] == m:  # equal margins are one place
            last = pools.pop()
            pools[-1][0] = (pools[-1][0] * pools[-1][1] + t) / (pools[-1][1] + 1)
            pools[-1][1] += 1
            del last
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, n, lo, hi = pools.pop()
            p = pools[-1]
            p[0] = (p[0] * p[1] + v * n) / (p[1] + n)
            p[1] += n
            p[3] = hi
    xs, ys = [], []
    for v, _, lo, hi in pools:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return tuple(xs), tuple(ys)


# ---------------------------------------------------------------- Spark


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", usable: Column | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled documents.

    usable: a condition on the labels' id column; other rows are never read as
    labels. Of the usable labelled rows at most max_rows are taken, those with the
    smallest hash of their id. Ids with several labels, and null labels, are left out.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    if usable is not None:
        chosen = labels.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", F.least("label", F.lit(1)).alias("label"), F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(10)).alias("fold"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    known = spark.createDataFrame(chosen.toPandas(), "id long, label int, fold long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # at most max_rows labels

    counts = rows.where("fold < 5").select("text", "label").mapInArrow(lean(lexicon_counts), "name long, toxic long, other long")
    counts = counts.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n = known.where("fold < 5").agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, other = max(1, n[0]), max(1, n[1] - n[0])
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("other") + 0.5) / other)
    top = counts.where(F.col("toxic") >= max(MIN_DOCS, toxic // MIN_SHARE)).withColumn("odds", odds).where("odds > 3").orderBy(F.desc(F.col("odds") * F.log(F.col("toxic"))), "name").limit(MAX_LEXICON).toPandas()
    names = top["name"].to_numpy(np.int64).view(U64)
    order = np.argsort(names)
    model = Model(names[order], top["odds"].to_numpy(float)[order])

    shape = ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def described(batches):
        for b in batches:
            for i, j, buf, off in text_slices(b.column(0)):
                x = model.features(buf, off)
                yield pa.RecordBatch.from_arrays([b.column(1)[i:j], b.column(2)[i:j], *[pa.array(x[:, k]) for k in range(x.shape[1])]], names=["label", "fold", *[f"f{k}" for k in range(x.shape[1])]])

    got = rows.where("fold >= 5").select("text", "label", F.col("fold").cast("long").alias("fold")).mapInArrow(lean(described), f"label int, fold long, {shape}").toPandas()
    if not len(got):
        return model
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    x, y = got[[f"f{k}" for k in range(len(FEATURES))]].to_numpy(float), got["label"].to_numpy(float)
    fold = np.arange(len(y)) % CALIBRATION_FOLDS  # rows are in order of their values, so folds are alike
    unseen = np.zeros(len(y))
    for k in range(CALIBRATION_FOLDS):
        base, trees = boost(x[fold != k], y[fold != k], rate=model.rate)
        unseen[fold == k] = Model(model.lexicon, model.weights, trees, base, model.rate).margin(x[fold == k])
    model.base, model.trees = boost(x, y, rate=model.rate)
    model.steps = isotonic(unseen, y)
    return model


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), a row per input row; null text counts as empty."""

    def run(batches):
        for b in batches:
            for i, j, buf, off in text_slices(b.column(1)):
                s = model.score(model.features(buf, off))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)[i:j], "score": s, "predicted": (s >= threshold).astype(np.int32)}, schema=pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            col = b.column(at).cast(pa.string())
            keep = np.zeros(b.num_rows, bool)
            for i, j, buf, off in text_slices(col):
                keep[i:j] = model.score(model.features(buf, off)) < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
