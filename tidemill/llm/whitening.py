"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers. Of the distinct vectors a shift is subtracted, and sums
and cross-products are added up without rounding: matrix products in double
precision over so few rows that every partial sum is an integer below 2^53, then
whole numbers of any size. n * X'X - S S' is formed exactly and does not depend on
the shift; only then is it converted to floats and decomposed. Vectors of different
lengths are separate tables with a model each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

SCALE = 256
COMPONENTS = 4
EXACT = 1 << 53  # integers up to here are doubles
LIMB = 22  # bits of a limb of larger entries
ROWS = 4_096  # vectors that are multiplied at a time, at most


def _matrix(col: pa.ListArray, kind) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(col), -1)


def _by_length(col: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of rows) of a column of lists."""
    size = np.asarray(col.value_lengths())
    for d in np.unique(size):
        yield int(d), np.flatnonzero(size == d)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """X'X of integers (int64, or Python's own for larger ones) as Python integers, without rounding."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    if not x.size:
        return total
    top = max(abs(int(x.max())), abs(int(x.min())))
    if top * top <= EXACT:
        step = max(1, min(ROWS, EXACT // max(1, top * top)))
        for a in range(0, len(x), step):
            part = x[a : a + step].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total
    limbs, rest = [], x.astype(object)
    while any(rest.flat):
        low = rest % (1 << LIMB)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
        if not any(v not in (0, -1) for v in rest.flat):  # a last limb of signs
            limbs.append(rest.astype(np.float64))
            break
    step = EXACT >> (2 * LIMB)
    for i, p in enumerate(limbs):
        for j, q in enumerate(limbs):
            for a in range(0, len(x), step):
                total = total + (p[a : a + step].T @ q[a : a + step]).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def _shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift without overflow: in 64 bits where that is enough."""
    s = np.array(shift, object)
    far = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, shift)) if x.size else 0
    return x - s.astype(np.int64) if far < 1 << 62 else x.astype(object) - s


_PART = "d int, i int, n long, sum string, cross array<string>"
_PART_ARROW = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("sum", pa.string()), ("cross", pa.list_(pa.string()))])
_MODEL = "d int, n long, sums array<string>, trace double, values array<double>, vectors array<array<double>>"
_MODEL_ARROW = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("trace", pa.float64()), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.list_(pa.float64())))])


def _scatter(shifts: dict[int, list[int]]):
    """A task's share: for each length and dimension i the number of vectors, their sum and their products with dimensions up to i."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            col = b.column("x")
            for d, at in _by_length(col):
                for a in range(0, len(at), ROWS):
                    x = _shifted(_matrix(col.take(pa.array(at[a : a + ROWS])), np.int64), shifts[d])
                    n, s, m = held.get(d, (0, np.zeros(d, object), np.zeros((d, d), object)))
                    held[d] = (n + len(x), s + x.astype(object).sum(0), m + exact_gram(x))
        for d, (n, s, m) in held.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [n] * d, "sum": [str(v) for v in s], "cross": [[str(v) for v in m[i, : i + 1]] for i in range(d)]}, schema=_PART_ARROW)

    return run


def _added(part: pa.Table) -> pa.Table:
    """The tasks' shares of one dimension, added up."""
    rows = part.to_pylist()
    cross = [sum(map(int, v)) for v in zip(*[r["cross"] for r in rows])]
    return pa.Table.from_pydict({"d": [rows[0]["d"]], "i": [rows[0]["i"]], "n": [sum(r["n"] for r in rows)], "sum": [str(sum(int(r["sum"]) for r in rows))], "cross": [[str(v) for v in cross]]}, schema=_PART_ARROW)


def decompose(n: int, sums: list[int], cross: list[list[int]], k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Trace of the covariance, its k largest eigenvalues and their unit vectors (rows; of either sign, the largest entry positive)."""
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            v[i, j] = v[j, i] = float(n * cross[i][j] - sums[i] * sums[j]) / float(n * n)
    trace = float(sum(n * cross[i][i] - sums[i] ** 2 for i in range(d))) / float(n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order].T
    flip = np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(1)])
    return trace, np.where(values > d * np.finfo(float).eps * max(trace, 0), values, 0.0), vectors * flip[:, None]


def _fitted(shifts: dict[int, list[int]], k: int):
    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["i"])
        d, n = rows[0]["d"], rows[0]["n"]
        sums = [int(r["sum"]) for r in rows]
        trace, values, vectors = decompose(n, sums, [[int(v) for v in r["cross"]] for r in rows], k)
        whole = [s + n * c for s, c in zip(sums, shifts[d])]  # without the shift again
        return pa.Table.from_pydict({"d": [d], "n": [n], "sums": [[str(s) for s in whole]], "trace": [trace], "values": [values.tolist()], "vectors": [vectors.tolist()]}, schema=_MODEL_ARROW)

    return run


class Model:
    """Mean, components and eigenvalues of vectors of one length."""

    def __init__(self, row):
        self.n, self.sums, self.trace = row["n"], [int(s) for s in row["sums"]], row["trace"]
        self.values, self.vectors = np.array(row["values"]), np.array(row["vectors"]).reshape(len(row["values"]), -1)
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        far = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        s = np.array(self.sums, object)
        return self.n * x - s.astype(np.int64) if far < 1 << 62 else self.n * x.astype(object) - s

    def deviations(self, c: np.ndarray) -> list[int]:
        """Sums of squares of centred vectors, exactly."""
        top = max(abs(int(c.max())), abs(int(c.min())))
        if c.dtype != object and top * top * c.shape[1] < 1 << 63:
            return (c * c).sum(1).tolist()
        c = c.astype(object)
        return (c * c).sum(1).tolist()

    def project(self, c: np.ndarray) -> np.ndarray:
        """Whitened components of centred vectors; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (c.astype(np.float64) / self.n) @ self.vectors.T / np.sqrt(self.values), np.nan)


_SHARE = "d int, n long, mean array<double>, about array<double>"
_SHARE_ARROW = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("about", pa.list_(pa.float64()))])


def _moments(models: dict[int, Model]):
    """A task's share of the whitened fit vectors' covariance: their number, means, and products about these means."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            col = b.column("x")
            for d, at in _by_length(col):
                m = models[d]
                w = m.project(m.centred(_matrix(col.take(pa.array(at)), np.int64)))
                held[d] = merged(held.get(d), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        for d, (n, mean, about) in held.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "mean": [mean.tolist()], "about": [about.ravel().tolist()]}, schema=_SHARE_ARROW)

    return run


def merged(a: tuple | None, b: tuple) -> tuple:
    """Number, means and centred products of two shares together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_error(rows) -> float | None:
    share = None
    for r in rows:
        share = merged(share, (r["n"], np.array(r["mean"]), np.array(r["about"]).reshape(len(r["mean"]), -1)))
    off = np.abs(share[2] / share[0] - np.eye(len(share[1])))
    return None if np.isnan(off).all() else float(np.nanmax(off))


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_WHITENED_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, k: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Rows whose vector is null or has null or non-finite entries are dropped, all
    others stay, repeated ones and those without id too; an empty vector has no
    components and thus no rows. Entries c become floor(256 * c), at the bounds of 64
    bits beyond them. The fit list has each distinct vector of a length once. A
    component without variance (fewer distinct vectors than components, constant
    entries) has whitened null and counts in no identity_error, which is null if
    there is no other; explained is null where nothing varies. A deviation of more
    than 38 digits is null. Vectors shorter than k have as many components as entries.
    """
    spark = vectors.sparkSession
    work = Scratch(spark)
    entries = F.col(f"`{vec_col}`").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    bound = float(1 << 63)
    whole = lambda c: F.when(c * SCALE >= bound, F.lit((1 << 63) - 1)).when(c * SCALE < -bound, F.lit(-(1 << 63))).otherwise(F.floor(c * SCALE))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fine))
    rows = rows.select("vec_id", F.transform("c", whole).alias("x"))
    fit = work.store(rows.select("x").distinct(), "whitening-fit")
    # any vector will do as a shift, as the scatter does not depend on it
    shifts = {r["d"]: r["x"] for r in fit.groupBy(F.size("x").alias("d")).agg(F.first("x").alias("x")).collect()}
    shares = fit.mapInArrow(lean(_scatter(shifts)), _PART)
    fitted = shares.groupBy("d", "i").applyInArrow(_added, _PART).groupBy("d").applyInArrow(_fitted(shifts, k), _MODEL)
    models = {r["d"]: Model(r) for r in fitted.collect()}  # k components for each length that occurs
    moments = fit.mapInArrow(lean(_moments(models)), _SHARE).collect()  # k * k numbers for each task
    for d, m in models.items():
        m.identity_error = _identity_error([r for r in moments if r["d"] == d])
    work.clear()

    def run(batches):
        for b in batches:
            ids, col = b.column("vec_id"), b.column("x")
            for d, at in _by_length(col):
                m, at = models[d], pa.array(at)
                c = m.centred(_matrix(col.take(at), np.int64))
                w, size = m.project(c), len(m.values)
                explained = [None if m.trace <= 0 else e / m.trace for e in m.values.tolist()]
                limit = 10**38
                deviation = pa.array([None if v >= limit else v for v in m.deviations(c)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(at)), size))
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at).take(each), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(at))), pa.array(np.full(len(flat), m.n, np.int64)), deviation.take(each), pa.array(flat, mask=np.isnan(flat)), pa.array(explained * len(at), pa.float64()), pa.array([m.identity_error] * len(flat), pa.float64())],
                    schema=_WHITENED_ARROW,
                )

    return rows.mapInArrow(lean(run), WHITENED)
