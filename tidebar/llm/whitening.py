"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the spectrum of the scatter of its vectors by centred rank-one updates (``spectra``); spectra are summed,
again by rank-one updates, over a tree of tasks; one pass over the vectors refines the result by Rayleigh-Ritz. Entries are
whole numbers, so sums and deviations are exact."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.spectra import Spectrum, add_spectrum, add_vector
from tidebar.llm.text import int_lists, list_column
from tidebar.sources.scratch import drop, materialize

COMPONENTS = 16
#: Partial results that one task or the driver adds up.
FAN = 16
#: Vectors of which one task keeps the spectrum; each of them costs about d ** 3 steps.
VECTORS = 4096
_PARTIAL = "n bigint, parts array<double>"


@dataclass(frozen=True)
class Whitener:
    """``n`` distinct vectors with exact ``sums``; ``components`` (columns) and ``values`` of their covariance, largest first; its ``trace``."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(id, x array<bigint>)`` with ``x = floor(scale * c) + shift``, without rows whose vector is null or holds an entry that is null or not finite."""
    rows = frame.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return fine.select("id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def _fold(partials: DataFrame, add: Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray] | None:
    """The sum of rows ``(n, parts)``: tasks add ``FAN`` rows each until so few are left that the driver adds the last."""
    def some(rows: pa.Table) -> pa.Table:
        n, parts = add(list(zip(rows.column("n").to_pylist(), (np.array(p) for p in rows.column("parts").to_pylist()))))
        return pa.table({"n": pa.array([n], pa.int64()), "parts": pa.array([parts], pa.list_(pa.float64()))})

    left = materialize(partials, "partials")
    while (count := left.count()) > FAN:
        # rows are dealt out evenly, in groups of about FAN
        groups = -(-count // FAN)
        more = materialize(left.withColumn("g", F.xxhash64("n", "parts") % groups).groupBy("g").applyInArrow(some, _PARTIAL), "partials")
        drop(left)
        left = more
    rows = [(r.n, np.array(r.parts)) for r in left.collect()]
    drop(left)
    return add(rows) if rows else None


def _plain_sum(rows):
    return sum(n for n, _ in rows), np.sum([p for _, p in rows], axis=0)


def _merge(d: int):
    def unpack(n, p):
        return Spectrum(n, p[:d], p[d:2 * d], p[2 * d:].reshape(d, d))

    def add(rows):
        total = Spectrum.empty(d)
        for n, p in rows:
            total = add_spectrum(total, unpack(n, p))
        return total.n, np.concatenate((total.mean, total.values, total.vectors.ravel()))
    return add


def _partials(per_task: Callable[[Iterator[np.ndarray]], tuple[int, np.ndarray] | None]):
    """One row ``(n, parts)`` per task from its matrices of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = (np.array(list(int_lists(b, "x"))) for b in batches if b.num_rows)
        got = per_task(matrices)
        if got:
            yield pa.record_batch([pa.array([got[0]], pa.int64()), pa.array([got[1]], pa.list_(pa.float64()))], ["n", "parts"])
    return run


def _spectrum(centre: np.ndarray):
    """Centred rank-one updates, one for each vector of the task."""
    def per_task(matrices):
        s = Spectrum.empty(len(centre))
        for m in matrices:
            for x in (m - centre).astype(float):
                s = add_vector(s, x)
        return (s.n, np.concatenate((s.mean, s.values, s.vectors.ravel()))) if s.n else None
    return per_task


def _projected(centre: np.ndarray, off: np.ndarray, basis: np.ndarray):
    """Covariance times n, in the basis, and the sums of the projections."""
    def per_task(matrices):
        n, total, sums = 0, np.zeros((basis.shape[1],) * 2), np.zeros(basis.shape[1])
        for m in matrices:
            y = ((m - centre) - off) @ basis
            total += y.T @ y
            sums += y.sum(0)
            n += len(m)
        return (n, np.concatenate((total.ravel(), sums))) if n else None
    return per_task


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries."""
    got = fit.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    return (max(r.n for r in got), [int(r.s) for r in sorted(got)]) if got else (0, [])


def _centre(sums, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left of it, so that differences from it lose no digits."""
    whole = [round(s / n) if abs(s) < 1 << 52 else s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def fit_whitener(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """The whitener of the distinct vectors of ``vectors (id, x)``, and the table of these.

    All vectors have one length, others are refused. Directions without variance (below 1e-12 of the largest) are no components:
    one vector, equal vectors, vectors without entries and an empty table have none. Equal vectors meet in a combined aggregate. What goes to the
    driver is ``FAN`` spectra of d * d numbers."""
    fit = materialize(vectors.select("x").distinct(), "fit")
    lengths = fit.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if lengths.a != lengths.b:
        raise ValueError("vectors of different lengths")
    none = Whitener(lengths.n, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    if not lengths.n or not lengths.a:
        return none, fit
    n, sums = _sums(fit)
    centre, off = _centre(sums, n)
    d = len(sums)
    _, parts = _fold(fit.repartition(-(-n // VECTORS)).mapInArrow(_partials(_spectrum(centre)), _PARTIAL), _merge(d))
    # largest first; sums of many updates leave the axes a little off a right angle
    basis = np.linalg.qr(parts[2 * d:].reshape(d, d)[:, ::-1])[0]
    _, parts = _fold(fit.mapInArrow(_partials(_projected(centre, off, basis)), _PARTIAL), _plain_sum)
    ritz, turn = np.linalg.eigh(parts[: d * d].reshape(d, d) / n)
    values, vectors_ = ritz[::-1], (basis @ turn)[:, ::-1]
    keep = min(components, int((values > 1e-12 * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
    return Whitener(n, tuple(sums), vectors_[:, :keep], values[:keep], float(ritz.sum())), fit


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""
    if not len(w.values):
        return 0.0
    k = len(w.values)
    n, parts = _fold(fit.mapInArrow(_partials(_projected(*_centre(w.sums, w.n), w.components / np.sqrt(w.values))), _PARTIAL), _plain_sum)
    mean = parts[k * k:] / n
    return float(np.abs(parts[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum of (n * x - S)^2 per row, exact."""
    top = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums)))
    if top < 1 << 62:
        off = x * n - np.array(sums, np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (off * off).sum(1).tolist()
    wide = x.astype(object) * n - np.array(sums, object)
    return (wide * wide).sum(1).tolist()


def whiten(vectors: DataFrame, w: Whitener) -> DataFrame:
    """``(id, deviation, whitened array<double>)`` of every row of ``vectors (id, x)``. A deviation beyond 64 bits is refused."""
    centre, off = _centre(w.sums, w.n) if len(w.values) else (np.zeros(0, np.int64), np.zeros(0))
    turn = w.components / np.sqrt(w.values) if len(w.values) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if turn is None or not batch.num_rows:
                continue
            x = np.array(list(int_lists(batch, "x")))
            y = ((x - centre) - off) @ turn
            yield pa.record_batch([batch.column("id"), pa.array(_deviations(x, w.n, w.sums), pa.int64()), list_column(list(y), pa.float64())], ["id", "deviation", "whitened"])
    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def whiten_embeddings(frame: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each row of ``frame`` with a whole vector and each component, numbered from 1
    by falling eigenvalue. Repeated rows come out repeated, ids are only handed on, other columns are ignored."""
    vectors = materialize(whole_vectors(frame, id_col, vector_col), "vectors")
    w, fit = fit_whitener(vectors, components)
    error = identity_error(fit, w)
    drop(fit)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.values]).cast("array<double>")
    out = whiten(vectors, w).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
