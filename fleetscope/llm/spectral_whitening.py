"""Embedding whitening by incremental eigendecomposition.

Every task keeps the spectrum of what it has read: row count, mean, an orthonormal basis and
the scatter's eigenvalues. A vector adds the rank-one term ``n / (n + 1) (x - mean)(x - mean)^T``;
the new eigenvalues are the roots of the secular equation ``1 + rho sum z_i^2 / (d_i - t) = 0``,
one between each two old ones, found all at once by rational interpolation inside brackets.
Terms without weight and eigenvalues that coincide are deflated first: their vectors stay, or
are rotated so that one of them does. The vectors of the others come from the weights for which
the computed roots are exact, so that the basis stays orthonormal.

Two spectra are combined by as many rank-one updates as the second has eigenvalues, and one for
the difference of the means. Spectra are merged eight at a time until one is left; that one
(``dim`` x ``dim`` numbers) reaches the driver.

Its basis only has to be near: a last pass over the rows sums their centred projections' products
(Rayleigh-Ritz), whose small eigenproblem turns the basis into the eigenvectors to double
precision, as the basis spans the whole space. A second pass with these vectors measures what the
whitened columns' covariance really is.

Rows are fixed-point: x = floor(1024 * entry) + 100000, with exact sums; the deviation of a row
from the sums is exact, too, beyond 64 bits.

Edge cases: null vectors and those with null or non-finite entries are dropped; so are vectors
of another length than the most frequent one (the longer on ties) and those with entries of
2^40 or more, which no fixed-point covariance can hold; null ids are kept, repeated rows count as
often as they occur; a component whose variance is below 1e-12 of the whole has ``whitened`` null
and is left out of ``identity_error``; a table whose rows are all equal has no trace, ``explained``
is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import store

SCALE, SHIFT, LARGEST = 1024.0, 100_000, float(1 << 40)
EPS = np.finfo(float).eps
ROWS = "id long, component int, deviation decimal(38,0), whitened double"
SPECTRUM = "part long, n long, mean array<double>, basis array<double>, values array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z2_i / (d_i - t)``, ``d`` ascending and distinct, ``z2`` positive.

    Returned as (index of the nearest pole, offset from it), one root above each pole; the
    last one is at most ``sum z2`` above.
    """
    k = len(d)
    width = np.append(np.diff(d), z2.sum())
    gap = d[:, None] - d  # gap[i, j] = d_i - d_j
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (z2[:, None] / (gap - width / 2)).sum(0)
    near = np.arange(k) + ((middle < 0) & (np.arange(k) < k - 1))  # the origin is the closer pole
    right = near > np.arange(k)
    delta = d[:, None] - d[near]
    lo, hi = np.where(right, -width / 2, 0.0), np.where(right, 0.0, np.where(middle < 0, width, width / 2))
    lo = np.where(~right & (middle < 0), width / 2, lo)
    left_pole = np.where(right, -width, 0.0)
    right_pole = left_pole + width
    below = np.arange(k)[:, None] <= np.arange(k)
    t = (lo + hi) / 2
    for _ in range(60):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            away = delta - t
            terms = z2[:, None] / away
            f = 1 + terms.sum(0)
            # beyond this no digit of f is known
            done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(terms).sum(0))
            if done.all():
                break
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            slopes = terms / away
            psi = np.where(below, slopes, 0).sum(0)
            phi = slopes.sum(0) - psi
            # the equation with one pole on either side that has f's value and slopes at t
            a_pole, b_pole = left_pole - t, right_pole - t
            c = f - a_pole * psi - b_pole * phi
            a = (a_pole + b_pole) * f - a_pole * b_pole * (psi + phi)
            b = a_pole * b_pole * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = t + step
            t = np.where(done, t, np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2))
    return near, t


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending values, basis columns) of ``basis diag(values) basis^T + rho v v^T``, rho >= 0."""
    z = basis.T @ v
    norm2 = float(z @ z)
    if rho * norm2 <= 0:
        return values, basis
    tol = 8 * EPS * max(values[-1], rho * norm2)
    live = np.abs(z) * np.sqrt(norm2) * rho > tol
    index = np.flatnonzero(live)
    # pairs of live values too close to tell apart: turn their vectors so that one has no weight
    if len(index) > 1 and (np.diff(values[index]) <= 2 * tol).any():
        values, basis, z = values.copy(), basis.copy(), z.copy()
        kept = index[0]
        for j in index[1:]:
            r = np.hypot(z[kept], z[j])
            c, s = z[j] / r, z[kept] / r
            if abs((values[j] - values[kept]) * c * s) <= tol:
                z[j], z[kept] = r, 0.0
                basis[:, [kept, j]] = basis[:, [kept, j]] @ np.array([[c, s], [-s, c]])
                mixed = values[kept] * s * s + values[j] * c * c
                values[kept], values[j] = values[kept] * c * c + values[j] * s * s, mixed
                live[kept] = False
            kept = j
        index = np.flatnonzero(live)
        index = index[np.argsort(values[index], kind="stable")]
    if not len(index):
        return values, basis
    d = values[index]
    near, t = secular_roots(d, rho * z[index] ** 2)
    poles = d[:, None] - d[near] - t  # d_i - root_j, with full relative precision
    # the weights for which the computed roots are the exact ones
    ratio = d[:, None] - d
    np.fill_diagonal(ratio, 1.0)
    weight = np.sqrt(np.abs(np.prod(poles / ratio.T, axis=1)))
    q = np.copysign(weight, z[index])[:, None] / poles
    q /= np.sqrt((q * q).sum(0))
    values, basis = values.copy(), basis.copy()
    values[index] = d[near] + t
    basis[:, index] = basis[:, index] @ q
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Row count, mean, scatter eigenvalues and basis of a set of vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.basis = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away = other.mean - self.mean
        if self.n:
            for value, v in zip(other.values, other.basis.T):
                if value > 0:
                    self.values, self.basis = rank_one(self.values, self.basis, v, float(value))
            self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / (self.n + other.n))
        else:
            self.values, self.basis = other.values, other.basis
        self.mean = self.mean + away * (other.n / (self.n + other.n))
        self.n += other.n

    def row(self) -> tuple:
        return self.n, self.mean.tolist(), self.basis.ravel().tolist(), self.values.tolist()

    @classmethod
    def of(cls, n: int, mean, basis, values) -> Spectrum:
        s = cls(len(mean))
        s.n, s.mean, s.values = int(n), np.asarray(mean, float), np.asarray(values, float)
        s.basis = np.asarray(basis, float).reshape(len(s.mean), -1)
        return s


def fixed_point(vector: Column) -> Column:
    """Longs of a vector, or null where it is null or an entry is null, not finite or too large."""
    x = F.transform(vector.cast("array<double>"), lambda c: F.when(F.abs(c) < LARGEST, (F.floor(c * SCALE) + SHIFT).cast("long")))
    return F.when(F.forall(x, lambda e: e.isNotNull()), x)


def _block(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spectra(rows: DataFrame, dim: int, per_task: int) -> DataFrame:
    """One row per task: the spectrum of its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        s = Spectrum(dim)
        for b in batches:
            for x in _block(b.column(0)).astype(float) if b.num_rows else ():
                s.add(x)
        if s.n:
            columns = [[TaskContext.get().partitionId()], *[[c] for c in s.row()]]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "n", "mean", "basis", "values"])
    tasks = max(1, -(-rows.count() // per_task))
    return store(rows.select("x").repartition(tasks).mapInArrow(run, SPECTRUM), "spectra")


def combined(parts: DataFrame, at_once: int = 8) -> Spectrum | None:
    """The spectrum of all rows, merged ``at_once`` at a time."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = Spectrum(len(group["mean"].iloc[0]))
        for r in group.itertuples():
            total.merge(Spectrum.of(r.n, r.mean, r.basis, r.values))
        return pd.DataFrame([(group["part"].iloc[0] // at_once, *total.row())], columns=["part", "n", "mean", "basis", "values"])

    while parts.count() > 1:
        parts = store(parts.groupBy(F.expr(f"part div {at_once}").alias("g")).applyInPandas(merge, SPECTRUM), "spectra")
    row = parts.first()
    return Spectrum.of(row.n, row["mean"], row.basis, row["values"]) if row else None


class Centre:
    """``n * x - sums`` of blocks of rows, exact: in 64-bit integers where they hold it, else in Python's."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.kind = n, np.int64 if 2 * n * max(1, largest) < 2 ** 62 else object
        self.sums = np.array(sums, self.kind)

    def exact(self, block: np.ndarray) -> np.ndarray:
        return block.astype(self.kind) * self.n - self.sums

    def __call__(self, block: np.ndarray) -> np.ndarray:
        return (self.exact(block) / self.n).astype(float)

    def deviations(self, block: np.ndarray) -> list[int]:
        away = self.exact(block)
        top = max(abs(int(away.max())), abs(int(away.min())))
        return ((away if top * top * away.shape[1] < 2 ** 62 else away.astype(object)) ** 2).sum(1).tolist()


def projected_products(rows: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred rows in the coordinates of ``basis``; the tasks' sums are added up by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            y = centre(_block(b.column(0))) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])
    got = rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(basis.shape[1] ** 2)
    out[got.column("at").to_numpy()] = got.column("value").to_numpy()
    out = out.reshape(basis.shape[1], -1) / centre.n
    return (out + out.T) / 2


class Whitening:
    """Fit over all usable rows of ``embeddings``: n, sums, components, variances, trace, identity_error."""

    def __init__(self, embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, per_task: int = 2048):
        rows = embeddings.select(F.col(id_col).cast("long").alias("id"), fixed_point(F.col(vector_col)).alias("x")).where("x IS NOT NULL AND size(x) > 0")
        rows = store(rows, "vectors")
        length = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        self.n, self.dim = (length.n, length.dim) if length else (0, 0)
        self.rows = rows.where(F.size("x") == self.dim)
        if not self.n:
            return
        entries = self.rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
            F.sum(F.col("v").cast("decimal(20,0)")).alias("total"), F.max(F.abs("v")).alias("largest")).orderBy("at").collect()
        self.centre = Centre(self.n, [int(r.total) for r in entries], max(r.largest for r in entries))
        spectrum = combined(spectra(self.rows, self.dim, per_task))
        basis = np.linalg.qr(spectrum.basis)[0]
        whole = projected_products(self.rows, self.centre, basis)
        variances, turn = np.linalg.eigh(whole)
        order = np.argsort(-variances, kind="stable")[:components]
        self.trace = float(np.trace(whole))
        self.components, self.variances = basis @ turn[:, order], np.maximum(variances[order], 0)
        usable = self.variances > 1e-12 * self.trace
        self.scales = np.where(usable, np.sqrt(np.where(usable, self.variances, 1)), np.nan)
        self.identity_error = None
        if usable.any():
            measured = projected_products(self.rows, self.centre, self.components[:, usable] / self.scales[usable])
            self.identity_error = float(np.abs(measured - np.eye(len(measured))).max())

    def transform(self) -> DataFrame:
        """One row per usable row and component: ``ROWS``."""
        if not self.n:
            return self.rows.sparkSession.createDataFrame([], ROWS)
        centre, components, scales = self.centre, self.components, self.scales
        k = components.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                block = _block(b.column(1))
                flat = (centre(block) @ components / scales).ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(np.arange(len(block)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                    pa.array([d for d in centre.deviations(block) for _ in range(k)], pa.decimal128(38, 0)), pa.array(flat, mask=np.isnan(flat))],
                    ["id", "component", "deviation", "whitened"])
        return self.rows.select("id", "x").mapInArrow(run, ROWS)

    def explained(self) -> list[float | None]:
        """Each component's share of the trace."""
        return [float(e) / self.trace if self.trace > 0 else None for e in self.variances] if self.n else []
