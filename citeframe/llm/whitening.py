"""Embedding whitening by incremental eigendecomposition.

A spectrum is a number of vectors, their mean, and the eigenvalues and eigenvectors of
their scatter matrix (the sum of outer products of centred vectors). Every partition keeps
one and takes in one vector after the other: with d the distance from the mean, the
scatter grows by n / (n + 1) * d d', a change of rank one. The new eigenvalues are the
roots of the secular equation

    1 + rho * sum over i of z_i^2 / (l_i - x) = 0,    z = d in the old eigenvectors

after deflation: directions in which z is nothing, and all but one direction of equal
eigenvalues (rotated so that one carries their part of z), keep what they have. Two spectra
become one the same way: the eigenpairs of the smaller are taken in one by one, then the
step between the two means. Spectra are combined in rounds of a fixed fan-in.

The result depends in its last digits on the partitions, so it is refined: the exact mean
is known, one pass over the vectors projects the covariance on the basis found
(Rayleigh-Ritz), and the eigenvectors of that small matrix turn the basis; this is repeated
until the projected matrix is diagonal to double precision. What moves is one spectrum or
one such matrix per partition, of a size that depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

FAN_IN = 8
MOST_PASSES = 4
_EPS = np.finfo(float).eps
_SPECTRUM = "part int, n long, mean array<double>, values array<double>, vectors array<double>"
_SUMS = "n long, sums array<double>"
_LONG = 1 << 63


# Rank-one updates.


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(weights / (poles - x)) for ascending, distinct poles and
    positive weights and rho: one above each pole. Returns, per root, the pole from which
    it was solved and its offset from it, which keeps the digits of close ones."""
    size = len(poles)
    above = np.append(poles[1:], poles[-1] + rho * weights.sum())
    gap = above - poles
    # The sign in the middle of an interval tells which of its ends is closer.
    middle = 1 + rho * (weights / (poles - (poles + gap / 2)[:, None])).sum(axis=1)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, np.arange(size), np.minimum(np.arange(size) + 1, size - 1))
    shifted = poles - poles[origin][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.append(gap[:-1] / 2, gap[-1:]), 0.0)
    x = (low + high) / 2
    own = weights[origin]
    for _ in range(80):
        distance = shifted - x[:, None]
        terms = weights / distance
        value = 1 + rho * terms.sum(axis=1)
        settled = np.abs(value) <= 16 * _EPS * (1 + rho * np.abs(terms).sum(axis=1))
        if settled.all():
            break
        rising = value > 0  # the function rises from one pole to the next
        high = np.where(rising, x, high)
        low = np.where(rising, low, x)
        # The pole at the origin is kept exactly and the rest taken as a line.
        rest = value + rho * own / x
        slope = rho * (terms / distance).sum(axis=1) - rho * own / x**2
        a, b, c = slope, rest - slope * x, -rho * own
        root = np.sqrt(np.maximum(b * b - 4 * a * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            big = -0.5 * (b + np.where(b >= 0, root, -root))
            first, second = np.where(a != 0, big / a, np.nan), c / big
            inside = lambda t: (t >= low) & (t <= high) & (t != 0)
            step = np.where(inside(first), first, np.where(inside(second), second, (low + high) / 2))
        x = np.where(settled, x, step)
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of V diag(values) V' + rho * change change', values ascending, rho >= 0."""
    z = vectors.T @ change
    length = float(np.sqrt(z @ z))
    if rho <= 0 or length == 0:
        return values, vectors
    scale = max(abs(values[0]), abs(values[-1]), rho * length**2)
    live = np.abs(z) * np.sqrt(rho) > 8 * _EPS * np.sqrt(scale)
    # Neighbours with (nearly) the same eigenvalue are rotated until one holds all of z.
    at = np.flatnonzero(live)
    close = at[1:][np.diff(values[at]) <= 8 * _EPS * scale] if len(at) > 1 else []
    if len(close):
        vectors = vectors.copy()
        order = {int(b): int(a) for a, b in zip(at[:-1], at[1:])}
        for b in close:
            a = order[int(b)]
            r = np.hypot(z[a], z[b])
            cos, sin = z[b] / r, z[a] / r
            vectors[:, [a, b]] = vectors[:, [a, b]] @ np.array([[cos, sin], [-sin, cos]])
            z[a], z[b], live[a] = 0.0, r, False
    at = np.flatnonzero(live)
    if not len(at):
        return values, vectors
    poles, part = values[at], z[at]
    origin, offset = secular_roots(poles, part**2, rho)
    distance = (poles - poles[origin][:, None]) - offset[:, None]  # pole - root, per root
    # The z that has exactly these roots: it makes the new vectors orthogonal.
    ratio = -distance.T  # pole i, root j: root_j - pole_i
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    fitted = np.sqrt(np.abs(np.prod(ratio / np.where(np.eye(len(at), dtype=bool), 1.0, gaps), axis=1) / rho))
    made = np.copysign(fitted, part) / distance
    made /= np.sqrt((made**2).sum(axis=1, keepdims=True))
    values, vectors = values.copy(), vectors.copy()
    vectors[:, at] = vectors[:, at] @ made.T
    values[at] = poles[origin] + offset
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray) -> None:
        step = vector - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, step, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + step / self.n

    def merge(self, other: Spectrum) -> None:
        if other.n > self.n:
            self.n, other.n = other.n, self.n
            self.mean, other.mean = other.mean, self.mean
            self.values, other.values = other.values, self.values
            self.vectors, other.vectors = other.vectors, self.vectors
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(float(value), 0.0))
        step, total = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, step, self.n * other.n / total)
        self.mean = self.mean + step * (other.n / total)
        self.n = total

    def row(self, part: int) -> pa.RecordBatch:
        lists = [pa.array([list(x)], pa.list_(pa.float64())) for x in (self.mean, self.values, self.vectors.ravel())]
        names = ["part", "n", "mean", "values", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([self.n]), *lists], names=names)

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        size = len(row["mean"])
        return cls(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(size, size))


# Spark.


def _matrix(batch: pa.RecordBatch, size: int, kind=np.float64) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(kind, copy=False).reshape(batch.num_rows, size)


def _spectra(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(size)
        for batch in batches:
            for vector in _matrix(batch, size):
                found.add(vector)
        if found.n:
            yield found.row(TaskContext.get().partitionId())

    return work


def _merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda row: row["part"])
    found = Spectrum.of(rows[0])
    for row in rows[1:]:
        found.merge(Spectrum.of(row))
    return pa.Table.from_batches([found.row(rows[0]["part"] // FAN_IN)])


def incremental_spectrum(vectors: DataFrame, size: int) -> Spectrum:
    """One spectrum of all rows of `x`: one per partition, then combined by FAN_IN."""
    spectra = cut_lineage(vectors.mapInArrow(_spectra(size), _SPECTRUM))
    parts = spectra.agg(F.max("part")).first()[0]
    if parts is None:
        return Spectrum.empty(size)
    while parts > 0:
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        spectra = cut_lineage(spectra.groupBy(group).applyInArrow(_merge_group, _SPECTRUM))
        parts //= FAN_IN
    return Spectrum.of(spectra.first().asDict())


def _summed(rows: DataFrame, of) -> tuple[int, np.ndarray]:
    """Sum over all rows of `of(matrix of a batch)`, one partial sum per partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + of(batch)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([list(np.ravel(total))], pa.list_(pa.float64()))})

    told = rows.mapInArrow(work, _SUMS)
    places = told.select("n", F.posexplode("sums").alias("place", "value"))
    # As long as the matrix, whatever the number of partitions.
    found = places.groupBy("place").agg(F.sum("n"), F.sum("value")).orderBy("place").collect()
    return (int(found[0][1]), np.array([row[2] for row in found])) if found else (0, np.zeros(0))


def projected_covariance(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """basis' * covariance * basis, divisor n; centred before multiplying."""
    size, width = basis.shape

    def of(batch: pa.RecordBatch) -> np.ndarray:
        told = (_matrix(batch, size) - mean) @ basis
        return told.T @ told

    n, sums = _summed(rows, of)
    return sums.reshape(width, width) / n


@dataclass(frozen=True)
class Whitener:
    """`n` and `sums` over the distinct vectors; `values` and `vectors` (columns) by
    falling eigenvalue; `trace` of the covariance; `error` as `fit` measures it."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); NaN for a component without variance."""
        known = self.values > 1e-12 * self.trace
        return np.where(known, 1 / np.sqrt(np.where(known, self.values, 1.0)), np.nan)


def as_integers(vector: Column) -> Column:
    """floor(256 * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    """Vectors without null, NaN or infinite entries, and not null themselves."""
    fine = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return vector.isNotNull() & F.forall(vector, fine)


def fit(x: DataFrame, components: int = 4) -> Whitener:
    """Fits on the rows of `x` (array<long>, all of one length), each distinct vector once."""
    ship_package(x.sparkSession)
    first = x.first()
    size = len(first[0]) if first else 0
    if not size:
        return Whitener(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    rows = cut_lineage(x.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    columns = rows.select(F.posexplode("x").alias("place", "value"))
    told = columns.groupBy("place").agg(F.count(F.lit(1)), F.sum(F.col("value").cast("decimal(20,0)"))).orderBy("place").collect()
    n, sums = int(told[0][1]), tuple(int(row[2]) for row in told)
    mean = np.array([float(s) / n for s in sums])
    basis = incremental_spectrum(rows, size).vectors[:, ::-1]
    for _ in range(MOST_PASSES):
        small = projected_covariance(rows, mean, basis)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        rest = np.abs(small - np.diag(np.diag(small))).max() if size > 1 else 0.0
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        if rest <= 64 * _EPS * max(values[-1], 0.0):
            break
    values = np.maximum(values[::-1], 0.0)
    basis = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    kept = min(components, size)
    found = Whitener(n, sums, values[:kept], basis[:, :kept], float(values.sum()))
    return Whitener(n, sums, found.values, found.vectors, found.trace, _identity_error(rows, found))


def _project(model: Whitener, rows: np.ndarray) -> np.ndarray:
    return ((rows - model.mean) @ model.vectors) * model.scales


def _identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """Largest entry of the covariance of the whitened vectors less the identity, over the
    components that have variance."""
    known = ~np.isnan(model.scales)
    if not known.any():
        return None
    size = len(model.sums)
    _, total = _summed(rows, lambda batch: _project(model, _matrix(batch, size))[:, known].sum(axis=0))
    middle = total / model.n

    def of(batch: pa.RecordBatch) -> np.ndarray:
        told = _project(model, _matrix(batch, size))[:, known] - middle
        return told.T @ told

    _, sums = _summed(rows, of)
    return float(np.abs(sums.reshape(known.sum(), -1) / model.n - np.eye(known.sum())).max())


def exact_deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 per row; null where it exceeds a long."""
    most = max(int(np.abs(rows).max(initial=0)), -int(rows.min(initial=0))) * n + max(map(abs, sums))
    if most * most * len(sums) < _LONG:
        return (((rows * n) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
    return [d if d < _LONG else None for d in exact]


def _whiten(model: Whitener):
    size, width = model.vectors.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = _matrix(batch, size, np.int64)
            told = _project(model, exact.astype(float)).ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(told) + 1, width), pa.int32()), pa.array(told, pa.float64(), from_pandas=True)
            )
            deviations = pa.array(exact_deviations(exact, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviations, lists], names=["id", "deviation", "whitened"])

    return work


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector: id, n, deviation, whitened, explained, identity_error.

    `whitened` and `explained` are arrays over the components, by falling eigenvalue; n is
    the number of distinct vectors, identity_error one value for all rows. Vectors that are
    null or hold a null, NaN or infinite entry are dropped, and so are those that do not
    have the most frequent length (of equals, the greatest) or have length 0. Entries beyond
    a long saturate; a deviation beyond a long is null. A component without variance (fewer
    distinct vectors than components) has a null `whitened` and counts for no error;
    `explained` is null where no component has variance. Equal eigenvalues leave their
    vectors free within their plane. Null and repeated ids stay. An empty table gives no
    rows. Time is quadratic in the dimension per row of a pass, cubic per row of the
    incremental pass.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), as_integers(F.col(vector_col)).alias("x"))
    lengths = rows.filter(F.size("x") > 0).groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = rows.schema["id"].dataType.simpleString()
    if lengths is None:
        return spark.createDataFrame([], f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    rows = rows.filter(F.size("x") == lengths[0])
    model = fit(rows.select("x"), components)
    told = rows.mapInArrow(_whiten(model), f"id {kind}, deviation long, whitened array<double>")
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    return told.select(
        "id",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*(F.lit(s).cast("double") for s in share)).alias("explained"),
        F.lit(model.error).cast("double").alias("identity_error"),
    )
