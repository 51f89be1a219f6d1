"""Embedding whitening by incremental eigendecomposition.

The fit list, each distinct quantised vector once, is read in four passes:

1. exact sums of every dimension;
2. each task folds its vectors, one by one, into a spectrum (count, mean, eigenvalues and
   eigenvectors of the scatter about that mean): a vector is one centred rank-one update,
   which solves the secular equation of a diagonal matrix plus a rank-one one, with
   deflation. Spectra of tasks are combined in a tree, each eigenpair of the one being a
   rank-one update of the other, and one more for the distance of the means;
3. Rayleigh-Ritz: the covariance times the basis that was found is computed over all rows;
   the small matrix that this gives in the basis is diagonalised. Where residuals are left,
   those of the whole basis are added to it, which doubles it, and the pass is repeated: at
   the latest when the basis is complete, after ``log2(length / RANK)`` turns, it is exact;
4. the covariance of the whitened fit list, for the identity error.

Vectors of one length are one fit. Only sums and bases (length squared at most) meet the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, table

SCALE = 256
COMPONENTS = 4
#: Most eigenpairs of a spectrum.
RANK = 32
#: Spectra, or sums, that one task combines.
FAN_IN = 32
#: Lengths of vectors are taken in blocks whose bases hold so many numbers.
BLOCK_NUMBERS = 8 << 20
#: A Ritz vector is done when its residual is that small beside the greatest eigenvalue.
RESIDUAL = 1e-13
EPS = np.finfo(float).eps
STATE = "dim int, slot long, state binary"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (d - root))`` for rising ``d``, one behind each ``d``.

    Gives the roots and ``d[i] - root[j]``, which is computed from the pole next to the root
    so that it keeps its leading digits. All roots are iterated at once: the terms on either
    side are each replaced by one pole that meets their value and slope, within a bracket.
    """
    k, w = len(d), rho * z * z
    gap = np.append(d[1:] - d[:-1], w.sum())
    mid = d + gap / 2
    terms = w[:, None] / (d[:, None] - mid[None, :])
    right = 1 + terms.sum(0) < 0  # the root is in the upper half of its interval
    right[-1] = False
    pole = np.arange(k) + right
    apart = d[:, None] - d[pole][None, :]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    x = (low + high) / 2
    at = np.arange(k)
    below = (at[:, None] <= at[None, :]).astype(float)
    left, far = np.empty(k), np.ones(k)
    with np.errstate(all="ignore"):
        for _ in range(60):
            g = apart - x
            t = w[:, None] / g
            slope = t / g
            total, lower = t.sum(0), np.einsum("ij,ij->j", t, below)
            f = 1 + total
            low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
            s_low = np.einsum("ij,ij->j", slope, below)
            s_high = slope.sum(0) - s_low
            left, far[:-1] = g[at, at], g[at[1:], at[:-1]]
            p_low, p_high = left * s_low, far * s_high
            c = f - p_low - p_high
            a, b = c * (left + far) + left * p_low + far * p_high, left * far * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = left[-1] + left[-1] * p_low[-1] / (f[-1] - p_low[-1])
            y = x + step
            y = np.where((y > low) & (y < high), y, (low + high) / 2)
            done = (np.abs(f) <= 4 * k * EPS * (1 + total - 2 * lower)) | (np.abs(step) <= 4 * EPS * np.abs(x))
            if done.all():
                break
            x = np.where(done, x, y)
    return d[pole] + x, apart - x


def rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``diag(d) + rho * z z'``, rho > 0.

    Deflation: an entry of ``z`` that is nothing beside the others leaves its pair as it is;
    of two equal entries of ``d`` one is turned so that its entry of ``z`` vanishes.
    """
    n, order = len(d), np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    length = np.sqrt(z @ z)
    vectors = np.eye(n)
    if length > 0:
        z /= length
        rho *= length * length
        tol = 8 * EPS * max(np.abs(d).max(), rho)
        moved = rho * np.abs(z) > tol
        live = np.flatnonzero(moved)
        if len(live) > 1:
            # turn the earlier one of two close entries into a deflated one
            near = d[live[1:]] - d[live[:-1]]
            pull = np.abs(z[live[1:]] * z[live[:-1]]) / (z[live[1:]] ** 2 + z[live[:-1]] ** 2)
            if (near * pull <= tol).any():
                at = live[0]
                for j in live[1:]:
                    r = np.hypot(z[at], z[j])
                    c, s = z[j] / r, z[at] / r
                    if abs((d[j] - d[at]) * c * s) <= tol:
                        z[at], z[j] = 0.0, r
                        d[at], d[j] = d[at] * c * c + d[j] * s * s, d[at] * s * s + d[j] * c * c
                        va, vj = vectors[:, at].copy(), vectors[:, j].copy()
                        vectors[:, at], vectors[:, j] = c * va - s * vj, s * va + c * vj
                        moved[at] = False
                    at = j
                live = np.flatnonzero(moved)
                live = live[np.argsort(d[live], kind="stable")]
        if len(live) == 1:
            d[live[0]] += rho * z[live[0]] ** 2
        elif len(live) > 1:
            roots, g = secular_roots(d[live], z[live], rho)
            # the z whose exact roots these are: makes the vectors orthogonal (Gu and Eisenstat)
            k, dl = len(live), d[live]
            row, col = np.arange(k)[:, None], np.arange(k)[None, :]
            nearby = np.where(col < row, dl[None, :], np.append(dl[1:], 0.0)[None, :]) - dl[:, None]
            nearby[:, -1] = 1.0
            exact = np.sqrt(np.abs((-g / nearby).prod(1))) * np.sign(z[live])
            turn = exact[:, None] / g
            turn /= np.sqrt((turn * turn).sum(0))
            d[live] = roots
            vectors[:, live] = vectors[:, live] @ turn
    out = np.empty((n, n))
    out[order] = vectors
    rising = np.argsort(d, kind="stable")
    return d[rising], out[:, rising]


@dataclass
class Spectrum:
    """Count, mean and up to ``rank`` eigenpairs of the scatter of vectors about their mean."""

    dim: int
    rank: int = RANK
    n: int = 0
    mean: np.ndarray = field(default=None)  # type: ignore[assignment]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.mean is None:
            self.mean, self.basis = np.zeros(self.dim), np.zeros((self.dim, 0))

    def update(self, v: np.ndarray, rho: float) -> None:
        """Adds ``rho * v v'`` to the scatter; the least pair goes where there are more than ``rank``."""
        if rho <= 0:
            return
        z = self.basis.T @ v
        if self.basis.shape[1] < self.dim:
            rest = v - self.basis @ z
            again = self.basis.T @ rest
            rest -= self.basis @ again
            z += again
            left = np.sqrt(rest @ rest)
            if left > 1e-12 * np.sqrt(v @ v):
                self.basis = np.column_stack([self.basis, rest / left])
                self.values, z = np.append(self.values, 0.0), np.append(z, left)
        if not len(z):
            return
        self.values, turn = rank_one(self.values, z, rho)
        self.basis = self.basis @ turn
        if len(self.values) > self.rank:
            self.values, self.basis = self.values[1:], self.basis[:, 1:]

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self.update(away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        apart, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.basis.T):
            self.update(vector, float(value))
        self.update(apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, dim, x)`` of the rows whose vector and all of its entries are there and finite."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & F.forall("c", finite))
    return rows.select("vec_id", F.size("c").alias("dim"), F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(0).cast("long")).alias("x"))


def _blocks_of_rows(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length in every batch, with their vectors as a matrix of longs."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            part = batch.take(at) if len(at) < len(dims) else batch
            step = max(1, min(rows, (4 << 20) // max(1, int(dim))))
            for a in range(0, part.num_rows, step):
                piece = part.slice(a, step)
                yield int(dim), piece, piece.column("x").flatten().to_numpy().reshape(piece.num_rows, int(dim))


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of each column as Python integers, which do not overflow."""
    fits = not len(x) or max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(x) < 1 << 62
    return (x if fits else x.astype(object)).sum(0).astype(object)


def fold(fit: DataFrame, start: Callable, step: Callable, combine: Callable) -> dict[int, object]:
    """``combine`` of what ``step`` makes of the rows of each length, in tasks and then in a tree.

    ``start(dim)`` is a state; ``step(state, x)`` takes a matrix of rows into it and returns
    it; ``combine(a, b)`` joins two. States are of the size of a basis, and one for each
    length reaches the driver.
    """

    def run(batches):
        slot, states = TaskContext.get().partitionId(), {}

        def out():
            dims = list(states)
            return pa.record_batch([pa.array(dims, pa.int32()), pa.array([slot] * len(dims), pa.int64()), pa.array([pickle.dumps(states[d]) for d in dims], pa.binary())], names=["dim", "slot", "state"])

        for dim, _, x in _blocks_of_rows(batches):
            states[dim] = step(states[dim] if dim in states else start(dim), x)
            if len(states) >= 64:  # a task holds the states of few lengths
                yield out()
                states.clear()
        yield out()

    def join(key, rows):
        whole = None
        for chunk in rows.column("state").chunks:
            for state in chunk:
                state = pickle.loads(state.as_py())
                whole = state if whole is None else combine(whole, state)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[1].as_py()], pa.int64()), "state": pa.array([pickle.dumps(whole)], pa.binary())})

    partial = materialise(fit.mapInArrow(run, STATE), "partial-states")
    top = partial.agg(F.max("slot")).first()[0] or 0
    while True:
        partial = partial.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("dim", "slot").applyInArrow(join, STATE)
        top //= FAN_IN
        if top == 0:
            return {r["dim"]: pickle.loads(r["state"]) for r in partial.collect()}


@dataclass(frozen=True)
class Whitening:
    """The components of one length of vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of ``(n x - S)^2``, exact; none where a long cannot hold them."""
        far = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0)), 0) + max([abs(s) for s in self.sums], default=0)
        if far * far * max(1, x.shape[1]) < 1 << 62:
            away = self.n * x - self.sums.astype(np.int64)
            return (away * away).sum(1).tolist()
        away = self.n * x.astype(object) - self.sums
        return [v if v < 1 << 63 else None for v in (away * away).sum(1)]


def _spectra(fit: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """An orthonormal basis for each length, of the leading eigenvectors of its scatter."""

    def step(s: Spectrum, x: np.ndarray) -> Spectrum:
        for row in x.astype(float):
            s.add(row)
        return s

    def combine(a: Spectrum, b: Spectrum) -> Spectrum:
        a, b = (a, b) if a.n >= b.n else (b, a)
        a.merge(b)
        return a

    spectra = fold(fit, Spectrum, step, combine)
    return {dim: np.linalg.qr(s.basis[:, ::-1])[0] for dim, s in spectra.items()}


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The components of each length in ``fit`` (``dim``, distinct ``x``); lengths of zero have none."""
    plus = lambda a, b: tuple(p + q for p, q in zip(a, b))
    sums = fold(fit, lambda dim: (0, np.zeros(dim, dtype=object)), lambda s, x: (s[0] + len(x), s[1] + exact_sum(x)), plus)
    means = {dim: np.array([s / n for s in total], dtype=float) for dim, (n, total) in sums.items()}
    bases, out = _spectra(fit, sums), {}
    while bases:
        part = fit.filter(F.col("dim").isin(*bases))

        def product(s, x, bases=bases):
            y = x - means[x.shape[1]]
            return s[0] + y.T @ (y @ bases[x.shape[1]]), s[1] + float((y * y).sum())

        images = fold(part, lambda dim, bases=bases: (np.zeros((dim, bases[dim].shape[1])), 0.0), product, plus)
        wider = {}
        for dim, (image, squares) in images.items():
            basis, n = bases[dim], sums[dim][0]
            image = image / n
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            top = min(components, len(values))
            found = basis @ turn[:, :top]
            rest = image @ turn - (basis @ turn) * values
            length = np.sqrt((rest * rest).sum(0))
            if basis.shape[1] < dim and (length[:top] > RESIDUAL * values[:1].max(initial=0.0)).any():
                new = rest[:, length > 0] / length[length > 0]
                new -= basis @ (basis.T @ new)
                wider[dim] = np.linalg.qr(np.column_stack([basis, new])[:, :dim])[0]
                continue
            there = values[:top] > dim * EPS * values[:1].max(initial=0.0)
            out[dim] = Whitening(*sums[dim], values[:top][there], found[:, there], squares / n)
        bases = wider
    kept = {dim: w for dim, w in out.items() if len(w.values)}

    def square(s, x):
        p = kept[x.shape[1]].project(x)
        return s[0] + p.T @ p, s[1] + p.sum(0)

    size = lambda dim: len(kept[dim].values)
    seen = fold(fit.filter(F.col("dim").isin(*kept)), lambda dim: (np.zeros((size(dim), size(dim))), np.zeros(size(dim))), square, plus) if kept else {}
    return {
        dim: Whitening(w.n, w.sums, w.values, w.vectors, w.trace, float(np.abs(seen[dim][0] / w.n - np.outer(seen[dim][1], seen[dim][1]) / w.n**2 - np.eye(size(dim))).max()))
        for dim, w in kept.items()
    }


def _apply(models: dict[int, Whitening]):
    def run(batches):
        for dim, rows, x in _blocks_of_rows(batches):
            w = models[dim]
            k, m = len(w.values), rows.num_rows
            yield pa.record_batch(
                [
                    rows.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array([v for v in w.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(w.project(x).ravel()),
                    pa.array(np.tile(w.values / w.trace, m)),
                    pa.array(np.full(m * k, w.error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every row.

    Entries are quantised to ``floor(256 * entry)``. Rows whose vector is null or holds null
    or non-finite entries take no part; null ids and repeated rows stay as they are, and a
    repeated vector counts once in the fit. Vectors of one length are one fit, with figures
    of its own. A component without variance (all vectors equal, or of zero entries) has no
    direction and gives no rows; so does an empty table. A deviation beyond a long is null.
    Other columns are not read, so no name can clash.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col).filter("dim > 0")
    fit = materialise(rows.select("dim", "x").distinct(), "fit-list")
    lengths = [r[0] for r in fit.select("dim").distinct().orderBy("dim").collect()]
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    while lengths:
        block = [lengths.pop(0)]
        while lengths and sum(d * d for d in [*block, lengths[0]]) <= BLOCK_NUMBERS:
            block.append(lengths.pop(0))
        models = fit_whitening(fit.filter(F.col("dim").isin(*block)), components)
        if models:
            part = rows.filter(F.col("dim").isin(*models)).mapInArrow(_apply(models), schema)
            out = part if out.isLocal() else out.unionByName(part)
    return out


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
