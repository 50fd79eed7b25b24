"""Whitening of embeddings by a randomised range finder over all rows.

Vectors become integers ``floor(1024 * c) + 100000``, whose sums are exact.  A pass
multiplies their covariance with an orthonormal basis without ever forming the
centred table: each partition adds up ``(x - mean)^T ((x - mean) Q)``.

1. A first pass gives the number of rows and the exact sums, hence the mean.
2. The basis starts with ``COMPONENTS + OVERSAMPLING`` random directions; each pass
   over all centred rows is a power step, followed by Rayleigh-Ritz in the basis.
3. Residuals ``|V u - e u|`` are held against the distance of ``e`` to the other
   eigenvalues, since their quotient bounds the error of ``u``.  If they don't get there
   in ``PASSES`` passes (or don't fall fast enough to), the basis is expanded to the
   full dimension, where Rayleigh-Ritz is the exact decomposition.
4. A pass over the whitened rows measures how far their covariance is from the identity.

Scale: a pass reads the table and shuffles a matrix of dimension times basis for each
partition, row by row of the matrix, in two levels.  The driver holds such a matrix:
it grows with the dimension, not with the rows.  Sums are taken in a fixed order of the
partitions.

Defined results: vectors that are null or hold null or non-finite entries are left out;
so are empty vectors, which have no component.  Vectors of another length are a fit list
of their own.  Repeated rows and ids are rows of their own.  Directions without variance
(a millionth of a millionth of the trace, as with one row or a dimension that is constant)
have a null ``whitened`` and don't count in ``identity_error``; ``explained`` is 0 if there is no
variance at all.  Entries beyond the range of a long become its bounds; a ``deviation``
beyond it is null.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
OVERSAMPLING = 8
PASSES = 6
#: Residual over eigenvalue gap that counts as double precision.
EXACT = 1e-12
FLAT = 1e-12
FAN = 64
LONG = 1 << 63


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * v)
    inside = np.abs(x) < 2.0**62
    if inside.all():
        return x.astype(np.int64) + SHIFT
    return np.array([[max(-LONG, min(LONG - 1, int(c) + SHIFT)) if np.isfinite(c) else (LONG - 1 if c > 0 else -LONG) for c in row] for row in x], object)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if x.dtype == object or len(x) * int(np.abs(x).max(initial=0)) >= LONG:
        return [int(s) for s in x.astype(object).sum(0)]
    return [int(s) for s in x.sum(0)]


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """``x - sums / n`` in double precision: whole parts are taken off as integers first."""
    whole = np.array([s // n for s in sums], object)
    part = np.array([(s - int(w) * n) / n for s, w in zip(sums, whole, strict=True)])
    big = x.dtype == object or max(abs(int(w)) for w in whole) > 1 << 61
    rest = (x.astype(object) - whole).astype(np.float64) if big else (x - whole.astype(np.int64)).astype(np.float64)
    return rest - part


def _gather(made: DataFrame) -> list[tuple[int, list[float]]]:
    """Rows ``i`` of the partitions' matrices (part, i, v), added up in two levels, each in the order of the partitions."""

    def add(key, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        v = table.column("v").combine_chunks()
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "i": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([v.flatten().to_numpy().reshape(len(v), -1)[order].sum(0)], pa.list_(pa.float64()))})

    for over in (FAN, None):
        part = F.expr(f"part div {over}") if over else F.lit(0).cast("long")
        made = C.by_group(made.select(part.alias("group"), "part", "i", "v"), ["i", "group"], add, "part long, i long, v array<double>")
    return sorted((r["i"], r["v"]) for r in made.select("i", "v").collect())  # a row for each dimension


def _rows(part: int, m: np.ndarray, first: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(m), pa.int64()), pa.array(range(first, first + len(m)), pa.int64()), pa.array(list(m), pa.list_(pa.float64()))], ["part", "i", "v"]
    )


class Fit:
    """Components of one table of equally long vectors: ``vectors`` (components x dimension), ``values``, ``explained``."""

    def __init__(self, rows: DataFrame, dim: int, count: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 29) -> None:
        self.rows, self.dim, self.passes_made, self.widths = rows, dim, 0, []
        self.n, self.sums = self._totals()
        self.count = min(count, dim)
        rng = np.random.default_rng(seed)
        width = min(dim, count + oversampling)
        basis = np.eye(dim) if width == dim else np.linalg.qr(rng.standard_normal((dim, width)))[0]
        e, u, trace, good = self._powers(basis, passes)
        if not good:
            e, u, trace, good = self._powers(np.eye(dim), 1)
        self.values, self.vectors = e[: self.count], u[:, : self.count].T
        self.explained = self.values / trace if trace > 0 else np.zeros(self.count)
        self.flat = self.values <= FLAT * trace
        self.scales = np.where(self.flat, np.nan, 1 / np.sqrt(np.where(self.flat, 1, self.values)))
        self.identity_error = self._identity_error()

    def _totals(self) -> tuple[int, list[int]]:
        dim = self.dim

        def add(batches):
            n, sums = 0, [0] * dim
            for batch in batches:
                if batch.num_rows:
                    n += batch.num_rows
                    sums = [a + b for a, b in zip(sums, _exact_sum(_integers(batch, dim)), strict=True)]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

        parts = self.rows.mapInArrow(add, "n long, sums array<string>")
        # exact sums as decimals, whatever their size in sums of longs
        total = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        return int(total[0]["n"]), [int(r["s"]) for r in sorted(total, key=lambda r: r["i"])]

    def _product(self, basis: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times ``basis``, and the covariance's trace, in one pass over all rows."""
        dim, n, sums = self.dim, self.n, self.sums

        def add(batches):
            out = np.zeros((dim, basis.shape[1] + 1))
            for batch in batches:
                if batch.num_rows:
                    z = _centred(_integers(batch, dim), sums, n)
                    out[:, :-1] += z.T @ (z @ basis)
                    out[:, -1] += (z * z).sum(0)
            yield _rows(TaskContext.get().partitionId(), out)

        self.passes_made += 1
        m = np.array([v for _, v in _gather(self.rows.mapInArrow(add, "part long, i long, v array<double>"))]) / n
        return m[:, :-1], float(m[:, -1].sum())

    def _powers(self, basis: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray, float, bool]:
        self.widths.append(basis.shape[1])
        full, last = basis.shape[1] == self.dim, np.inf
        for left in range(passes - 1, -1, -1):
            product, trace = self._product(basis)
            ritz = basis.T @ product
            e, s = np.linalg.eigh((ritz + ritz.T) / 2)
            e, s = np.maximum(e[::-1], 0), s[:, ::-1]
            u = basis @ s
            if full:
                return e, u, trace, True
            k = self.count
            residual = np.linalg.norm(product @ s[:, :k] - u[:, :k] * e[:k], axis=0)
            gap = np.array([np.abs(np.delete(e, j) - e[j]).min() for j in range(k)])
            worst = float(np.max(residual / np.maximum(gap, 1e-300)))
            if trace <= 0 or worst <= EXACT:
                return e, u, trace, True
            basis = np.linalg.qr(product)[0]
            if np.isfinite(last) and worst * (worst / last) ** left > EXACT:
                break  # at this rate the passes that are left don't suffice
            last = worst
        return e, u, trace, False

    def project(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.sums, self.n) @ self.vectors.T) * self.scales

    def _identity_error(self) -> float:
        live = np.flatnonzero(~self.flat)
        if not len(live):
            return 0.0
        dim, project = self.dim, self._projector()

        def add(batches):
            # number, sums and products about this partition's own mean
            n, mean, about = 0, np.zeros(len(live)), np.zeros((len(live), len(live)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                w = project(_integers(batch, dim))[:, live]
                m, d = len(w), w.mean(0) - mean
                c = w - w.mean(0)
                about += c.T @ c + np.outer(d, d) * (n * m / (n + m))
                mean, n = mean + d * (m / (n + m)), n + m
            if n:
                yield _rows(TaskContext.get().partitionId(), np.concatenate(([n], mean, about.ravel()))[None, :])

        # partitions' triples are merged pairwise, in their order
        def merge(key, table: pa.Table) -> pa.Table:
            k, total = len(live), None
            v = table.column("v").combine_chunks()
            for x in v.flatten().to_numpy().reshape(len(v), -1)[np.argsort(table.column("part").to_numpy())]:
                one = (x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k))
                if total is None:
                    total = one
                    continue
                n, d = total[0] + one[0], one[1] - total[1]
                total = (n, total[1] + d * (one[0] / n), total[2] + one[2] + np.outer(d, d) * (total[0] * one[0] / n))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "i": pa.array([0], pa.int64()), "v": pa.array([np.concatenate(([total[0]], total[1], total[2].ravel()))], pa.list_(pa.float64()))})

        parts = self.rows.mapInArrow(add, "part long, i long, v array<double>")
        for over in (FAN, None):
            part = F.expr(f"part div {over}") if over else F.lit(0).cast("long")
            parts = C.by_group(parts.select(part.alias("group"), "part", "v"), ["group"], merge, "part long, i long, v array<double>")
        v = np.array(parts.first()["v"])
        cov = v[1 + len(live) :].reshape(len(live), -1) / v[0]
        return float(np.abs(cov - np.eye(len(live))).max())

    def _projector(self):
        sums, n, vectors, scales = self.sums, self.n, self.vectors, self.scales
        return lambda x: (_centred(x, sums, n) @ vectors.T) * scales

    def transform(self) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
        dim, n, sums, count, project = self.dim, self.n, self.sums, self.count, self._projector()
        explained, error = self.explained, self.identity_error

        def rows(batches):
            for batch in batches:
                x = _integers(batch, dim) if batch.num_rows else np.zeros((0, dim), np.int64)
                w = project(x)
                small = x.dtype != object and n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums) < LONG
                far = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
                if not len(x) or int(np.abs(far).max()) ** 2 * dim < LONG:
                    deviation = (far.astype(np.int64) ** 2).sum(1).tolist()
                else:
                    deviation = [int(d) if d < LONG else None for d in (far.astype(object) ** 2).sum(1)]
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array([n] * len(flat), pa.int64()),
                     pa.array([d for d in deviation for _ in range(count)], pa.int64()), pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(np.tile(explained, len(x)), pa.float64()), pa.array([error] * len(flat), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return self.rows.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), d (their number) of the rows that are fitted."""
    v = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("d"))
    return base.where((F.col("d") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def whiten(vectors: DataFrame, **options) -> DataFrame:
    """The whitened rows of all vectors; each length of vector is fitted for itself."""
    rows = sound(vectors)
    lengths = sorted(r["d"] for r in rows.select("d").distinct().collect())  # a row for each length of vector
    out = [Fit(rows.where(F.col("d") == d), d, **options).transform() for d in lengths]
    if not out:
        return rows.selectExpr("vec_id", "1 component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error").where("false")
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole
