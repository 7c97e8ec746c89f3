"""Whitening of embeddings by an incremental eigendecomposition (op13).

Each partition keeps the mean and the spectrum (eigenvalues and eigenvectors) of the scatter matrix of the
vectors it has read.  A block of vectors, centred on its own mean, is first turned by an orthogonal
transformation into as many rows as there are dimensions (the triangular factor of a QR
decomposition, whose rows have the same scatter); each row is then a centred rank-one update of the
spectrum, and one more update accounts for the distance between the means.  An update solves the
secular equation for the new eigenvalues between the old ones, after deflating what the update doesn't
touch: directions it is orthogonal to, and equal eigenvalues but one.

Two spectra combine likewise: the second one's eigenvectors, scaled, are rank-one updates of the first.  A
tree of such merges gives the spectrum of all vectors.  Its eigenvectors span the space for a distributed
Rayleigh-Ritz step: the covariance of the centred vectors in that basis is summed over the
partitions, and its small eigenproblem removes the rounding errors that the updates have gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

EPS = np.finfo(float).eps
BLOCK = 2048        # vectors that are turned into one block of updates
FAN_IN = 16         # spectra merged by one task
COMPONENTS = 8
ZERO = 1e-12        # components below this share of the largest eigenvalue count as absent
LARGEST = 2.0 ** 50  # entries beyond have no exact form


@dataclass
class Spectrum:
    """``n`` vectors with this mean, whose scatter is ``vectors @ diag(values) @ vectors.T``; values ascend."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> "Spectrum":
        return Spectrum(0, np.zeros(dim), np.zeros(dim), np.eye(dim))


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(weights / (poles - x))``, for ascending distinct poles and positive weights.

    Returns the pole that each root is measured from and the distance, so that differences of roots and
    poles keep their leading digits.  Each step fits one rational term to the poles on either side of a root;
    a step that leaves the root's bracket is replaced by halving it."""
    k = len(poles)
    top = np.append(poles[1:], poles[-1] + weights.sum())
    gap = top - poles
    # the sign in the middle of each gap tells which end is nearer
    middle = poles + gap / 2
    f = 1 + (weights / (poles - middle[:, None])).sum(axis=1)
    near = np.where((f >= 0) | (np.arange(k) == k - 1), np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    origin = poles[near]
    delta = poles - origin[:, None]                  # poles as seen from each root's origin
    low = np.where(f >= 0, poles - origin, middle - origin)
    high = np.where(f >= 0, middle - origin, top - origin)
    x = (low + high) / 2
    lower = np.tril(np.ones((k, k), dtype=bool))     # poles at or below the root
    left, right = delta[np.arange(k), np.arange(k)], top - origin
    last = k - 1
    for _ in range(60):
        d = delta - x[:, None]
        terms = weights / d
        slopes = terms / d
        f = 1 + terms.sum(axis=1)
        size = 1 + np.abs(terms).sum(axis=1)
        done = (np.abs(f) <= 4 * EPS * size) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        below, above = (slopes * lower).sum(axis=1), (slopes * ~lower).sum(axis=1)
        dl, dr = left - x, right - x
        # c + s / (left - x) + t / (right - x), with the values and slopes of both sides
        s, t = dl * dl * below, dr * dr * above
        c = f - dl * below - dr * above
        # the last root has no pole above it: its bracket's end is no pole
        c[last] = f[last] - dl[last] * below[last]
        a = c
        b = -(c * (dl + dr) + s + t)
        q = c * dl * dr + s * dr + t * dl
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * a * q, 0))
            step = np.where(b <= 0, 2 * q / (-b + root), (-b - root) / (2 * a))
            step[last] = dl[last] + s[last] / c[last]
            nxt = x + step
        x = np.where(done, x, np.where((nxt > low) & (nxt < high), nxt, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors @ diag(values) @ vectors.T + outer(update, update)``; values ascend."""
    z = vectors.T @ update
    scale = max(float(values[-1]), float(z @ z))
    if not scale > 0:
        return values, vectors
    tol = 8 * EPS * scale
    # deflation: equal eigenvalues are turned until only one of them meets the update
    close = np.flatnonzero(np.diff(values) <= tol)
    if len(close):
        z, vectors = z.copy(), vectors.copy()
        for i in close:
            r = np.hypot(z[i], z[i + 1])
            if r > 0:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                a, b = vectors[:, i].copy(), vectors[:, i + 1].copy()
                vectors[:, i], vectors[:, i + 1] = c * a - s * b, s * a + c * b
    touched = np.abs(z) * np.linalg.norm(z) > tol
    # ... and directions that the update is orthogonal to stay as they are
    at = np.flatnonzero(touched)
    if not len(at):
        return values, vectors
    poles, w = values[at], z[at] ** 2
    near, x = secular_roots(poles, w)
    distance = (poles[:, None] - poles[near]) - x        # pole i minus root j
    # weights for which the roots found are exact keep the eigenvectors orthogonal
    k = len(at)
    if k > 1:
        ratio = -distance.copy()
        apart = poles[None, :] - poles[:, None]
        apart[np.arange(k), np.arange(k)] = 1.0
        np.fill_diagonal(ratio, -np.diagonal(distance))
        with np.errstate(all="ignore"):
            fitted = np.abs(np.prod(ratio / apart, axis=1))
        w = np.where(np.isfinite(fitted) & (fitted > 0), fitted, w)
    turn = np.sign(z[at])[:, None] * np.sqrt(w)[:, None] / distance
    turn /= np.linalg.norm(turn, axis=0)
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[at] = poles[near] + x
    new_vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def merged(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of both sets of vectors: the second one's directions as updates of the first."""
    if a.n < b.n:
        a, b = b, a
    if not b.n:
        return a
    n = a.n + b.n
    step = b.mean - a.mean
    values, vectors = a.values, a.vectors
    for value, direction in zip(b.values, b.vectors.T):
        if value > 0:
            values, vectors = rank_one(values, vectors, np.sqrt(value) * direction)
    values, vectors = rank_one(values, vectors, np.sqrt(a.n / n * b.n) * step)
    return Spectrum(n, a.mean + step * (b.n / n), values, vectors)


def absorbed(spectrum: Spectrum, block: np.ndarray) -> Spectrum:
    """``spectrum`` with a block of vectors (rows) added by centred rank-one updates."""
    if not len(block):
        return spectrum
    mean = block.mean(axis=0)
    rows = block - mean
    if len(rows) > block.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    values, vectors = spectrum.values, spectrum.vectors
    for row in rows:
        values, vectors = rank_one(values, vectors, row)
    n = spectrum.n + len(block)
    step = mean - spectrum.mean
    if spectrum.n:
        values, vectors = rank_one(values, vectors, np.sqrt(spectrum.n / n * len(block)) * step)
    return Spectrum(n, spectrum.mean + step * (len(block) / n), values, vectors)


_SPECTRUM = "n bigint, mean array<double>, eigenvalues array<double>, vectors array<double>"


def _as_row(s: Spectrum) -> list:
    return [s.n, s.mean.tolist(), s.values.tolist(), s.vectors.ravel().tolist()]


def _from_row(row) -> Spectrum:
    dim = len(row["mean"])
    return Spectrum(int(row["n"]), np.asarray(row["mean"], dtype=float), np.asarray(row["eigenvalues"], dtype=float),
                    np.asarray(row["vectors"], dtype=float).reshape(dim, dim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _spectra(vectors: DataFrame, dim: int) -> DataFrame:
    """One spectrum for each partition of ``vectors``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, held = Spectrum.empty(dim), []
        for batch in batches:
            held.append(_matrix(batch.column(0), dim).astype(float))
            while sum(map(len, held)) >= BLOCK:
                block = np.concatenate(held)
                spectrum, held = absorbed(spectrum, block[:BLOCK]), [block[BLOCK:]]
        if held:
            spectrum = absorbed(spectrum, np.concatenate(held))
        if spectrum.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([_as_row(spectrum)], columns=["n", "mean", "eigenvalues", "vectors"]),
                                             preserve_index=False)

    return vectors.select("x").mapInArrow(read, _SPECTRUM)


def _combined(group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for _, row in group.sort_values("place", kind="stable").iterrows():
        s = _from_row(row)
        total = s if total is None else merged(total, s)
    return pd.DataFrame([[int(group["place"].iloc[0]) // FAN_IN, *_as_row(total)]],
                        columns=["place", "n", "mean", "eigenvalues", "vectors"])


def whole_spectrum(vectors: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all vectors, by a tree of merges of ``FAN_IN`` each; the driver gets the last one."""
    spark = vectors.sparkSession
    now, left = _spectra(vectors, dim).withColumn("place", F.spark_partition_id().cast("bigint")), None
    while left is None or left > 1:
        path = scratch_path(spark, "spectra")
        if left is not None:
            now = now.withColumn("_g", F.floor(F.col("place") / FAN_IN)).groupBy("_g").applyInPandas(
                _combined, "place bigint, " + _SPECTRUM)
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        left = now.count()
        if left and left > 1:  # dense places, so that each round merges FAN_IN at a time
            most = now.agg(F.max("place")).first()[0]
            if most >= left * FAN_IN:
                now = now.withColumn("place", F.pmod(F.xxhash64("place"), F.lit(left)))
    return _from_row(now.first()) if left else Spectrum.empty(dim)


def _dots(vectors: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The sum of outer products of the centred vectors in ``basis``, over all rows."""
    k = basis.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch.column(0), len(mean)) - mean) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "v"])

    # cells are added up by Spark in a map-side combined aggregation: k * k rows reach the driver
    cells = vectors.select("x").mapInArrow(add, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k)
    for r in cells.collect():
        out[r["cell"]] = r["v"]
    return out.reshape(k, k)


@dataclass
class Whitening:
    """Mean, components (columns, unit vectors by falling eigenvalue) and eigenvalues of a covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def fixed_point(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0,
                shift: int = 100_000) -> DataFrame:
    """(id, x): the vectors as arrays of long, ``floor(scale * entry) + shift``.

    Rows are left out whose vector is null or empty, or holds a null, a NaN, an infinite entry or one
    beyond 2^50, where the integer form is no longer exact."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.when(
        F.abs(v) * F.lit(scale) < F.lit(LARGEST), F.floor(v * F.lit(scale)).cast("bigint") + F.lit(shift).cast("bigint")))
    rows = embeddings.select(F.col(id_col).alias("id"), x.alias("x"))
    return rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull()))


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of the column ``x`` of ``vectors`` (arrays of long, all of one length); None without rows."""
    sums = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n, totals = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    mean = np.array([t / n for t in totals])
    start = whole_spectrum(vectors, len(totals))
    basis, _ = np.linalg.qr(start.vectors[:, ::-1])
    ritz = _dots(vectors, basis, mean) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    components = basis @ turn[:, ::-1]
    # either sign is right; the largest entry is made positive
    top = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return Whitening(n, totals, components * np.where(top < 0, -1.0, 1.0), values[::-1], float(np.trace(ritz)))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each sound vector and each of the
    first ``components`` components.

    ``n`` is the number of vectors the fit uses (all sound ones), ``deviation`` the exact sum of
    (n*x - S)^2 over the dimensions (null where it is beyond a long), ``whitened`` the centred vector
    on the component over the root of its eigenvalue, ``explained`` the component's share of the variance,
    ``identity_error`` the largest entry of whitened's covariance minus the identity, measured over all rows.

    Null, empty and unsound vectors are left out (see ``fixed_point``), and so are vectors shorter or longer than
    the commonest length (the longest of equally common ones).  Components without variance
    (a single vector, equal vectors, fewer directions than components) have no whitened value and give no rows.
    Repeated ids and rows count each for itself; equal eigenvalues give any orthonormal directions of
    their space; an empty table gives an empty table; other columns are not read."""
    id_type = embeddings.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    spark = embeddings.sparkSession
    vectors = fixed_point(embeddings, id_col, vector_col)
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.filter(F.size("x") == lengths["d"])
    model = fit(vectors)
    sound = np.flatnonzero(model.eigenvalues[:components] > ZERO * max(model.eigenvalues[0], 0.0))
    if not len(sound):
        return spark.createDataFrame([], schema)
    mean = np.array([s / model.n for s in model.sums])
    basis = model.components[:, sound] / np.sqrt(model.eigenvalues[sound])
    error = float(np.abs(_dots(vectors, basis, mean) / model.n - np.eye(len(sound))).max())
    n, sums, explained = model.n, np.array(model.sums, dtype=object), model.eigenvalues[sound] / model.trace
    k = len(sound)

    def deviations(x: np.ndarray) -> list[int | None]:
        apart = np.abs(x - mean).max(initial=0) + 1
        if len(mean) * float(n * apart) ** 2 < 2.0 ** 62 and n * float(np.abs(x).max(initial=0)) < 2.0 ** 62:
            y = x * n - sums.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
        return [v if v < 2 ** 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(mean))
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(sound + 1, m).astype(np.int32)), pa.array(np.full(m * k, n, dtype=np.int64)),
                pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()),
                pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names=schema.names)

    return vectors.mapInArrow(project, schema)
