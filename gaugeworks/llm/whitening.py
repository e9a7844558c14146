"""Whitening of embeddings: blockwise TSQR, then a one-sided Jacobi SVD of R.

Each task reduces its centred rows to an upper triangle, block after block; triangles are stacked
and reduced 16 at a time. The last one, R (as wide as a vector), has the singular values and right
singular vectors of all centred rows, though these never meet and are never squared: small
deviations keep their digits. Plane rotations make R's columns orthogonal; rotated into each other,
their lengths are the singular values, and the product of the rotations holds the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .vectors import folded, integer_vectors, matrix_blocks

SWEEPS = 60
SHAPE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def triangle(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of all vectors x less the mean."""
    d = len(mean)

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.linalg.qr(centred if state is None else np.vstack((state, centred)), mode="r")

    r = folded(rows, step, lambda states: np.linalg.qr(np.vstack([s.reshape(-1, d) for s in states]), mode="r"))
    return np.zeros((0, d)) if r is None else r.reshape(-1, d)


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of columns by round, in which every pair comes once (a round-robin tournament)."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(min(p), max(p)) for p in zip(seats[: len(seats) // 2], seats[::-1]) if max(p) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi_svd(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns (of each, the largest entry is positive)."""
    a, v = np.array(r, float), np.eye(r.shape[1])
    order = rounds(r.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in order:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            act = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not act.any():
                continue
            turned = True
            p, q = p[act], q[act]
            zeta = (beta[act] - alpha[act]) / (2 * gamma[act])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    by = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[by], v[:, by]
    return sigma, v * np.where(v[np.abs(v).argmax(0), np.arange(len(by))] < 0, -1.0, 1.0)


def identity_error(rows: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened vectors, less the identity; centred before it is multiplied."""
    k = axes.shape[1]
    if not k:
        return 0.0

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ axes
        m = w.mean(0)
        new = np.concatenate(([len(w)], m, ((w - m).T @ (w - m)).ravel()))
        return new if state is None else both([state, new])

    def both(states: list[np.ndarray]) -> np.ndarray:
        out = states[0]
        for s in states[1:]:
            n, delta = out[0] + s[0], s[1 : k + 1] - out[1 : k + 1]
            out = np.concatenate(([n], out[1 : k + 1] + delta * s[0] / n, out[k + 1 :] + s[k + 1 :] + np.outer(delta, delta).ravel() * out[0] * s[0] / n))
        return out

    state = folded(rows, step, both)
    return float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors are floor(256 c). Covariances are over the n distinct vectors, divisor n. Rows whose
    vector is null, holds null or non-finite entries, or has another length than most, are left out.
    Repeated rows, and rows of one vector, each get their figures; a null vec_id stays null. A
    component without variance has whitened and explained 0 and no part in identity_error. Equal
    eigenvalues have some orthonormal components, the same for all rows. A deviation of 2^63 or more
    is null. Vectors shorter than `components` have as many components as entries. Other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings.select(F.col("vec_id").cast("long"), "embedding"))
    fit, _ = written(rows.select("x").distinct(), "distinct-vectors")
    sums = {r["pos"]: int(r["s"]) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}  # a row a dimension
    n, d = fit.count(), len(sums)
    if not n or not d:
        return spark.createDataFrame([], SHAPE)
    total = [sums[k] for k in range(d)]
    mean = np.array([s / n for s in total])
    sigma, axes = jacobi_svd(triangle(fit, mean))
    k = min(components, d)
    varied = sigma[:k] > sigma[0] * 1e-13 * d
    scale = np.where(varied, np.sqrt(n) / np.where(varied, sigma[:k], 1), 0.0)
    axes = axes[:, :k] * scale
    explained = sigma[:k] ** 2 / (sigma**2).sum() if varied.any() else np.zeros(k)
    explained = np.where(varied, explained, 0.0)
    error = identity_error(fit, mean, axes[:, varied])
    largest = max(map(abs, total)) // n + 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in matrix_blocks(batch):
                w = (x - mean) @ axes
                if d * (n * (int(np.abs(x).max()) + largest)) ** 2 < 1 << 63:
                    deviation = ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x.tolist()]
                    deviation = [v if v < 1 << 63 else None for v in deviation]
                at = np.repeat(np.arange(len(x)), k)
                many = len(at)
                columns = [part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n)), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHAPE.split(", ")])

    return rows.mapInArrow(project, SHAPE)
