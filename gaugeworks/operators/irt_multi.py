"""The between-item multi-dimensional 2PL: one trait a series, traits correlated, unit variances.

Nodes are a tensor grid of Gauss-Hermite nodes z, turned by the Cholesky factor of the current
correlations: theta = L z, so the grid fits strong correlations too. A pass over packed learners
takes posteriors on the grid with matrix products and adds up, in each task, the gradient and
curvature of every item's (b, log a) and the second moments of the traits: six numbers an item and
a small matrix, whatever the grid. Items take a damped step from their sums; the correlations are
those that the moments make likeliest under unit variances. Rounds are extrapolated as in `irt_many`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .irt_many import MOST_ITEMS, packed, unpacked

#: Numbers of a matrix of learners by nodes, or of items by nodes, that are worked on at once.
NUMBERS = 1 << 20


def grid(dims: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Independent standard normal nodes (points, dims) and their weights."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    points = np.array(np.meshgrid(*[x] * dims, indexing="ij")).reshape(dims, -1).T
    weights = np.prod(np.array(np.meshgrid(*[w / w.sum()] * dims, indexing="ij")).reshape(dims, -1), axis=0)
    keep = weights > 1e-14  # corners that no learner can be in
    return points[keep], weights[keep] / weights[keep].sum()


def likeliest_correlations(moments: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The correlation matrix S of largest -log|S| - tr(S^-1 M), by damped Newton on its entries."""
    d = len(start)
    rows, columns = np.tril_indices(d, -1)
    if not len(rows):
        return np.eye(d)

    def matrix(v: np.ndarray) -> np.ndarray:
        s = np.eye(d)
        s[rows, columns] = s[columns, rows] = v
        return s

    def value(v: np.ndarray) -> float:
        sign, size = np.linalg.slogdet(matrix(v))
        if sign <= 0 or np.linalg.eigvalsh(matrix(v)).min() < 1e-6:
            return -np.inf
        return -size - float(np.trace(np.linalg.solve(matrix(v), moments)))

    def slope(v: np.ndarray) -> np.ndarray:
        inverse = np.linalg.inv(matrix(v))
        g = inverse @ moments @ inverse - inverse
        return 2 * g[rows, columns]

    v = start[rows, columns].copy()
    for _ in range(50):
        g, h = slope(v), np.empty((len(v), len(v)))
        for k in range(len(v)):
            e = np.zeros(len(v))
            e[k] = 1e-6
            h[k] = (slope(v + e) - slope(v - e)) / 2e-6
        h = -(h + h.T) / 2
        h += np.eye(len(v)) * max(0.0, 1e-6 - np.linalg.eigvalsh(h).min())
        move, t, base = np.linalg.solve(h, g), 1.0, value(v)
        while t > 1e-8 and value(v + t * move) < base:
            t /= 2
        if t <= 1e-8 or np.abs(t * move).max() < 1e-12:
            break
        v = v + t * move
    return matrix(v)


def chances(x: np.ndarray, dim: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z = a (theta - b) and p of items (b, log a) at the nodes of their trait."""
    z = np.clip(np.exp(x[:, 1:2]) * (theta.T[dim] - x[:, 0:1]), -35, 35)
    return z, np.clip(1 / (1 + np.exp(-z)), 1e-10, 1 - 1e-10)


def batches_of(batches: Iterator[pd.DataFrame], items: np.ndarray, points: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Some learners at a time: they, the places of their items, and seen and y as matrices of learners by these items."""
    step = max(1, NUMBERS // max(1, points))
    for batch in batches:
        for k in range(0, len(batch), step):
            some = batch.iloc[k : k + step]
            at, y, learner = unpacked(some, items)
            own, place = np.unique(at, return_inverse=True)
            seen, right = np.zeros((len(some), len(own))), np.zeros((len(some), len(own)))
            seen[learner, place] = 1
            right[learner, place] = y
            yield some, own, seen, right


def grid_posterior(seen: np.ndarray, right: np.ndarray, p: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    like = right @ np.log(p) + (seen - right) @ np.log(1 - p) + np.log(weights)
    top = like.max(axis=1, keepdims=True)
    mass = np.exp(like - top)
    whole = mass.sum(axis=1, keepdims=True)
    return mass / whole, (top + np.log(whole))[:, 0]


def one_round(learners: DataFrame, items: np.ndarray, dim: np.ndarray, x: np.ndarray, corr: np.ndarray, nodes: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Log-likelihood, learners, summed trait moments, and by item gb, gl, hbb, hbl, hll at (x, corr)."""
    d = len(corr)
    shared = learners.sparkSession.sparkContext.broadcast((items, dim, x, np.linalg.cholesky(corr)))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, dim, x, factor = shared.value
        points, weights = grid(d, nodes)
        theta = points @ factor.T
        sums, moments, total, count = np.zeros((len(items), 5)), np.zeros((d, d)), 0.0, 0
        for some, own, seen, right in batches_of(batches, items, len(theta)):
            a = np.exp(x[own, 1])
            z, p = chances(x[own], dim[own], theta)
            post, loglik = grid_posterior(seen, right, p, weights)
            total += float(loglik.sum())
            count += len(some)
            moments += (theta * post.sum(0)[:, None]).T @ theta
            n, r = seen.T @ post, right.T @ post
            e, v = r - n * p, n * p * (1 - p)
            sums[own] += np.column_stack((-a * e.sum(1), (z * e).sum(1), a * a * v.sum(1), -a * (v * z).sum(1), (v * z * z).sum(1)))
        rows = [(int(k), sums[k].tolist()) for k in np.flatnonzero(sums.any(axis=1))]
        yield pd.DataFrame([*rows, (-1, [total, count, *moments.ravel()])], columns=["item", "sums"])

    parts = learners.mapInPandas(step, "item int, sums array<double>")
    width = max(5, 2 + d * d)
    found = parts.groupBy("item").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums")).toPandas()  # a row an item
    whole = found[found["item"] < 0]["sums"].iloc[0]
    out = np.zeros((len(items), 5))
    for k, s in zip(found["item"], found["sums"]):
        if k >= 0:
            out[k] = s[:5]
    return whole[0], whole[1], np.array(whole[2 : 2 + d * d]).reshape(d, d), out


def irt_fit_multi(resp: DataFrame, series: DataFrame, nodes: int = 15, rounds: int = 200, tol: float = 1e-7) -> tuple[DataFrame, np.ndarray, dict, DataFrame]:
    """Parameters (question_id, dim, a, b), trait correlations, figures of the fit, and the packed learners.

    resp: (user_id, question_id, y); series: (question_id, series_id), one a question; traits are the
    series in order. Priors b ~ N(0, 3^2), log a ~ N(0, 0.5^2). figures: series, items, learners,
    loglik, trace of the objective (it doesn't fall), converged.
    """
    learners = packed(resp)
    stats = resp.groupBy("question_id").agg(((F.sum("y") + 0.5) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n")).join(series.select("question_id", "series_id"), "question_id").toPandas().sort_values("question_id")  # a row an item
    if len(stats) > MOST_ITEMS:
        raise ValueError(f"parameters are broadcast: at most {MOST_ITEMS} items")
    items, names = stats["question_id"].to_numpy(np.int64), sorted(stats["series_id"].unique())
    dim = np.searchsorted(names, stats["series_id"])
    p, d = stats["p"].to_numpy(float), max(1, len(names))
    state = (np.column_stack((np.clip(-np.log(p / (1 - p)), -4, 4), np.zeros(len(p)))), np.full((d, d), 0.5) + 0.5 * np.eye(d))
    figures = {"series": names, "items": len(items), "learners": 0, "loglik": float("nan"), "trace": [], "converged": False}
    limit, before, plain, trace = tol * max(1, int(stats["n"].sum())), None, None, figures["trace"]
    for _ in range(rounds if len(items) else 0):
        x, corr = state
        loglik, count, moments, s = one_round(learners, items, dim, x, corr, nodes)
        objective = loglik - float((x[:, 0] ** 2 / 18 + 2 * x[:, 1] ** 2).sum())
        if plain is not None and objective < trace[-1]:  # the extrapolation was too long
            state, plain = plain, None
            continue
        gain = objective - trace[-1] if trace else np.inf
        trace.append(objective)
        figures |= {"loglik": loglik, "learners": int(count)}
        if plain is None and gain < limit:
            figures["converged"] = True
            break
        gb, gl, hbb, hll, hbl = s[:, 0] - x[:, 0] / 9, s[:, 1] - 4 * x[:, 1], s[:, 2] + 1 / 9, s[:, 4] + 4, s[:, 3]
        det = hbb * hll - hbl * hbl
        move = np.column_stack((np.clip((hll * gb - hbl * gl) / det, -1, 1), np.clip((hbb * gl - hbl * gb) / det, -0.5, 0.5)))
        new = (x + move, likeliest_correlations(moments / count, corr))
        if before is not None and plain is None:
            r, v = x - before[0], new[0] - 2 * x + before[0]
            rc, vc = corr - before[1], new[1] - 2 * corr + before[1]
            alpha = max(1.0, float(np.sqrt(((r * r).sum() + (rc * rc).sum()) / max((v * v).sum() + (vc * vc).sum(), 1e-300))))
            ahead = before[0] + 2 * alpha * r + alpha * alpha * v, before[1] + 2 * alpha * rc + alpha * alpha * vc
            sound = alpha > 1 and np.abs(ahead[0]).max() < 12 and np.abs(ahead[1] - np.eye(d)).max() < 1 and np.linalg.eigvalsh(ahead[1]).min() > 1e-4
            before, plain, state = None, (new if sound else None), (ahead if sound else new)
            continue
        before, plain, state = state, None, new
    x, corr = state
    rows = [(int(q), int(k), float(np.exp(l)), float(b)) for q, k, (b, l) in zip(items, dim, x)]
    return resp.sparkSession.createDataFrame(rows, "question_id long, dim int, a double, b double"), corr, figures, learners


def predict_multi(learners: DataFrame, targets: DataFrame, params: DataFrame, corr: np.ndarray, nodes: int = 15) -> DataFrame:
    """(user_id, question_id, y, p) of targets, from each learner's posterior over the grid; learners without answers have the prior."""
    table = params.orderBy("question_id").toPandas()  # a row an item
    x, d = np.column_stack((table["b"], np.log(table["a"]))), len(corr)
    shared = targets.sparkSession.sparkContext.broadcast((table["question_id"].to_numpy(np.int64), table["dim"].to_numpy(int), x, np.linalg.cholesky(corr)))
    asked = targets.groupBy("user_id").agg(F.collect_list(F.struct("question_id", "y")).alias("t")).select("user_id", F.col("t.question_id").alias("asked"), F.col("t.y").alias("truth"))
    rows = asked.join(learners.select("user_id", "items", "ys"), "user_id", "left")
    rows = rows.withColumns({"items": F.coalesce("items", F.array().cast("array<long>")), "ys": F.coalesce("ys", F.array().cast("array<int>"))})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, dim, x, factor = shared.value
        points, weights = grid(d, nodes)
        theta = points @ factor.T
        for some, own, seen, right in batches_of(batches, items, len(theta)):
            post, _ = grid_posterior(seen, right, chances(x[own], dim[own], theta)[1], weights)
            at, y, learner = unpacked(pd.DataFrame({"items": some["asked"], "ys": some["truth"]}), items)
            if len(at):
                new, place = np.unique(at, return_inverse=True)
                p = post @ chances(x[new], dim[new], theta)[1].T
                yield pd.DataFrame({"user_id": some["user_id"].to_numpy()[learner], "question_id": items[at], "y": y.astype(int), "p": p[learner, place]})

    return rows.mapInPandas(step, "user_id long, question_id long, y int, p double")
