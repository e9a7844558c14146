"""Many item response fits in one EM: settings that share a pass over packed learners.

A setting is a model with its priors, its group of learners and its items. Settings on one group
(priors of c, held-out folds, models) share each learner's row; replicates have groups of their own.
A round is one job for all settings: posteriors of learners in array operations, expected counts
added up in each task before the shuffle, item maxima where the counts land. Every other round
extrapolates each setting's path (squared extrapolation) and takes that back where the objective
falls, so the objective of what is kept never does.

Item parameters pass through the driver and are broadcast: at most MOST_ITEMS items times settings
(some 100 MB of curves and counts in a task); more settings run one lot after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import icc, item_maxima, log_priors, normal_nodes
from ..sources.scratch import written

NODES = 41
MODELS = {"1PL": 1, "2PL": 2, "3PL": 3}
MOST_ITEMS = 1 << 17
#: Responses whose curves a task holds at once, NODES numbers each in a few arrays (some 50 MB).
RESPONSES = 1 << 15


@dataclass(frozen=True)
class Setting:
    """One fit: model, whether priors hold, the Beta prior of c, the group of learners it sees, and items it leaves out."""

    model: str = "2PL"
    priors: bool = True
    c_prior: tuple[float, float] = (5, 17)
    group: int = 0
    without: frozenset = frozenset()

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {sorted(MODELS)}")


@dataclass
class Fit:
    """items (sorted ids), x (b, log a, logit c by item), the objective of each kept round, the log-likelihood at x."""

    setting: Setting
    items: np.ndarray
    x: np.ndarray
    limit: float
    trace: list[float] = field(default_factory=list)
    loglik: float = float("nan")
    converged: bool = False

    def curves(self) -> np.ndarray:
        """(a, b, c) by item."""
        c = 1 / (1 + np.exp(-self.x[:, 2])) if self.setting.model == "3PL" else np.zeros(len(self.x))
        return np.column_stack((np.exp(self.x[:, 1]), self.x[:, 0], c))


def packed(resp: DataFrame, group: str | None = None) -> DataFrame:
    """(grp, user_id, items, ys): a row per learner (and group)."""
    rows = resp.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), "user_id", "question_id", "y")
    rows = rows.groupBy("grp", "user_id").agg(F.sort_array(F.collect_list(F.struct("question_id", "y"))).alias("r"))
    return written(rows.select("grp", "user_id", F.col("r.question_id").alias("items"), F.col("r.y").alias("ys")), "learners")[0]


def log_curves(curves: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.clip(icc(nodes[None, :], *(curves[:, k : k + 1] for k in range(3))), 1e-10, 1 - 1e-10)
    return np.log(p), np.log(1 - p)


def unpacked(batch: pd.DataFrame, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the item among `items`, y, and learner of every response to one of them."""
    counts = np.fromiter(map(len, batch["items"]), np.int64, len(batch))
    if not counts.sum() or not len(items):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    item, y = np.concatenate(batch["items"].tolist()).astype(np.int64), np.concatenate(batch["ys"].tolist()).astype(float)
    learner = np.repeat(np.arange(len(batch)), counts)
    at = np.minimum(np.searchsorted(items, item), len(items) - 1)
    known = items[at] == item
    return at[known], y[known], learner[known]


def slices(batches: Iterator[pd.DataFrame], most: int | None = None) -> Iterator[pd.DataFrame]:
    """Whole learners at a time, with about `most` responses: memory doesn't grow with the learners of an Arrow batch."""
    most = most or RESPONSES
    for batch in batches:
        counts = np.fromiter(map(len, batch["items"]), np.int64, len(batch)) + 1  # learners without answers cost something too
        lot = (np.cumsum(counts) - counts) // most
        edges = np.flatnonzero(np.concatenate(([True], lot[1:] != lot[:-1], [True]))) if len(batch) else ()
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.iloc[a:b]


def posteriors(at: np.ndarray, y: np.ndarray, learner: np.ndarray, n: int, right: np.ndarray, wrong: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior over the nodes, and marginal log-likelihood, of n learners."""
    like = np.tile(np.log(weights), (n, 1))
    if len(learner):
        edge = np.flatnonzero(np.concatenate(([True], learner[1:] != learner[:-1])))
        like[learner[edge]] += np.add.reduceat(np.where(y[:, None] > 0, right[at], wrong[at]), edge)
    top = like.max(axis=1, keepdims=True)
    mass = np.exp(like - top)
    whole = mass.sum(axis=1, keepdims=True)
    return mass / whole, (top + np.log(whole))[:, 0]


def em_round(learners: DataFrame, fits: dict[int, Fit]) -> pd.DataFrame:
    """One EM step of every fit: (setting, item place, b, la, lc, ga, ha), and a row (setting, -1, loglik, ...)."""
    spark = learners.sparkSession
    shared = spark.sparkContext.broadcast({k: (f.setting, f.items, f.x, f.curves()) for k, f in fits.items()})
    nodes, weights = normal_nodes(NODES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        curves = {k: log_curves(abc, nodes) for k, (_, _, _, abc) in known.items()}
        sums = {k: (np.zeros((len(items), NODES)), np.zeros((len(items), NODES))) for k, (_, items, _, _) in known.items()}
        total = dict.fromkeys(known, 0.0)
        for batch in slices(batches):
            for k, (setting, items, _, _) in known.items():
                mine = batch[batch["grp"] == setting.group]
                if not len(mine):
                    continue
                at, y, learner = unpacked(mine, items)
                post, loglik = posteriors(at, y, learner, len(mine), *curves[k], weights)
                total[k] += float(loglik.sum())
                order = np.argsort(at, kind="stable")
                if len(order):
                    edge = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
                    own = post[learner[order]]
                    sums[k][0][at[order][edge]] += np.add.reduceat(own, edge)
                    sums[k][1][at[order][edge]] += np.add.reduceat(own * y[order][:, None], edge)
        for k, (n, r) in sums.items():
            seen = np.flatnonzero(n.sum(axis=1))
            for some in np.array_split(seen, -(-len(seen) // 4096) or 1):
                yield pd.DataFrame({"setting": k, "item": some, "n": list(n[some]), "r": list(r[some]), "loglik": 0.0})
        yield pd.DataFrame([(k, -1, [0.0] * NODES, [0.0] * NODES, v) for k, v in total.items()], columns=["setting", "item", "n", "r", "loglik"])

    parts = learners.mapInPandas(count, "setting int, item int, n array<double>, r array<double>, loglik double")
    added = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(NODES)]).alias(c)
    counts = parts.groupBy("setting", "item").agg(added("n"), added("r"), F.sum("loglik").alias("loglik"))

    def maximise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, rows in batch.groupby("setting"):
                setting, _, x, _ = shared.value[k]
                whole = rows[rows["item"] < 0]
                if len(whole):
                    yield pd.DataFrame({"setting": k, "item": -1, "b": whole["loglik"], "la": 0.0, "lc": 0.0, "ga": 0.0, "ha": 0.0})
                rows = rows[rows["item"] >= 0]
                if not len(rows):
                    continue
                n, r, at = np.stack(rows["n"]), np.stack(rows["r"]), rows["item"].to_numpy()
                new = item_maxima(n, r, nodes, x[at], setting.model, setting.priors, setting.c_prior)
                d = np.exp(new[:, 1:2]) * (nodes - new[:, 0:1])
                p = 1 / (1 + np.exp(-np.clip(d, -35, 35)))
                yield pd.DataFrame({"setting": k, "item": at, "b": new[:, 0], "la": new[:, 1], "lc": new[:, 2], "ga": ((r - n * p) * d).sum(1), "ha": (n * p * (1 - p) * d * d).sum(1)})

    return counts.mapInPandas(maximise, "setting int, item int, b double, la double, lc double, ga double, ha double").toPandas()


class Path:
    """The way of one fit: plain steps and squared extrapolations, the latter taken back where the objective falls."""

    def __init__(self, fit: Fit) -> None:
        self.fit, self.before, self.trial = fit, None, False

    def step(self, new: np.ndarray, loglik: float) -> None:
        """new: the EM step from fit.x; loglik: at fit.x."""
        fit = self.fit
        s = fit.setting
        objective = loglik + (float(log_priors(fit.x, s.model, s.c_prior).sum()) if s.priors else 0.0)
        if self.trial and fit.trace and objective < fit.trace[-1]:
            fit.x, self.before, self.trial = self.plain, None, False
            return
        gain = objective - fit.trace[-1] if fit.trace else np.inf
        plain = not self.trial
        fit.trace.append(objective)
        fit.loglik = loglik
        if plain and gain < fit.limit:
            fit.converged = True
            return
        if self.before is not None and plain:
            r, v = fit.x - self.before, new - 2 * fit.x + self.before
            alpha = -max(1.0, float(np.sqrt((r * r).sum() / max((v * v).sum(), 1e-300))))
            ahead = self.before - 2 * alpha * r + alpha * alpha * v
            self.plain, self.before, self.trial = new, None, alpha < -1.0
            fit.x = np.clip(ahead, [-12, -4, -12], [12, 4, 2]) if self.trial else new
            return
        self.before, self.trial = fit.x, False
        fit.x = new


def fit_many(learners: DataFrame, resp: DataFrame, settings: list[Setting], rounds: int = 200, tol: float = 1e-7, start: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> list[Fit]:
    """A fit for each setting. resp: (grp,) question_id, y of the learners; start: items and x by group, where known.

    A fit stops when a plain step gains less than tol for each of its responses.
    """
    by = ["grp", "question_id"] if "grp" in resp.columns else ["question_id"]
    stats = resp.groupBy(*by).agg(((F.sum("y") + 0.5) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n")).toPandas()  # a row an item and group
    fits = []
    for s in settings:
        own = stats[stats["grp"] == s.group] if "grp" in stats else stats
        own = own[~own["question_id"].isin(s.without)].sort_values("question_id")
        p = own["p"].to_numpy(float)
        x = np.column_stack((np.clip(-np.log(p / (1 - p)), -4, 4), np.zeros(len(p)), np.full(len(p), np.log(0.15 / 0.85))))
        items = own["question_id"].to_numpy(np.int64)
        if start and s.group in start:
            known, given = start[s.group]
            at = np.minimum(np.searchsorted(known, items), max(0, len(known) - 1))
            found = known[at] == items if len(known) else np.zeros(len(items), bool)
            x[found] = given[at[found]]
        fits.append(Fit(s, items, x, tol * max(1, int(own["n"].sum()))))
    if max([0, *(len(f.items) for f in fits)]) > MOST_ITEMS:
        raise ValueError(f"parameters are broadcast: at most {MOST_ITEMS} items")
    lots, lot = [], []
    for k, f in enumerate(fits):
        if lot and sum(len(fits[j].items) for j in lot) + len(f.items) > MOST_ITEMS:
            lots, lot = [*lots, lot], []
        lot.append(k)
    for lot in [*lots, lot]:
        paths = {k: Path(fits[k]) for k in lot if len(fits[k].items)}
        for _ in range(rounds):
            open_ = {k: p for k, p in paths.items() if not p.fit.converged}
            if not open_:
                break
            groups = sorted({fits[k].setting.group for k in open_})
            found = em_round(learners.where(F.col("grp").isin(groups)), {k: fits[k] for k in open_})
            for k, path in open_.items():
                rows = found[found["setting"] == k]
                loglik, rows = float(rows[rows["item"] < 0]["b"].sum()), rows[rows["item"] >= 0]
                new = path.fit.x.copy()
                new[rows["item"].to_numpy()] = rows[["b", "la", "lc"]].to_numpy()
                if path.fit.setting.model == "1PL":
                    new[:, 1] += np.clip(rows["ga"].sum() / max(rows["ha"].sum(), 1e-9), -0.5, 0.5)
                path.step(new, loglik)
    return fits


def parameters(learners: DataFrame, fits: list[Fit]) -> DataFrame:
    """(setting, question_id, a, b, c) of all fits; setting is the place in the list."""
    rows = [(k, int(q), *map(float, abc)) for k, f in enumerate(fits) for q, abc in zip(f.items, f.curves())]
    return learners.sparkSession.createDataFrame(rows, "setting int, question_id long, a double, b double, c double")


def abilities(learners: DataFrame, fits: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """(setting, user_id, theta, sd, loglik, post) of every learner under each of its settings: {setting: (group, items, (a, b, c))}."""
    shared = learners.sparkSession.sparkContext.broadcast(fits)
    nodes, weights = normal_nodes(NODES)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curves = {k: log_curves(abc, nodes) for k, (_, _, abc) in shared.value.items()}
        for batch in slices(batches):
            for k, (group, items, _) in shared.value.items():
                mine = batch[batch["grp"] == group]
                if not len(mine):
                    continue
                post, loglik = posteriors(*unpacked(mine, items), len(mine), *curves[k], weights)
                mean = post @ nodes
                sd = np.sqrt(np.maximum(post @ nodes**2 - mean**2, 0))
                yield pd.DataFrame({"setting": k, "user_id": mine["user_id"].to_numpy(), "theta": mean, "sd": sd, "loglik": loglik, "post": list(post)})

    return learners.mapInPandas(step, "setting int, user_id long, theta double, sd double, loglik double, post array<double>")


def abilities_of(learners: DataFrame, fits: list[Fit]) -> DataFrame:
    return abilities(learners, {k: (f.setting.group, f.items, f.curves()) for k, f in enumerate(fits)})
