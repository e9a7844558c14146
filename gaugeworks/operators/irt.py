"""Item response models fitted by EM on long responses.

The objective is the marginal posterior: theta ~ N(0, 1) on Gauss-Hermite nodes; priors
b ~ N(0, 3^2), log a ~ N(0, 0.5^2) for 2PL and 3PL, c ~ Beta(5, 17) for 3PL; 1PL has one free
common a without a prior. `irt_many` holds the EM; here are single fits and what follows from them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import normal_nodes
from ..sources.scratch import written
from .irt_many import MODELS, NODES, Setting, abilities, fit_many, packed, parameters

__all__ = ["MODELS", "NODES", "packed", "irt_fit", "eap", "irt_predict"]


def irt_fit(resp: DataFrame, model: str = "2PL", priors: bool = True, rounds: int = 200, tol: float = 1e-7) -> tuple[DataFrame, list[float], DataFrame]:
    """Item parameters (question_id, a, b, c), the objective after each kept round, and the packed learners.

    Stops when the objective gains less than tol for each response in a plain step; it does not fall
    (a test checks both). A round is one job; the driver gets a row per item.
    """
    setting = Setting(model, priors)
    learners = packed(resp)
    (fit,) = fit_many(learners, resp, [setting], rounds, tol)
    return parameters(learners, [fit]).drop("setting"), fit.trace, learners


def converged(trace: list[float], limit: float) -> bool:
    return len(trace) > 1 and trace[-1] - trace[-2] < limit


def runaway(params: DataFrame, most: float = 4.0) -> DataFrame:
    """How many discriminations run away (over `most`), as without priors they may."""
    return params.agg(F.count("*").alias("items"), F.count_if(F.col("a") > most).alias("runaway"), F.max("a").alias("largest_a"))


def as_arrays(params: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Items in order, and (a, b, c) of each: a row per item."""
    rows = sorted((int(r["question_id"]), r["a"], r["b"], r["c"]) for r in params.collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], float).reshape(-1, 3)


def eap(learners: DataFrame, params: DataFrame) -> DataFrame:
    """(user_id, theta, sd, loglik, post): posterior mean and sd, marginal log-likelihood, posterior over the nodes."""
    return abilities(learners, {0: (0, *as_arrays(params))}).drop("setting")


def reliability(ability: DataFrame) -> DataFrame:
    v = F.var_pop("theta")
    return ability.agg(F.count("*").alias("learners"), (v / (v + F.avg(F.col("sd") ** 2))).alias("reliability"))


def information_criteria(ability: DataFrame, n_items: int, n_responses: int, model: str) -> DataFrame:
    """Log-likelihood, parameters, AIC, and BIC with N = learners and N = responses."""
    k = n_items + 1 if model == "1PL" else MODELS[model] * n_items
    ll, n = F.sum("loglik"), F.count("*")
    return ability.agg(F.lit(model).alias("model"), ll.alias("loglik"), F.lit(k).alias("k"), (2 * k - 2 * ll).alias("aic"), (k * F.log(n) - 2 * ll).alias("bic"), (k * F.log(F.lit(float(max(1, n_responses)))) - 2 * ll).alias("bic_responses"))


def irt_predict(targets: DataFrame, ability: DataFrame, params: DataFrame) -> DataFrame:
    """targets (user_id, question_id, ...) with p: the item's curve averaged over the learner's posterior."""
    nodes = F.array(*[F.lit(float(x)) for x in normal_nodes(NODES)[0]])
    rows = targets.join(ability.select("user_id", "post").hint("merge"), "user_id").join(params, "question_id")
    curve = F.zip_with("post", nodes, lambda w, t: w * (F.col("c") + (1 - F.col("c")) / (1 + F.exp(-F.col("a") * (t - F.col("b"))))))
    return rows.withColumn("p", F.aggregate(curve, F.lit(0.0), lambda s, x: s + x)).select(*targets.columns, "p")


def item_difficulty(rows: DataFrame, mu: float = 0.0, s2: float = 9.0, a: float | str = 1.0) -> DataFrame:
    """(question_id, b): damped Newton MAP of new items' difficulties from abilities (question_id, theta, y), a fixed: a number or a column.

    Newton's sums are grouped, so an item's rows never meet in one task; all items step together,
    until the largest step is under 1e-9.
    """
    fixed = F.col(a) if isinstance(a, str) else F.lit(float(a))
    state = rows.select("question_id").distinct().withColumn("b", F.lit(float(mu)))
    rows, _ = written(rows.select("question_id", "theta", "y", fixed.alias("_a")), "calibration")
    for _ in range(40):
        p = 1 / (1 + F.exp(-F.col("_a") * (F.col("theta") - F.col("b"))))
        sums = rows.join(state, "question_id").groupBy("question_id").agg(F.first("b").alias("b"), F.sum(-F.col("_a") * (F.col("y") - p)).alias("g"), F.sum(F.col("_a") ** 2 * p * (1 - p)).alias("h"))
        move = (F.col("g") - (F.col("b") - mu) / s2) / (F.col("h") + 1 / s2)
        moved, _ = written(sums.select("question_id", "b", F.least(F.greatest(move, F.lit(-1.0)), F.lit(1.0)).alias("move")), "difficulty")
        state = moved.select("question_id", (F.col("b") + F.col("move")).alias("b"))
        if (moved.agg(F.max(F.abs("move"))).first()[0] or 0.0) < 1e-9:
            break
    return state


def item_difficulty_slope(rows: DataFrame, mu: float = 0.0, s2: float = 9.0, a0: float | str = 1.0, sl2: float = 0.25, steps: int = 60) -> DataFrame:
    """(question_id, a, b): joint MAP of (b, log a) of new items from abilities (question_id, theta, y).

    b ~ N(mu, s2), log a ~ N(log a0, sl2), a0 a number or a column; damped scoring whose sums are grouped, so an item's rows
    never meet in one task and all items step together, until the largest step is under 1e-9.
    """
    centre = F.log(F.col(a0) if isinstance(a0, str) else F.lit(float(a0)))
    rows, _ = written(rows.select("question_id", "theta", "y", centre.alias("_l0")), "calibration")
    state = rows.groupBy("question_id").agg(F.lit(float(mu)).alias("b"), F.first("_l0").alias("l"))
    for _ in range(steps):
        a = F.exp("l")
        z = a * (F.col("theta") - F.col("b"))
        p = 1 / (1 + F.exp(-z))
        e, v = F.col("y") - p, p * (1 - p)
        sums = {"gb": -a * e, "gl": z * e, "hbb": v * a * a, "hbl": -v * a * z, "hll": v * z * z}
        # state: a row an item; written, so that Spark knows how large it is
        summed = rows.join(state, "question_id").groupBy("question_id").agg(F.first("b").alias("b"), F.first("l").alias("l"), F.first("_l0").alias("_l0"), *[F.sum(x).alias(n) for n, x in sums.items()])
        gb, gl = F.col("gb") - (F.col("b") - mu) / s2, F.col("gl") - (F.col("l") - F.col("_l0")) / sl2
        hbb, hll, hbl = F.col("hbb") + 1 / s2, F.col("hll") + 1 / sl2, F.col("hbl")
        det = hbb * hll - hbl * hbl
        bound = lambda x, most: F.least(F.greatest(x, F.lit(-most)), F.lit(most))
        moves = summed.select("question_id", "b", "l", bound((hll * gb - hbl * gl) / det, 1.0).alias("mb"), bound((hbb * gl - hbl * gb) / det, 0.5).alias("ml"))
        moved, _ = written(moves.select("question_id", (F.col("b") + F.col("mb")).alias("b"), (F.col("l") + F.col("ml")).alias("l"), F.greatest(F.abs("mb"), F.abs("ml")).alias("move")), "difficulty")
        state = moved.drop("move")
        if (moved.agg(F.max("move")).first()[0] or 0.0) < 1e-9:
            break
    return state.select("question_id", F.exp("l").alias("a"), "b")


def new_learner_holdout(resp: DataFrame, model: str = "2PL", seed: int = 0) -> DataFrame:
    """Held-out answers of new learners: parameters from 80 % of the learners, ability from half of
    the answers of the rest, p for the other half. Shares are hashed, so partitioning has no say."""
    from ..functions.scalars import hash01

    new = hash01(F.col("user_id"), seed=seed) < 0.2
    seen = hash01(F.col("user_id"), F.col("question_id"), seed=seed + 1) < 0.5
    rows, _ = written(resp.select("user_id", "question_id", "y").withColumn("_new", new).withColumn("_seen", seen), "new-learners")
    params, _, _ = irt_fit(rows.where("not _new").drop("_new", "_seen"), model)
    ability = eap(packed(rows.where("_new and _seen").drop("_new", "_seen")), params)
    return irt_predict(rows.where("_new and not _seen").drop("_new", "_seen"), ability, params)


def series_ability(resp: DataFrame, params: DataFrame) -> DataFrame:
    """Abilities of learners in two series, each from its own items: n, r, reliabilities and disattenuated r by pair of series."""
    known = as_arrays(params)
    names = [int(r[0]) for r in resp.select("series_id").distinct().collect()]  # a row a series
    ability = abilities(packed(resp, "series_id"), {k: (k, *known) for k in names})
    parts, _ = written(ability.select("user_id", F.col("setting").alias("series"), "theta", "sd"), "series")
    v = F.var_pop("theta")
    rel = parts.groupBy("series").agg((v / (v + F.avg(F.col("sd") ** 2))).alias("rel"))
    pairs = parts.alias("a").join(parts.alias("b"), F.expr("a.user_id = b.user_id and a.series < b.series")).groupBy(F.col("a.series").alias("series_a"), F.col("b.series").alias("series_b")).agg(F.count("*").alias("n"), F.corr("a.theta", "b.theta").alias("r"))
    out = pairs.join(rel.select(F.col("series").alias("series_a"), F.col("rel").alias("rel_a")), "series_a").join(rel.select(F.col("series").alias("series_b"), F.col("rel").alias("rel_b")), "series_b")
    return out.withColumn("r_disattenuated", F.col("r") / F.sqrt(F.col("rel_a") * F.col("rel_b")))
