"""Studies of fitted response models: priors of c, errors of discriminations, a null of Q3, calibration of new items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import newton_ab, newton_b, normal_nodes, upper_gamma
from ..functions.scalars import hash01, sigmoid
from ..sources.scratch import written
from .irt import irt_predict, item_difficulty, item_difficulty_slope
from .irt_many import NODES, Fit, Setting, abilities_of, fit_many, packed, parameters, posteriors, slices, unpacked
from .responses import q3

C_PRIORS = ((5, 17), (2.5, 7.5), (1, 3), (2, 18))


# -- priors of c -----------------------------------------------------------------


def prior_sensitivity(resp: DataFrame, c_priors: tuple[tuple[float, float], ...] = C_PRIORS, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """The 3PL under several Beta priors of c: (prior, prior_mean, mean_c, sd_c, loglik, converged), and held-out (prior, user_id, question_id, y, p).

    resp: (user_id, question_id, y, held). All fits, on all rows and without the held ones, are one EM.
    """
    both = resp.select("user_id", "question_id", "y", F.explode(F.when(F.col("held"), F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).alias("grp"))
    both, _ = written(both, "prior-rows")
    learners = packed(both, "grp")
    n = len(c_priors)
    fits = fit_many(learners, both, [Setting("3PL", c_prior=c, group=g) for g in (0, 1) for c in c_priors], rounds)
    names = [f"Beta({a:g},{b:g})" for a, b in c_priors]
    rows = [(name, a / (a + b), float(f.curves()[:, 2].mean()) if len(f.items) else None, float(f.curves()[:, 2].std()) if len(f.items) else None, f.loglik, f.converged) for name, (a, b), f in zip(names, c_priors, fits)]
    table = resp.sparkSession.createDataFrame(rows, "prior string, prior_mean double, mean_c double, sd_c double, loglik double, converged boolean")
    ability, params, held = abilities_of(learners, fits).where(F.col("setting") >= n), parameters(learners, fits).where(F.col("setting") >= n), resp.where("held").select("user_id", "question_id", "y")
    ability, _ = written(ability, "abilities")
    out = None
    for k, name in enumerate(names):
        own = lambda df: df.where(F.col("setting") == n + k).drop("setting")  # noqa: E731, B023
        part = irt_predict(held, own(ability), own(params)).withColumn("prior", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return table, out


# -- standard errors of discriminations ------------------------------------------

#: Items of a block of the information matrix, and items whose matrix the driver inverts at most (128 MB).
INFO_BLOCK, MOST_INFORMED = 64, 2000


def information(learners: DataFrame, fit: Fit) -> np.ndarray:
    """The observed information of a 2PL posterior at fit.x, in (b, log a) item by item: complete less missing information.

    A learner's part is the expected curvature less the posterior covariance of its scores; tasks add
    up blocks of pairs of items over their learners, and blocks are added in two steps.
    """
    if len(fit.items) > MOST_INFORMED:
        raise ValueError(f"the information matrix is inverted on the driver: at most {MOST_INFORMED} items")
    items, x = fit.items, fit.x
    nodes, weights = normal_nodes(NODES)
    blocks = -(-len(items) // INFO_BLOCK)
    width = 2 * INFO_BLOCK
    shared = learners.sparkSession.sparkContext.broadcast((items, x))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, x = shared.value
        z = np.exp(x[:, 1:2]) * (nodes - x[:, 0:1])
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -35, 35))), 1e-10, 1 - 1e-10)
        a, v = np.exp(x[:, 1]), p * (1 - p)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches):
            at, y, learner = unpacked(batch, items)
            post, _ = posteriors(at, y, learner, len(batch), np.log(p), np.log(1 - p), weights)
            edges = np.searchsorted(learner, np.arange(len(batch) + 1))
            for u in range(len(batch)):
                own, mine, w = at[edges[u] : edges[u + 1]], y[edges[u] : edges[u + 1], None], post[u]
                if not len(own):
                    continue
                e = mine - p[own]
                score = np.stack((-a[own, None] * e, z[own] * e), axis=1).reshape(-1, NODES)  # b, log a of each item in turn
                mean = score @ w
                part = np.outer(mean, mean) - (score * w) @ score.T
                k = 2 * np.arange(len(own))
                vw, ew = v[own] * w, e * w
                cross = a[own] * (ew.sum(1) - (vw * z[own]).sum(1))
                part[k, k] += a[own] ** 2 * vw.sum(1)
                part[k, k + 1] += cross
                part[k + 1, k] += cross
                part[k + 1, k + 1] += (vw * z[own] ** 2 - ew * z[own]).sum(1)
                place, block = np.stack((2 * own, 2 * own + 1), axis=1).ravel(), np.repeat(own // INFO_BLOCK, 2)
                for i in np.unique(block):
                    for j in np.unique(block):
                        if i <= j:
                            m = sums.setdefault((int(i), int(j)), np.zeros((width, width)))
                            left, right = block == i, block == j
                            m[np.ix_(place[left] - i * width, place[right] - j * width)] += part[np.ix_(left, right)]
        yield pd.DataFrame([(i, j, m.ravel().tolist()) for (i, j), m in sums.items()], columns=["i", "j", "m"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "j": [rows["j"].iloc[0]], "m": [sum(np.array(m) for m in rows["m"]).tolist()]})

    shape = "i int, j int, m array<double>"
    parts = learners.mapInPandas(add, shape).withColumn("lot", F.floor(F.spark_partition_id() / 32))
    found = parts.groupBy("i", "j", "lot").applyInPandas(lambda rows: summed(rows), shape).groupBy("i", "j").applyInPandas(lambda rows: summed(rows), shape).toPandas()
    out = np.zeros((blocks * width, blocks * width))
    for i, j, m in zip(found["i"], found["j"], found["m"]):
        m = np.array(m).reshape(width, width)
        out[i * width : (i + 1) * width, j * width : (j + 1) * width] = m
        out[j * width : (j + 1) * width, i * width : (i + 1) * width] = m.T
    n = 2 * len(items)
    out = out[:n, :n]
    out[np.arange(n), np.arange(n)] += np.tile([1 / 9, 4.0], len(items)) if fit.setting.priors else 0.0
    return out


def discrimination_errors(learners: DataFrame, fit: Fit, common: float) -> DataFrame:
    """(question_id, a, se_log_a, low, high, excludes_common): posterior standard errors of log a, 95 % intervals, and whether these leave out a common a."""
    spark = learners.sparkSession
    shared = spark.sparkContext.broadcast(information(learners, fit) if len(fit.items) else np.zeros((0, 0)))

    def inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"v": np.diag(np.linalg.inv(shared.value))[1::2]})

    # in a task, which has one thread for linear algebra; the matrix is bounded
    variances = spark.range(1, numPartitions=1).mapInPandas(inverted, "v double").toPandas()["v"].to_numpy(float)
    se, la = np.sqrt(np.maximum(variances, 0)), fit.x[:, 1]
    low, high = np.exp(la - 1.96 * se), np.exp(la + 1.96 * se)
    rows = [(int(q), float(np.exp(v)), float(s), float(lo), float(hi), bool(lo > common or hi < common)) for q, v, s, lo, hi in zip(fit.items, la, se, low, high)]
    return spark.createDataFrame(rows, "question_id long, a double, se_log_a double, low double, high double, excludes_common boolean")


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.count("*").alias("items"),
        F.percentile("se_log_a", 0.5).alias("median_se"),
        F.sqrt(F.avg(F.col("se_log_a") ** 2)).alias("rms_se"),
        F.stddev_pop(F.log("a")).alias("sd_log_a"),
        F.count_if("excludes_common").alias("excluding_common"),
        F.count_if(F.col("a") < 0.5).alias("below_half"),
        F.count_if(F.col("high") < 0.5).alias("surely_below_half"),
    )


def likelihood_ratio(learners: DataFrame, one: Fit, two: Fit) -> DataFrame:
    """(lr, df, p, loglik_1pl, loglik_2pl, runaway): 1PL against 2PL, both without priors; with runaway discriminations the test is not to be trusted."""
    lr, df = 2 * (two.loglik - one.loglik), len(two.items) - 1
    a = two.curves()[:, 0]
    row = (float(lr), df, upper_gamma(df / 2, lr / 2) if df > 0 else None, float(one.loglik), float(two.loglik), int(((a < 0.05) | (a > 20)).sum()))
    rows = [row] if len(two.items) else []
    return learners.sparkSession.createDataFrame(rows, "lr double, df int, p double, loglik_1pl double, loglik_2pl double, runaway int")


# -- a null of residual correlations ------------------------------------------------


def residuals(resp: DataFrame, ability: DataFrame, params: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, user_id, question_id, r): y less p at the learner's mean ability."""
    # a row a learner (and replicate): Spark's estimate of it is far too low, and the driver would hold it for a broadcast
    rows = resp.join(ability.select(*keys, "user_id", "theta").hint("merge"), [*keys, "user_id"]).join(params.select(*keys, "question_id", "a", "b", "c"), [*keys, "question_id"])
    p = F.col("c") + (1 - F.col("c")) * sigmoid(F.col("a") * (F.col("theta") - F.col("b")))
    return rows.select(*keys, "user_id", "question_id", (F.col("y") - p).alias("r"))


def drawn_abilities(ability: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """(grp, user_id, theta): a node of each learner's posterior for each replicate, by a hashed number."""
    nodes = F.array(*[F.lit(float(v)) for v in normal_nodes(NODES)[0]])
    u = hash01(F.col("user_id"), F.col("grp"), seed=seed)
    rows = ability.select("user_id", "post", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("grp")).withColumn("_u", u)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    place = F.aggregate("post", start, lambda acc, w: F.struct((acc["s"] + w).alias("s"), (acc["k"] + F.when(acc["s"] + w <= F.col("_u"), 1).otherwise(0)).alias("k")), lambda acc: acc["k"])
    return rows.select("grp", "user_id", F.get(nodes, F.least(place, F.lit(NODES - 1))).alias("theta"))


def simulated_logs(resp: DataFrame, ability: DataFrame, params: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """(grp, user_id, question_id, y): the log answered anew under the fitted model, once a replicate; md5 draws, so partitioning has no say."""
    rows = resp.select("user_id", "question_id").join(drawn_abilities(ability, reps, seed).hint("merge"), "user_id").join(params.select("question_id", "a", "b", "c"), "question_id")
    p = F.col("c") + (1 - F.col("c")) * sigmoid(F.col("a") * (F.col("theta") - F.col("b")))
    y = (hash01(F.col("user_id"), F.col("question_id"), F.col("grp"), seed=seed + 1) < p).cast("int")
    return rows.select("grp", "user_id", "question_id", y.alias("y"))


def q3_null(resp: DataFrame, reps: int = 30, min_common: int = 50, cut: float = 0.2, seed: int = 0, rounds: int = 100) -> DataFrame:
    """Local dependence against a parametric bootstrap: (kind, rep, pairs, mean_q3, share_over, q99, q999, largest, threshold, above, expected).

    kind 'observed' has the log itself and `above`, its pairs beyond `threshold` (the 99.9th
    percentile of abs(Q3 - mean) over all replicates), against `expected`; kind 'null' has each of
    the replicates: abilities from the posteriors, answers from the fitted 2PL, the model refitted.
    """
    resp, _ = written(resp.select("user_id", "question_id", "y"), "responses")
    learners = packed(resp)
    fits = fit_many(learners, resp, [Setting("2PL")])
    ability, _ = written(abilities_of(learners, fits).drop("setting"), "abilities")
    params = parameters(learners, fits).drop("setting")
    seen = q3(residuals(resp, ability, params), min_common).withColumn("rep", F.lit(-1).cast("long"))
    logs, _ = written(simulated_logs(resp, ability, params, reps, seed), "replicates")
    many = packed(logs, "grp")
    again = fit_many(many, logs, [Setting("2PL", group=g) for g in range(reps)], rounds, start={g: (fits[0].items, fits[0].x) for g in range(reps)})
    keyed = lambda df: df.withColumn("grp", F.col("setting").cast("long")).drop("setting")  # noqa: E731  setting k is of group k
    drawn = q3(residuals(logs, keyed(abilities_of(many, again)), keyed(parameters(many, again)), ("grp",)), min_common, ("grp",)).withColumnRenamed("grp", "rep")
    rows, _ = written(seen.select("rep", "q3").unionByName(drawn.select("rep", "q3")).where("q3 is not null"), "q3")
    centred, _ = written(rows.join(rows.groupBy("rep").agg(F.avg("q3").alias("mean")), "rep").withColumn("s", F.col("q3") - F.col("mean")), "q3-centred")
    threshold = centred.where("rep >= 0").agg(F.percentile(F.abs("s"), 0.999).alias("threshold"))
    each = centred.crossJoin(F.broadcast(threshold)).groupBy("rep").agg(
        F.count("*").alias("pairs"),
        F.first("mean").alias("mean_q3"),
        F.avg((F.abs("s") > cut).cast("double")).alias("share_over"),
        F.percentile("s", 0.99).alias("q99"),
        F.percentile("s", 0.999).alias("q999"),
        F.max("s").alias("largest"),
        F.first("threshold").alias("threshold"),
        F.count_if(F.abs("s") > F.col("threshold")).alias("above"),
    )
    kind = F.when(F.col("rep") < 0, "observed").otherwise("null")
    return each.select(kind.alias("kind"), *each.columns, (0.001 * F.col("pairs")).alias("expected"))


# -- calibration of new items ----------------------------------------------------------

KS, DRAWS, FOLDS = (5, 10, 20, 40, 60, 80), 200, 5
TREATMENTS = ("one", "anchors", "joint")


def leave_item_out(resp: DataFrame, ability: DataFrame, params: DataFrame) -> DataFrame:
    """(user_id, question_id, y, theta): mean ability without the answer itself, its likelihood divided out of the posterior."""
    nodes = F.array(*[F.lit(float(v)) for v in normal_nodes(NODES)[0]])
    rows = resp.select("user_id", "question_id", "y").join(ability.select("user_id", "post").hint("merge"), "user_id").join(params, "question_id")

    def left(w: Column, t: Column) -> Column:
        p = F.col("c") + (1 - F.col("c")) * sigmoid(F.col("a") * (t - F.col("b")))
        p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
        m = w / F.when(F.col("y") > 0, p).otherwise(1 - p)
        return F.struct(m.alias("m"), (m * t).alias("mt"))

    total = F.aggregate(F.zip_with("post", nodes, left), F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("mt")), lambda s, x: F.struct((s["m"] + x["m"]).alias("m"), (s["mt"] + x["mt"]).alias("mt")), lambda s: s["mt"] / s["m"])
    return rows.select("user_id", "question_id", "y", total.alias("theta"))


def item_fold(key: Column, folds: int = FOLDS, seed: int = 0) -> Column:
    return F.floor(hash01(key, seed=seed) * folds).cast("int")


def fold_priors(truth: DataFrame, texts: list[str], folds: int = FOLDS, weak: float = 9.0) -> DataFrame:
    """(question_id, priors: array of (name, mu, s2)): a weak prior, the population's, and one from each text prediction, all from the other folds.

    truth: (question_id, truth, fold, texts...). A text's prior is its linear fit and the variance that leaves.
    """
    others = truth.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_to <> fold")
    sums = [F.avg("truth").alias("_m"), F.var_pop("truth").alias("_v")]
    for t in texts:
        known = lambda c: F.when(F.col(t).isNotNull(), F.col(c))  # noqa: E731, B023
        sums += [F.regr_slope("truth", F.col(t)).alias(f"_k_{t}"), F.regr_intercept("truth", F.col(t)).alias(f"_i_{t}"), (F.var_pop(known("truth")) * (1 - F.coalesce(F.regr_r2("truth", F.col(t)), F.lit(0.0)))).alias(f"_s_{t}")]
    fit = others.groupBy(F.col("_to").alias("fold")).agg(*sums)
    rows = truth.join(F.broadcast(fit), "fold", "left")  # a row a fold
    least = lambda v: F.greatest(F.coalesce(v, F.lit(weak)), F.lit(1e-6))
    entry = lambda name, mu, s2: F.struct(F.lit(name).alias("name"), F.coalesce(mu, F.lit(0.0)).alias("mu"), s2.alias("s2"))
    priors = [entry("weak", F.lit(0.0), F.lit(weak)), entry("population", F.col("_m"), least(F.col("_v")))]
    priors += [entry(f"text:{t}", F.coalesce(F.col(f"_i_{t}") + F.col(f"_k_{t}") * F.col(t), F.col("_m")), least(F.coalesce(F.col(f"_s_{t}"), F.col("_v")))) for t in texts]
    return rows.select("question_id", "truth", F.array(*priors).alias("priors"))


def estimate(treatment: str, theta, y, mask, abar, mu, s2) -> np.ndarray:
    if treatment == "joint":
        return newton_ab(theta, y, mask, np.log(abar), mu, s2)[0]
    return newton_b(theta, y, mask, np.ones(len(mu)) if treatment == "one" else abar, mu, s2)


#: A draw looks first at answers whose hashed place is among so many times the largest sample.
AHEAD = 3


def drawn_samples(rows: DataFrame, most: int, draws: int, seed: int = 0) -> DataFrame:
    """(question_id, draw, s): the first `most` answers (place, theta, y, abar) of each of an item's hashed orders, in order.

    Hashes are uniform, so the first answers are those under a bound of AHEAD * most / n: only
    these are shuffled, some numbers an item and draw whatever the log holds. A draw that has fewer
    under the bound goes over all of its item's answers.
    """
    rows = rows.select("question_id", "user_id", "theta", "y", "abar")
    sizes, _ = written(rows.groupBy("question_id").agg(F.count("*").alias("_n")), "sizes")
    u = hash01(F.col("question_id"), F.col("user_id"), F.col("draw"), seed=seed)
    order = lambda entry: F.slice(F.sort_array(F.collect_list(entry)), 1, most)
    entry = F.struct("_u", "user_id", "theta", "y", "abar")
    each = rows.join(F.broadcast(sizes), "question_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", u)  # a row an item is sent
    near = each.where(F.col("_u") * F.col("_n") <= AHEAD * most).groupBy("question_id", "draw").agg(order(entry).alias("_s"), F.count("*").alias("_k"))
    near, _ = written(near, "samples")
    every = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    short = every.join(near, ["question_id", "draw"], "left").where(F.coalesce("_k", F.lit(0)) < F.least(F.lit(most), "_n")).select("question_id", "draw")
    short, _ = written(short, "short-draws")
    whole = near.where(F.col("_k") < 0)
    if short.limit(1).count():
        again = rows.join(F.broadcast(short), "question_id").withColumn("_u", u)
        place = Window.partitionBy("question_id", "draw").orderBy("_u", "user_id")
        whole = again.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).groupBy("question_id", "draw").agg(order(entry).alias("_s"), F.count("*").alias("_k"))
    found = near.join(short, ["question_id", "draw"], "left_anti").unionByName(whole)
    return found.select("question_id", "draw", F.transform("_s", lambda x, i: F.struct((i + 1).alias("place"), x["theta"].alias("theta"), x["y"].alias("y"), x["abar"].alias("abar"))).alias("s"))


def calibration_errors(rows: DataFrame, priors: DataFrame, ks: tuple[int, ...] = KS, draws: int = DRAWS, treatment: str = "one", seed: int = 0) -> DataFrame:
    """(question_id, prior, k, mse): mean squared error of difficulties from k answers, over draws without replacement.

    rows: (question_id, user_id, theta, y, abar); priors: of fold_priors, with the truth. A draw is a
    hashed order of an item's answers, and its first k are the sample; k = 0 is the prior's mean. An
    item with fewer than k answers has no row for that k.
    """
    return sample_errors(written(drawn_samples(rows, max(ks), draws, seed), "drawn")[0], priors, ks, treatment)


def sample_errors(samples: DataFrame, priors: DataFrame, ks: tuple[int, ...], treatment: str) -> DataFrame:
    """`calibration_errors` of samples that are drawn already."""
    most = max(ks)
    samples = samples.withColumn("abar", F.col("s")[0]["abar"]).join(priors, "question_id")  # at most `most` answers a draw
    flat = samples.select("question_id", "abar", "truth", F.col("s.theta").alias("theta"), F.col("s.y").alias("y"), F.col("priors.name").alias("names"), F.col("priors.mu").alias("mu"), F.col("priors.s2").alias("s2"))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.fromiter(map(len, batch["theta"]), np.int64, len(batch))
            theta, y = np.zeros((len(batch), most)), np.zeros((len(batch), most))
            row, place = np.repeat(np.arange(len(batch)), size), np.concatenate([np.arange(n) for n in size]) if len(batch) else np.zeros(0, int)
            if len(row):
                theta[row, place], y[row, place] = np.concatenate(batch["theta"].tolist()), np.concatenate(batch["y"].tolist())
            names = list(batch["names"].iloc[0]) if len(batch) else []
            mu, s2 = (np.array(batch[c].tolist(), float).reshape(len(batch), -1) for c in ("mu", "s2"))
            truth, abar, item = batch["truth"].to_numpy(), batch["abar"].to_numpy(), batch["question_id"].to_numpy()
            for k in ks:
                some = size >= k
                for n, name in enumerate(names if some.any() else []):
                    b = estimate(treatment, theta[some, :k], y[some, :k], np.ones((int(some.sum()), k)), abar[some], mu[some, n], s2[some, n])
                    yield pd.DataFrame({"question_id": item[some], "prior": name, "k": k, "e": (b - truth[some]) ** 2})

    drawn = flat.mapInPandas(step, "question_id long, prior string, k int, e double").groupBy("question_id", "prior", "k").agg(F.avg("e").alias("mse"))
    none = priors.select("question_id", "truth", F.explode("priors").alias("p")).select("question_id", F.col("p.name").alias("prior"), F.lit(0).alias("k"), ((F.col("p.mu") - F.col("truth")) ** 2).alias("mse"))
    return drawn.unionByName(none)


def equivalent_answers(rmse: dict[int, float], value: float) -> float | None:
    """How many answers under the weak prior give this error: its curve inverted on log k, and beyond its start error ~ 1/sqrt(k)."""
    known = sorted((k, v) for k, v in rmse.items() if k > 0 and v is not None)
    if not known or value is None:
        return None
    (k0, top), ks, curve = known[0], np.log([k for k, _ in known]), np.array([v for _, v in known])
    if value >= top:
        return float(k0 * (top / value) ** 2)
    return float(np.exp(np.interp(-value, -np.minimum.accumulate(curve), ks)))


def calibration_report(errors: DataFrame, by: tuple[str, ...] = (), reps: int = 1000) -> DataFrame:
    """(by, prior, k, items, rmse, ci_low, ci_high, less_population, less_low, less_high, equivalent_k) with intervals over items."""
    from .metrics import bootstrap

    errors, _ = written(errors, "calibration-errors")
    keys = [*by, "prior", "k"]
    own = bootstrap(errors, ["question_id"], {"n": F.lit(1.0), "e": F.col("mse")}, {"rmse": "sqrt(e / n)"}, reps, by=keys)
    own = own.select(*keys, F.col("value").alias("rmse"), "ci_low", "ci_high").join(errors.groupBy(*keys).agg(F.count("*").alias("items")), keys)
    population = errors.where("prior = 'population'").select("question_id", *by, "k", F.col("mse").alias("base"))
    pairs = errors.join(population, ["question_id", *by, "k"])
    less = bootstrap(pairs, ["question_id"], {"n": F.lit(1.0), "e": F.col("mse"), "b": F.col("base")}, {"less": "sqrt(e / n) - sqrt(b / n)"}, reps, by=keys)
    less = less.select(*keys, F.col("value").alias("less_population"), F.col("ci_low").alias("less_low"), F.col("ci_high").alias("less_high"))
    table = own.join(less, keys, "left").toPandas()  # a row a prior and k
    table["equivalent_k"] = None
    for _, rows in table.groupby(list(by)) if by else [((), table)]:
        weak = rows[rows["prior"] == "weak"].set_index("k")["rmse"].to_dict()
        table.loc[rows.index, "equivalent_k"] = [equivalent_answers(weak, v) if k else None for k, v in zip(rows["k"], rows["rmse"])]
    kinds = dict(errors.dtypes)
    shape = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "items long", *(f"{c} double" for c in ("rmse", "ci_low", "ci_high", "less_population", "less_low", "less_high", "equivalent_k"))])
    names = [c.split()[0] for c in shape.split(", ")]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in table[names].astype(object).itertuples(index=False)]
    return errors.sparkSession.createDataFrame(rows, shape)


def calibration(resp: DataFrame, texts: DataFrame, ks: tuple[int, ...] = KS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Report of how well k answers place a new item, by prior: abilities without the item, truth from all its answers.

    resp: (user_id, question_id, y); texts: (question_id, a column a text prediction).
    """
    names = [c for c in texts.columns if c != "question_id"]
    resp, _ = written(resp.select("user_id", "question_id", "y"), "responses")
    learners = packed(resp)
    fits = fit_many(learners, resp, [Setting("2PL")])
    rows, _ = written(leave_item_out(resp, abilities_of(learners, fits), parameters(learners, fits).drop("setting")).withColumn("abar", F.lit(1.0)), "left-out")
    truth = item_difficulty(rows).withColumnRenamed("b", "truth").join(texts, "question_id", "left").withColumn("fold", item_fold(F.col("question_id"), seed=seed))
    priors, _ = written(fold_priors(truth, names), "priors")
    return calibration_report(calibration_errors(rows, priors, ks, draws, "one", seed))


def cross_fits(resp: DataFrame, folds: int = FOLDS, seed: int = 0) -> tuple[DataFrame, list[Fit], DataFrame]:
    """Five fits in one EM, each without a fold of items: (question_id, user_id, y, theta, fold, abar, half), the fits, and the folds of items.

    theta comes from the anchors, items of the other folds; abar is their geometric mean
    discrimination; half (0 reference, 1 calibration) is hashed.
    """
    resp, _ = written(resp.select("user_id", "question_id", "y"), "responses")
    items = resp.select("question_id").distinct().withColumn("fold", item_fold(F.col("question_id"), folds, seed))
    known = items.toPandas()  # a row an item
    learners = packed(resp)
    fits = fit_many(learners, resp, [Setting("2PL", without=frozenset(known[known["fold"] == f]["question_id"].tolist())) for f in range(folds)])
    means = resp.sparkSession.createDataFrame([(f, float(np.exp(fit.x[:, 1].mean())) if len(fit.items) else 1.0) for f, fit in enumerate(fits)], "fold int, abar double")
    ability = abilities_of(learners, fits).select(F.col("setting").alias("fold"), "user_id", "theta")
    half = (hash01(F.col("question_id"), F.col("user_id"), seed=seed + 7) >= 0.5).cast("int")
    rows = resp.join(items, "question_id").join(ability.hint("merge"), ["fold", "user_id"]).join(F.broadcast(means), "fold")
    return written(rows.withColumn("half", half), "cross-fitted")[0], fits, items


def treated_truth(rows: DataFrame, treatment: str) -> DataFrame:
    """(question_id, truth): difficulties from the given answers under a treatment of a: 1, the anchors' mean, or estimated jointly."""
    if treatment == "joint":
        return item_difficulty_slope(rows, a0="abar").select("question_id", F.col("b").alias("truth"))
    return item_difficulty(rows, a=1.0 if treatment == "one" else "abar").withColumnRenamed("b", "truth")


def calibration_crossfit(resp: DataFrame, texts: DataFrame, ks: tuple[int, ...] = KS[:4], draws: int = DRAWS, treatments: tuple[str, ...] = TREATMENTS, seed: int = 0) -> DataFrame:
    """The report of `calibration` with anchors refitted without each item's fold, by treatment of a and reference.

    reference 'half': truth from one hashed half of an item's answers, samples from the other;
    'all': both from all of them.
    """
    names = [c for c in texts.columns if c != "question_id"]
    rows, _, items = cross_fits(resp, seed=seed)
    drawn = {r: written(drawn_samples(rows.where("half = 1") if r == "half" else rows, max(ks), draws, seed), "drawn")[0] for r in ("half", "all")}  # a draw serves all treatments
    out = None
    for treatment in treatments:
        for reference in ("half", "all"):
            known = rows.where("half = 0") if reference == "half" else rows
            truth = treated_truth(known, treatment).join(items, "question_id").join(texts, "question_id", "left")
            priors, _ = written(fold_priors(truth, names), "priors")
            part = sample_errors(drawn[reference], priors, ks, treatment).withColumns({"treatment": F.lit(treatment), "reference": F.lit(reference)})
            out = part if out is None else out.unionByName(part)
    return calibration_report(out, ("treatment", "reference"))
