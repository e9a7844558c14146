"""Registered studies of response and rating models: parameters, errors, dependence, calibration, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash01
from ..operators import irt, irt_multi, irt_studies, metrics, ratings, responses, text
from ..operators.irt_many import Setting, abilities_of, fit_many, packed, parameters
from ..operators.ordering import cuts, time_split
from ..sources.scratch import written
from ..sources.standins import view
from .extended import rounded
from .queries import ADDITIVE, GAMES, K24, ORACLE_SQL, PRUNE, SCORED, duck_scores, job, ordered_games, score_rows, scored, split_bank


def kept(spark, sf_dir) -> DataFrame:
    """The pruned log with its hashed hold-out."""
    return written(responses.holdout(responses.prune(scored(spark, sf_dir))), "responses")[0]


def item_texts(spark, sf_dir) -> DataFrame:
    """(question_id, ridge): difficulty that a ridge on bank texts predicts; the first 100 items, which stand for the questions, are never trained on."""
    bank = split_bank(spark, sf_dir).select("id", "text", "b_logit")
    r = hash01(F.col("id"))
    bank = bank.withColumn("split", F.when(F.col("id") <= 100, "test").when(r < 0.9, "train").otherwise("val"))
    pred = text.text_ridge(bank, "id", text.word_grams(F.col("text")), "b_logit").where("split = 'test'")
    return written(pred.select((F.col("id") - 1).alias("question_id"), F.col("yhat").alias("ridge")), "item-texts")[0]


# -- parameters and their errors ----------------------------------------------------


@job()
def irt_prior_sensitivity(spark, sf_dir):
    """The 3PL under four priors of c: guessing, log-likelihood, and held-out scores, by one EM."""
    table, held = irt_studies.prior_sensitivity(kept(spark, sf_dir))
    scores = metrics.binary_scores(held, ["prior"]).select("prior", "n", "auc", "log_loss")
    return table.join(scores, "prior", "left")


@job()
def irt_discrimination_errors(spark, sf_dir):
    """Posterior standard errors of log a of the 2PL, and whether an item's interval leaves out the common a of the 1PL."""
    rows = kept(spark, sf_dir)
    learners = packed(rows)
    one, two = fit_many(learners, rows, [Setting("1PL"), Setting("2PL")])
    common = float(one.curves()[0, 0]) if len(one.items) else 1.0
    return irt_studies.discrimination_errors(learners, two, common)


@job()
def irt_error_summary(spark, sf_dir):
    return irt_studies.error_summary(irt_discrimination_errors(spark, sf_dir))


@job()
def irt_likelihood_ratio(spark, sf_dir):
    """1PL against 2PL without priors: likelihood ratio, degrees of freedom, its chi-square tail, and runaway discriminations."""
    rows = kept(spark, sf_dir)
    learners = packed(rows)
    fits = fit_many(learners, rows, [Setting("1PL", priors=False), Setting("2PL", priors=False)])
    return irt_studies.likelihood_ratio(learners, *fits)


@job()
def irt_fit_report(spark, sf_dir):
    """Shares and medians of infit and outfit under the 2PL."""
    rows = kept(spark, sf_dir)
    learners = packed(rows)
    fits = fit_many(learners, rows, [Setting("2PL")])
    fit = responses.item_fit(rows, parameters(learners, fits).drop("setting"), abilities_of(learners, fits).select("user_id", "theta"))
    return responses.fit_summary(fit)


# -- dependence ------------------------------------------------------------------------


@job(
    f"""WITH {SCORED}, {ADDITIVE.replace('WHERE held)', ')')}, res AS (SELECT user_id, question_id, y - p AS r FROM pred),
    q AS (SELECT a.question_id AS i, b.question_id AS j, corr(a.r, b.r) AS q3 FROM res a JOIN res b USING (user_id) WHERE a.question_id < b.question_id GROUP BY 1, 2 HAVING count(*) >= 30),
    k AS (SELECT i % 3 = j % 3 AS same, q3, (SELECT avg(q3) FROM q) AS m FROM q)
    SELECT count(*) AS pairs, round(avg(q3), 6) AS mean_q3, round(avg((abs(q3 - m) > 0.2)::INT), 6) AS share_over, count(*) FILTER (WHERE same) AS pairs_same, round(avg(q3) FILTER (WHERE same), 6) AS mean_same, round(avg(q3) FILTER (WHERE NOT same), 6) AS mean_different FROM k""",
    "resp_raw",
    "answer_keys",
)
def q3_report(spark, sf_dir):
    """Residual correlations of the additive predictor: centred shares, and pairs of one series against two."""
    rows, _ = written(responses.holdout(scored(spark, sf_dir)), "holdout")
    pred = responses.additive_predict(rows.where("not held"), rows).withColumn("p", F.round("p", 9))
    pairs = responses.q3(pred.select("user_id", "question_id", (F.col("y") - F.col("p")).alias("r")), 30)
    kinds = rows.select("question_id", (F.col("question_id") % 3).alias("kind")).distinct()
    return rounded(responses.q3_summary(written(pairs, "q3")[0], kinds), "mean_q3", "share_over", "mean_same", "mean_different")


@job()
def irt_q3_null(spark, sf_dir):
    """Observed residual correlations against 30 simulated and refitted logs."""
    return irt_studies.q3_null(kept(spark, sf_dir), reps=30, min_common=30)


@job()
def irt_multi_items(spark, sf_dir):
    """Items of the model with a trait a series."""
    rows = kept(spark, sf_dir)
    return irt_multi.irt_fit_multi(rows, responses.item_series(rows))[0]


@job()
def irt_multi_comparison(spark, sf_dir):
    """One trait against one a series: log-likelihood, criteria, latent correlations, and held-out scores."""
    rows = kept(spark, sf_dir)
    series = written(responses.item_series(rows), "series")[0]
    train, held = rows.where("not held"), rows.where("held").select("user_id", "question_id", "y")
    learners = packed(train)
    fits = fit_many(learners, train, [Setting("2PL")])
    one = irt.irt_predict(held, abilities_of(learners, fits), parameters(learners, fits).drop("setting"))
    params, corr, figures, multi = irt_multi.irt_fit_multi(train, series)
    many = irt_multi.predict_multi(multi, held, params, corr)
    preds = one.select("y", "p", F.lit("one").alias("model")).unionByName(many.select("y", "p", F.lit("by series").alias("model")))
    scores = metrics.binary_scores(preds, ["model"]).select("model", "n", "auc", "log_loss")
    d, n, learned = len(figures["series"]), figures["items"], max(1, figures["learners"])
    extra = d * (d - 1) // 2
    names = [f"{a}-{b}" for k, a in enumerate(figures["series"]) for b in figures["series"][k + 1 :]]
    values = [float(corr[i, j]) for i in range(d) for j in range(i + 1, d)]
    table = [("one", 2 * n, fits[0].loglik, learned, None), ("by series", 2 * n + extra, figures["loglik"], learned, ", ".join(f"{n}: {v:.6f}" for n, v in zip(names, values)))]
    table = spark.createDataFrame(table, "model string, k int, loglik double, learners int, correlations string")
    table = table.withColumn("aic", 2 * F.col("k") - 2 * F.col("loglik")).withColumn("bic", F.col("k") * F.log("learners") - 2 * F.col("loglik"))
    return table.join(scores, "model", "left")


# -- calibration --------------------------------------------------------------------------


@job()
def irt_calibration(spark, sf_dir):
    """Errors of difficulties from 5 to 80 answers by prior, and how many answers a prior is worth."""
    return irt_studies.calibration(kept(spark, sf_dir), item_texts(spark, sf_dir))


@job()
def irt_calibration_crossfit(spark, sf_dir):
    """The same with anchors refitted without each item's fold, by treatment of a and reference."""
    return irt_studies.calibration_crossfit(kept(spark, sf_dir), item_texts(spark, sf_dir))


NEW_ROWS = f"""{SCORED}, {PRUNE}, ab AS (SELECT user_id, ln((sum(y) + 0.5) / (count(*) - sum(y) + 0.5)) AS theta FROM u2 GROUP BY 1), cal AS (SELECT question_id, theta, y FROM u2 JOIN ab USING (user_id))"""


def rough_abilities(spark, sf_dir) -> DataFrame:
    """Answers with the smoothed logit of their learner's share of right ones."""
    rows = kept(spark, sf_dir)
    theta = rows.groupBy("user_id").agg(F.log((F.sum("y") + 0.5) / (F.count("*") - F.sum("y") + 0.5)).alias("theta"))
    return rows.join(theta, "user_id").select("question_id", "theta", "y")


@job(
    f"""WITH {NEW_ROWS}, step AS (SELECT question_id, 0 AS k, 0.0::DOUBLE AS b FROM (SELECT DISTINCT question_id FROM cal)
      UNION ALL SELECT question_id, k + 1, b + greatest(least((g - b / 9) / (h + 1.0::DOUBLE / 9), 1), -1) FROM (SELECT question_id, any_value(k) AS k, any_value(b) AS b, sum(-(y - p)) AS g, sum(p * (1 - p)) AS h FROM (SELECT s.question_id, k, b, y, 1 / (1 + exp(b - theta)) AS p FROM step s JOIN cal USING (question_id) WHERE k < 40) GROUP BY 1))
    SELECT question_id, round(b, 6) AS b FROM step WHERE k = 40""",
    "resp_raw",
    "answer_keys",
)
def new_item_difficulty(spark, sf_dir):
    """MAP of each item's difficulty with a fixed at 1."""
    return rounded(irt.item_difficulty(rough_abilities(spark, sf_dir)), "b")


@job(
    f"""WITH {NEW_ROWS}, step AS (SELECT question_id, 0 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS l FROM (SELECT DISTINCT question_id FROM cal)
      UNION ALL SELECT question_id, k + 1, b + greatest(least((hll * gb - hbl * gl) / (hbb * hll - hbl * hbl), 1), -1), l + greatest(least((hbb * gl - hbl * gb) / (hbb * hll - hbl * hbl), 0.5), -0.5)
      FROM (SELECT question_id, any_value(k) AS k, any_value(b) AS b, any_value(l) AS l, sum(-a * (y - p)) - any_value(b) / 9 AS gb, sum(z * (y - p)) - any_value(l) / 0.25 AS gl, sum(p * (1 - p) * a * a) + 1.0::DOUBLE / 9 AS hbb, sum(-p * (1 - p) * a * z) AS hbl, sum(p * (1 - p) * z * z) + 4 AS hll
        FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM (SELECT s.question_id, k, b, l, y, exp(l) AS a, exp(l) * (theta - b) AS z FROM step s JOIN cal USING (question_id) WHERE k < 60)) GROUP BY 1))
    SELECT question_id, round(exp(l), 6) AS a, round(b, 6) AS b FROM step WHERE k = 60""",
    "resp_raw",
    "answer_keys",
)
def new_item_slope(spark, sf_dir):
    """Joint MAP of each item's difficulty and discrimination."""
    return rounded(irt.item_difficulty_slope(rough_abilities(spark, sf_dir)), "a", "b")


# -- references of difficulty: fitted models and text predictions ---------------------------------


def fitted_scales(spark, sf_dir) -> DataFrame:
    """(question_id, series_id, p, b_logit, b_1pl, b_2pl, b_3pl, pred): difficulties of three models fitted in one EM, and the text's prediction."""
    rows = kept(spark, sf_dir)
    learners = packed(rows)
    fits = fit_many(learners, rows, [Setting(m) for m in ("1PL", "2PL", "3PL")])
    b = parameters(learners, fits).groupBy("question_id").agg(*[F.max(F.when(F.col("setting") == k, F.col("b"))).alias(f"b_{k + 1}pl") for k in range(3)])
    n, s = F.count("*"), F.sum("y")
    stats = rows.groupBy("question_id").agg(F.avg("y").alias("p"), F.log((n - s + 0.5) / (s + 0.5)).alias("b_logit"))
    out = stats.join(b, "question_id").join(responses.item_series(rows).select("question_id", "series_id"), "question_id").join(item_texts(spark, sf_dir).withColumnRenamed("ridge", "pred"), "question_id")
    return written(out, "scales")[0]


MODELS = ("b_1pl", "b_2pl", "b_3pl")
CHOICES = [("b_1pl", "b_2pl"), ("b_1pl", "b_3pl"), ("b_2pl", "b_3pl"), *[(m, "b_logit") for m in MODELS]]


@job()
def cold_start_fitted(spark, sf_dir):
    """Text predictions of items that no response was used for, against each fitted difficulty."""
    return metrics.scale_correlations(fitted_scales(spark, sf_dir), [("pred", b) for b in (*MODELS, "b_logit")], {"all": F.lit(True)})


@job()
def reference_choice_fitted(spark, sf_dir):
    """The fitted difficulties against each other and the observed logit, and with the text, with and without easy items."""
    return metrics.scale_correlations(fitted_scales(spark, sf_dir), CHOICES + [("pred", b) for b in MODELS], {"all": F.lit(True), "p_up_to_0.4": F.col("p") <= 0.4})


@job()
def scale_sensitivity_fitted(spark, sf_dir):
    """Text predictions against the one-trait and the trait-a-series difficulty, within each series and without it."""
    rows = kept(spark, sf_dir)
    multi = irt_multi.irt_fit_multi(rows, responses.item_series(rows))[0].select("question_id", F.col("b").alias("b_multi"))
    scales = written(fitted_scales(spark, sf_dir).join(multi, "question_id"), "scales")[0]
    parts = {f"{n}_{k}": F.col("series_id") == k if n == "within" else F.col("series_id") != k for n in ("within", "without") for k in range(3)}
    return metrics.scale_correlations(scales, [("pred", "b_2pl"), ("pred", "b_multi"), ("b_2pl", "b_multi")], {"all": F.lit(True), **parts})


# -- rating models side by side -------------------------------------------------------------------------


def compared(preds: DataFrame, history: DataFrame) -> DataFrame:
    """Scores of (config, seq, p) on the decisive games of history, all of them and those of experienced players."""
    rows = preds.join(history, "seq").withColumn("y", F.col("s").cast("int")).withColumn("p", F.round("p", 9))
    subsets = F.when((F.col("n_u") >= 10) & (F.col("n_o") >= 10), F.array(F.lit("all"), F.lit("experienced"))).otherwise(F.array(F.lit("all")))
    out = metrics.binary_scores(rows.withColumn("subset", F.explode(subsets)), ["subset", "config"])
    return rounded(out, "log_loss", "brier", "accuracy", "auc")


@job()
def rating_comparison(spark, sf_dir):
    """All rating models on decisive duels of the last fifth: Elo, Glicko-2, TrueSkill, the base rate, a logit on history, boosted trees on history and Elo."""
    from ..operators.learners import duel_boosted, duel_logit

    games = written(time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"]), "games")[0]
    preds = [ratings.replay(games, m, {m: c})[0].select("config", "seq", "p") for m, c in (("elo", {"k": 24.0}), ("glicko2", {"tau": 0.5}), ("trueskill", {"beta": 25 / 6, "tau": 25 / 300, "p_draw": 0.1}))]
    edge = F.log(F.col("elo_p") / (1 - F.col("elo_p")))
    rows = ratings.duel_history(games).where("s <> 0.5").join(preds[0].select("seq", F.col("p").alias("elo_p")), "seq")
    rows = rows.withColumns({"y": F.col("s").cast("int"), "log_u": F.log1p("n_u"), "log_o": F.log1p("n_o"), "elo_logit": edge})
    rows, _ = written(rows.drop("elo_p"), "history")
    part = {k: rows.where(F.col("split") == k) for k in ("train", "val", "test")}
    columns = ["rate_diff", "rate_u", "rate_o", "log_u", "log_o"]
    named = lambda df, name: df.select(F.lit(name).alias("config"), "seq", "p")
    preds += [named(ratings.base_rate(part["train"], part["test"]), "base_rate"), named(duel_logit(part["train"], part["test"], columns), "logit")]
    preds += [named(duel_boosted(part["train"], part["val"], part["test"], [*columns, "elo_logit"]), "boosted")]
    whole = preds[0]
    for p in preds[1:]:
        whole = whole.unionByName(p)
    return compared(whole, part["test"].select("seq", "s", "n_u", "n_o"))


@job(
    f"""WITH {K24}, n AS (SELECT count(*) AS n FROM games), sides AS (SELECT seq, 0 AS side, user_id AS player FROM games UNION ALL SELECT seq, 1, opponent_id FROM games),
    past AS (SELECT seq, min(c) AS least FROM (SELECT seq, side, row_number() OVER (PARTITION BY player ORDER BY seq) - 1 AS c FROM sides) GROUP BY 1),
    rate AS (SELECT avg(s) AS r FROM games, n WHERE s <> 0.5 AND seq < n * 0.6::DOUBLE),
    sc AS (SELECT s::INT AS y, least, unnest(['elo', 'base_rate']) AS model, unnest([round(step.p, 9), round(rate.r, 9)]) AS p FROM games JOIN step USING (seq) JOIN past USING (seq), n, rate WHERE s <> 0.5 AND seq >= n * 0.8::DOUBLE),
    every AS (SELECT 'all' AS subset, * FROM sc UNION ALL SELECT 'experienced', * FROM sc WHERE least >= 10)
    SELECT split_part(config, '|', 1) AS subset, split_part(config, '|', 2) AS config, n, log_loss, brier, accuracy, auc FROM ({duck_scores("SELECT subset || '|' || model AS config, y, p FROM every")})""",
    "duels",
)
def elo_and_base_rate(spark, sf_dir):
    """Elo and the base rate of the same table, which SQL can say."""
    games = written(time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"]), "games")[0]
    elo = ratings.replay(games, "elo", {"elo": {"k": 24.0}})[0].select("config", "seq", "p")
    history = ratings.duel_history(games).where("s <> 0.5")
    test = history.where("split = 'test'")
    base = ratings.base_rate(history.where("split = 'train'"), test).select(F.lit("base_rate").alias("config"), "seq", "p")
    return compared(elo.unionByName(base), test.select("seq", "s", "n_u", "n_o"))


@job()
def glicko2_periods(spark, sf_dir):
    """Glicko-2 by day and by week: five tau scored on the games between 60 and 80 % of the log, and the best one of each period on the last fifth."""
    games = written(time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"]), "games")[0]
    scored_games = games.where("s <> 0.5 and split <> 'train'").select("seq", "split", F.col("s").cast("int").alias("y"))
    out = None
    for unit in ("day", "week"):
        pred, _ = ratings.glicko_period_grid(games, {f"{t:g}": t for t in (0.2, 0.3, 0.5, 0.9, 1.2)}, unit)
        part = metrics.binary_scores(scored_games.join(pred, "seq"), ["config", "split"]).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    out, _ = written(out, "period-scores")
    best = out.where("split = 'val'").groupBy("unit").agg(F.min_by("config", F.struct("log_loss", "config")).alias("best"))
    rows = out.join(F.broadcast(best), "unit").withColumn("best", F.col("config") == F.col("best")).where("best or split = 'val'")
    return rounded(rows.select("unit", F.col("config").alias("tau"), "split", "best", "n", "auc", "log_loss", "brier"), "auc", "log_loss", "brier")
