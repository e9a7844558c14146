"""Response logs: scoring, first attempts, pruning, statistics, hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash01, logit, sigmoid
from ..sources.scratch import written
from .graphs import connected_components
from .pairs import correlation, pair_moments


def score_response(resp: DataFrame, keys: DataFrame) -> DataFrame:
    """y = 1 if the answer is a key of its own question; a timeout (null answer) is 0. Questions without a key go."""
    known = keys.select("question_id", "answer_id").distinct()
    asked = known.select("question_id").distinct()
    hits = known.withColumn("_hit", F.lit(1))
    return resp.join(asked, "question_id", "left_semi").join(hits, ["question_id", "answer_id"], "left").withColumn("y", F.coalesce("_hit", F.lit(0))).drop("_hit")


def first_attempt(resp: DataFrame) -> DataFrame:
    """The earliest row of each learner and question, by (created_at, id); an aggregate, not a sort."""
    rest = [c for c in resp.columns if c not in ("user_id", "question_id")]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")
    return resp.groupBy("user_id", "question_id").agg(first).select("user_id", "question_id", "r.*")


def prune(resp: DataFrame, item_min: int = 30, user_min: int = 10, passes: int = 3) -> DataFrame:
    """Items with enough learners, then learners with enough items, exactly `passes` times.

    Each pass is written, so the log is read once and a pass reads what the one before kept.
    """
    resp, _ = written(resp, "responses")
    for _ in range(passes):
        for key, least in (("question_id", item_min), ("user_id", user_min)):
            keep = resp.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
            resp, _ = written(resp.join(keep, key, "left_semi"), "pruned")
    return resp


def item_stats(resp: DataFrame) -> DataFrame:
    return resp.groupBy("question_id").agg(F.count("*").alias("n_resp"), F.avg("y").alias("p_value"))


def additive_predict(train: DataFrame, test: DataFrame) -> DataFrame:
    """sigmoid(logit item mean + logit person mean - logit mean); missing means are the global one."""
    items = train.groupBy("question_id").agg(F.avg("y").alias("_i"))
    people = train.groupBy("user_id").agg(F.avg("y").alias("_p"))
    whole = train.agg(F.avg("y").alias("_g"))
    out = test.join(items, "question_id", "left").join(people, "user_id", "left").crossJoin(F.broadcast(whole))
    part = lambda c: logit(F.coalesce(c, "_g"))
    return out.withColumn("p", sigmoid(part("_i") + part("_p") - logit(F.col("_g")))).drop("_i", "_p", "_g")


def holdout(resp: DataFrame, share: float = 0.1, by: tuple[str, ...] = ("user_id", "question_id"), seed: int = 0) -> DataFrame:
    """held: a hashed share of the keys, the same at any partitioning."""
    return resp.withColumn("held", hash01(*[F.col(c) for c in by], seed=seed) < share)


def common_learners(resp: DataFrame) -> DataFrame:
    """(i, j, n) learners that answered both items, for pairs that share any."""
    return pair_moments(resp).select("i", "j", "n")


def item_series(resp: DataFrame) -> DataFrame:
    """Series of each item: the most frequent (smallest on ties), and how many it has."""
    n = resp.groupBy("question_id", "series_id").agg(F.count("*").alias("n"))
    return n.groupBy("question_id").agg(F.min_by("series_id", F.struct(-F.col("n"), F.col("series_id"))).alias("series_id"), F.count("*").alias("n_series"))


def design_summary(resp: DataFrame) -> DataFrame:
    """Per series: items, groups, learners, responses, first and last time."""
    return resp.groupBy("series_id").agg(F.count_distinct("question_id").alias("items"), F.count_distinct("group_id").alias("rounds"), F.count_distinct("user_id").alias("learners"), F.count("*").alias("responses"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def series_overlap(resp: DataFrame) -> DataFrame:
    """Learners active in both of two series."""
    s = resp.select("user_id", "series_id").distinct()
    return s.alias("a").join(s.alias("b"), F.expr("a.user_id = b.user_id and a.series_id < b.series_id")).groupBy(F.col("a.series_id").alias("series_a"), F.col("b.series_id").alias("series_b")).agg(F.count("*").alias("learners"))


def series_counts(resp: DataFrame) -> DataFrame:
    """Learners by the number of series they are in."""
    per = resp.groupBy("user_id").agg(F.count_distinct("series_id").alias("series"))
    return per.groupBy("series").agg(F.count("*").alias("learners"))


def design_totals(resp: DataFrame) -> DataFrame:
    """Density of the learner-item table, learners in several groups, and median responses of learners and items."""
    cells = resp.select("user_id", "question_id").distinct().agg(F.count("*").alias("cells"))
    users = resp.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("g")).agg(F.count("*").alias("learners"), F.percentile("n", 0.5).alias("median_by_learner"), F.count_if(F.col("g") > 1).alias("multi_round"))
    items = resp.groupBy("question_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("items"), F.percentile("n", 0.5).alias("median_by_item"))
    return cells.crossJoin(users).crossJoin(items).select("learners", "items", (F.col("cells") / (F.col("learners") * F.col("items"))).alias("density"), "multi_round", "median_by_learner", "median_by_item")


def pair_shares(pairs: DataFrame, series: DataFrame, least: int = 50) -> DataFrame:
    """Shares of all item pairs with any common learner and with `least` of them, and of pairs across series with any.

    pairs: (i, j, n) that share a learner; series: (question_id, series_id) of every item.
    """
    of = lambda c: series.select(F.col("question_id").alias(c), F.col("series_id").alias(f"_s{c}"))
    sides = pairs.join(of("i"), "i").join(of("j"), "j")
    counts = sides.agg(F.count("*").alias("any"), F.count_if(F.col("n") >= least).alias("enough"), F.count_if(F.col("_si") != F.col("_sj")).alias("across"))
    size = series.groupBy("series_id").agg(F.count("*").alias("k")).agg(F.sum("k").alias("items"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    i, q = F.col("items"), F.col("squares")
    return counts.crossJoin(size).select((i * (i - 1) / 2).cast("long").alias("pairs"), (2 * F.col("any") / (i * (i - 1))).alias("share_any"), (2 * F.col("enough") / (i * (i - 1))).alias("share_enough"), (2 * F.col("across") / (i * i - q)).alias("share_across"))


def response_components(resp: DataFrame) -> DataFrame:
    """Components of the graph of learners and items, with their learners and items."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = connected_components(resp.select(node("i", "question_id").alias("a"), node("u", "user_id").alias("b")).distinct())
    return parts.groupBy("component").agg(F.count_if(F.col("node").startswith("u")).alias("learners"), F.count_if(F.col("node").startswith("i")).alias("items"))


def item_fit(resp: DataFrame, params: DataFrame, theta: DataFrame) -> DataFrame:
    """Infit and outfit of each item under p = c + (1 - c) sigmoid(a (theta - b))."""
    rows = resp.join(params, "question_id").join(theta, "user_id")
    p = F.col("c") + (1 - F.col("c")) * sigmoid(F.col("a") * (F.col("theta") - F.col("b")))
    rows = rows.withColumn("_v", p * (1 - p)).withColumn("_r2", (F.col("y") - p) ** 2)
    return rows.groupBy("question_id").agg((F.sum("_r2") / F.sum("_v")).alias("infit"), F.avg(F.col("_r2") / F.col("_v")).alias("outfit"))


def q3(resid: DataFrame, min_common: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of residuals (keys, user_id, question_id, r) for item pairs with enough common learners."""
    return pair_moments(resid, "r", keys).where(F.col("n") >= min_common).select(*keys, "i", "j", "n", correlation().alias("q3"))


def q3_summary(pairs: DataFrame, kinds: DataFrame, cut: float = 0.2) -> DataFrame:
    """Of pairs (i, j, q3): how many, mean, share with abs(q3 - mean) over the cut, and means of pairs of one kind and of two. kinds: (question_id, kind)."""
    of = lambda c: kinds.select(F.col("question_id").alias(c), F.col("kind").alias(f"_k{c}"))
    rows = pairs.join(of("i"), "i").join(of("j"), "j").withColumn("_same", F.col("_ki") == F.col("_kj"))
    mean = rows.agg(F.avg("q3").alias("_mean"))
    rows = rows.crossJoin(F.broadcast(mean))
    return rows.agg(F.count("q3").alias("pairs"), F.avg("q3").alias("mean_q3"), F.avg((F.abs(F.col("q3") - F.col("_mean")) > cut).cast("double")).alias("share_over"), F.count_if("_same").alias("pairs_same"), F.avg(F.when(F.col("_same"), F.col("q3"))).alias("mean_same"), F.avg(F.when(~F.col("_same"), F.col("q3"))).alias("mean_different"))


def fit_summary(fit: DataFrame, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Shares of items whose infit and outfit lie in [low, high], and medians. fit: (question_id, infit, outfit)."""
    inside = lambda c: F.avg(F.col(c).between(low, high).cast("double"))
    return fit.agg(F.count("*").alias("items"), *[f(c).alias(f"{c}_{n}") for c in ("infit", "outfit") for n, f in (("share", inside), ("median", lambda c: F.percentile(c, 0.5)))])
