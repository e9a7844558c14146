"""Prediction runs over seeds: scores, ensembles, model choice, sensitivity to the set of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_scores(runs: DataFrame, by: tuple[str, ...] = ("model", "seed"), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """RMSE and Pearson correlation (0 for a constant prediction) of every run."""
    r = F.when(F.min(pred) == F.max(pred), 0.0).otherwise(F.corr(truth, pred))
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col(pred) - F.col(truth)) ** 2)).alias("rmse"), r.alias("pearson"))


def seed_ensemble(runs: DataFrame, by: tuple[str, ...] = ("model",), item: str = "id", pred: str = "pred") -> DataFrame:
    """Mean prediction of each item over seeds."""
    return runs.groupBy(*by, item).agg(F.avg(pred).alias("pred"))


def good_runs(val_scores: DataFrame, least_r: float = 0.2, seeds: int = 3) -> DataFrame:
    """Runs whose validation correlation reaches least_r; of each model the first `seeds` by seed."""
    order = Window.partitionBy("model").orderBy("seed")  # as many rows as a model has seeds
    return val_scores.where(F.col("pearson") >= least_r).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds).drop("_r")


def select_model(val_scores: DataFrame, least_r: float = 0.2, seeds: int = 3) -> DataFrame:
    """Models with the mean validation RMSE of their good runs; chosen marks the smallest (the first name on ties)."""
    means = good_runs(val_scores, least_r, seeds).groupBy("model").agg(F.count("*").alias("seeds"), F.avg("rmse").alias("mean_rmse"))
    best = means.agg(F.min_by("model", F.struct("mean_rmse", "model")).alias("_best"))
    return means.crossJoin(F.broadcast(best)).select("model", "seeds", "mean_rmse", (F.col("model") == F.col("_best")).alias("chosen"))


def seed_sensitivity(runs: DataFrame, sets: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """For each named set of seeds: mean and deviation of r over its runs, and r of its ensemble. sets: (set, model, seed)."""
    some = runs.join(F.broadcast(sets), ["model", "seed"])  # a row a run
    each = run_scores(some, ("set", "model", "seed"), truth, pred).groupBy("set").agg(F.avg("pearson").alias("mean_r"), F.stddev_samp("pearson").alias("sd_r"), F.count("*").alias("runs"))
    both = some.groupBy("set", "model", "id").agg(F.avg(pred).alias("_p"), F.first(truth).alias("_t")).groupBy("set").agg(F.corr("_t", "_p").alias("ensemble_r"))
    return each.join(both, "set")
