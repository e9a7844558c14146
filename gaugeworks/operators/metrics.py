"""Prediction quality: regression and binary scores, rank correlation, screening, tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import md5_of_pairs, normal_two_sided, t_two_sided
from ..functions.scalars import clip, hash_text, sigmoid
from ..sources.scratch import written
from .ordering import indexed, prefix_sums


def rank_means(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """df with average ranks of x inside each group: distinct values are counted first, then summed in order."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("_c"))
    placed = prefix_sums(indexed(counts, [*by, x]), by, "seq", {"_below": F.col("_c")})
    ranks = placed.select(*by, x, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, [*by, x])


def correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson and Spearman (average ranks) with two-sided p, per group. Rows with a null are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = rank_means(rank_means(rows, by, x, "_rx"), by, y, "_ry")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a * ((m - 2) / max(1e-300, 1 - a * a)) ** 0.5, m - 2) if a is not None and a == a and m > 2 else None for a, m in zip(r, n)])

    return out.withColumn("pearson_p", p_of("pearson", "n")).withColumn("spearman_p", p_of("spearman", "n"))


def regression_report(df: DataFrame, by: list[str], y: str = "b_logit", yhat: str = "yhat", p: str = "p") -> DataFrame:
    """RMSE and MAE on b, RMSE on p with sigmoid(-yhat), Pearson (0 for a constant prediction)."""
    e = F.col(yhat) - F.col(y)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse_b"),
        F.avg(F.abs(e)).alias("mae_b"),
        F.sqrt(F.avg((sigmoid(-F.col(yhat)) - F.col(p)) ** 2)).alias("rmse_p"),
        F.when(F.min(yhat) == F.max(yhat), 0.0).otherwise(F.corr(y, yhat)).alias("pearson"),
    )


def binary_scores(df: DataFrame, by: list[str], y: str = "y", p: str = "p", weight: Column | None = None) -> DataFrame:
    """AUC (ties count half), log loss, Brier score and accuracy at 1/2, weighted if asked.

    Rows are summed by distinct score before anything is ordered; the order is two-level.
    """
    w = weight if weight is not None else F.lit(1.0)
    q = clip(F.col(p))
    scored = df.groupBy(*by, F.col(p).alias("_p")).agg(F.sum(w * F.col(y)).alias("_pos"), F.sum(w * (1 - F.col(y))).alias("_neg"))
    placed = prefix_sums(indexed(scored, [*by, "_p"]), by, "seq", {"_below": F.col("_neg")})
    auc = placed.groupBy(*by).agg((F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)) / (F.sum("_pos") * F.sum("_neg"))).alias("auc"))
    rest = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum(-w * (F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))) / F.sum(w)).alias("log_loss"),
        (F.sum(w * (F.col(p) - F.col(y)) ** 2) / F.sum(w)).alias("brier"),
        (F.sum(w * ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")) / F.sum(w)).alias("accuracy"),
    )
    return rest.join(auc, by) if by else rest.crossJoin(auc)


def abs_error_shares(df: DataFrame, by: list[str], yhat: str = "yhat", p: str = "p") -> DataFrame:
    e = F.abs(sigmoid(-F.col(yhat)) - F.col(p))
    return df.groupBy(*by).agg(F.avg((e < 0.1).cast("double")).alias("within_10"), F.avg((e < 0.2).cast("double")).alias("within_20"), F.avg(e).alias("mae_p"))


def screening(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """k = round(n / 10) hardest by truth and by prediction (ties by key): precision, and predicted hardest in the easier half."""
    n = df.count()
    k = df.sparkSession.range(1).select(F.bround(F.lit(n * 0.1)).cast("long")).first()[0]
    top = lambda c, name: indexed(df.select(key, (-F.col(c)).alias("_s")), ["_s", key], "_r").where(F.col("_r") < k).select(key, F.lit(1).alias(name))
    median = df.agg(F.percentile(truth, 0.5).alias("_m"))
    rows = df.join(top(truth, "_t"), key, "left").join(top(pred, "_h"), key, "left").crossJoin(F.broadcast(median))
    picked = F.col("_h") == 1
    return rows.agg(F.lit(k).alias("k"), (F.count_if(picked & (F.col("_t") == 1)) / k).alias("precision"), (F.count_if(picked & (F.col(truth) < F.col("_m"))) / k).alias("in_easier_half"))


def decile_screening(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """AUC of the hardest and of the easiest tenth under the prediction, and the share of the predicted easiest in the harder half."""
    n = df.count()
    k = df.sparkSession.range(1).select(F.bround(F.lit(n * 0.1)).cast("long")).first()[0]
    rows, _ = written(df.select(key, truth, pred), "screening")
    ends = lambda c, sign, name: indexed(rows.select(key, (sign * F.col(c)).alias("_s")), ["_s", key], "_r").where(F.col("_r") < k).select(key, F.lit(1).alias(name))
    median = rows.agg(F.percentile(truth, 0.5).alias("_m"))
    all_, _ = written(rows.join(ends(truth, -1, "_hard"), key, "left").join(ends(truth, 1, "_easy"), key, "left").join(ends(pred, 1, "_low"), key, "left").crossJoin(F.broadcast(median)), "ends")
    auc = lambda flag, p: binary_scores(all_.select(F.coalesce(flag, F.lit(0)).alias("y"), p.alias("p")), []).select("auc")
    share = all_.agg(F.lit(k).alias("k"), (F.count_if((F.col("_low") == 1) & (F.col(truth) > F.col("_m"))) / k).alias("in_harder_half"))
    return share.crossJoin(auc("_hard", F.col(pred)).withColumnRenamed("auc", "auc_hardest")).crossJoin(auc("_easy", -F.col(pred)).withColumnRenamed("auc", "auc_easiest"))


def scale_correlations(df: DataFrame, pairs: list[tuple[str, str]], cuts: dict[str, Column]) -> DataFrame:
    """(cut, x, y, n, pearson, spearman, p values) of pairs of columns over the rows of each named cut; a row may be in several."""
    each = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) for x, y in pairs])
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cuts.items()]))
    rows = df.select(F.explode(named).alias("cut"), each.alias("_e")).select("cut", F.explode("_e").alias("e")).select("cut", "e.*")
    return correlations(rows, ["cut", "x", "y"], "_x", "_y")


def best_config(scores: DataFrame, by: list[str], loss: str = "log_loss", order: str = "config") -> DataFrame:
    """The row of smallest loss, the first in grid order on ties."""
    return scores.groupBy(*by).agg(F.min_by(F.struct(*scores.columns), F.struct(loss, order)).alias("r")).select("r.*")


def adjust(df: DataFrame, key: str, p: str = "p_value", level: float = 0.05) -> DataFrame:
    """holm and bh: whether each p-value is rejected at the level. Ties in order of key; nulls are never rejected."""
    tested = df.where(F.col(p).isNotNull())
    placed = indexed(tested, [p, key], "_r")
    m = tested.agg(F.count("*").alias("_m"))
    rows = placed.crossJoin(F.broadcast(m))
    edge = rows.agg(F.min(F.when(F.col(p) > level / (F.col("_m") - F.col("_r")), F.col("_r"))).alias("_holm"), F.max(F.when(F.col(p) <= level * (F.col("_r") + 1) / F.col("_m"), F.col("_r"))).alias("_bh"))
    out = rows.crossJoin(F.broadcast(edge)).select(*df.columns, (F.col("_r") < F.coalesce("_holm", "_m")).alias("holm"), (F.col("_r") <= F.coalesce("_bh", F.lit(-1))).alias("bh"))
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("holm", F.lit(False)).withColumn("bh", F.lit(False)))


def z_to_p(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(x.to_numpy()))

    return tail(z)


def design_effect(pairs: DataFrame, key: str, deffs: tuple[float, ...] = (1, 2, 5, 10, 20, 50), level: float = 0.05) -> DataFrame:
    """Shares rejected (Holm, BH) when z is deflated by the root of each variance inflation.

    One order by abs(z) serves all: deflation keeps it.
    """
    tested = pairs.where("z is not null").select(key, F.abs("z").alias("_z"), (-F.abs("z")).alias("_order"))
    placed, _ = written(indexed(tested, ["_order", key], "_r"), "tests")
    m = placed.count()
    rows = placed.select("_r", F.posexplode(F.array(*[F.lit(float(d)) for d in deffs])).alias("_k", "deff"), "_z").withColumn("_p", z_to_p(F.col("_z") / F.sqrt("deff")))
    edges = rows.groupBy("deff").agg(F.min(F.when(F.col("_p") > level / (m - F.col("_r")), F.col("_r"))).alias("holm"), F.max(F.when(F.col("_p") <= level * (F.col("_r") + 1) / m, F.col("_r"))).alias("bh"))
    return edges.select("deff", (F.coalesce("holm", F.lit(m)) / m).alias("share_holm"), ((F.coalesce("bh", F.lit(-1)) + 1) / m).alias("share_bh"))


def signed_rank(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank test of a - b, zeros left out, average ranks, normal approximation; and the paired t."""
    d = df.select(key, (F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d")).withColumn("_g", F.lit(0))
    ranked = rank_means(d, ["_g"], "_abs", "_r")
    w = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"))
    ties = d.groupBy("_abs").agg(F.count("*").alias("t")).agg(F.sum((F.col("t") ** 3 - F.col("t")) / 48.0).alias("tie"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie"))
    t = df.agg((F.avg(F.col(a) - F.col(b)) / (F.stddev_samp(F.col(a) - F.col(b)) / F.sqrt(F.count("*")))).alias("paired_t"))
    return w.crossJoin(ties).withColumn("z", z).crossJoin(t).select("n", "w_plus", "z", "paired_t")


#: P(N <= k) of a Poisson(1) number, k from 0; what lies beyond the last is below 1e-9.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974149, 0.9999998885745217]
#: Replicates whose numbers one md5 gives: 8 hex digits each.
PER_HASH = 4


def block_weights(units: list[str], block: Column, seed: int = 0) -> list[Column]:
    """Poisson(1) weights of the replicates of a block, the product over units; SQL can repeat them from md5."""
    out = []
    for k in range(PER_HASH):
        w = F.lit(1)
        for unit in units:
            u = F.conv(F.substring(F.md5(hash_text(F.col(unit), block, seed=seed)), 1 + 8 * k, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
            w = w * sum((u >= c).cast("int") for c in POISSON)
        out.append(w)
    return out


def bootstrap(df: DataFrame, units: list[str], moments: dict[str, Column], stats: dict[str, str], reps: int = 1000, seed: int = 0, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Percentile intervals of statistics of weighted sums, units resampled with Poisson(1) weights.

    moments: sums a statistic needs; stats: SQL over their names. Moments are summed per unit
    first, so a replicate costs a number per unit, and resamples are never made. A task makes the
    weights of some rows for all replicates at once and adds their moments up; only sums are
    shuffled. Several units (two players) multiply their weights. A weight depends on the unit, replicate and seed alone.
    With `by`, a row for each of its groups and statistics.
    """
    by = by or []
    per_unit = df.groupBy(*by, *units).agg(*[F.sum(c).alias(k) for k, c in moments.items()])
    texts = per_unit.select(*by, *[F.col(u).cast("string").alias(f"_u{i}") for i, u in enumerate(units)], *[F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(moments)])
    # rows that share a unit are near each other, so that its weights serve them all; a unit of many rows is dealt to several tasks
    texts = texts.repartitionByRange("_u0", *[f"_u{i}" for i in range(1, len(units))], *by).sortWithinPartitions(*by, "_u0")

    names = list(moments)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}  # by group: sums by moment and replicate, and whether a moment had a value

        def flush() -> Iterator[pa.RecordBatch]:
            for group, (total, seen) in sums.items():
                keys = [pa.array([v] * reps, kind) for v, kind in zip(group, kinds)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(reps, dtype=np.int32)), *[pa.array(x) if s else pa.nulls(reps, pa.float64()) for x, s in zip(total, seen)]], names=[*by, "_rep", *names])
            sums.clear()

        for batch in batches:
            kinds = [batch.column(c).type for c in by]
            for k in range(0, len(batch), 1024):  # some rows' weights at a time: 8 bytes a row and replicate
                some = batch.slice(k, 1024)
                weights = product_weights([some.column(f"_u{i}").to_pandas() for i in range(len(units))], reps, seed)
                values = np.stack([some.column(f"_m{i}").fill_null(0.0).to_numpy() for i in range(len(names))])
                known = np.stack([some.column(f"_m{i}").is_valid().to_numpy(zero_copy_only=False) for i in range(len(names))])
                groups: dict[tuple, list] = {}
                for i, group in enumerate(zip(*[some.column(c).to_pylist() for c in by]) if by else ()):
                    groups.setdefault(group, []).append(i)
                for group, at in (groups or {(): slice(None)}).items():
                    total, seen = sums.setdefault(group, [np.zeros((len(names), reps)), np.zeros(len(names), bool)])
                    total += values[:, at] @ weights[at]
                    seen |= known[:, at].any(axis=1)
                if len(sums) * len(names) * reps > 1 << 23:
                    yield from flush()
        yield from flush()

    kinds_of = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    parts = texts.mapInArrow(add, ", ".join([*(f"`{c}` {kinds_of[c]}" for c in by), "_rep int", *(f"`{m}` double" for m in moments)]))
    reps_of = parts.groupBy(*by, "_rep").agg(*[F.sum(m).alias(m) for m in moments])
    point = per_unit.groupBy(*by).agg(*[F.sum(k).alias(k) for k in moments])
    return intervals(reps_of, point, stats, by, level)


def intervals(reps: DataFrame, point: DataFrame, stats: dict[str, str], by: list[str], level: float = 0.95) -> DataFrame:
    """(stat, value, ci_low, ci_high) of each statistic, by group."""
    tail = (1 - level) / 2
    unpivot = lambda df, to: df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.expr(t).cast("double").alias(to)) for n, t in stats.items()])).alias("_e")).select(*by, "_e.*")
    ranges = unpivot(reps, "v").groupBy(*by, "stat").agg(F.percentile("v", tail).alias("ci_low"), F.percentile("v", 1 - tail).alias("ci_high"))
    return unpivot(point, "value").join(ranges, [*by, "stat"]).select(*by, "stat", "value", "ci_low", "ci_high")


def auc_difference(df: DataFrame, units: list[str], y: str, scores: dict[str, str], pairs: list[tuple[str, str]], reps: int = 1000, seed: int = 0, level: float = 0.95, block: int = 1 << 12) -> DataFrame:
    """AUC of one score less that of another, with percentile intervals, units resampled with Poisson(1) weights.

    Each score orders the rows once, after rows alike in score, units and class are counted. A task
    holds a block of distinct scores and sums, for all replicates together, the weights of both
    classes and what pairs inside the block add to the AUC; blocks then need only the negatives
    before them. Weights of some rows' units are made at once. A score that more than `block` rows have is a block of its own, dealt to several
    tasks by its units: inside it all pairs are ties. Several units multiply their weights.
    """
    names = {name: k for k, name in enumerate(scores)}
    long = df.select(*units, F.col(y).cast("int").alias("_y"), F.explode(F.array(*[F.struct(F.lit(k).alias("_m"), F.col(scores[n]).cast("double").alias("_p")) for n, k in names.items()])).alias("_e")).select(*units, "_y", "_e.*")
    long = long.groupBy("_m", "_p", "_y", *units).agg(F.count("*").alias("_c"))
    counts = long.groupBy("_m", "_p").agg(F.count("*").alias("_n"))
    placed = prefix_sums(indexed(counts, ["_m", "_p"]), ["_m"], "seq", {"_before": F.col("_n")})
    tied = F.col("_n") > block
    start = F.when(tied, F.col("_before")).otherwise(F.floor(F.col("_before") / block) * block)  # grows with the score: what follows a tied score starts over a block later
    rows = long.join(placed.select("_m", "_p", start.cast("long").alias("_b"), F.when(tied, F.ceil(F.col("_n") / block)).otherwise(1).alias("_parts")), ["_m", "_p"])
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*units), F.col("_parts"))).withColumns({f"_u{i}": F.col(u).cast("string") for i, u in enumerate(units)})

    def partial(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_p", kind="stable")
        p = part["_p"].to_numpy()
        score = np.cumsum(np.concatenate(([False], p[1:] != p[:-1])))
        sums = np.zeros((2, score[-1] + 1, reps + 1))
        for k in range(0, len(part), 1024):  # some rows' weights at a time: 8 bytes a row and replicate
            some, at = part.iloc[k : k + 1024], score[k : k + 1024]
            weights = np.empty((len(some), reps + 1))  # the last column is the sample itself
            weights[:, :reps], weights[:, reps] = product_weights([some[f"_u{i}"] for i in range(len(units))], reps, seed), 1.0
            weights *= some["_c"].to_numpy(float)[:, None]
            for label in (0, 1):
                own = np.flatnonzero(some["_y"].to_numpy() == label)
                if len(own):
                    edge = np.flatnonzero(np.concatenate(([True], at[own][1:] != at[own][:-1])))
                    sums[label, at[own][edge]] += np.add.reduceat(weights[own], edge)
        neg, pos = sums
        several = bool(part["_parts"].iloc[0] > 1)
        inside = 0.0 if several else (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame({"_m": key[0], "_b": key[1], "_rep": np.arange(reps + 1), "_pos": pos.sum(axis=0), "_neg": neg.sum(axis=0), "_in": inside, "_several": several})

    parts = rows.groupBy("_m", "_b", "_part").applyInPandas(partial, "_m int, _b long, _rep int, _pos double, _neg double, _in double, _several boolean")
    sums = parts.groupBy("_m", "_b", "_rep").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.when(F.bool_or("_several"), F.sum("_pos") * F.sum("_neg") / 2).otherwise(F.sum("_in")).alias("_in"))
    before = Window.partitionBy("_m", "_rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    auc = sums.withColumn("_less", F.coalesce(F.sum("_neg").over(before), F.lit(0.0))).groupBy("_rep").pivot("_m", list(names.values())).agg(F.try_divide(F.sum(F.col("_in") + F.col("_pos") * F.col("_less")), F.sum("_pos") * F.sum("_neg")))
    stats = {f"{a} - {b}": f"`{names[a]}` - `{names[b]}`" for a, b in pairs}
    return intervals(auc.where(F.col("_rep") < reps), auc.where(F.col("_rep") == reps), stats, [], level)


def poisson_weights(unit: str, reps: int, seed: int = 0) -> np.ndarray:
    return weights_of_units([unit], reps, seed)[0]


def weights_of_units(units: list[str | None], reps: int, seed: int = 0) -> np.ndarray:
    """The weights of `block_weights` for all replicates, a row a unit."""
    heads = [b"" if u is None else f"{u}|".encode() for u in units]
    tails = [f"{b}|{seed}".encode() for b in range(-(-reps // PER_HASH))]
    least = np.ceil(np.array(POISSON) * 4294967296.0).astype(np.uint32)  # x / 2^32 >= P as whole numbers
    return np.searchsorted(least, md5_of_pairs(heads, tails).reshape(len(units), -1)[:, :reps], side="right")


def product_weights(columns: list[pd.Series], reps: int, seed: int = 0) -> np.ndarray:
    """Weights of some rows, the product over their units; a unit's are made once."""
    out = np.ones((1, 1))
    for texts in columns:
        code, names = pd.factorize(texts, use_na_sentinel=False)
        out = out * weights_of_units([None if pd.isna(u) else u for u in names], reps, seed)[code]
    return out.astype(float)
