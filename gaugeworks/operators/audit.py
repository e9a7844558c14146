"""Audits, catalogue and release: what a data set holds, and what of it may be published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordering import indexed


def catalog(tables: dict[str, DataFrame], limit: int = 0) -> DataFrame:
    """Rows, columns, whether cut at the row limit, and first and last date of the first time column."""
    parts = []
    for name, df in sorted(tables.items()):
        times = [c for c, t in df.dtypes if t.startswith("timestamp") or c == "created_at"]
        at = F.try_to_timestamp(F.col(times[0]).cast("string")) if times else F.lit(None).cast("timestamp")
        parts.append(df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min(at).alias("first"), F.max(at).alias("last")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("truncated", (F.lit(limit) > 0) & (F.col("rows") >= limit))


def manifest_catalog(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The catalogue of an export: what its manifest lists beside what is there. manifest: as `sources.tables.read_manifest` gives."""
    times = catalog(tables).select("table", "first", "last", F.lit(True).alias("_there"))
    out = manifest.join(times, "table", "left")
    return out.select("table", "rows", F.size("columns").alias("columns"), (F.col("rows") >= F.col("row_limit")).alias("truncated"), F.coalesce("_there", F.lit(False)).alias("present"), F.array_join("excluded_columns", ",").alias("excluded"), "first", "last")


def catalog_summary(cat: DataFrame) -> DataFrame:
    """One row of totals; missing counts listed tables that are not there."""
    missing = F.count_if(~F.col("present")) if "present" in cat.columns else F.lit(0).cast("long")
    return cat.agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum("columns").alias("columns"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("rows") == 0).alias("empty"), missing.alias("missing"))


def reconstruction_audit(games: DataFrame, rounds: DataFrame) -> DataFrame:
    """Duels and rounds in one row: ids, times, self-play, draws, players, rounds a game, nulls."""
    players = games.select(F.col("user_id").alias("p")).union(games.select("opponent_id")).distinct().agg(F.count("*").alias("players"))
    a = games.agg(F.count("*").alias("games"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_if(F.col("user_id") == F.col("opponent_id")).alias("self_play"), F.avg(F.col("winner_id").isNull().cast("double")).alias("draw_share"))
    b = rounds.agg(F.count("*").alias("rounds"), F.count_distinct("game_id").alias("games_with_rounds"), F.count_if(F.col("cat_id").isNull()).alias("no_category"), F.count_if(F.col("u1").isNull()).alias("null_u1"))
    return a.crossJoin(players).crossJoin(b)


def round_histogram(rounds: DataFrame) -> DataFrame:
    """Games by their number of rounds, with the share of them whose rounds all have one time."""
    per = rounds.groupBy("game_id").agg(F.count("*").alias("rounds"), F.count_distinct("created_at").alias("times"))
    return per.groupBy("rounds").agg(F.count("*").alias("games"), F.avg((F.col("times") == 1).cast("double")).alias("share_one_time"))


def category_link(difficulty: DataFrame, items: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """Difficulty of categories in duels beside the mean difficulty of their bank items, and of predictions if there are any.

    difficulty: (cat_id, elo_difficulty, n_resp); items: (id, cat_id, b_logit); preds: (cat_id, pred).
    """
    bank = items.groupBy("cat_id").agg(F.avg("b_logit").alias("bank_b"), F.count("*").alias("n_items"))
    link = difficulty.join(bank, "cat_id")
    return link.join(preds.groupBy("cat_id").agg(F.avg("pred").alias("model_b")), "cat_id", "left") if preds is not None else link


def link_report(link: DataFrame, key: str, x: str, y: str, weight: str) -> DataFrame:
    """r of all rows, the range of r without each row and the row whose removal gives the lowest, and r without the two of smallest weight."""
    loo = leave_one_out(link, key, x, y).agg(F.min("r").alias("loo_low"), F.max("r").alias("loo_high"), F.min_by(key, F.struct("r", key)).alias("lowest_without"))
    two = F.array_sort(F.collect_list(F.struct(weight, key)))  # a row a category
    few = link.agg(F.slice(two, 1, 2)[key].alias("_few"))
    kept = link.crossJoin(F.broadcast(few)).where(~F.array_contains("_few", F.col(key))).agg(F.corr(x, y).alias("r_without_two"), F.count("*").alias("n_without_two"))
    return link.agg(F.count("*").alias("n"), F.corr(x, y).alias("r_all")).crossJoin(loo).crossJoin(kept)


def label_audit(items: DataFrame, label: str, other: str) -> DataFrame:
    """Confusion counts of two labels."""
    return items.groupBy(F.col(label).alias("label"), F.col(other).alias("other")).agg(F.count("*").alias("n"))


def weighted_accuracy(items: DataFrame, label: str, other: str, checked: DataFrame, right: str, z: float = 1.959963984540054) -> DataFrame:
    """One row: accuracy of a label from checked rows, each class weighing its share of all items, with a normal interval of the stratified sum; agreement of the label with another.

    checked: rows (label, right 0/1). Classes nobody checked have no part in the accuracy; a null right counts as unchecked.
    """
    sizes = items.groupBy(label).agg(F.count("*").alias("_size"), F.count_if(F.col(label) == F.col(other)).alias("_same"))
    shares = checked.where(F.col(right).isNotNull()).groupBy(label).agg(F.avg(F.col(right).cast("double")).alias("_p"), F.count("*").alias("_n"))
    rows = sizes.join(shares, label, "left")
    part = F.when(F.col("_n").isNotNull(), F.col("_size"))
    sums = rows.agg(F.count("_n").alias("classes"), F.sum("_size").alias("n_items"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_checked"), F.sum(part).alias("_all"), F.sum(part * F.col("_p")).alias("_hits"), F.sum((part * part) * (F.col("_p") * (1 - F.col("_p")) / F.col("_n"))).alias("_var"), F.sum("_same").alias("_same"))
    accuracy, half = F.try_divide("_hits", "_all"), z * F.try_divide(F.sqrt("_var"), F.col("_all"))
    return sums.select("classes", "n_items", "n_checked", accuracy.alias("accuracy"), (accuracy - half).alias("low"), (accuracy + half).alias("high"), F.try_divide("_same", "n_items").alias("agreement"))


def duel_statuses(games: DataFrame) -> DataFrame:
    """Duels by how they ended (first, second, draw, other: a winner who did not play), with players, first and last day."""
    status = F.when(F.col("winner_id").isNull(), "draw").when(F.col("winner_id") == F.col("user_id"), "first").when(F.col("winner_id") == F.col("opponent_id"), "second").otherwise("other")
    named = games.withColumn("status", status)
    players = named.select("status", F.explode(F.array("user_id", "opponent_id")).alias("_p")).groupBy("status").agg(F.count_distinct("_p").alias("players"))
    days = named.groupBy("status").agg(F.count("*").alias("games"), F.min("created_at").cast("date").cast("string").alias("first_day"), F.max("created_at").cast("date").cast("string").alias("last_day"))
    return days.join(players, "status")


def wilson(df: DataFrame, hits: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Wilson interval of a share."""
    p, m = F.col(hits) / F.col(n), F.col(n)
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return df.withColumn("share", p).withColumn("low", mid - half).withColumn("high", mid + half)


def leave_one_out(link: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Correlation without each row, from the totals less its own moments."""
    rows = link.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) ** 2, "syy": F.col(y) ** 2, "sxy": F.col(x) * F.col(y)}
    total = rows.agg(*[F.sum(v).alias(f"_{k}") for k, v in m.items()])
    d = rows.crossJoin(F.broadcast(total)).withColumns({f"_{k}": F.col(f"_{k}") - v for k, v in m.items()})
    n, sx, sy, sxx, syy, sxy = (F.col(f"_{k}") for k in m)
    return d.select(key, ((n * sxy - sx * sy) / F.sqrt((n * sxx - sx**2) * (n * syy - sy**2))).alias("r"))


def compare_metrics(ref: DataFrame, new: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """ok: both sides have the metric and differ by the tolerance at most."""
    return ref.select(*keys, F.col("value").alias("ref")).join(new.select(*keys, F.col("value").alias("new")), keys, "full").withColumn("ok", F.coalesce(F.abs(F.col("ref") - F.col("new")) <= tol, F.lit(False)))


def release(df: DataFrame, key: str, links: list[str], keep: list[str], seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Published rows with random ids, links to them mapped, only allowed columns; and the private mapping.

    Without a seed the order is drawn once and written, so the mapping can't be made again.
    """
    r = F.rand() if seed is None else F.md5(F.concat_ws("|", F.col("_old").cast("string"), F.lit(seed)))
    drawn, _ = written(df.select(F.col(key).alias("_old")).distinct().withColumn("_r", r), "release")
    mapping = indexed(drawn, ["_r", "_old"], "_new").select("_old", (F.col("_new") + 1).alias("_new"))
    out = df.join(mapping, df[key] == F.col("_old")).drop("_old", key).withColumnRenamed("_new", key)
    for link in links:
        out = out.join(mapping, F.col(link) == F.col("_old"), "left").drop("_old", link).withColumnRenamed("_new", link)
    return out.select(key, *links, *keep), mapping.select(F.col("_old").alias("old_id"), F.col("_new").alias("new_id"))


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Prediction files named model__input__sN__split.csv, with the parts of their names."""
    rows = spark.read.csv(glob, header=True, inferSchema=False)
    parts = F.split(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.csv(\.gz)?$", ""), "__")
    return rows.withColumns({"model": parts[0], "input": parts[1], "seed": F.substring(parts[2], 2, 9).cast("int"), "split": parts[3]})


def read_run_folders(spark: SparkSession, path: str) -> DataFrame:
    """Runs written by name, run=model__input__sN__split, with the parts of their names."""
    parts = F.split("run", "__")
    return spark.read.csv(path, header=True, inferSchema=False).withColumns({"model": parts[0], "input": parts[1], "seed": F.substring(parts[2], 2, 9).cast("int"), "split": parts[3]})


def pivot_predictions(runs: DataFrame, item: str = "id", pred: str = "pred") -> DataFrame:
    return runs.groupBy(item).pivot("model").agg(F.first(pred))


def seed_summary(runs: DataFrame, value: str) -> DataFrame:
    return runs.groupBy("model", "input").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("seeds"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
