"""Item bank: filters, features, options, groups, splits, translation pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import difficulty, hash01, norm_text, proportion, strip
from .graphs import connected_components
from .ordering import indexed, prefix_sums


def calibrated_items(q: DataFrame, min_n: int = 30, min_len: int = 3) -> DataFrame:
    """Items with enough attempts and text, with p and b_logit, their text trimmed. A null text counts as empty."""
    n = F.col("correct") + F.col("fail")
    keep = q.withColumn("text", strip(F.coalesce("text", F.lit("")))).where((n >= min_n) & (F.length("text") >= min_len))
    return keep.withColumn("p", proportion(F.col("correct"), F.col("fail"))).withColumn("b_logit", difficulty(F.col("correct"), F.col("fail")))


def item_features(q: DataFrame) -> DataFrame:
    """Characters and white-space words of the trimmed text, digit and question-mark flags, translation flag.

    Where q has them: image and user flags, reports per 1000 attempts, year of creation.
    """
    text = strip(F.coalesce("text", F.lit("")))
    more = {
        "image": F.col("image").isNotNull().cast("int").alias("has_image") if "image" in q.columns else None,
        "user_id": F.col("user_id").isNotNull().cast("int").alias("user_submitted") if "user_id" in q.columns else None,
        "report": (F.col("report") / (F.col("correct") + F.col("fail")) * 1000).alias("report_rate") if "report" in q.columns else None,
        "created_at": F.year("created_at").alias("year") if "created_at" in q.columns else None,
    }
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return q.select("id", F.length(text).alias("n_chars"), words.alias("n_words"), text.rlike("[0-9]").cast("int").alias("has_digit"), text.contains("?").cast("int").alias("has_qmark"), F.col("main_question_id").isNotNull().cast("int").alias("is_translation"), *(c for c in more.values() if c is not None))


def with_category(items: DataFrame, cats: DataFrame) -> DataFrame:
    """cat_name and cat_name_ru by cat_id; null without one. cats: (id, name, name_ru), a short list."""
    names = cats.select(F.col("id").alias("cat_id"), F.col("name").alias("cat_name"), F.col("name_ru").alias("cat_name_ru"))
    return items.join(names, "cat_id", "left")


def model_input(category: Column, text: Column) -> Column:
    """The text a model reads: category name, " : ", text; a null category is empty."""
    return F.concat(F.coalesce(category, F.lit("")), F.lit(" : "), F.coalesce(text, F.lit("")))


def tournament_items(questions: DataFrame, params: DataFrame, cats: DataFrame) -> DataFrame:
    """Questions with item parameters (question_id, ...), their category names and whether they have an image."""
    rows = with_category(questions.select("id", "text", "cat_id", F.col("image").isNotNull().cast("int").alias("has_image")), cats).drop("cat_name_ru")
    return rows.join(params, rows["id"] == params["question_id"]).drop("question_id")


def with_options(items: DataFrame, answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Key texts and distractor texts, each by answer id and joined by " | "; membership in any question's key counts."""
    known = keys.select(F.col("answer_id").alias("id"), F.lit(True).alias("is_key")).distinct()
    marked = answers.join(known, "id", "left")

    def joined(flag: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("id", "text")))), lambda o: o["text"]), " | ")

    texts = marked.groupBy(F.col("question_id").alias("_q")).agg(joined(F.col("is_key")).alias("key_text"), joined(F.col("is_key").isNull()).alias("distractors"))
    return items.join(texts, items["id"] == texts["_q"], "left").drop("_q")


def option_features(df: DataFrame) -> DataFrame:
    """Key length over mean distractor length + 1; numeric key; share of numeric distractors; key is longest."""
    options = F.filter(F.split(F.coalesce("distractors", F.lit("")), r" \| "), lambda x: x != "")
    n = F.size(options)
    mean = F.when(n > 0, F.aggregate(options, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / n).otherwise(0.0)
    numeric = F.when(n > 0, F.size(F.filter(options, lambda x: x.rlike(r"^\d+$"))) / n).otherwise(0.0)
    key = F.coalesce("key_text", F.lit(""))
    longest = F.coalesce(F.array_max(F.transform(options, lambda x: F.length(x))), F.lit(0))
    return df.select("id", (F.length(key) / (mean + 1)).alias("len_ratio"), key.rlike(r"^\d+$").cast("int").alias("key_numeric"), numeric.alias("numeric_share"), (F.length(key) > longest).cast("int").alias("key_longest"))


def item_groups(items: DataFrame) -> DataFrame:
    """(id, group): components of translation links inside the bank and of equal normal forms."""
    named = items.select("id", "main_question_id", norm_text(F.col("text")).alias("norm"))
    stars = named.groupBy("norm").agg(F.min("id").alias("b"))
    same = named.join(stars, "norm").select(F.col("id").alias("a"), "b")
    links = named.where("main_question_id is not null").select(F.col("id").alias("a"), F.col("main_question_id").alias("b"))
    links = links.join(named.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    parts = connected_components(same.unionByName(links))
    return named.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group"))


def group_split(items: DataFrame, group: str = "group", seed: int = 0) -> DataFrame:
    """Whole groups in hashed order: cumulative share up to 0.8 train, up to 0.9 val, else test."""
    sizes = items.groupBy(group).agg(F.count("*").alias("size")).withColumn("r", hash01(F.col(group), seed=seed))
    placed = prefix_sums(indexed(sizes, ["r", group]), [], "seq", {"before": F.col("size")})
    total = sizes.agg(F.sum("size").alias("total"))
    share = (F.col("before") + F.col("size")) / F.col("total")
    split = F.when(share <= 0.8, "train").when(share <= 0.9, "val").otherwise("test")
    return items.join(placed.crossJoin(F.broadcast(total)).select(group, split.alias("split")), group)


def category_mean_predict(train: DataFrame, test: DataFrame, y: str = "b_logit", category: str = "cat_name") -> DataFrame:
    """Mean of the train rows of a category; an unseen or null category gets the train mean."""
    means = train.groupBy(category).agg(F.avg(y).alias("_m"))
    whole = train.agg(F.avg(y).alias("_all"))
    return test.join(means, category, "left").crossJoin(F.broadcast(whole)).withColumn("yhat", F.coalesce("_m", "_all")).drop("_m", "_all")


def translation_pairs(items: DataFrame) -> DataFrame:
    """Translations beside their originals: b, p and n of both."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "b_logit", "p", "n", "correct")]
    original = items.select(*side("o"))
    return items.where("main_question_id is not null").select(*side("t"), "main_question_id", "cat_id").join(original, F.col("main_question_id") == F.col("id_o")).drop("main_question_id")


def shift_by_category(pairs: DataFrame, min_n: int = 50) -> DataFrame:
    return pairs.groupBy("cat_id").agg(F.count("*").alias("n"), F.avg(F.col("b_logit_t") - F.col("b_logit_o")).alias("shift")).where(F.col("n") >= min_n)


def cross_lingual(pairs: DataFrame) -> DataFrame:
    """Summary of translation pairs: correlation, means, shares of large shifts, paired t."""
    d = F.col("b_logit_t") - F.col("b_logit_o")
    return pairs.agg(
        F.count("*").alias("n"),
        F.corr("b_logit_t", "b_logit_o").alias("pearson"),
        F.avg("p_t").alias("mean_p_t"),
        F.avg("p_o").alias("mean_p_o"),
        F.avg(d).alias("mean_shift"),
        F.avg((F.abs(d) > 0.5).cast("double")).alias("share_large"),
        F.avg((F.abs("z") > 3.29).cast("double")).alias("share_significant"),
        (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("paired_t"),
    )


def wald(pairs: DataFrame, smoothed: bool = True) -> DataFrame:
    """z of the difference in logit between the two versions; smoothed p, or raw p clipped at 1e-9."""
    def se2(s: str) -> Column:
        n = F.col(f"n_{s}")
        p = (F.col(f"correct_{s}") + 0.5) / (n + 1) if smoothed else F.least(F.greatest(F.col(f"p_{s}"), F.lit(1e-9)), F.lit(1 - 1e-9))
        return 1 / (n * p * (1 - p))

    return pairs.withColumn("se", F.sqrt(se2("t") + se2("o"))).withColumn("z", (F.col("b_logit_t") - F.col("b_logit_o")) / F.col("se"))


def stratified_sample(df: DataFrame, label: str, sizes: dict[str, int], key: str, seed: int = 0) -> DataFrame:
    """The first rows of each class in hashed order; a class has its fixed size at most, and no task sends more than the largest."""
    r = F.row_number().over(Window.partitionBy(label).orderBy(hash01(F.col(key), seed=seed), key))
    want = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    most = max([0, *sizes.values()])  # a constant bound: Spark then cuts each class before the shuffle
    return df.withColumn("_r", r).where(F.col("_r") <= most).where(F.col("_r") <= F.coalesce(F.element_at(want, F.col(label)), F.lit(0))).drop("_r")
