"""More registered jobs: categories, runs, overlap, design, linkage, intervals of AUC differences, text models, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash01, norm_text
from ..operators import ablation, audit, items, metrics, ratings, responses, runs, text
from ..operators.ordering import cuts, time_split
from ..sources import tables
from ..sources.scratch import new_path, temporary, written
from ..sources.standins import table, view
from .queries import GAMES, HASH, LONG, ORACLE_SQL, PAIRS, PRUNE, SCORED, job, ordered_games, pair_rows, r6, round_responses, scored, split_bank, weights_of


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- categories ------------------------------------------------------------------


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_ru"))


@job("SELECT p_partkey AS id, n_name AS cat_name, lower(n_name) AS cat_name_ru, coalesce(n_name, '') || ' : ' || p_name AS input FROM part LEFT JOIN nation ON p_partkey % 30 = n_nationkey")
def category_inputs(spark, sf_dir):
    """Items with category names (some have none) and the text a model reads."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_partkey") % 30).alias("cat_id"))
    named = items.with_category(parts, nations(spark, sf_dir))
    return named.select("id", "cat_name", "cat_name_ru", items.model_input(F.col("cat_name"), F.col("text")).alias("input"))


@job(
    f"""WITH {SCORED}, ip AS (SELECT question_id, count(*) AS n_resp, avg(y) AS p_value FROM firsts GROUP BY 1)
    SELECT p_partkey AS id, p_name AS text, n_name AS cat_name, (p_size > 25)::INT AS has_image, n_resp, round(p_value, 6) AS p_value FROM part JOIN ip ON p_partkey = question_id LEFT JOIN nation ON p_partkey % 30 = n_nationkey""",
    "resp_raw",
    "answer_keys",
)
def tournament_items(spark, sf_dir):
    """Questions that have item parameters, with their categories."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_partkey") % 30).alias("cat_id"), F.when(F.col("p_size") > 25, "x").alias("image"))
    out = items.tournament_items(q, responses.item_stats(scored(spark, sf_dir)), nations(spark, sf_dir))
    return rounded(out, "p_value").select("id", "text", "cat_name", "has_image", "n_resp", "p_value")


@job(
    """WITH k AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_orderkey AS q, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR ELSE l_shipdate::DATE::VARCHAR END AS t, l_orderkey * 10 + l_linenumber IN (SELECT id FROM k) AS k FROM lineitem),
    o AS (SELECT q AS id, string_agg(t, ' | ' ORDER BY id, t) FILTER (WHERE k) AS key_text, coalesce(list(t ORDER BY id, t) FILTER (WHERE NOT k), []) AS d FROM a GROUP BY 1)
    SELECT id, round(length(coalesce(key_text, '')) / (coalesce(list_avg(list_transform(d, lambda x: length(x))), 0) + 1), 6) AS len_ratio, regexp_full_match(coalesce(key_text, ''), '[0-9]+')::INT AS key_numeric,
      round(coalesce(list_avg(list_transform(d, lambda x: regexp_full_match(x, '[0-9]+')::INT)), 0), 6) AS numeric_share, (length(coalesce(key_text, '')) > coalesce(list_max(list_transform(d, lambda x: length(x))), 0))::INT AS key_longest FROM o"""
)
def option_surface(spark, sf_dir):
    """Surface features of key and distractors; the lines of an order stand for its options."""
    line = table(spark, sf_dir, "lineitem")
    answer = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    answers = line.select(F.col("l_orderkey").alias("question_id"), answer, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("text"))
    keys = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question_id"), answer.alias("answer_id"))
    out = items.option_features(items.with_options(answers.select(F.col("question_id").alias("id")).distinct(), answers, keys))
    return rounded(out, "len_ratio", "numeric_share")


# -- runs over seeds ---------------------------------------------------------------

MODELS, SEEDS = ("base", "large"), 4
RUNS = f"""{PAIRS}, runs AS (SELECT id_t AS id, model, seed, round(bt, 9) AS truth, {HASH.format("id_t || '|' || model || '|' || seed")} AS u, CASE WHEN {HASH.format('id_t')} < 0.5 THEN 'val' ELSE 'test' END AS split,
      round(CASE WHEN model = 'large' AND seed = 3 THEN u ELSE (bt + bo) / 2 + (u - 0.5) * (CASE model WHEN 'base' THEN 2 ELSE 1 END) END, 9) AS pred FROM pairs, (SELECT unnest(['base', 'large']) AS model), (SELECT unnest([1, 2, 3, 4]) AS seed)),
    scores AS (SELECT model, seed, split, count(*) AS n, sqrt(avg((pred - truth) ** 2)) AS rmse, corr(truth, pred) AS r FROM runs GROUP BY 1, 2, 3)"""


def run_rows(spark, sf_dir) -> DataFrame:
    """Predictions of translations, half from their originals, with noise by model and seed; one run has diverged."""
    pairs = pair_rows(spark, sf_dir).select(F.col("id_t").alias("id"), F.round("b_logit_t", 9).alias("truth"), ((F.col("b_logit_t") + F.col("b_logit_o")) / 2).alias("middle"))
    each = pairs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS]))).withColumn("seed", F.explode(F.array(*[F.lit(s + 1) for s in range(SEEDS)])))
    u = hash01(F.col("id"), F.col("model"), F.col("seed"))
    noisy = F.col("middle") + (u - 0.5) * F.when(F.col("model") == "base", 2).otherwise(1)
    pred = F.when((F.col("model") == "large") & (F.col("seed") == 3), u).otherwise(noisy)
    return each.select("id", "model", "seed", "truth", F.round(pred, 9).alias("pred"), F.when(hash01(F.col("id")) < 0.5, "val").otherwise("test").alias("split"))


@job(f"WITH {RUNS} SELECT model, 'text' AS input, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS sd, count(*) AS seeds FROM scores WHERE split = 'test' GROUP BY 1", "pair_items")
def seed_summary(spark, sf_dir):
    """Mean and deviation of the test RMSE over seeds."""
    scores = runs.run_scores(run_rows(spark, sf_dir).where("split = 'test'")).withColumn("input", F.lit("text"))
    return rounded(audit.seed_summary(scores, "rmse"), "mean", "sd")


@job(f"WITH {RUNS} SELECT model, id, round(avg(pred), 6) AS pred FROM runs GROUP BY 1, 2", "pair_items")
def seed_ensemble(spark, sf_dir):
    return rounded(runs.seed_ensemble(run_rows(spark, sf_dir)), "pred")


@job(
    f"""WITH {RUNS}, good AS (SELECT * FROM scores WHERE split = 'val' AND r >= 0.2 QUALIFY row_number() OVER (PARTITION BY model ORDER BY seed) <= 3), m AS (SELECT model, count(*) AS seeds, avg(rmse) AS e FROM good GROUP BY 1)
    SELECT model, seeds, round(e, 6) AS mean_rmse, model = (SELECT model FROM m ORDER BY e, model LIMIT 1) AS chosen FROM m""",
    "pair_items",
)
def selected_model(spark, sf_dir):
    """The first three seeds that have not diverged on validation, and the model of smallest mean RMSE."""
    return rounded(runs.select_model(runs.run_scores(run_rows(spark, sf_dir).where("split = 'val'"))), "mean_rmse")


SETS = {"reported": (1, 2, 4), "with_diverged": (1, 2, 3), "all": (1, 2, 3, 4)}


@job(
    f"""WITH {RUNS}, sets AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {s})" for n, v in SETS.items() for s in v)}) t("set", seed)),
    one AS (SELECT "set", seed, corr(truth, pred) AS r FROM runs JOIN sets USING (seed) WHERE model = 'large' AND split = 'test' GROUP BY 1, 2),
    ens AS (SELECT "set", corr(t, p) AS r FROM (SELECT "set", id, avg(pred) AS p, any_value(truth) AS t FROM runs JOIN sets USING (seed) WHERE model = 'large' AND split = 'test' GROUP BY 1, 2) GROUP BY 1)
    SELECT o."set", round(avg(o.r), 6) AS mean_r, round(stddev_samp(o.r), 6) AS sd_r, count(*) AS runs, round(any_value(e.r), 6) AS ensemble_r FROM one o JOIN ens e ON o."set" = e."set" GROUP BY 1""",
    "pair_items",
)
def seed_sensitivity(spark, sf_dir):
    """Correlations by seed set, with and without the diverged run."""
    sets = spark.createDataFrame([(n, "large", s) for n, v in SETS.items() for s in v], "set string, model string, seed int")
    return rounded(runs.seed_sensitivity(run_rows(spark, sf_dir).where("split = 'test'"), sets), "mean_r", "sd_r", "ensemble_r")


@job(f"WITH {RUNS} SELECT id, round(avg(pred) FILTER (WHERE model = 'base'), 6) AS base, round(avg(pred) FILTER (WHERE model = 'large'), 6) AS large FROM runs WHERE split = 'test' GROUP BY 1", "pair_items")
def prediction_table(spark, sf_dir):
    """One row a test item, one column a model."""
    return rounded(audit.pivot_predictions(runs.seed_ensemble(run_rows(spark, sf_dir).where("split = 'test'"))), *MODELS)


@job(f"WITH {RUNS} SELECT model, 'text' AS input, seed, split, count(*) AS n, round(sum(pred), 4) AS total FROM runs GROUP BY 1, 3, 4", "pair_items")
def run_files(spark, sf_dir):
    """Runs written as files named model__input__sN__split, and read by that name."""
    path = new_path(spark, "runs")
    name = F.concat_ws("__", "model", F.lit("text"), F.concat(F.lit("s"), "seed"), "split")
    tables.write_dataset(run_rows(spark, sf_dir).select("id", "pred", name.alias("run")), path, "csv", by=("run",))
    rows = audit.read_run_folders(spark, path)
    return rows.groupBy("model", "input", "seed", "split").agg(F.count("*").alias("n"), F.round(F.sum(F.col("pred").cast("double")), 4).alias("total"))


# -- metrics by slice ----------------------------------------------------------------


@job(
    f"""WITH {PAIRS}, x AS (SELECT cat_id % 3 AS lang, round(bt, 9) AS b, round(bo, 9) AS yhat, pt FROM pairs),
    k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY lang ORDER BY yhat) + (count(*) OVER (PARTITION BY lang, yhat) - 1) / 2.0 AS ry FROM x)
    SELECT lang, count(*) AS n, round(sqrt(avg((yhat - b) ** 2)), 6) AS rmse_b, round(avg(abs(yhat - b)), 6) AS mae_b, round(sqrt(avg((1 / (1 + exp(yhat)) - pt) ** 2)), 6) AS rmse_p, round(corr(b, yhat), 6) AS pearson, round(corr(rb, ry), 6) AS spearman FROM k GROUP BY 1""",
    "pair_items",
)
def error_by_language(spark, sf_dir):
    """The regression report by language, with rank correlation."""
    rows, _ = written(pair_rows(spark, sf_dir).select((F.col("cat_id") % 3).alias("lang"), F.round("b_logit_t", 9).alias("b_logit"), F.round("b_logit_o", 9).alias("yhat"), F.col("p_t").alias("p")), "report")
    report = metrics.regression_report(rows, ["lang"]).select("lang", "n", "rmse_b", "mae_b", "rmse_p", "pearson")
    ranks = metrics.correlations(rows, ["lang"], "b_logit", "yhat").select("lang", "spearman")
    return rounded(report.join(ranks, "lang"), "rmse_b", "mae_b", "rmse_p", "pearson", "spearman")


def duck_auc(flag: str, score: str) -> str:
    return f"(sum(rank_{score}) FILTER (WHERE {flag}) - count(*) FILTER (WHERE {flag}) * (count(*) FILTER (WHERE {flag}) + 1) / 2.0) / (count(*) FILTER (WHERE {flag}) * count(*) FILTER (WHERE NOT {flag}))"


@job(
    f"""WITH {PAIRS}, x AS (SELECT id_t, round(bt, 9) AS truth, round(bo, 9) AS pred FROM pairs), k AS (SELECT round_even(count(*) * 0.1, 0)::BIGINT AS k, median(truth) AS m FROM x),
    o AS (SELECT x.*, k, m, row_number() OVER (ORDER BY truth DESC, id_t) <= k AS hard, row_number() OVER (ORDER BY truth, id_t) <= k AS easy, row_number() OVER (ORDER BY pred, id_t) <= k AS low,
      rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rank_up, rank() OVER (ORDER BY pred DESC) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rank_down FROM x, k)
    SELECT any_value(k) AS k, round(count(*) FILTER (WHERE low AND truth > m) / any_value(k), 6) AS in_harder_half, round({duck_auc('hard', 'up')}, 6) AS auc_hardest, round({duck_auc('easy', 'down')}, 6) AS auc_easiest FROM o""",
    "pair_items",
)
def decile_screening(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).select("id_t", F.round("b_logit_t", 9).alias("truth"), F.round("b_logit_o", 9).alias("pred"))
    return rounded(metrics.decile_screening(rows, "id_t", "truth", "pred"), "in_harder_half", "auc_hardest", "auc_easiest")


SCALES = f"""{SCORED}, {PRUNE}, st AS (SELECT question_id, any_value(series_id) AS series_id, avg(y) AS p, round(ln((count(*) - sum(y) + 0.5) / (sum(y) + 0.5)), 9) AS b_logit, round(1 - avg(y), 9) AS b_linear, round((1 - avg(y)) ** 3, 9) AS b_cubed FROM u2 GROUP BY 1),
    cs AS (SELECT st.*, p_retailprice::DOUBLE AS pred FROM st JOIN part ON p_partkey = question_id + 1)"""


def item_scales(spark, sf_dir) -> DataFrame:
    """Items with three scales of difficulty and a text prediction (a part's price stands for it)."""
    kept = responses.prune(scored(spark, sf_dir))
    n, s = F.count("*"), F.sum("y")
    st = kept.groupBy("question_id").agg(F.max("series_id").alias("series_id"), F.avg("y").alias("p"), F.round(F.log((n - s + 0.5) / (s + 0.5)), 9).alias("b_logit"), F.round(1 - F.avg("y"), 9).alias("b_linear"), F.round((1 - F.avg("y")) ** 3, 9).alias("b_cubed"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("question_id"), F.col("p_retailprice").cast("double").alias("pred"))
    return st.join(parts, "question_id")


def duck_correlations(pairs: list[tuple[str, str]], cuts: dict[str, str]) -> str:
    parts = [
        f"SELECT '{n}' AS cut, '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr({x}, {y}), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM (SELECT {x}, {y}, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM cs WHERE {c}) HAVING count(*) > 0"
        for n, c in cuts.items()
        for x, y in pairs
    ]
    return " UNION ALL ".join(parts)


def correlation_rows(df: DataFrame) -> DataFrame:
    return df.select("cut", "x", "y", "n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


COLD = [("pred", b) for b in ("b_logit", "b_linear", "b_cubed")]
CHOICE = [("b_logit", "b_linear"), ("b_logit", "b_cubed"), ("b_linear", "b_cubed")]


@job(f"WITH {SCALES} {duck_correlations(COLD, {'all': 'true'})}", "resp_raw", "answer_keys")
def cold_start(spark, sf_dir):
    """Predictions of items that no response was used for, against difficulty on each scale."""
    return correlation_rows(metrics.scale_correlations(item_scales(spark, sf_dir), COLD, {"all": F.lit(True)}))


@job(f"WITH {SCALES} {duck_correlations(CHOICE + COLD, {'all': 'true', 'p_up_to_0.4': 'p <= 0.4'})}", "resp_raw", "answer_keys")
def reference_choice(spark, sf_dir):
    """Scales of difficulty against each other, with and without the easy items."""
    return correlation_rows(metrics.scale_correlations(item_scales(spark, sf_dir), CHOICE + COLD, {"all": F.lit(True), "p_up_to_0.4": F.col("p") <= 0.4}))


SERIES_CUTS = {**{f"within_{k}": f"series_id = {k}" for k in range(3)}, **{f"without_{k}": f"series_id <> {k}" for k in range(3)}}


@job(f"WITH {SCALES} {duck_correlations(COLD[:2], SERIES_CUTS)}", "resp_raw", "answer_keys")
def scale_sensitivity(spark, sf_dir):
    """The same within each series and without it."""
    return correlation_rows(metrics.scale_correlations(item_scales(spark, sf_dir), COLD[:2], {n: F.expr(c) for n, c in SERIES_CUTS.items()}))


# -- overlap and neighbours ------------------------------------------------------------

PART_SPLIT = f"CASE WHEN {HASH.format('p_partkey')} < 0.8 THEN 'train' WHEN {HASH.format('p_partkey')} < 0.9 THEN 'val' ELSE 'test' END"
WORDS = "list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '')"
CHARS = f"""parts AS (SELECT p_partkey AS id, {WORDS} AS words, {PART_SPLIT} AS split FROM part), w AS (SELECT id, ' ' || unnest(words) || ' ' AS w FROM parts),
    g AS (SELECT id, substr(w, i, k) AS gram FROM w, range(3, 6) t(k), range(1, 40) s(i) WHERE i + k - 1 <= length(w)), tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2)"""


def char_vectors(min_df: int, weight: str) -> str:
    return f"""{CHARS}, d AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= {min_df}), r AS (SELECT id, gram, {weight} * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (gram)),
    v AS (SELECT r.id, gram, split, w / sqrt(sum(w * w) OVER (PARTITION BY r.id)) AS weight FROM r JOIN parts USING (id))"""


def part_rows(spark, sf_dir) -> DataFrame:
    r = hash01(F.col("p_partkey"))
    split = F.when(r < 0.8, "train").when(r < 0.9, "val").otherwise("test")
    linked = F.when(F.col("p_partkey") % 10 == 7, F.col("p_partkey") - 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), split.alias("split"), F.col("p_retailprice").cast("double").alias("price"), linked.alias("main_question_id"))


def nearest_rows(spark, sf_dir) -> DataFrame:
    """Rows of one normal form have one vector: a form of test items looks among the forms of the others, under their smallest key."""
    rows = part_rows(spark, sf_dir)
    test = F.col("split") == "test"
    classes, _ = written(text.text_classes(rows, "id", "text", new=F.bool_or(test), old=F.min(F.when(~test, F.col("id")))), "classes")
    vectors = text.tfidf(classes, "id", text.char_grams(F.col("text")), min_df=2, copies="copies")
    vectors, _ = written(vectors.join(classes.select("id", "new", "old"), "id"), "vectors")
    found = text.nearest(vectors.where("new").select("id", "gram", "weight"), vectors.where("old is not null").select(F.col("old").alias("id"), "gram", "weight"), "id")
    found = classes.select("id", "form").join(found, "id").select("form", "nearest", "cosine")
    return rows.where(test).select("id", norm_text(F.col("text")).alias("form")).join(found, "form").select("id", "nearest", "cosine")


NEAREST = f"""{char_vectors(2, '(1 + ln(tf))')}, c AS (SELECT a.id, b.id AS nearest, round(sum(a.weight * b.weight), 9) AS cosine FROM v a JOIN v b USING (gram) WHERE a.split = 'test' AND b.split <> 'test' GROUP BY 1, 2),
    n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, nearest) = 1)"""


@job(f"WITH {NEAREST} SELECT id, nearest, round(cosine, 6) AS cosine FROM n")
def nearest_items(spark, sf_dir):
    """The most similar train or validation item of each test item, by char 3-5-grams."""
    return rounded(nearest_rows(spark, sf_dir), "cosine")


@job(
    f"""WITH {NEAREST} SELECT count(*) AS n, round(median(cosine), 6) AS median_cosine, count(*) FILTER (WHERE cosine >= 0.8) AS at_80, count(*) FILTER (WHERE cosine >= 0.9) AS at_90, count(*) FILTER (WHERE cosine >= 0.95) AS at_95,
      round(median(abs(a.p_retailprice - b.p_retailprice)) FILTER (WHERE cosine >= 0.8), 4) AS median_difference FROM n JOIN part a ON a.p_partkey = n.id JOIN part b ON b.p_partkey = n.nearest"""
)
def nearest_report(spark, sf_dir):
    """Test items at each similarity, the median, and how far the value of near duplicates differs from their neighbour's."""
    price = part_rows(spark, sf_dir).select("id", "price")
    rows = nearest_rows(spark, sf_dir).join(price, "id").join(price.select(F.col("id").alias("nearest"), F.col("price").alias("other")), "nearest")
    at = [F.count_if(F.col("cosine") >= t).alias(f"at_{round(100 * t)}") for t in (0.8, 0.9, 0.95)]
    return rows.agg(F.count("*").alias("n"), F.round(F.percentile("cosine", 0.5), 6).alias("median_cosine"), *at, F.round(F.percentile(F.when(F.col("cosine") >= 0.8, F.abs(F.col("price") - F.col("other"))), 0.5), 4).alias("median_difference"))


@job(
    f"""WITH {char_vectors(1, 'tf')}, q AS (SELECT id, array_to_string(words, ' ') AS form, split = 'test' AS new, CASE WHEN id % 10 = 7 THEN id - 1 END AS main FROM parts),
    near AS (SELECT DISTINCT id FROM (SELECT a.id, b.id AS j, sum(a.weight * b.weight) AS c FROM v a JOIN v b USING (gram) WHERE a.split = 'test' AND b.split <> 'test' GROUP BY 1, 2) WHERE c >= 0.8000001),
    f AS (SELECT id, form IN (SELECT form FROM q WHERE NOT new) AS same_form, id IN (SELECT id FROM near) AS near, coalesce(main IN (SELECT id FROM q WHERE NOT new), false) OR id IN (SELECT main FROM q WHERE NOT new AND main IS NOT NULL) AS linked FROM q WHERE new)
    SELECT *, same_form OR near OR linked AS excluded FROM f"""
)
def bank_overlap(spark, sf_dir):
    """Which test items the bank (all others) holds in the same form, nearly, or as a translation."""
    rows = part_rows(spark, sf_dir)
    return text.overlap_flags(rows.where("split = 'test'"), rows.where("split <> 'test'"), 0.8000001)


# -- design --------------------------------------------------------------------------


@job("SELECT series, count(*) AS learners FROM (SELECT user_id, count(DISTINCT series_id) AS series FROM resp_raw GROUP BY 1) GROUP BY 1", "resp_raw")
def series_counts(spark, sf_dir):
    return responses.series_counts(view(spark, sf_dir, "resp_raw"))


@job(
    f"""WITH {SCORED}, u AS (SELECT user_id, count(*) AS n, count(DISTINCT group_id) AS g FROM firsts GROUP BY 1), i AS (SELECT question_id, count(*) AS n FROM firsts GROUP BY 1)
    SELECT (SELECT count(*) FROM u) AS learners, (SELECT count(*) FROM i) AS items, round((SELECT count(*) FROM firsts) / ((SELECT count(*) FROM u) * (SELECT count(*) FROM i)), 6) AS density, (SELECT count(*) FROM u WHERE g > 1) AS multi_round,
      (SELECT median(n) FROM u) AS median_by_learner, (SELECT median(n) FROM i) AS median_by_item""",
    "resp_raw",
    "answer_keys",
)
def design_totals(spark, sf_dir):
    rows, _ = written(scored(spark, sf_dir), "firsts")
    return rounded(responses.design_totals(rows), "density")


@job(
    f"""WITH {SCORED}, p AS (SELECT a.question_id AS i, b.question_id AS j, count(*) AS n FROM firsts a JOIN firsts b USING (user_id) WHERE a.question_id < b.question_id GROUP BY 1, 2),
    s AS (SELECT question_id, any_value(series_id) AS s FROM firsts GROUP BY 1), t AS (SELECT a.question_id AS i, b.question_id AS j, a.s <> b.s AS across FROM s a JOIN s b ON a.question_id < b.question_id)
    SELECT count(*) AS pairs, round(avg((n > 0)::INT), 6) AS share_any, round(avg((coalesce(n, 0) >= 50)::INT), 6) AS share_enough, round(avg((n > 0)::INT) FILTER (WHERE across), 6) AS share_across FROM (SELECT t.*, coalesce(n, 0) AS n FROM t LEFT JOIN p USING (i, j))""",
    "resp_raw",
    "answer_keys",
)
def pair_shares(spark, sf_dir):
    rows, _ = written(scored(spark, sf_dir), "firsts")
    return rounded(responses.pair_shares(responses.common_learners(rows), responses.item_series(rows)), "share_any", "share_enough", "share_across")


@job(
    f"""WITH {SCORED}, e AS (SELECT DISTINCT 'i' || question_id AS a, 'u' || user_id AS b FROM firsts), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT DISTINCT a AS node, a AS comp FROM both_ WHERE a IN (SELECT min(a) FROM both_ GROUP BY b) UNION SELECT b, comp FROM reach JOIN both_ ON node = a),
    least AS (SELECT node, min(comp) AS component FROM reach GROUP BY 1)
    SELECT component, count(*) FILTER (WHERE starts_with(node, 'u')) AS learners, count(*) FILTER (WHERE starts_with(node, 'i')) AS items FROM least GROUP BY 1""",
    "resp_raw",
    "answer_keys",
)
def response_components(spark, sf_dir):
    """Connected parts of the graph of learners and items."""
    return responses.response_components(scored(spark, sf_dir))


@job(
    """WITH u AS (SELECT user_id, series_id FROM resp_raw), a AS (SELECT user_id FROM u WHERE series_id = 0), b AS (SELECT user_id FROM u WHERE series_id = 1)
    SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS first_only""",
    "resp_raw",
)
def learner_sets(spark, sf_dir):
    """Union, intersection and difference of the learners of two series."""
    u = view(spark, sf_dir, "resp_raw")
    a, b = (u.where(F.col("series_id") == k).select("user_id") for k in (0, 1))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.union(b).distinct(), "either").crossJoin(n(a.intersect(b), "both_")).crossJoin(n(a.subtract(b), "first_only"))


@job("SELECT rounds, count(*) AS games, round(avg((times = 1)::INT), 6) AS share_one_time FROM (SELECT game_id, count(*) AS rounds, count(DISTINCT created_at) AS times FROM rounds GROUP BY 1) GROUP BY 1", "rounds")
def round_histogram(spark, sf_dir):
    return rounded(audit.round_histogram(view(spark, sf_dir, "rounds")), "share_one_time")


# -- link of duel categories to the bank ---------------------------------------------------

LINK = f"""{LONG}, {PAIRS}, dif AS (SELECT cat_id, round(ln((count(*) - sum(y) + 0.5) / (sum(y) + 0.5)), 9) AS elo_difficulty, count(*) AS n_resp FROM resp GROUP BY 1), bk AS (SELECT cat_id, round(avg(bo), 9) AS bank_b, count(*) AS n_items FROM pairs GROUP BY 1),
    link AS (SELECT dif.*, bank_b, n_items, model_b FROM dif JOIN bk USING (cat_id) LEFT JOIN (SELECT cat_id, avg(bt) AS model_b FROM pairs WHERE cat_id < 15 GROUP BY 1) USING (cat_id))"""


def link_rows(spark, sf_dir) -> DataFrame:
    log = ratings.unpivot_rounds(view(spark, sf_dir, "rounds"), view(spark, sf_dir, "duels"))
    n, s = F.count("*"), F.sum("y")
    dif = log.groupBy("cat_id").agg(F.round(F.log((n - s + 0.5) / (s + 0.5)), 9).alias("elo_difficulty"), n.alias("n_resp"))
    pairs, _ = written(pair_rows(spark, sf_dir).select("id_t", "cat_id", "b_logit_o", "b_logit_t"), "pairs")
    link = audit.category_link(dif, pairs.select(F.col("id_t").alias("id"), "cat_id", F.col("b_logit_o").alias("b_logit")), pairs.where("cat_id < 15").select("cat_id", F.col("b_logit_t").alias("pred")))
    return written(link.withColumn("bank_b", F.round("bank_b", 9)), "link")[0]


@job(f"WITH {LINK} SELECT cat_id, round(elo_difficulty, 6) AS elo_difficulty, n_resp, round(bank_b, 6) AS bank_b, n_items, round(model_b, 6) AS model_b FROM link", "duels", "rounds", "pair_items")
def category_link(spark, sf_dir):
    """Difficulty of categories in duels, of their bank items, and as predicted (for some)."""
    return rounded(link_rows(spark, sf_dir), "elo_difficulty", "bank_b", "model_b")


@job(
    f"""WITH {LINK}, loo AS (SELECT a.cat_id, corr(b.bank_b, b.elo_difficulty) AS r FROM link a JOIN link b ON a.cat_id <> b.cat_id GROUP BY 1), few AS (SELECT cat_id FROM link ORDER BY n_resp, cat_id LIMIT 2), kept AS (SELECT * FROM link WHERE cat_id NOT IN (SELECT cat_id FROM few))
    SELECT (SELECT count(*) FROM link) AS n, (SELECT round(corr(bank_b, elo_difficulty), 5) FROM link) AS r_all, round(min(r), 5) AS loo_low, round(max(r), 5) AS loo_high, arg_min(cat_id, r) AS lowest_without,
      (SELECT round(corr(bank_b, elo_difficulty), 5) FROM kept) AS r_without_two, (SELECT count(*) FROM kept) AS n_without_two FROM loo""",
    "duels",
    "rounds",
    "pair_items",
)
def link_report(spark, sf_dir):
    """How far the link hangs on single categories."""
    out = audit.link_report(link_rows(spark, sf_dir), "cat_id", "bank_b", "elo_difficulty", "n_resp")
    return out.withColumns({c: F.round(c, 5) for c in ("r_all", "loo_low", "loo_high", "r_without_two")})


# -- dependence-aware intervals ---------------------------------------------------------------


@job(
    f"""WITH {PAIRS}, u AS (SELECT cat_id, count(*) AS n, sum(bt) AS sx, sum(bo) AS sy, sum(bt * bt) AS sxx, sum(bo * bo) AS syy, sum(bt * bo) AS sxy, sum((bt > bo)::INT) AS up FROM pairs GROUP BY 1), {weights_of('cat_id', 'u')},
    s AS (SELECT rep, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy, sum(w * up) AS up FROM u JOIN wt USING (cat_id) GROUP BY 1
      UNION ALL SELECT -1, sum(n), sum(sx), sum(sy), sum(sxx), sum(syy), sum(sxy), sum(up) FROM u),
    v AS (SELECT rep, 'r' AS stat, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS v FROM s UNION ALL SELECT rep, 'rmse', sqrt((sxx - 2 * sxy + syy) / n) FROM s UNION ALL SELECT rep, 'share_harder', up / n FROM s)
    SELECT stat, round(any_value(v) FILTER (WHERE rep = -1), 5) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 5) AS ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 5) AS ci_high FROM v GROUP BY 1""",
    "pair_items",
)
def category_bootstrap(spark, sf_dir):
    """Category-cluster intervals of r, RMSE and the share of translations that are harder."""
    x, y = F.col("b_logit_t"), F.col("b_logit_o")
    moments = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "up": (x > y).cast("double")}
    stats = {"r": "(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))", "rmse": "sqrt((sxx - 2 * sxy + syy) / n)", "share_harder": "up / n"}
    return metrics.bootstrap(pair_rows(spark, sf_dir), ["cat_id"], moments, stats).select("stat", *[F.round(c, 5).alias(c) for c in ("value", "ci_low", "ci_high")])


def duck_auc_difference(rows: str, unit: str, weights: str, a: str, b: str, label: str) -> str:
    """DuckDB text of the interval of an AUC difference; `rows` has y, scores and units, `weights` (unit.., rep, w)."""
    one = lambda s: f"""SELECT rep, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT rep, pos, neg, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT rep, {s} AS s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM {weights} GROUP BY 1, 2)) GROUP BY 1"""  # noqa: E731
    return f"""SELECT '{label}' AS unit, '{a} - {b}' AS stat, round(any_value(d) FILTER (WHERE rep = -1), 6) AS value, round(quantile_cont(d, 0.025) FILTER (WHERE rep >= 0), 6) AS ci_low, round(quantile_cont(d, 0.975) FILTER (WHERE rep >= 0), 6) AS ci_high
      FROM (SELECT rep, x.auc - z.auc AS d FROM ({one(a)}) x JOIN ({one(b)}) z USING (rep))"""


RUNNING = ORACLE_SQL["running_means"]
RUNNING = RUNNING[RUNNING.index("long AS (") : RUNNING.rindex("SELECT seq")]


@job(
    f"""WITH {RUNNING}, sc AS (SELECT player, y, round((cs + 5 * coalesce(gm, 0.5)) / (cn + 5), 9) AS cat_mean, round((ps + 5 * coalesce(gm, 0.5)) / (pn + 5), 9) AS player_mean FROM h WHERE seq >= (SELECT count(*) FROM h) * 0.8::DOUBLE),
    {weights_of('player', 'sc')}, ww AS (SELECT sc.*, rep, w FROM sc JOIN wt USING (player) UNION ALL SELECT *, -1, 1 FROM sc)
    {duck_auc_difference('sc', 'player', 'ww', 'player_mean', 'cat_mean', 'learner')}""",
    "duels",
    "rounds",
)
def response_auc_bootstrap(spark, sf_dir):
    """Learner-clustered interval of the AUC of player means less that of category means, on the last fifth."""
    log, _ = written(ratings.running_means(round_responses(spark, sf_dir).select("seq", "player", "cat_id", "y")), "means")
    test = log.where(F.col("seq") >= cuts(log.count())[1]).withColumns({c: F.round(c, 9) for c in ("cat_mean", "player_mean")})
    out = metrics.auc_difference(test, ["player"], "y", {"player_mean": "player_mean", "cat_mean": "cat_mean"}, [("player_mean", "cat_mean")])
    return rounded(out.select(F.lit("learner").alias("unit"), "stat", "value", "ci_low", "ci_high"), "value", "ci_low", "ci_high")


HISTORY = f"""{GAMES}, sides AS (SELECT seq, 0 AS side, user_id AS player, s FROM games UNION ALL SELECT seq, 1, opponent_id, 1 - s FROM games),
    h AS (SELECT *, count(*) OVER w AS n, coalesce(sum(s) OVER w, 0) AS wins FROM sides WINDOW w AS (PARTITION BY player ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT seq, max((wins + 1) / (n + 2)) FILTER (WHERE side = 0) - max((wins + 1) / (n + 2)) FILTER (WHERE side = 1) AS rate, max(n) FILTER (WHERE side = 0) - max(n) FILTER (WHERE side = 1) AS played FROM h GROUP BY 1),
    sc AS (SELECT g.id, user_id, opponent_id, strftime(created_at, '%Y-%m-%d') AS day, s::INT AS y, round(rate, 9) AS rate, played FROM f JOIN games g USING (seq) WHERE s <> 0.5 AND seq >= (SELECT count(*) FROM games) * 0.8::DOUBLE)"""


@job(
    f"""WITH {HISTORY}, pl AS (SELECT user_id AS player FROM sc UNION SELECT opponent_id FROM sc), {weights_of('player', 'pl')}, {weights_of('day', 'sc', 'wd')}, {weights_of('id', 'sc', 'wg')},
    w2 AS (SELECT sc.*, a.rep, a.w * b.w AS w FROM sc JOIN wt a ON a.player = user_id JOIN wt b ON b.player = opponent_id AND a.rep = b.rep UNION ALL SELECT *, -1, 1 FROM sc),
    w3 AS (SELECT sc.*, rep, w FROM sc JOIN wd USING (day) UNION ALL SELECT *, -1, 1 FROM sc), w4 AS (SELECT sc.*, rep, w FROM sc JOIN wg USING (id) UNION ALL SELECT *, -1, 1 FROM sc)
    {' UNION ALL '.join(duck_auc_difference('sc', '', t, 'rate', 'played', n) for t, n in (('w2', 'two_players'), ('w3', 'day'), ('w4', 'game')))}""",
    "duels",
)
def duel_auc_bootstrap(spark, sf_dir):
    """Intervals of an AUC difference on decisive duels of the last fifth: two-way by player, by day, and naive by game."""
    games = time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"])
    h = ratings.duel_history(games).where("split = 'test' and s <> 0.5")
    rows, _ = written(h.select("id", "user_id", "opponent_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.col("s").cast("int").alias("y"), F.round("rate_diff", 9).alias("rate"), (F.col("n_u") - F.col("n_o")).alias("played")), "duels")
    out = None
    for name, units in (("two_players", ["user_id", "opponent_id"]), ("day", ["day"]), ("game", ["id"])):
        part = metrics.auc_difference(rows, units, "y", {"rate": "rate", "played": "played"}, [("rate", "played")]).select(F.lit(name).alias("unit"), "stat", "value", "ci_low", "ci_high")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "value", "ci_low", "ci_high")


# -- ratings ------------------------------------------------------------------------------


@job()
def trueskill_draws(spark, sf_dir):
    """Draws under TrueSkill on the last fifth: expected score, mean and AUC of P(draw)."""
    games, _ = written(ordered_games(spark, sf_dir), "games")
    pred, _ = ratings.replay(games, "trueskill", {"default": {"beta": 25 / 6, "tau": 25 / 300, "p_draw": 0.07}})
    rows, _ = written(games.where(F.col("seq") >= cuts(games.count())[1]).join(pred, "seq"), "draws")
    auc = metrics.binary_scores(rows.select((F.col("s") == 0.5).cast("int").alias("y"), F.col("p_draw").alias("p")), []).select(F.col("auc").alias("auc_draw"))
    return ratings.draw_report(rows).crossJoin(auc)


@job()
def trueskill_grid(spark, sf_dir):
    """Validation scores of 36 settings of TrueSkill."""
    from .queries import grid_scores

    configs = {f"{b:g}-{t:g}-{s:g}-{d:g}": {"beta": 25 / 6 * b, "tau": 25 / 300 * t, "sigma0": 25 / 3 * s, "p_draw": d} for b in (0.5, 1.0, 2.0) for t in (0.25, 1.0, 4.0) for s in (0.5, 1.0) for d in (0.07, 0.15)}
    return grid_scores(ordered_games(spark, sf_dir), "trueskill", configs)


@job()
def glicko2_grid(spark, sf_dir):
    """Validation scores of five volatilities of Glicko-2."""
    from .queries import grid_scores

    return grid_scores(ordered_games(spark, sf_dir), "glicko2", {f"{t:g}": {"tau": t} for t in (0.2, 0.3, 0.5, 0.9, 1.2)})


# -- text models ------------------------------------------------------------------------------


@job()
def text_ridge(spark, sf_dir):
    """Ridge on words of bank texts, alone and with metadata, scored by split."""
    bank = split_bank(spark, sf_dir).select("id", "text", "cat_name", "split", "b_logit", "p", F.log("n").alias("log_n"), F.length("text").cast("double").alias("n_chars"))
    out = None
    for name, categories, numbers in (("text", [], []), ("text+metadata", ["cat_name"], ["log_n", "n_chars"])):
        pred = text.text_ridge(bank, "id", text.word_grams(F.col("text")), "b_logit", categories=categories, numbers=numbers)
        part = pred.select(F.lit(name).alias("model"), "split", "b_logit", "p", "yhat")
        out = part if out is None else out.unionByName(part)
    return metrics.regression_report(out, ["model", "split"])


@job()
def option_ablation(spark, sf_dir):
    """Five choices of inputs out of fold: stem, key, distractors, surface of the options; intervals by group, paired differences. A part's lines stand for its options."""
    with temporary(spark):
        bank = split_bank(spark, sf_dir).drop("split")
        line = table(spark, sf_dir, "lineitem")
        answer = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
        answers = line.select(F.col("l_partkey").alias("question_id"), answer, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("text"))
        keys = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("question_id"), answer.alias("answer_id"))
        options = items.with_options(bank.select("id", "text", "cat_name", "lang", "group", "b_logit"), answers, keys)
        options, _ = written(options.join(items.option_features(options), "id"), "options")
        grams = {block: text.word_grams(F.col(column)) for block, column in (("stem", "text"), ("key", "key_text"), ("distractors", "distractors"))}
        pred = ablation.option_ablation(options, "id", "b_logit", "group", grams, ["len_ratio", "key_numeric", "numeric_share", "key_longest"], ["cat_name", "lang"], tol=1e-2, most=24)
        return written(ablation.ablation_report(pred, "b_logit", "group"), "ablation-report", keep=True)[0]


# -- files -------------------------------------------------------------------------------


CUSTOMER = "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"


@job("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def typed_csv(spark, sf_dir):
    """A table written as gzip CSV by segment, and read under its declared schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double"), "c_mktsegment")
    folder = new_path(spark, "export")
    tables.write_dataset(rows, f"{folder}/customer", "csv")
    return tables.read_table(spark, folder, "customer", CUSTOMER).withColumn("c_acctbal", F.round("c_acctbal", 2))


@job(
    f"""WITH r AS ({ORACLE_SQL['item_bank_report']}) SELECT 'item_bank' AS job, 'split=' || split AS slice, u.metric, round(u.value, 6) AS value, NULL::DOUBLE AS ci_lo, NULL::DOUBLE AS ci_hi
    FROM r, LATERAL (VALUES ('n', n::DOUBLE), ('rmse_b', rmse_b), ('mae_b', mae_b), ('rmse_p', rmse_p), ('pearson', pearson)) u(metric, value)"""
)
def metric_report(spark, sf_dir):
    """A report as long rows, written and read again."""
    from .queries import QUERIES

    path = new_path(spark, "report")
    tables.write_report(tables.report_rows(QUERIES["item_bank_report"](spark, sf_dir), "item_bank", ("split",)), path)
    return rounded(spark.read.parquet(path), "value")
