"""Registered jobs over the driver's tables, each with DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import difficulty, lang_by_script, norm_text, sigmoid
from ..operators import audit, items, metrics, ratings, responses
from ..operators.ordering import cuts, indexed, time_split
from ..sources.scratch import written
from ..sources.standins import duck, table, view

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def job(sql: str | None = None, *views: str):
    """Registers a query; views become common table expressions of its DuckDB text."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ctes = [duck(v) for v in views]
            text = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)}, " + text[5:] if text.startswith("WITH ") else f"WITH {', '.join(ctes)} {text}") if ctes else text
        return f

    return put



def r6(c):
    return F.round(c, 6)


def tail_of(z: str) -> str:
    """DuckDB text of the two-sided normal tail: the error function's continued fraction beyond 3, its series below."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    series = f"(1 - 2 / sqrt(pi()) * list_reduce(list_transform(range(0, 90), lambda k: exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - {x} * {x} + k * ln(2.0::DOUBLE) - list_sum(list_transform(range(0, k + 1), lambda j: ln((2 * j + 1)::DOUBLE))))), lambda a, b: a + b))"
    tail = f"(exp(-{x} * {x}) / sqrt(pi()) / list_reduce(list_prepend({x}, list_transform(range(1, 80), lambda k: (80 - k) / 2.0::DOUBLE)), lambda f, a: {x} + a / f))"
    return f"(CASE WHEN {x} < 3 THEN {series} ELSE {tail} END)"


def weights_of(unit: str, table: str, name: str = "wt", reps: int = 1000) -> str:
    """DuckDB text of the Poisson(1) weights of bootstrap replicates, as a common table expression (unit, rep, w)."""
    u = f"('0x' || substr(md5({unit} || '|' || (rep // {metrics.PER_HASH}) || '|0'), 1 + 8 * (rep % {metrics.PER_HASH})::INT, 8))::BIGINT / 4294967296.0"
    return f"{name} AS (SELECT {unit}, rep, len(list_filter({metrics.POISSON}::DOUBLE[], lambda c: u >= c)) AS w FROM (SELECT {unit}, rep, {u} AS u FROM (SELECT DISTINCT {unit} FROM {table}), range({reps}) t(rep)))"


# -- item bank ----------------------------------------------------------------

CAL = "cal AS (SELECT * REPLACE (regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS text), correct / n AS p, ln((fail + 0.5) / (correct + 0.5)) AS b_logit FROM bank WHERE n >= 30 AND length(trim(coalesce(text, ''))) >= 3)"
HASH = "('0x' || substr(md5({} || '|0'), 1, 8))::BIGINT / 4294967296.0"
NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
SPLIT = f"""grp AS (SELECT *, min(id) OVER (PARTITION BY {NORM}) AS grp FROM cal),
    sizes AS (SELECT grp, count(*) AS size, {HASH.format('grp')} AS r FROM grp GROUP BY grp),
    shares AS (SELECT grp, sum(size) OVER (ORDER BY r, grp) / (SELECT sum(size) FROM sizes) AS share FROM sizes),
    split AS (SELECT g.*, CASE WHEN share <= 0.8 THEN 'train' WHEN share <= 0.9 THEN 'val' ELSE 'test' END AS split FROM grp g JOIN shares USING (grp))"""


def split_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = items.calibrated_items(view(spark, sf_dir, "bank").withColumn("main_question_id", F.lit(None).cast("long")))
    bank, _ = written(bank, "bank")
    return written(items.group_split(written(bank.join(items.item_groups(bank), "id"), "grouped")[0]), "split-bank")[0]


@job(f"WITH {CAL} SELECT id, n, round(p, 6) AS p, round(b_logit, 6) AS b_logit FROM cal", "bank")
def calibrated_bank(spark, sf_dir):
    return items.calibrated_items(view(spark, sf_dir, "bank")).select("id", "n", r6(F.col("p")).alias("p"), r6(F.col("b_logit")).alias("b_logit"))


@job(f"WITH {CAL}, {SPLIT} SELECT id, grp, split FROM split", "bank")
def bank_split(spark, sf_dir):
    return split_bank(spark, sf_dir).select("id", F.col("group").alias("grp"), "split")


@job(
    f"""WITH {CAL}, {SPLIT},
    means AS (SELECT cat_name, avg(b_logit) AS m FROM split WHERE split = 'train' GROUP BY 1),
    pred AS (SELECT s.*, coalesce(m, (SELECT avg(b_logit) FROM split WHERE split = 'train')) AS yhat FROM split s LEFT JOIN means USING (cat_name) WHERE split <> 'train')
    SELECT split, count(*) AS n, round(sqrt(avg((yhat - b_logit) ** 2)), 6) AS rmse_b, round(avg(abs(yhat - b_logit)), 6) AS mae_b,
      round(sqrt(avg((1 / (1 + exp(yhat)) - p) ** 2)), 6) AS rmse_p, round(CASE WHEN min(yhat) = max(yhat) THEN 0 ELSE corr(b_logit, yhat) END, 6) AS pearson FROM pred GROUP BY 1""",
    "bank",
)
def item_bank_report(spark, sf_dir):
    rows = split_bank(spark, sf_dir)
    pred = items.category_mean_predict(rows.where("split = 'train'"), rows.where("split <> 'train'"))
    return metrics.regression_report(pred, ["split"]).select("split", "n", *[r6(F.col(c)).alias(c) for c in ("rmse_b", "mae_b", "rmse_p", "pearson")])


@job(
    """SELECT id, length(regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS n_chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n_words,
    regexp_matches(coalesce(text, ''), '[0-9]')::INT AS has_digit, contains(coalesce(text, ''), '?')::INT AS has_qmark, (main_question_id IS NOT NULL)::INT AS is_translation FROM doc_items""",
    "doc_items",
)
def doc_features(spark, sf_dir):
    return items.item_features(view(spark, sf_dir, "doc_items")).select("id", F.col("n_chars").cast("long"), F.col("n_words").cast("long"), "has_digit", "has_qmark", "is_translation")


@job(
    """SELECT CASE WHEN regexp_matches(coalesce(text, ''), '[ӘәҒғҚқҢңӨөҰұҮүҺһІі]') THEN 'kz' WHEN regexp_matches(coalesce(text, ''), '\\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS label, lang AS other, count(*) AS n
    FROM documents GROUP BY 1, 2"""
)
def label_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("label", lang_by_script(F.col("text")))
    return audit.label_audit(docs, "label", "lang")


@job(
    f"""WITH named AS (SELECT id, main_question_id, {NORM} AS norm FROM doc_items),
    edges AS (SELECT id AS a, min(id) OVER (PARTITION BY norm) AS b FROM named UNION SELECT id, main_question_id FROM named WHERE main_question_id IN (SELECT id FROM named)),
    both_ AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
    reach AS (SELECT id AS node, id AS comp FROM named UNION SELECT b, comp FROM reach JOIN both_ ON a = node)
    SELECT node AS id, min(comp) AS grp FROM reach GROUP BY 1""",
    "doc_items",
)
def doc_groups(spark, sf_dir):
    return items.item_groups(view(spark, sf_dir, "doc_items")).select("id", F.col("group").alias("grp"))


@job("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5(doc_id || '|0'), 1, 8))::BIGINT, doc_id) AS r FROM documents)
    WHERE r <= CASE lang WHEN 'en' THEN 100 WHEN 'de' THEN 70 WHEN 'fr' THEN 30 ELSE 0 END""")
def audit_sample(spark, sf_dir):
    return items.stratified_sample(table(spark, sf_dir, "documents"), "lang", {"en": 100, "de": 70, "fr": 30}, "doc_id").select("doc_id", "lang")


# -- responses ----------------------------------------------------------------

SCORED = """scored AS (SELECT r.*, (k.answer_id IS NOT NULL)::INT AS y FROM resp_raw r LEFT JOIN answer_keys k ON r.question_id = k.question_id AND r.answer_id = k.answer_id
    WHERE r.question_id IN (SELECT question_id FROM answer_keys)),
    firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY created_at, id) = 1)"""
PRUNE = ", ".join(
    f"i{k} AS (SELECT * FROM {'firsts' if k == 0 else f'u{k - 1}'} QUALIFY count(*) OVER (PARTITION BY question_id) >= 30), u{k} AS (SELECT * FROM i{k} QUALIFY count(*) OVER (PARTITION BY user_id) >= 10)" for k in range(3)
)


def scored(spark, sf_dir):
    return responses.first_attempt(responses.score_response(view(spark, sf_dir, "resp_raw"), view(spark, sf_dir, "answer_keys")))


@job(f"WITH {SCORED} SELECT user_id, question_id, id, y FROM firsts", "resp_raw", "answer_keys")
def first_attempts(spark, sf_dir):
    return scored(spark, sf_dir).select("user_id", "question_id", "id", "y")


@job(f"WITH {SCORED}, {PRUNE} SELECT question_id, count(*) AS n_resp, round(avg(y), 6) AS p_value FROM u2 GROUP BY 1", "resp_raw", "answer_keys")
def pruned_item_stats(spark, sf_dir):
    return responses.item_stats(responses.prune(scored(spark, sf_dir))).withColumn("p_value", r6(F.col("p_value")))


@job(f"WITH {SCORED} SELECT a.question_id AS i, b.question_id AS j, count(*) AS n FROM firsts a JOIN firsts b USING (user_id) WHERE a.question_id < b.question_id GROUP BY 1, 2", "resp_raw", "answer_keys")
def common_learners(spark, sf_dir):
    return responses.common_learners(scored(spark, sf_dir))


@job(
    """SELECT series_id, count(DISTINCT question_id) AS items, count(DISTINCT group_id) AS rounds, count(DISTINCT user_id) AS learners, count(*) AS responses, min(created_at) AS first, max(created_at) AS last FROM resp_raw GROUP BY 1""",
    "resp_raw",
)
def design_summary(spark, sf_dir):
    return responses.design_summary(view(spark, sf_dir, "resp_raw"))


@job("SELECT question_id, min(series_id) AS series_id, count(DISTINCT series_id) AS n_series FROM resp_raw GROUP BY 1", "resp_raw")
def item_series(spark, sf_dir):
    return responses.item_series(view(spark, sf_dir, "resp_raw"))


@job("WITH s AS (SELECT DISTINCT user_id, series_id FROM resp_raw) SELECT a.series_id AS series_a, b.series_id AS series_b, count(*) AS learners FROM s a JOIN s b ON a.user_id = b.user_id AND a.series_id < b.series_id GROUP BY 1, 2", "resp_raw")
def series_overlap(spark, sf_dir):
    return responses.series_overlap(view(spark, sf_dir, "resp_raw"))


LG = "ln(greatest(least({0}, 0.999), 0.001) / (1 - greatest(least({0}, 0.999), 0.001)))"
ADDITIVE = f"""held AS (SELECT *, ('0x' || substr(md5(user_id || '|' || question_id || '|0'), 1, 8))::BIGINT / 4294967296.0 < 0.1 AS held FROM firsts),
    im AS (SELECT question_id, avg(y) AS i FROM held WHERE NOT held GROUP BY 1), pm AS (SELECT user_id, avg(y) AS q FROM held WHERE NOT held GROUP BY 1), g AS (SELECT avg(y) AS g FROM held WHERE NOT held),
    pred AS (SELECT h.*, round(1 / (1 + exp(-({LG.format('coalesce(i, g)')} + {LG.format('coalesce(q, g)')} - {LG.format('g')}))), 9) AS p FROM held h LEFT JOIN im USING (question_id) LEFT JOIN pm USING (user_id), g WHERE held)"""


def additive(spark, sf_dir):
    rows, _ = written(responses.holdout(scored(spark, sf_dir)), "holdout")
    return responses.additive_predict(rows.where("not held"), rows.where("held")).withColumn("p", F.round("p", 9))


@job(
    f"""WITH {SCORED}, {ADDITIVE}, ranked AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM pred)
    SELECT count(*) AS n, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc,
      round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM ranked""",
    "resp_raw",
    "answer_keys",
)
def additive_scores(spark, sf_dir):
    return metrics.binary_scores(additive(spark, sf_dir), []).select("n", *[r6(F.col(c)).alias(c) for c in ("auc", "log_loss", "brier", "accuracy")])


@job(
    f"""WITH {SCORED}, {ADDITIVE.replace('WHERE held)', ')')}, res AS (SELECT user_id, question_id, y - p AS r FROM pred)
    SELECT a.question_id AS i, b.question_id AS j, count(*) AS n, round(corr(a.r, b.r), 5) AS q3 FROM res a JOIN res b USING (user_id) WHERE a.question_id < b.question_id GROUP BY 1, 2 HAVING count(*) >= 50""",
    "resp_raw",
    "answer_keys",
)
def residual_q3(spark, sf_dir):
    rows, _ = written(responses.holdout(scored(spark, sf_dir)), "holdout")
    pred = responses.additive_predict(rows.where("not held"), rows).withColumn("p", F.round("p", 9))
    return responses.q3(pred.select("user_id", "question_id", (F.col("y") - F.col("p")).alias("r"))).withColumn("q3", F.round("q3", 5))


# -- translation pairs ----------------------------------------------------------

PAIRS = """it AS (SELECT *, correct / n AS p, ln((n - correct + 0.5) / (correct + 0.5)) AS b FROM pair_items),
    pairs AS (SELECT t.id AS id_t, t.cat_id, t.b AS bt, o.b AS bo, t.p AS pt, o.p AS po, t.b - o.b AS d,
      (t.b - o.b) / sqrt(1 / (t.n * ((t.correct + 0.5) / (t.n + 1)) * (1 - (t.correct + 0.5) / (t.n + 1))) + 1 / (o.n * ((o.correct + 0.5) / (o.n + 1)) * (1 - (o.correct + 0.5) / (o.n + 1)))) AS z
      FROM it t JOIN it o ON t.main_question_id = o.id)"""


def pair_rows(spark, sf_dir):
    it = view(spark, sf_dir, "pair_items").withColumn("p", F.col("correct") / F.col("n")).withColumn("b_logit", difficulty(F.col("correct"), F.col("n") - F.col("correct")))
    return items.wald(items.translation_pairs(it))


@job(
    f"""WITH {PAIRS} SELECT count(*) AS n, round(corr(bt, bo), 6) AS pearson, round(avg(pt), 6) AS mean_p_t, round(avg(po), 6) AS mean_p_o, round(avg(d), 6) AS mean_shift,
    round(avg((abs(d) > 0.5)::INT), 6) AS share_large, round(avg((abs(z) > 3.29)::INT), 6) AS share_significant, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS paired_t FROM pairs""",
    "pair_items",
)
def cross_lingual_summary(spark, sf_dir):
    out = items.cross_lingual(pair_rows(spark, sf_dir))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@job(f"WITH {PAIRS} SELECT cat_id, count(*) AS n, round(avg(d), 6) AS shift FROM pairs GROUP BY 1 HAVING count(*) >= 50", "pair_items")
def shift_by_category(spark, sf_dir):
    return items.shift_by_category(pair_rows(spark, sf_dir)).withColumn("shift", r6(F.col("shift")))


@job(
    f"""WITH {PAIRS}, tests AS (SELECT id_t, round(z, 6) AS z, {tail_of('z')} AS p_value FROM pairs),
    ordered AS (SELECT *, row_number() OVER (ORDER BY p_value, id_t) - 1 AS r, count(*) OVER () AS m FROM tests),
    edge AS (SELECT min(r) FILTER (WHERE p_value > 0.05 / (m - r)) AS holm, max(r) FILTER (WHERE p_value <= 0.05 * (r + 1) / m) AS bh FROM ordered)
    SELECT id_t, z, round(p_value, 6) AS p_value, r < coalesce(edge.holm, m) AS holm, r <= coalesce(edge.bh, -1) AS bh FROM ordered, edge""",
    "pair_items",
)
def adjusted_tests(spark, sf_dir):
    """Decisions on the two-sided normal tail."""
    tests = pair_rows(spark, sf_dir).select("id_t", F.round("z", 6).alias("z"), metrics.z_to_p(F.col("z")).alias("p_value"))
    return metrics.adjust(tests, "id_t").select("id_t", "z", r6(F.col("p_value")).alias("p_value"), "holm", "bh")


@job(
    f"""WITH {PAIRS}, d AS (SELECT unnest([1.0, 2.0, 5.0, 10.0, 20.0, 50.0])::DOUBLE AS deff),
    t AS (SELECT deff, {tail_of('z / sqrt(deff)')} AS p, row_number() OVER (PARTITION BY deff ORDER BY abs(z) DESC, id_t) - 1 AS r, count(*) OVER (PARTITION BY deff) AS m FROM pairs, d)
    SELECT deff, round(coalesce(min(r) FILTER (WHERE p > 0.05 / (m - r)), any_value(m)) / any_value(m), 6) AS share_holm, round((coalesce(max(r) FILTER (WHERE p <= 0.05 * (r + 1) / m), -1) + 1) / any_value(m), 6) AS share_bh FROM t GROUP BY 1""",
    "pair_items",
)
def design_effects(spark, sf_dir):
    out = metrics.design_effect(pair_rows(spark, sf_dir), "id_t")
    return out.select("deff", r6(F.col("share_holm")).alias("share_holm"), r6(F.col("share_bh")).alias("share_bh"))


@job(
    f"""WITH {PAIRS}, e AS (SELECT round(bt, 9) - round(bo, 9) AS d FROM pairs), nz AS (SELECT round(d, 9) AS d, round(abs(d), 9) AS a FROM e WHERE round(d, 9) <> 0),
    k AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM nz), w AS (SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w_plus FROM k),
    ties AS (SELECT sum((t ** 3 - t) / 48.0) AS tie FROM (SELECT count(*) AS t FROM nz GROUP BY a))
    SELECT n, w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie), 6) AS z, (SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) FROM e) AS paired_t FROM w, ties""",
    "pair_items",
)
def paired_tests(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).select("id_t", F.round("b_logit_t", 9).alias("a"), F.round("b_logit_o", 9).alias("b"))
    out = metrics.signed_rank(rows.withColumn("d", F.round(F.col("a") - F.col("b"), 9)).withColumn("zero", F.lit(0.0)), "id_t", "d", "zero")
    return out.select("n", "w_plus", r6(F.col("z")).alias("z"), r6(F.col("paired_t")).alias("paired_t"))


@job(
    f"""WITH {PAIRS}, u AS (SELECT cat_id, count(*) AS n, sum(d) AS d, sum((abs(d) > 0.5)::INT) AS big FROM pairs GROUP BY 1), {weights_of('cat_id', 'u')},
    s AS (SELECT rep, sum(w * n) AS n, sum(w * d) AS d, sum(w * big) AS big FROM u JOIN wt USING (cat_id) GROUP BY 1)
    SELECT 'mean_shift' AS stat, (SELECT round(sum(d) / sum(n), 6) FROM u) AS value, round(quantile_cont(d / n, 0.025), 6) AS ci_low, round(quantile_cont(d / n, 0.975), 6) AS ci_high FROM s
    UNION ALL SELECT 'share_large', (SELECT round(sum(big) / sum(n), 6) FROM u), round(quantile_cont(big / n, 0.025), 6), round(quantile_cont(big / n, 0.975), 6) FROM s""",
    "pair_items",
)
def shift_bootstrap(spark, sf_dir):
    """Category-cluster bootstrap of the mean shift and its share of large values."""
    d = F.col("b_logit_t") - F.col("b_logit_o")
    return metrics.bootstrap(pair_rows(spark, sf_dir), ["cat_id"], {"n": F.lit(1.0), "d": d, "big": (F.abs(d) > 0.5).cast("double")}, {"mean_shift": "d / n", "share_large": "big / n"}).select("stat", *[r6(F.col(c)).alias(c) for c in ("value", "ci_low", "ci_high")])


@job(
    f"""WITH {PAIRS}, x AS (SELECT bt, bo, rank() OVER (ORDER BY bt) + (count(*) OVER (PARTITION BY bt) - 1) / 2.0 AS rx, rank() OVER (ORDER BY bo) + (count(*) OVER (PARTITION BY bo) - 1) / 2.0 AS ry FROM (SELECT round(bt, 9) AS bt, round(bo, 9) AS bo FROM pairs))
    SELECT 'all' AS part, count(*) AS n, round(corr(bt, bo), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM x""",
    "pair_items",
)
def pair_correlations(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).select(F.lit("all").alias("part"), F.round("b_logit_t", 9).alias("x"), F.round("b_logit_o", 9).alias("y"))
    return metrics.correlations(rows, ["part"], "x", "y").select("part", "n", r6(F.col("pearson")).alias("pearson"), r6(F.col("spearman")).alias("spearman"))


@job(
    f"""WITH {PAIRS}, x AS (SELECT id_t, round(bt, 9) AS truth, round(bo, 9) AS pred FROM pairs),
    k AS (SELECT round_even(count(*) * 0.1, 0)::BIGINT AS k, median(truth) AS m FROM x),
    o AS (SELECT *, row_number() OVER (ORDER BY truth DESC, id_t) AS rt, row_number() OVER (ORDER BY pred DESC, id_t) AS rp FROM x)
    SELECT any_value(k) AS k, round(count(*) FILTER (WHERE rp <= k AND rt <= k) / any_value(k), 6) AS precision, round(count(*) FILTER (WHERE rp <= k AND truth < m) / any_value(k), 6) AS in_easier_half FROM o, k""",
    "pair_items",
)
def hardest_screening(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).select("id_t", F.round("b_logit_t", 9).alias("truth"), F.round("b_logit_o", 9).alias("pred"))
    return metrics.screening(rows, "id_t", "truth", "pred").select("k", r6(F.col("precision")).alias("precision"), r6(F.col("in_easier_half")).alias("in_easier_half"))


@job(f"WITH {PAIRS}, e AS (SELECT abs(1 / (1 + exp(bo)) - pt) AS e FROM pairs) SELECT round(avg((e < 0.1)::INT), 6) AS within_10, round(avg((e < 0.2)::INT), 6) AS within_20, round(avg(e), 6) AS mae_p FROM e", "pair_items")
def error_shares(spark, sf_dir):
    out = metrics.abs_error_shares(pair_rows(spark, sf_dir), [], "b_logit_o", "p_t")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@job(
    f"""WITH {PAIRS}, c AS (SELECT cat_id, round(avg(bt), 9) AS x, round(avg(bo), 9) AS y FROM pairs GROUP BY 1)
    SELECT a.cat_id, round(corr(b.x, b.y), 5) AS r FROM c a JOIN c b ON a.cat_id <> b.cat_id GROUP BY 1""",
    "pair_items",
)
def link_sensitivity(spark, sf_dir):
    c = pair_rows(spark, sf_dir).groupBy("cat_id").agg(F.round(F.avg("b_logit_t"), 9).alias("x"), F.round(F.avg("b_logit_o"), 9).alias("y"))
    return audit.leave_one_out(c, "cat_id", "x", "y").withColumn("r", F.round("r", 5))


# -- duels ----------------------------------------------------------------------

GAMES = """games AS (SELECT *, row_number() OVER (ORDER BY created_at, id) - 1 AS seq, CASE WHEN winner_id IS NULL THEN 0.5 WHEN winner_id = user_id THEN 1.0 ELSE 0.0 END AS s FROM duels WHERE user_id <> opponent_id)"""


def ordered_games(spark, sf_dir):
    return indexed(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"])


@job(f"WITH {GAMES}, n AS (SELECT count(*) AS n FROM games) SELECT id, seq, CASE WHEN seq < n * 0.6::DOUBLE THEN 'train' WHEN seq < n * 0.8::DOUBLE THEN 'val' ELSE 'test' END AS split FROM games, n", "duels")
def duel_split(spark, sf_dir):
    return time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"]).select("id", "seq", "split")


@job(
    f"""WITH {GAMES}, sides AS (SELECT seq, 0 AS side, user_id AS player, s FROM games UNION ALL SELECT seq, 1, opponent_id, 1 - s FROM games),
    h AS (SELECT *, count(*) OVER w AS n, coalesce(sum(s) OVER w, 0) AS wins FROM sides WINDOW w AS (PARTITION BY player ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT g.id, max(n) FILTER (WHERE side = 0) AS n_u, max(n) FILTER (WHERE side = 1) AS n_o,
      round(max((wins + 1) / (n + 2)) FILTER (WHERE side = 0) - max((wins + 1) / (n + 2)) FILTER (WHERE side = 1), 6) AS rate_diff FROM h JOIN games g USING (seq) GROUP BY 1""",
    "duels",
)
def duel_history(spark, sf_dir):
    return ratings.duel_history(ordered_games(spark, sf_dir)).select("id", "n_u", "n_o", r6(F.col("rate_diff")).alias("rate_diff"))


LONG = """long AS (SELECT r.id, r.game_id, r.cat_id, r.created_at, CASE WHEN pos < 3 THEN d.user_id ELSE d.opponent_id END AS player, pos,
      CASE pos WHEN 0 THEN u1 WHEN 1 THEN u2 WHEN 2 THEN u3 WHEN 3 THEN o1 WHEN 4 THEN o2 ELSE o3 END AS y
      FROM rounds r JOIN duels d ON d.id = r.game_id, range(6) t(pos) WHERE cat_id IS NOT NULL AND u1 IS NOT NULL AND u2 IS NOT NULL AND u3 IS NOT NULL),
    resp AS (SELECT *, row_number() OVER (ORDER BY created_at, id, pos) - 1 AS seq FROM long WHERE y IS NOT NULL)"""


def round_responses(spark, sf_dir, order: str = "created_at"):
    long = ratings.unpivot_rounds(view(spark, sf_dir, "rounds"), view(spark, sf_dir, "duels"))
    return indexed(long, [order, "id", "pos"])


@job(f"WITH {LONG} SELECT seq, id, game_id, cat_id, player, pos, y FROM resp", "duels", "rounds")
def round_log(spark, sf_dir):
    return round_responses(spark, sf_dir).select("seq", "id", "game_id", "cat_id", "player", F.col("pos").cast("long"), F.col("y"))


@job(
    f"""WITH {LONG}, h AS (SELECT *, avg(y) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gm,
      count(*) OVER c AS cn, coalesce(sum(y) OVER c, 0) AS cs, count(*) OVER p AS pn, coalesce(sum(y) OVER p, 0) AS ps FROM resp
      WINDOW c AS (PARTITION BY cat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY player ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, round(coalesce(gm, 0.5), 6) AS global_mean, round((cs + 5 * coalesce(gm, 0.5)) / (cn + 5), 6) AS cat_mean, round((ps + 5 * coalesce(gm, 0.5)) / (pn + 5), 6) AS player_mean FROM h""",
    "duels",
    "rounds",
)
def running_means(spark, sf_dir):
    out = ratings.running_means(round_responses(spark, sf_dir).select("seq", "player", "cat_id", "y"))
    return out.select("seq", *[r6(F.col(c)).alias(c) for c in ("global_mean", "cat_mean", "player_mean")])


@job(f"WITH {LONG} SELECT cat_id, round(avg(y), 6) AS accuracy, count(*) AS n_resp FROM resp GROUP BY 1", "duels", "rounds")
def category_accuracy(spark, sf_dir):
    rows = ratings.unpivot_rounds(view(spark, sf_dir, "rounds"), view(spark, sf_dir, "duels"))
    return rows.groupBy("cat_id").agg(r6(F.avg("y")).alias("accuracy"), F.count("*").alias("n_resp"))


@job(
    """SELECT count(*) AS games, min(id) AS first_id, max(id) AS last_id, count(*) FILTER (WHERE user_id = opponent_id) AS self_play, round(avg((winner_id IS NULL)::INT), 6) AS draw_share,
      (SELECT count(*) FROM (SELECT user_id FROM duels UNION SELECT opponent_id FROM duels)) AS players, (SELECT count(*) FROM rounds) AS rounds, (SELECT count(DISTINCT game_id) FROM rounds) AS games_with_rounds,
      (SELECT count(*) FROM rounds WHERE cat_id IS NULL) AS no_category, (SELECT count(*) FROM rounds WHERE u1 IS NULL) AS null_u1 FROM duels""",
    "duels",
    "rounds",
)
def reconstruction_audit(spark, sf_dir):
    return audit.reconstruction_audit(view(spark, sf_dir, "duels"), view(spark, sf_dir, "rounds")).withColumn("draw_share", r6(F.col("draw_share")))


ELO_GRID = {f"{k:03d}{home:+03d}": {"k": float(k), "home": float(home)} for k in (16, 32, 48, 64, 96, 128, 192) for home in (0, -25, 25)}


def duck_replay(configs: dict[str, dict]) -> str:
    """DuckDB text of exact Elo as a recursion over games; a step holds the ratings of all players as a list."""
    values = ", ".join(f"('{n}', {c['k']}::DOUBLE, {c.get('home', 0.0)}::DOUBLE)" for n, c in configs.items())
    return f"""{GAMES}, pl AS MATERIALIZED (SELECT player, row_number() OVER (ORDER BY player) AS i FROM (SELECT user_id AS player FROM games UNION SELECT opponent_id FROM games)),
    g AS MATERIALIZED (SELECT seq, s, a.i AS u, b.i AS o FROM games JOIN pl a ON a.player = user_id JOIN pl b ON b.player = opponent_id),
    step AS (SELECT config, k, home, -1::BIGINT AS seq, NULL::DOUBLE AS p, list_transform(range((SELECT count(*) FROM pl)), lambda x: 0.0::DOUBLE) AS r FROM (VALUES {values}) c(config, k, home)
      UNION ALL SELECT config, k, home, seq, p, list_transform(r, lambda x, j: CASE j WHEN u THEN x + k * (s - p) WHEN o THEN x - k * (s - p) ELSE x END)
      FROM (SELECT t.config, t.k, t.home, g.seq, g.s, g.u, g.o, r, 1 / (1 + pow(10.0::DOUBLE, (r[o] - r[u] - home) / 400)) AS p FROM step t JOIN g ON g.seq = t.seq + 1))"""


def duck_scores(rows: str) -> str:
    """DuckDB text of the binary scores of (config, y, p)."""
    return f"""SELECT config, count(*) AS n, round(avg(-(y * ln(greatest(least(p, 0.999999), 0.000001)) + (1 - y) * ln(1 - greatest(least(p, 0.999999), 0.000001)))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy,
      round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY config ORDER BY p) + (count(*) OVER (PARTITION BY config, p) - 1) / 2.0 AS r FROM ({rows})) GROUP BY 1"""


def score_rows(df: DataFrame) -> DataFrame:
    """The binary scores by config, rounded; scores are rounded before they are ordered, so ties are the same everywhere."""
    out = metrics.binary_scores(df.withColumn("p", F.round("p", 9)), ["config"])
    return out.withColumns({c: r6(F.col(c)) for c in ("log_loss", "brier", "accuracy", "auc")})


K24 = duck_replay({"k24": {"k": 24.0}})
VALIDATED = "SELECT config, s::INT AS y, round(p, 9) AS p FROM games JOIN step USING (seq) WHERE s <> 0.5 AND seq >= (SELECT count(*) FROM games) * 0.6::DOUBLE AND seq < (SELECT count(*) FROM games) * 0.8::DOUBLE"


def duck_brier_interval(weighted: str) -> str:
    """DuckDB text of the interval of a Brier score; `weighted` gives (rep, w, e), rep -1 being the sample."""
    return f"SELECT 'brier' AS stat, round(any_value(v) FILTER (WHERE rep = -1), 6) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 6) AS ci_high FROM (SELECT rep, sum(w * e) / sum(w) AS v FROM ({weighted}) GROUP BY 1)"


def duck_response_replay(configs: dict[str, dict], order: str = "created_at") -> str:
    """DuckDB text of the exact replay of responses; a step holds the levels of players and categories, and of pairs if asked."""
    values = ", ".join(f"('{n}', {c['a']}::DOUBLE, {c['b']}::DOUBLE, {str(c.get('per_cat', False)).lower()})" for n, c in configs.items())
    long = LONG.replace("r.created_at", f"r.{order} AS created_at")
    return f"""{long}, nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT 'p' || player AS node FROM resp UNION SELECT 'c' || cat_id FROM resp)), pairs AS (SELECT player, cat_id, row_number() OVER (ORDER BY player, cat_id) AS x FROM (SELECT DISTINCT player, cat_id FROM resp)),
    g AS MATERIALIZED (SELECT seq, y, a.i AS u, b.i AS o, x, row_number() OVER (PARTITION BY a.i ORDER BY seq) - 1 AS nu, row_number() OVER (PARTITION BY b.i ORDER BY seq) - 1 AS no, row_number() OVER (PARTITION BY x ORDER BY seq) - 1 AS nx
      FROM resp JOIN nodes a ON a.node = 'p' || player JOIN nodes b ON b.node = 'c' || cat_id JOIN pairs USING (player, cat_id)),
    step AS (SELECT config, a, b, per_cat, -1::BIGINT AS seq, NULL::DOUBLE AS p, list_transform(range((SELECT count(*) FROM nodes)), lambda x: 0.0::DOUBLE) AS r, list_transform(range(CASE WHEN per_cat THEN (SELECT count(*) FROM pairs) ELSE 0 END), lambda x: 0.0::DOUBLE) AS q FROM (VALUES {values}) c(config, a, b, per_cat)
      UNION ALL SELECT config, a, b, per_cat, seq, p, list_transform(r, lambda v, j: CASE j WHEN u THEN v + a / (1 + b * nu) * (y - p) WHEN o THEN v - a / (1 + b * no) * (y - p) ELSE v END), list_transform(q, lambda v, j: CASE j WHEN x THEN v + a / (1 + b * nx) * (y - p) ELSE v END)
      FROM (SELECT t.config, t.a, t.b, t.per_cat, g.*, r, q, 1 / (1 + exp(-(r[u] + coalesce(q[x], 0) - r[o]))) AS p FROM step t JOIN g ON g.seq = t.seq + 1))"""


@job(f"WITH {K24} SELECT id, games.seq, round(p, 6) AS p FROM games JOIN step ON games.seq = step.seq", "duels")
def elo_exact(spark, sf_dir):
    """Exact Elo before each duel, K 24."""
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.replay(games, "elo", {"k24": {"k": 24.0}})
    return games.join(pred, "seq").select("id", "seq", r6(F.col("p")).alias("p"))


def grid_scores(games: DataFrame, model: str, configs: dict) -> DataFrame:
    pred, _ = ratings.replay(games, model, configs)
    n = games.count()
    a, b = cuts(n)
    val = games.where((F.col("seq") >= a) & (F.col("seq") < b) & (F.col("s") != 0.5)).withColumn("y", F.col("s").cast("int"))
    return score_rows(val.join(pred, "seq"))


@job(f"WITH {duck_replay(ELO_GRID)} {duck_scores(VALIDATED)}", "duels")
def elo_grid(spark, sf_dir):
    """Validation scores of the 21 settings."""
    return grid_scores(ordered_games(spark, sf_dir), "elo", ELO_GRID)


@job(f"WITH {duck_replay(ELO_GRID)} SELECT *, 'elo' AS model FROM ({duck_scores(VALIDATED)}) ORDER BY log_loss, config LIMIT 1", "duels")
def elo_best(spark, sf_dir):
    scores = grid_scores(ordered_games(spark, sf_dir), "elo", ELO_GRID).withColumn("model", F.lit("elo"))
    return metrics.best_config(scores, ["model"])


@job()
def glicko2_exact(spark, sf_dir):
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.replay(games, "glicko2", {"05": {"tau": 0.5}})
    return games.join(pred, "seq").select("id", "seq", r6(F.col("p")).alias("p"))


@job()
def trueskill_exact(spark, sf_dir):
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.replay(games, "trueskill", {"default": {"beta": 25 / 6, "tau": 25 / 300, "p_draw": 0.1}})
    return games.join(pred, "seq").select("id", "seq", r6(F.col("p")).alias("p"))


@job(
    f"""WITH {GAMES}, pl AS MATERIALIZED (SELECT player, row_number() OVER (ORDER BY player) AS i FROM (SELECT user_id AS player FROM games UNION SELECT opponent_id FROM games)),
    g AS MATERIALIZED (SELECT seq, s, a.i AS u, b.i AS o, dense_rank() OVER (ORDER BY date_trunc('week', created_at)) AS week FROM games JOIN pl a ON a.player = user_id JOIN pl b ON b.player = opponent_id),
    step AS (SELECT 1::BIGINT AS week, list_transform(range((SELECT count(*) FROM pl)), lambda x: 0.0::DOUBLE) AS r
      UNION ALL SELECT week + 1, list_transform(r, lambda v, j: v + coalesce(list_sum(list_transform(list_filter(moves, lambda m: m.i = j), lambda m: m.d)), 0))
      FROM (SELECT week, any_value(r) AS r, list_concat(list({{'i': u, 'd': d}}), list({{'i': o, 'd': -d}})) AS moves FROM (SELECT t.week, r, u, o, 24 * (s - 1 / (1 + pow(10.0::DOUBLE, (r[o] - r[u]) / 400))) AS d FROM step t JOIN g ON g.week = t.week) GROUP BY 1))
    SELECT id, seq, round(1 / (1 + pow(10.0::DOUBLE, (r[o] - r[u]) / 400)), 6) AS p FROM g JOIN step USING (week) JOIN games USING (seq)""",
    "duels",
)
def elo_weekly(spark, sf_dir):
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.elo_periods(games, 24.0, unit="week")
    return games.join(pred, "seq").select("id", "seq", r6(F.col("p")).alias("p"))


@job()
def glicko2_weekly(spark, sf_dir):
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.glicko_periods(games, 0.5, unit="week")
    return games.join(pred, "seq").select("id", "seq", r6(F.col("p")).alias("p"))


PLAIN = {"plain": {"a": 0.3, "b": 0.05}}
GAINS = {**PLAIN, "pairs": {"a": 0.3, "b": 0.05, "per_cat": True}}


@job(f"WITH {duck_response_replay(GAINS)} SELECT config, resp.seq, resp.y, round(p, 6) AS p FROM resp JOIN step ON resp.seq = step.seq", "duels", "rounds")
def response_elo(spark, sf_dir):
    resp = round_responses(spark, sf_dir)
    pred, _ = ratings.response_elo(resp, GAINS)
    return resp.join(pred, "seq").select("config", "seq", "y", r6(F.col("p")).alias("p"))


@job(f"WITH {duck_response_replay(PLAIN, 'updated_at')} {duck_scores('SELECT config, y, round(p, 9) AS p FROM resp JOIN step USING (seq)')}", "duels", "rounds")
def response_elo_by_completion(spark, sf_dir):
    """The same replay ordered by completion time: the sensitivity to late rows."""
    resp = round_responses(spark, sf_dir, "updated_at")
    pred, _ = ratings.response_elo(resp, PLAIN)
    return score_rows(resp.join(pred, "seq"))


@job(
    f"""WITH {K24}, sc AS (SELECT user_id, opponent_id, (s - p) ** 2 AS e FROM games JOIN step USING (seq) WHERE s <> 0.5), {weights_of('player', 'pl')}
    {duck_brier_interval("SELECT a.rep, a.w * b.w AS w, e FROM sc JOIN wt a ON a.player = user_id JOIN wt b ON b.player = opponent_id AND a.rep = b.rep UNION ALL SELECT -1, 1, e FROM sc")}""",
    "duels",
)
def player_bootstrap(spark, sf_dir):
    """Two-way player bootstrap of the Brier score of exact Elo."""
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.replay(games, "elo", {"k24": {"k": 24.0}})
    rows = games.where("s <> 0.5").join(pred, "seq").withColumn("e", (F.col("s") - F.col("p")) ** 2)
    out = metrics.bootstrap(rows, ["user_id", "opponent_id"], {"n": F.lit(1.0), "e": F.col("e")}, {"brier": "e / n"})
    return out.select("stat", *[r6(F.col(c)).alias(c) for c in ("value", "ci_low", "ci_high")])


# -- catalogue and release --------------------------------------------------------

NAMES = ("customer", "events", "lineitem", "orders", "part", "documents")


@job(
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, {f'min({c})' if c else 'NULL::TIMESTAMP'} AS first, {f'max({c})' if c else 'NULL::TIMESTAMP'} AS last FROM {t}"
        for t, c in (("customer", None), ("documents", None), ("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("part", None))
    )
)
def data_catalog(spark, sf_dir):
    return audit.catalog({t: table(spark, sf_dir, t) for t in NAMES}).select("table", "rows", F.col("columns").cast("long"), "first", "last")


@job(
    """WITH m AS (SELECT id, row_number() OVER (ORDER BY md5(id || '|seed'), id) AS new_id FROM doc_items)
    SELECT m.new_id AS id, l.new_id AS main_question_id, correct, fail FROM doc_items d JOIN m USING (id) LEFT JOIN m l ON d.main_question_id = l.id""",
    "doc_items",
)
def open_release(spark, sf_dir):
    """With a seed, so that SQL can repeat it; a real release draws its order once."""
    return audit.release(view(spark, sf_dir, "doc_items"), "id", ["main_question_id"], ["correct", "fail"], seed="seed")[0]


# -- text -------------------------------------------------------------------------


@job(
    """WITH w AS (SELECT p_partkey AS id, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM part),
    g AS (SELECT id, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))])) AS gram FROM w),
    tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
    r AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (gram))
    SELECT id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM r"""
)
def part_tfidf(spark, sf_dir):
    """Word 1- and 2-gram weights of part names."""
    from ..operators.text import tfidf, word_grams

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return tfidf(parts, "id", word_grams(F.col("p_name")), min_df=2).withColumn("weight", r6(F.col("weight")))


def similar_names(spark, sf_dir, *also: DataFrame) -> tuple[DataFrame, ...]:
    """(form, id, copies) of the normal forms of part names that have a vector, `also`, and pairs (i, j, cosine) of forms."""
    from ..operators.text import similar_pairs, text_classes, tfidf, word_grams

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    classes, _ = written(text_classes(parts, "id", "p_name"), "classes")
    vectors, _ = written(tfidf(classes, "id", word_grams(F.col("p_name")), min_df=2, copies="copies"), "vectors")
    pairs = similar_pairs(vectors, "id", 0.8000001).withColumn("cosine", r6(F.col("cosine")))
    return classes.join(vectors.select("id"), "id", "left_semi"), *also, pairs


@job(
    """WITH w AS (SELECT p_partkey AS id, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM part),
    g AS (SELECT id, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))])) AS gram FROM w),
    tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
    r AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (gram)),
    v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r)
    SELECT a.id AS i, b.id AS j, round(sum(a.weight * b.weight), 6) AS cosine FROM v a JOIN v b USING (gram) WHERE a.id < b.id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.8000001"""
)
def similar_parts(spark, sf_dir):
    """Pairs of part names of TF-IDF cosine 0.8 or more, by prefix filter over normal forms; copies are expanded last."""
    from ..functions.scalars import norm_text
    from ..operators.text import expanded_pairs

    members = table(spark, sf_dir, "part").select(norm_text(F.col("p_name")).alias("form"), F.col("p_partkey").alias("id"))
    return expanded_pairs(*similar_names(spark, sf_dir, members)).select("i", "j", "cosine")


@job()
def vector_ridge(spark, sf_dir):
    from ..functions.scalars import hash01
    from ..operators.text import vector_ridge as ridge

    r = hash01(F.col("vec_id"))
    rows = table(spark, sf_dir, "embeddings").withColumn("split", F.when(r < 0.6, "train").when(r < 0.8, "val").otherwise("test"))
    return ridge(rows, "embedding", "label", "split").select("vec_id", "label", "yhat")


# -- response models ----------------------------------------------------------------


def fitted(spark, sf_dir, model: str):
    from ..operators import irt

    rows, _ = written(responses.holdout(responses.prune(scored(spark, sf_dir))), "responses")
    train = rows.where("not held").select("user_id", "question_id", "y")
    params, trace, learners = irt.irt_fit(train, model)
    return irt, rows, params, learners, irt.converged(trace, 1e-7 * train.count())


@job()
def irt_2pl_items(spark, sf_dir):
    return fitted(spark, sf_dir, "2PL")[2]


@job()
def irt_criteria(spark, sf_dir):
    """Information criteria of the three models, fitted in one EM, the best by BIC, and whether the fits converged."""
    from ..operators import irt
    from ..operators.irt_many import Setting, abilities_of, fit_many, packed

    rows, _ = written(responses.holdout(responses.prune(scored(spark, sf_dir))).where("not held").select("user_id", "question_id", "y"), "responses")
    learners = packed(rows)
    fits = fit_many(learners, rows, [Setting(m) for m in ("1PL", "2PL", "3PL")])
    ability, _ = written(abilities_of(learners, fits), "abilities")
    out, n = None, rows.count()
    for k, fit in enumerate(fits):
        part = irt.information_criteria(ability.where(F.col("setting") == k), len(fit.items), n, fit.setting.model).withColumn("converged", F.lit(fit.converged))
        out = part if out is None else out.unionByName(part)
    out, _ = written(out, "criteria")
    return out.crossJoin(F.broadcast(out.agg(F.min_by("model", "bic").alias("_best")))).withColumn("best", F.col("model") == F.col("_best")).drop("_best")


@job()
def irt_without_priors(spark, sf_dir):
    """Maximum likelihood, and how many discriminations run away."""
    from ..operators import irt

    rows, _ = written(responses.prune(scored(spark, sf_dir)), "responses")
    return irt.runaway(irt.irt_fit(rows.select("user_id", "question_id", "y"), "2PL", priors=False)[0])


@job()
def irt_holdout_scores(spark, sf_dir):
    """Held-out responses under the 2PL against the additive predictor."""
    irt, rows, params, learners, _ = fitted(spark, sf_dir, "2PL")
    held = rows.where("held").select("user_id", "question_id", "y")
    a = irt.irt_predict(held, irt.eap(learners, params), params).withColumn("model", F.lit("2PL"))
    b = responses.additive_predict(rows.where("not held"), held).withColumn("model", F.lit("additive")).select(*a.columns)
    return metrics.binary_scores(a.unionByName(b), ["model"])


@job()
def irt_item_fit(spark, sf_dir):
    irt, rows, params, learners, _ = fitted(spark, sf_dir, "2PL")
    return responses.item_fit(rows.where("not held"), params, irt.eap(learners, params).select("user_id", "theta"))


@job()
def irt_reliability(spark, sf_dir):
    irt, _, params, learners, _ = fitted(spark, sf_dir, "2PL")
    return irt.reliability(irt.eap(learners, params))


# -- further checks -----------------------------------------------------------------


@job(
    """SELECT lang, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, round(avg((n > 64)::INT), 6) AS share_over
    FROM (SELECT lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n FROM documents) GROUP BY 1"""
)
def token_profile(spark, sf_dir):
    from ..operators.text import token_profile as profile

    return profile(table(spark, sf_dir, "documents"), "lang").select("lang", r6(F.col("median")).alias("median"), r6(F.col("p95")).alias("p95"), F.col("most").cast("long"), r6(F.col("share_over")).alias("share_over"))


@job(f"SELECT doc_id, {NORM} IN (SELECT {NORM} FROM benchmark) AS same_form FROM documents")
def benchmark_forms(spark, sf_dir):
    from ..operators.text import overlap

    return overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "same_form")


@job(ORACLE_SQL["duel_history"].replace("FROM h JOIN games g USING (seq) GROUP BY 1", "FROM h JOIN games g USING (seq) GROUP BY 1 HAVING max(n) FILTER (WHERE side = 0) >= 10 AND max(n) FILTER (WHERE side = 1) >= 10"))
def experienced_duels(spark, sf_dir):
    rows = ratings.experienced(ratings.duel_history(ordered_games(spark, sf_dir)))
    return rows.select("id", "n_u", "n_o", r6(F.col("rate_diff")).alias("rate_diff"))


@job(
    f"""WITH {GAMES}, n AS (SELECT count(*) AS n FROM games), rate AS (SELECT avg(s) AS p FROM games, n WHERE seq < n * 0.6::DOUBLE AND s <> 0.5)
    SELECT count(*) AS n, round(avg((s - p) ** 2), 6) AS brier, round(avg((s = 0.5)::INT), 6) AS draw_share FROM games, rate, n WHERE seq >= n * 0.8::DOUBLE""",
    "duels",
)
def draw_report(spark, sf_dir):
    """Base-rate predictor scored on the last fifth, draws included."""
    rows = time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"])
    out = ratings.draw_report(ratings.base_rate(rows.where("split = 'train'"), rows.where("split = 'test'")))
    return out.select("n", r6(F.col("brier")).alias("brier"), r6(F.col("draw_share")).alias("draw_share"))


@job(
    """SELECT lang, hits, n, round(hits / n, 6) AS share, round((hits / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) - 1.959963984540054 * sqrt((hits / n) * (1 - hits / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n)) / (1 + 1.959963984540054 ** 2 / n), 6) AS low,
      round((hits / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) + 1.959963984540054 * sqrt((hits / n) * (1 - hits / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n)) / (1 + 1.959963984540054 ** 2 / n), 6) AS high
    FROM (SELECT lang, count(*) FILTER (WHERE quality = 1) AS hits, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""
)
def label_precision(spark, sf_dir):
    """Wilson intervals of the share of good labels by language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count("*").alias("n"))
    return audit.wilson(rows, "hits", "n").select("lang", "hits", "n", *[r6(F.col(c)).alias(c) for c in ("share", "low", "high")])


@job(
    f"""WITH {LONG}, v AS (SELECT cat_id, avg(CASE WHEN id % 2 = 0 THEN y END) AS a, avg(CASE WHEN id % 2 = 1 THEN y END) AS b FROM resp GROUP BY 1)
    SELECT cat_id, round(a, 6) AS ref, round(b, 6) AS new, coalesce(abs(a - b) <= 0.05, false) AS ok FROM v""",
    "duels",
    "rounds",
)
def metric_comparison(spark, sf_dir):
    """Category accuracies of even and odd rounds held against each other."""
    rows = ratings.unpivot_rounds(view(spark, sf_dir, "rounds"), view(spark, sf_dir, "duels"))
    half = lambda k: rows.where(F.col("id") % 2 == k).groupBy("cat_id").agg(F.avg("y").alias("value"))
    return audit.compare_metrics(half(0), half(1), ["cat_id"], 0.05).select("cat_id", r6(F.col("ref")).alias("ref"), r6(F.col("new")).alias("new"), "ok")


@job(
    "SELECT count(*) AS tables, sum(rows)::BIGINT AS rows, sum(columns)::BIGINT AS columns, 0::BIGINT AS truncated, count(*) FILTER (WHERE rows = 0) AS empty, 0::BIGINT AS missing FROM (" + ORACLE_SQL["data_catalog"] + ")"
)
def catalog_summary(spark, sf_dir):
    return audit.catalog_summary(audit.catalog({t: table(spark, sf_dir, t) for t in NAMES}))


@job(
    "SELECT count(*) FILTER (WHERE best >= 0.8) AS at_80, count(*) FILTER (WHERE best >= 0.9) AS at_90, count(*) FILTER (WHERE best >= 0.95) AS at_95 FROM (SELECT id, max(cosine) AS best FROM (SELECT i AS id, cosine FROM p UNION ALL SELECT j, cosine FROM p) GROUP BY 1)".replace("FROM p", "FROM (" + ORACLE_SQL["similar_parts"] + ")")
)
def near_duplicate_parts(spark, sf_dir):
    """Parts whose nearest other part reaches each threshold; a copy reaches all."""
    from ..operators.text import near_duplicate_classes

    return near_duplicate_classes(*similar_names(spark, sf_dir))


@job()
def duel_models(spark, sf_dir):
    """Logistic regression and boosted trees on history, scored on the last fifth."""
    from ..operators.learners import duel_boosted, duel_logit

    games = time_split(ratings.duel_outcome(view(spark, sf_dir, "duels")), ["created_at", "id"])
    rows = ratings.duel_history(games).where("s <> 0.5").withColumn("y", F.col("s").cast("int")).withColumn("log_u", F.log1p("n_u")).withColumn("log_o", F.log1p("n_o"))
    rows, _ = written(rows, "history")
    part = {k: rows.where(F.col("split") == k) for k in ("train", "val", "test")}
    columns = ["rate_diff", "rate_u", "rate_o", "log_u", "log_o"]
    a = duel_logit(part["train"], part["test"], columns).select(F.lit("logit").alias("model"), "y", "p")
    b = duel_boosted(part["train"], part["val"], part["test"], columns).select(F.lit("boosted").alias("model"), "y", "p")
    return metrics.binary_scores(a.unionByName(b), ["model"])


@job()
def metadata_boosted(spark, sf_dir):
    """Difficulty of bank items from metadata by boosted trees, scored by split."""
    from ..operators.learners import boosted_regression

    rows = split_bank(spark, sf_dir).withColumn("log_n", F.log("n")).withColumn("n_chars", F.length("text"))
    rows, _ = written(rows, "bank")
    part = {k: rows.where(F.col("split") == k) for k in ("train", "val", "test")}
    return metrics.regression_report(boosted_regression(part["train"], part["val"], part["test"], ["log_n", "n_chars"], "cat_name"), ["split"])


@job()
def response_elo_grid(spark, sf_dir):
    """Scores of 5 gains and 4 decays, without and with the term of learner and category, on the responses between 60 and 80 % of the log."""
    resp = round_responses(spark, sf_dir)
    pred, _ = ratings.response_elo(resp, {f"{a:g}-{b:g}{'-pairs' * c}": {"a": a, "b": b, "per_cat": c} for c in (False, True) for a in (0.03, 0.05, 0.1, 0.2, 0.4) for b in (0.001, 0.005, 0.02, 0.05)})
    a, b = cuts(resp.count())
    return score_rows(resp.where((F.col("seq") >= a) & (F.col("seq") < b)).join(pred, "seq"))


@job(
    f"""WITH {K24}, sc AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, (s - p) ** 2 AS e FROM games JOIN step USING (seq) WHERE s <> 0.5), {weights_of('day', 'sc')}
    {duck_brier_interval("SELECT rep, w, e FROM sc JOIN wt USING (day) UNION ALL SELECT -1, 1, e FROM sc")}""",
    "duels",
)
def day_bootstrap(spark, sf_dir):
    """Calendar-day block bootstrap of the Brier score of exact Elo."""
    games = ordered_games(spark, sf_dir)
    pred, _ = ratings.replay(games, "elo", {"k24": {"k": 24.0}})
    rows = games.where("s <> 0.5").join(pred, "seq").select(F.to_date("created_at").alias("day"), ((F.col("s") - F.col("p")) ** 2).alias("e"))
    out = metrics.bootstrap(rows, ["day"], {"n": F.lit(1.0), "e": F.col("e")}, {"brier": "e / n"})
    return out.select("stat", *[r6(F.col(c)).alias(c) for c in ("value", "ci_low", "ci_high")])


@job()
def new_learner_scores(spark, sf_dir):
    """The 2PL on answers of learners it was not fitted on."""
    from ..operators import irt

    return metrics.binary_scores(irt.new_learner_holdout(responses.prune(scored(spark, sf_dir))), [])


@job()
def series_abilities(spark, sf_dir):
    from ..operators import irt

    rows, _ = written(responses.prune(scored(spark, sf_dir)), "responses")
    params, _, _ = irt.irt_fit(rows.select("user_id", "question_id", "y"), "1PL")
    return irt.series_ability(rows, params)


from . import audits, extended, studies  # noqa: E402,F401  register more jobs
