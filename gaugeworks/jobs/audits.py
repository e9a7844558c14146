"""Registered jobs: label accuracy, ends of duels, significance of the link, paired intervals by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import lang_by_script
from ..operators import audit, metrics
from ..sources.scratch import written
from ..sources.standins import table, view
from .extended import LINK, link_rows, rounded
from .queries import PAIRS, job, pair_rows, weights_of


@job(
    """WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[ӘәҒғҚқҢңӨөҰұҮүҺһІі]') THEN 'kz' WHEN regexp_matches(coalesce(text, ''), '\\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS label, lang FROM documents),
    z AS (SELECT label, count(*) AS size, count(*) FILTER (WHERE label = lang) AS same FROM d GROUP BY 1), c AS (SELECT label, avg(quality) AS p, count(*) AS n FROM d JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
    s AS (SELECT count(n) AS classes, sum(size)::BIGINT AS n_items, coalesce(sum(n), 0)::BIGINT AS n_checked, sum(size) FILTER (WHERE n > 0) AS every, sum(size * p) AS hits, sum(size * size * p * (1 - p) / n) AS var, sum(same) AS same FROM z LEFT JOIN c USING (label))
    SELECT classes, n_items, n_checked, round(hits / every, 6) AS accuracy, round(hits / every - 1.959963984540054 * sqrt(var) / every, 6) AS low, round(hits / every + 1.959963984540054 * sqrt(var) / every, 6) AS high, round(same / n_items, 6) AS agreement FROM s"""
)
def label_accuracy(spark, sf_dir):
    """Class-weighted accuracy of script labels from checked rows, and their agreement with the language given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", lang_by_script(F.col("text")).alias("label"))
    out = audit.weighted_accuracy(docs, "label", "lang", docs.join(table(spark, sf_dir, "labels"), "doc_id"), "quality")
    return rounded(out, "accuracy", "low", "high", "agreement")


@job(
    """WITH s AS (SELECT *, CASE WHEN winner_id IS NULL THEN 'draw' WHEN winner_id = user_id THEN 'first' WHEN winner_id = opponent_id THEN 'second' ELSE 'other' END AS status FROM duels)
    SELECT status, count(*) AS games, min(created_at)::DATE::VARCHAR AS first_day, max(created_at)::DATE::VARCHAR AS last_day, (SELECT count(DISTINCT p) FROM (SELECT status AS t, unnest([user_id, opponent_id]) AS p FROM s) WHERE t = o.status) AS players FROM s o GROUP BY 1""",
    "duels",
)
def duel_statuses(spark, sf_dir):
    """Duels by how they ended."""
    return audit.duel_statuses(view(spark, sf_dir, "duels"))


# Student's tail by Simpson's rule over the angle
STUDENT = """round(1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * th / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cos(th * i / 2000) ** (n - 3))), 6)"""


@job(
    f"""WITH {LINK}, v AS (SELECT 'bank_b' AS x, bank_b AS a, elo_difficulty AS b FROM link UNION ALL SELECT 'model_b', round(model_b, 9), elo_difficulty FROM link WHERE model_b IS NOT NULL),
    r AS (SELECT x, count(*) AS n, corr(a, b) AS pearson FROM v GROUP BY 1), t AS (SELECT *, asin(abs(pearson)) AS th FROM r)
    SELECT x, n, round(pearson, 6) AS pearson, {STUDENT} AS pearson_p FROM t""",
    "duels",
    "rounds",
    "pair_items",
)
def link_significance(spark, sf_dir):
    """Correlation of duel difficulty with the bank and with predictions, with p of Student's t."""
    link = link_rows(spark, sf_dir)
    rows = link.select(F.explode(F.array(*[F.struct(F.lit(c).alias("x"), F.round(c, 9).alias("a"), F.col("elo_difficulty").alias("b")) for c in ("bank_b", "model_b")])).alias("_e")).select("_e.*").where("a IS NOT NULL")
    rows, _ = written(rows, "link-pairs")
    return rounded(metrics.correlations(rows, ["x"], "a", "b"), "pearson", "pearson_p").select("x", "n", "pearson", "pearson_p")


PAIRED = {"rmse_half": "sqrt(saa / n)", "rmse_full": "sqrt(sbb / n)", "half_less_full": "sqrt(saa / n) - sqrt(sbb / n)"}


@job(
    f"""WITH {PAIRS}, u AS (SELECT id_t, cat_id % 3 AS lang, 1.0::DOUBLE AS n, (bo / 2 - bt) ** 2 AS saa, (bo - bt) ** 2 AS sbb FROM pairs), {weights_of('id_t', 'u')},
    s AS (SELECT lang, rep, sum(w * n) AS n, sum(w * saa) AS saa, sum(w * sbb) AS sbb FROM u JOIN wt USING (id_t) GROUP BY 1, 2 UNION ALL SELECT lang, -1, sum(n), sum(saa), sum(sbb) FROM u GROUP BY 1),
    v AS ({' UNION ALL '.join(f"SELECT lang, rep, '{k}' AS stat, {f} AS v FROM s" for k, f in PAIRED.items())})
    SELECT lang, stat, round(any_value(v) FILTER (WHERE rep = -1), 5) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 5) AS ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 5) AS ci_high FROM v GROUP BY 1, 2""",
    "pair_items",
)
def paired_errors_by_language(spark, sf_dir):
    """RMSE of two predictions and their paired difference by language; rows are resampled."""
    y, x = F.col("b_logit_t"), F.col("b_logit_o")
    rows = pair_rows(spark, sf_dir).select("id_t", (F.col("cat_id") % 3).alias("lang"), "b_logit_t", "b_logit_o")
    moments = {"n": F.lit(1.0), "saa": (x / 2 - y) ** 2, "sbb": (x - y) ** 2}
    return metrics.bootstrap(rows, ["id_t"], moments, PAIRED, by=["lang"]).select("lang", "stat", *[F.round(c, 5).alias(c) for c in ("value", "ci_low", "ci_high")])
