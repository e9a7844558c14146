"""Views of the driver's tables in the shapes of quiz data, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "resp_raw": (
        ("events",),
        """SELECT event_id AS id, user_id, k AS question_id, k % 3 AS series_id, (k % 3) * 10 + user_id % 5 AS group_id, ts AS created_at,
        CASE WHEN event_type = 'error' THEN NULL WHEN value > 5 + 6 * (user_id % 7) + 5 * (k % 11) THEN k * 4 ELSE k * 4 + 1 + event_id % 3 END AS answer_id
        FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events})""",
    ),
    "answer_keys": ((), "SELECT id AS question_id, id * 4 AS answer_id FROM range(100) UNION ALL SELECT id, id * 4 + 2 FROM range(100) WHERE id % 10 = 0"),
    "duels": (
        ("events",),
        """SELECT a.event_id div 2 AS id, a.user_id, b.user_id AS opponent_id, a.ts AS created_at,
        CASE WHEN abs(a.value + 8 * (a.user_id % 7) - b.value - 8 * (b.user_id % 7)) < 4 THEN NULL
             WHEN a.value + 8 * (a.user_id % 7) > b.value + 8 * (b.user_id % 7) THEN a.user_id ELSE b.user_id END AS winner_id
        FROM {events} a JOIN {events} b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0""",
    ),
    "rounds": (
        ("events",),
        """SELECT r AS id, r * 3 AS game_id, min(ts) AS created_at, max(ts) AS updated_at,
        max(CASE WHEN pos = 0 AND event_type <> 'signup' THEN k % 18 END) AS cat_id,
        max(CASE WHEN pos = 0 THEN y END) AS u1, max(CASE WHEN pos = 1 THEN y END) AS u2, max(CASE WHEN pos = 2 THEN y END) AS u3,
        max(CASE WHEN pos = 3 THEN y END) AS o1, max(CASE WHEN pos = 4 THEN y END) AS o2, max(CASE WHEN pos = 5 THEN y END) AS o3
        FROM (SELECT event_id div 6 AS r, event_id % 6 AS pos, ts, event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
              CASE WHEN event_type = 'error' THEN NULL WHEN value > 30 THEN 1 ELSE 0 END AS y FROM {events}) GROUP BY r""",
    ),
    "bank": (
        ("part", "lineitem"),
        """SELECT p_partkey AS id, p_name AS text, p_brand AS cat_name, p_type AS lang, n, correct, n - correct AS fail
        FROM {part} JOIN (SELECT l_partkey, count(*) AS n, count_if(l_returnflag <> 'R') AS correct FROM {lineitem} GROUP BY 1) ON p_partkey = l_partkey""",
    ),
    "pair_items": (
        ("lineitem",),
        """SELECT l_partkey * 2 + CAST(l_linestatus = 'O' AS INT) AS id, CASE WHEN l_linestatus = 'O' THEN l_partkey * 2 END AS main_question_id, count(*) AS n,
        count_if(l_returnflag <> 'R' AND l_quantity > CASE WHEN l_linestatus = 'O' THEN 12 ELSE 6 END) AS correct, min(l_partkey % 25) AS cat_id
        FROM {lineitem} GROUP BY l_partkey, l_linestatus""",
    ),
    "doc_items": (
        ("documents",),
        """SELECT doc_id AS id, text, lang, source AS cat_name, n_chars % 40 + 1 AS correct, doc_id % 30 + 1 AS fail,
        CASE WHEN doc_id % 10 = 7 THEN doc_id - 1 END AS main_question_id FROM {documents}""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in by name."""
    tables, text = SPARK[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def duck(name: str) -> str:
    """The same view as a common table expression of DuckDB."""
    _, text = SPARK[name]
    text = text.replace(" div ", " // ").replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")
    text = text.replace("FROM range(100)", "FROM range(100) t(id)")
    for t in ("events", "part", "lineitem", "documents"):
        text = text.replace("{" + t + "}", t)
    return f"{name} AS ({text})"
