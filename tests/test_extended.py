"""Jobs and operators that DuckDB can't say, on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import audit, items, runs, text
from gaugeworks.sources import tables


def test_csv_with_quotes_nulls_and_lines(spark, tmp_path):
    rows = [(1, 'a "b", c', None), (2, "two\nlines", 2.5), (3, None, -1.0)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    tables.write_dataset(df, f"file://{tmp_path}/t", "csv")
    got = tables.read_table(spark, f"file://{tmp_path}", "t", "id long, text string, x double")
    assert sorted(tuple(r) for r in got.collect()) == rows and not got.inputFiles()[0].endswith("gz")


def test_manifest_catalogue(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"row_limit_per_table": 3, "tables": {"a": {"rows": 3, "file": "a.csv.gz", "columns": ["id", "t"], "excluded_columns": ["mail"]}, "b": {"rows": 0, "file": "b.csv.gz", "columns": ["id"], "excluded_columns": []}}}))
    a = spark.createDataFrame([("2024-01-02 00:00:00",), ("bad",)], "created_at string")
    got = audit.manifest_catalog(tables.read_manifest(spark, f"file://{tmp_path}/manifest.json"), {"a": a})
    by = {r.table: r for r in got.collect()}
    assert (by["a"].truncated, by["a"].present, by["a"].excluded, by["a"].columns, by["b"].present, by["b"].rows) == (True, True, "mail", 2, False, 0)
    assert str(by["a"]["first"]) == "2024-01-02 00:00:00" and by["b"]["last"] is None
    assert tuple(audit.catalog_summary(got).first()) == (2, 3, 3, 1, 1, 1)


def test_report_rows(spark, tmp_path):
    wide = spark.createDataFrame([("x", 1.0, 2.0)], "part string, a double, b double")
    long = tables.report_rows(wide, "job", ("part",))
    assert sorted(tuple(r) for r in long.collect()) == [("job", "part=x", "a", 1.0, None, None), ("job", "part=x", "b", 2.0, None, None)]
    stat = spark.createDataFrame([("r", 0.5, 0.4, 0.6)], "stat string, value double, ci_low double, ci_high double")
    assert tuple(tables.report_rows(stat, "j").first()) == ("j", "all", "r", 0.5, 0.4, 0.6)
    tables.write_report(long, f"file://{tmp_path}/r", "json")
    assert spark.read.json(f"file://{tmp_path}/r").first()["metrics"][1]["metric"] == "b"


def test_diverged_runs_go_and_the_next_seed_comes(spark):
    scores = spark.createDataFrame([("m", s, 1.0 + s, r) for s, r in ((1, 0.5), (2, 0.1), (3, 0.6), (4, 0.7), (5, 0.9))] + [("n", 1, 3.9, 0.5)], "model string, seed int, rmse double, pearson double")
    assert sorted((r.model, r.seed) for r in runs.good_runs(scores).collect()) == [("m", 1), ("m", 3), ("m", 4), ("n", 1)]
    got = {r.model: r for r in runs.select_model(scores).collect()}
    assert got["m"].mean_rmse == pytest.approx((2 + 4 + 5) / 3) and got["m"].chosen and not got["n"].chosen


def test_features_of_trimmed_texts(spark):
    q = spark.createDataFrame([(1, "   ab 1? \n", None, "x", None, 1, 9, 1, "2023-05-01")], "id long, text string, main_question_id long, image string, user_id long, correct int, fail int, report int, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    r = items.item_features(q).first()
    assert (r.n_chars, r.n_words, r.has_digit, r.has_qmark, r.has_image, r.user_submitted, r.report_rate, r.year) == (5, 2, 1, 1, 1, 0, 100.0, 2023)
    assert items.calibrated_items(spark.createDataFrame([(1, "  ab ", 40, 1), (2, "\tabc ", 40, 1)], "id long, text string, correct int, fail int")).select("text").collect() == [("abc",)]


def test_text_ridge_against_closed_form(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words, 6)), float(rng.normal()), "train" if k < 60 else "val" if k < 75 else "test") for k in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, y double, split string")
    got = {r.id: r.yhat for r in text.text_ridge(df, "id", text.word_grams(F.col("text"), 1, 1), "y", alphas=(3.0,)).collect()}
    weights = {(r.id, r.gram): r.weight for r in text.tfidf_from(df.where("split = 'train'"), df, "id", text.word_grams(F.col("text"), 1, 1), 2).collect()}
    x = np.array([[weights.get((k, w), 0.0) for w in words] for k in range(90)])
    y = np.array([r[2] for r in rows])
    a, b = x[:60] - x[:60].mean(axis=0), y[:60] - y[:60].mean()
    coef = np.linalg.solve(a.T @ a + 3.0 * np.eye(12), a.T @ b)
    want = (x - x[:60].mean(axis=0)) @ coef + y[:60].mean()
    assert sorted(got) == list(range(60, 90)) and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)


def test_unknown_categories_are_zero_and_folds_hold_whole_groups(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k), k // 3) for k in range(12)], "id long, c string, x double, grp long")
    new = spark.createDataFrame([(99, "z", 5.5, 9)], "id long, c string, x double, grp long")
    v = text.metadata_vector(df, df.unionByName(new), ["c"], ["x"]).where("id = 99").first().metadata_vector.toArray()
    assert v.tolist() == pytest.approx([0, 0, 0.0])
    folds = text.group_folds(df, "grp", 2).groupBy("grp").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("f")).collect()
    assert all(r.n == 1 for r in folds) and sorted(r.f for r in folds) == [0, 0, 1, 1]
