"""Ridge over folds in one recurrence against plain fits; the report against its formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import ablation

ALPHAS = (0.3, 3.0, 30.0)


def plain_ridge(x, y, train, alpha):
    mean, level = x[train].mean(axis=0), y[train].mean()
    a = x[train] - mean
    coef = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y[train] - level))
    return (x - mean) @ coef + level


def test_all_folds_and_penalties_equal_plain_fits(spark):
    rng = np.random.default_rng(5)
    n, k, width = 48, 3, {"stem": 9, "key": 5}
    fold = rng.permutation(np.arange(n) % k)
    x = {(b, t): rng.normal(size=(n, w)) * (rng.random((n, w)) < 0.6) for b, w in width.items() for t in ablation.held_out(k)}
    y = x["stem", "0_0"] @ rng.normal(size=9) * 0.3 + rng.normal(size=n)
    rows = spark.createDataFrame([(i, int(fold[i]), float(y[i])) for i in range(n)], "id long, fold int, y double")
    cells = [(b, i, f"c{j}", *[float(x[b, t][i, j]) for t in ablation.held_out(k)]) for b, w in width.items() for i in range(n) for j in range(w)]
    cells = spark.createDataFrame(cells, "block string, id long, feature string, " + ", ".join(f"w{t} double" for t in ablation.held_out(k)))
    variants = {"one": ["stem"], "both": ["stem", "key"]}
    got = {(r.variant, r.id): r for r in ablation.ridge_over_folds(rows, cells, "id", "y", variants, k, ALPHAS, tol=1e-10).collect()}
    assert len(got) == 2 * n and all(r.residual <= 1e-8 for r in got.values())
    for name, blocks in variants.items():
        for f in range(k):
            full = {g: np.hstack([x[b, f"{min(f, g)}_{max(f, g)}"] for b in blocks]) for g in range(k)}
            errors = [sum(((plain_ridge(full[g], y, (fold != f) & (fold != g), a) - y)[fold == g] ** 2).sum() for g in range(k) if g != f) for a in ALPHAS]
            alpha = ALPHAS[int(np.argmin(errors))]
            want = plain_ridge(full[f], y, fold != f, alpha)
            for i in np.flatnonzero(fold == f):
                assert got[name, int(i)].alpha == alpha and got[name, int(i)].yhat == pytest.approx(want[i], abs=1e-7)


def test_constant_targets_rows_without_cells_and_no_rows(spark):
    rows = spark.createDataFrame([(i, i % 2, 2.5) for i in range(8)], "id long, fold int, y double")
    cells = spark.createDataFrame([("stem", i, "c", 1.0 * i, 1.0 * i, 1.0 * i) for i in range(4)], "block string, id long, feature string, w0_0 double, w0_1 double, w1_1 double")
    got = ablation.ridge_over_folds(rows, cells, "id", "y", {"one": ["stem"]}, 2).collect()
    assert len(got) == 8 and all(r.yhat == pytest.approx(2.5) for r in got)
    assert ablation.ridge_over_folds(rows.where("id < 0"), cells, "id", "y", {"one": ["stem"]}, 2).count() == 0


def test_weights_come_from_the_other_folds(spark):
    rows = spark.createDataFrame([(1, 0, "a b", "u"), (2, 0, "a", "u"), (3, 1, "a b", None), (4, 1, "b c", "v")], "id long, fold int, text string, c string")
    grams = F.split("text", " ")
    w = {(r.id, r.feature): (r.w0_0, r.w1_1) for r in ablation.text_cells(rows, "id", "stem", grams, 2).collect()}
    # outside fold 0 only b is in two rows, outside fold 1 only a
    assert w == {(1, "a"): (0.0, 1.0), (1, "b"): (1.0, 0.0), (2, "a"): (0.0, 1.0), (3, "a"): (0.0, 1.0), (3, "b"): (1.0, 0.0), (4, "b"): (1.0, 0.0)}
    c = {(r.id, r.feature): (r.w0_0, r.w1_1) for r in ablation.category_cells(rows, "id", "meta", ["c"], 2).collect()}
    assert c == {(1, "c=u"): (0.0, 1.0), (2, "c=u"): (0.0, 1.0), (4, "c=v"): (1.0, 0.0)}


def test_report_pairs_the_same_items(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=60)
    p = {"a": y + rng.normal(size=60), "b": y + 2 * rng.normal(size=60)}
    df = spark.createDataFrame([(v, i, i % 5, float(y[i]), float(p[v][i]), i // 3) for v in p for i in range(60)], "variant string, id long, fold int, y double, yhat double, grp long").withColumn("residual", F.lit(0.0))
    got = {(r.variant, r.less, r.stat): r for r in ablation.ablation_report(df, "y", "grp", [("a", "b")], reps=200).collect()}
    r = {v: np.corrcoef(y, p[v])[0, 1] for v in p}
    assert set(got) == {(v, None, s) for v in p for s in ("r", "rmse")} | {("a", "b", s) for s in ("r", "rmse")}
    assert got["a", "b", "r"].value == pytest.approx(r["a"] - r["b"])
    assert got["a", "b", "rmse"].value == pytest.approx(*[np.sqrt(np.mean((y - p["a"]) ** 2)) - np.sqrt(np.mean((y - p["b"]) ** 2))])
    by_fold = [np.corrcoef(y[f::5], p["a"][f::5])[0, 1] for f in range(5)]
    assert got["a", None, "r"].fold_sd == pytest.approx(np.std(by_fold, ddof=1)) and got["a", None, "r"].fold_mean == pytest.approx(np.mean(by_fold))
    assert all(x.ci_low <= x.ci_high for x in got.values()) and got["a", "b", "r"].fold_mean is None


def test_scans_equal_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{j}" for j in range(12)]
    rows = [(i, i // 2, " ".join(rng.choice(words, rng.integers(0, 9))) if i % 11 else None, " ".join(rng.choice(words[:4], 3)), "x" if i % 3 else None, float(i % 5) if i % 7 else None, float(rng.normal())) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, grp long, stem string, opt string, cat string, num double, y double")
    texts = {"stem": F.split("stem", " "), "key": F.split("opt", " ")}
    variants = {"a": ["stem", "meta"], "b": ["stem", "key", "surface", "meta"]}

    def run():
        got = ablation.option_ablation(items, "id", "y", "grp", texts, ["num"], ["cat"], variants, 3, tol=1e-10, most=5)  # stopped early, both at the same place
        return {(r.variant, r.id): r for r in got.collect()}

    empty = items.where("id < 0").withColumn("fold", F.lit(0))
    assert ablation.ridge_by_scans(empty, "id", "y", texts, ["num"], ["cat"], variants, 3).count() == 0
    scans = run()
    with monkeypatch.context() as m:
        m.setattr(ablation, "text_cells", None)  # no cells are made for the scans
        assert len(run()) == 120
    monkeypatch.setattr(ablation, "MOST_NUMBERS", 0)
    joins = run()
    assert set(scans) == set(joins) and len(scans) == 120
    for k, r in joins.items():
        assert scans[k].alpha == r.alpha and (scans[k].yhat, scans[k].residual) == pytest.approx((r.yhat, r.residual), abs=1e-9)


@pytest.mark.parametrize("sparse", [0, 64])
def test_blocks_as_matrices_and_by_cells(spark, monkeypatch, sparse):
    """Blocks of few features are matrices in a scan; both ways give what the joins give."""
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, i // 2, " ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(0, 6))) if i % 9 else None, float(i % 4), float(rng.normal())) for i in range(50)], "id long, grp long, stem string, num double, y double")
    monkeypatch.setattr(ablation, "SPARSE", sparse)
    made = lambda: {(r.variant, r.id): (r.yhat, r.residual) for r in ablation.option_ablation(items, "id", "y", "grp", {"stem": F.split("stem", " ")}, ["num"], [], {"a": ["stem"], "b": ["stem", "surface"]}, 3, tol=1e-10, most=4).collect()}
    scans = made()
    monkeypatch.setattr(ablation, "MOST_NUMBERS", 0)
    joins = made()
    assert set(scans) == set(joins) and len(scans) == 100
    assert all(scans[k] == pytest.approx(v, abs=1e-9) for k, v in joins.items())
