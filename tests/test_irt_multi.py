import numpy as np
import pytest

from gaugeworks.operators import irt, irt_many, irt_multi


def simulated(corr, n=1500, items=15, seed=3):
    rng = np.random.default_rng(seed)
    d = len(corr)
    theta = rng.normal(size=(n, d)) @ np.linalg.cholesky(corr).T
    rows = []
    for q in range(items * d):
        a, b = rng.uniform(1.2, 2.2), rng.uniform(-1.5, 1.5)
        y = rng.random(n) < 1 / (1 + np.exp(-a * (theta[:, q % d] - b)))
        rows += [(u, q, int(y[u])) for u in range(n)]
    return rows


def frames(spark, rows, d):
    resp = spark.createDataFrame(rows, "user_id long, question_id long, y int").repartition(4)
    return resp, spark.createDataFrame([(q, q % d) for q in sorted({r[1] for r in rows})], "question_id long, series_id int")


def test_recovers_planted_correlations(spark):
    want = np.array([[1, 0.8, 0.3], [0.8, 1, 0.5], [0.3, 0.5, 1]])
    resp, series = frames(spark, simulated(want), 3)
    params, corr, figures, learners = irt_multi.irt_fit_multi(resp, series, nodes=9, tol=1e-6)
    assert np.abs(corr - want).max() < 0.05 and figures["converged"]
    assert all(b >= a - 1e-6 for a, b in zip(figures["trace"], figures["trace"][1:]))
    targets = resp.where("user_id < 50 and question_id % 7 = 0")
    got = irt_multi.predict_multi(learners, targets, params, corr, nodes=9).toPandas()
    assert len(got) == targets.count() and got["p"].between(0, 1).all() and got[got["y"] == 1]["p"].mean() > got[got["y"] == 0]["p"].mean()


def test_one_series_is_the_one_dimensional_fit(spark, monkeypatch):
    monkeypatch.setattr(irt_many, "NODES", 21)
    resp, series = frames(spark, simulated(np.eye(1), n=300, items=12), 1)
    params, corr, figures, _ = irt_multi.irt_fit_multi(resp, series, nodes=21, tol=1e-9)
    one, trace, _ = irt.irt_fit(resp, "2PL", tol=1e-9)
    got, want = ({r["question_id"]: (r["a"], r["b"]) for r in x.collect()} for x in (params, one))
    assert corr.tolist() == [[1.0]] and figures["trace"][-1] == pytest.approx(trace[-1], abs=1e-3)
    for q in want:
        assert got[q] == pytest.approx(want[q], abs=5e-3)


def test_correlations_of_moments():
    s = np.array([[1, 0.6, -0.2], [0.6, 1, 0.1], [-0.2, 0.1, 1]])
    assert irt_multi.likeliest_correlations(s, np.eye(3)) == pytest.approx(s, abs=1e-8)


def test_no_answers(spark):
    resp, series = frames(spark, [], 3)
    params, _, figures, _ = irt_multi.irt_fit_multi(resp, series)
    assert params.count() == 0 and figures["items"] == 0
