import numpy as np
import pytest

from gaugeworks.functions.kernels import item_maxima, log_priors, normal_nodes
from gaugeworks.operators import irt


def simulated(n=250, items=25, seed=5):
    rng = np.random.default_rng(seed)
    theta, b, a = rng.normal(size=n), np.linspace(-2, 2, items), rng.uniform(0.7, 1.6, items)
    y = rng.random((n, items)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))
    return [(u, q, int(y[u, q])) for u in range(n) for q in range(items)], theta, a, b


def objective(rows, params):
    """The marginal log-posterior of the 2PL, plainly."""
    nodes, weights = normal_nodes(irt.NODES)
    y = np.full((250, 25), np.nan)
    for u, q, v in rows:
        y[u, q] = v
    a, b = (np.array([params[q][k] for q in range(25)])[:, None] for k in (0, 1))
    p = 1 / (1 + np.exp(-a * (nodes[None, :] - b)))
    like = np.log(weights) + y @ np.log(p) + (1 - y) @ np.log(1 - p)
    top = like.max(axis=1)
    return float((top + np.log(np.exp(like - top[:, None]).sum(axis=1))).sum()) + float(log_priors(np.array([(params[q][1], np.log(params[q][0]), 0.0) for q in range(25)]), "2PL").sum())


def test_recovery_and_ascent(spark):
    rows, theta, a, b = simulated()
    resp = spark.createDataFrame(rows, "user_id long, question_id long, y int").repartition(3)
    params, trace, learners = irt.irt_fit(resp, "2PL")
    got = sorted(params.collect())
    assert irt.converged(trace, 1e-7 * len(rows)) and abs(trace[-1] - objective(rows, {r.question_id: (r.a, r.b) for r in got})) < 0.01
    for q in (0, 7, 24):  # the gradient is near 0 at the end
        for k in (0, 1):
            side = [objective(rows, {r.question_id: (r.a * np.exp(h * (k == 0)) if r.question_id == q else r.a, r.b + h * (k == 1) * (r.question_id == q)) for r in got}) for h in (-1e-3, 1e-3)]
            assert abs(side[1] - side[0]) / 2e-3 < 0.1
    assert np.corrcoef([r.b for r in got], b)[0, 1] > 0.95
    assert all(y >= x - 1e-6 for x, y in zip(trace, trace[1:]))
    ability = irt.eap(learners, params)
    est = {r.user_id: r.theta for r in ability.collect()}
    assert np.corrcoef([est[u] for u in range(250)], theta)[0, 1] > 0.85
    assert 0.6 < irt.reliability(ability).first()["reliability"] < 0.95
    targets = resp.limit(5)
    assert all(0 < r.p < 1 for r in irt.irt_predict(targets, ability, params).collect())


@pytest.mark.parametrize("model", ["1PL", "2PL", "3PL"])
def test_item_maximum_is_a_maximum(model):
    nodes, weights = normal_nodes()
    n = weights * 400
    r = n * (0.1 + 0.9 / (1 + np.exp(-1.3 * (nodes - 0.4))))
    start = np.array([[0.0, 0.0, np.log(0.15 / 0.85)]])
    ((b, la, lc),) = item_maxima(n[None], r[None], nodes, start, model)
    a, c = np.exp(la), 1 / (1 + np.exp(-lc)) if model == "3PL" else 0.0

    def value(a, b, c):
        p = np.clip(c + (1 - c) / (1 + np.exp(-a * (nodes - b))), 1e-10, 1 - 1e-10)
        return (r * np.log(p) + (n - r) * np.log(1 - p)).sum() + float(log_priors(np.array([(b, np.log(a), np.log(c / (1 - c)) if c else 0.0)]), model)[0])

    best = value(a, b, c)
    assert value(a, b + 0.05, c) < best and value(a, b - 0.05, c) < best
    if model != "1PL":
        assert value(a * 1.05, b, c) < best and value(a / 1.05, b, c) < best
    if model == "3PL":
        assert value(a, b, c * 1.1) < best and value(a, b, c / 1.1) < best


def test_new_item_difficulty(spark):
    rng = np.random.default_rng(2)
    rows = [(q, float(t), int(rng.random() < 1 / (1 + np.exp(-(t - q))))) for q in (-1, 0, 1) for t in rng.normal(size=400)]
    got = {r.question_id: r.b for r in irt.item_difficulty(spark.createDataFrame(rows, "question_id long, theta double, y int")).collect()}
    for q in (-1, 0, 1):
        mine = [(t, y) for k, t, y in rows if k == q]
        slope = sum(-(y - 1 / (1 + np.exp(-(t - got[q])))) for t, y in mine) - got[q] / 9
        assert abs(slope) < 1e-4 and abs(got[q] - q) < 0.4
