import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.kernels import log_priors, newton_ab, normal_nodes
from gaugeworks.operators import irt, irt_many, irt_studies
from gaugeworks.operators.irt_many import Setting


def simulated(n=200, items=8, seed=5, c=0.0):
    rng = np.random.default_rng(seed)
    theta, b, a = rng.normal(size=n), np.linspace(-1.5, 1.5, items), rng.uniform(0.7, 1.6, items)
    p = c + (1 - c) / (1 + np.exp(-a * (theta[:, None] - b)))
    y = rng.random((n, items)) < p
    return [(u, q, int(y[u, q])) for u in range(n) for q in range(items) if (u * 7 + q * 3) % 11]


@pytest.fixture(scope="module")
def log(spark):
    rows = simulated()
    resp = spark.createDataFrame(rows, "user_id long, question_id long, y int").repartition(3)
    learners = irt_many.packed(resp)
    return rows, resp, learners, irt_many.fit_many(learners, resp, [Setting("2PL")])[0]


def objective(rows, x):
    nodes, weights = normal_nodes(irt_many.NODES)
    p = 1 / (1 + np.exp(-np.exp(x[:, 1:2]) * (nodes - x[:, 0:1])))
    like = {}
    for u, q, y in rows:
        like[u] = like.get(u, np.log(weights)) + np.log(p[q] if y else 1 - p[q])
    return sum(float(v.max() + np.log(np.exp(v - v.max()).sum())) for v in like.values()) + float(log_priors(x, "2PL").sum())


def test_many_settings_are_their_separate_fits(spark):
    resp = spark.createDataFrame(simulated(c=0.2), "user_id long, question_id long, y int")
    learners = irt_many.packed(resp)
    settings = [Setting("1PL"), Setting("2PL"), Setting("3PL"), Setting("3PL", c_prior=(2, 18)), Setting("2PL", without=frozenset({1, 4}))]
    together = irt_many.fit_many(learners, resp, settings)
    for s, got in zip(settings, together):
        (alone,) = irt_many.fit_many(learners, resp, [s])
        assert got.items.tolist() == alone.items.tolist() and got.x == pytest.approx(alone.x, abs=1e-9) and got.converged
        assert all(b >= a - 1e-9 for a, b in zip(got.trace, got.trace[1:]))
    assert 1 not in together[4].items and set(together[0].x[:, 1]) == {together[0].x[0, 1]}


def test_information_is_the_curvature(log):
    rows, _, learners, fit = log
    got = irt_studies.information(learners, fit)
    n, h = 2 * len(fit.items), 1e-3

    def at(i, j, a, b):
        x = fit.x.copy()
        x[i // 2, i % 2] += a
        x[j // 2, j % 2] += b
        return objective(rows, x)

    for i, j in [(0, 0), (1, 1), (0, 1), (2, 5), (3, 3), (6, 9), (n - 1, n - 1), (1, n - 1)]:
        want = -(at(i, j, h, h) - at(i, j, h, -h) - at(i, j, -h, h) + at(i, j, -h, -h)) / (4 * h * h)
        assert got[i, j] == pytest.approx(want, abs=1e-3 * max(1, abs(want))) and got[i, j] == pytest.approx(got[j, i])
    errors = irt_studies.discrimination_errors(learners, fit, 1.0)
    cov = np.linalg.inv(got)
    assert [r["se_log_a"] for r in errors.orderBy("question_id").collect()] == pytest.approx(np.sqrt(np.diag(cov)[1::2]))
    assert irt_studies.error_summary(errors).first()["items"] == len(fit.items)


def test_prior_sensitivity(spark):
    resp = spark.createDataFrame(simulated(c=0.2), "user_id long, question_id long, y int").withColumn("held", (F.col("user_id") + F.col("question_id")) % 10 == 0)
    table, held = irt_studies.prior_sensitivity(resp)
    got = {r["prior"]: r for r in table.collect()}
    assert set(got) == {"Beta(5,17)", "Beta(2.5,7.5)", "Beta(1,3)", "Beta(2,18)"} and got["Beta(2,18)"]["mean_c"] < got["Beta(5,17)"]["mean_c"]
    params, trace, _ = irt.irt_fit(resp, "3PL")
    assert got["Beta(5,17)"]["mean_c"] == pytest.approx(np.mean([r["c"] for r in params.collect()]), abs=1e-6)
    assert held.count() == 4 * resp.where("held").count()


def test_leaving_an_item_out_is_a_posterior_without_it(log):
    rows, resp, learners, fit = log
    params = irt_many.parameters(learners, [fit]).drop("setting")
    got = {(r["user_id"], r["question_id"]): r["theta"] for r in irt_studies.leave_item_out(resp, irt.eap(learners, params), params).collect()}
    nodes, weights = normal_nodes(irt_many.NODES)
    p = 1 / (1 + np.exp(-np.exp(fit.x[:, 1:2]) * (nodes - fit.x[:, 0:1])))
    for u in (0, 17, 150):
        own = [(q, y) for v, q, y in rows if v == u]
        for q, _ in own:
            w = weights * np.prod([p[k] if y else 1 - p[k] for k, y in own if k != q], axis=0)
            assert got[u, q] == pytest.approx((w @ nodes) / w.sum(), abs=1e-9)
    assert len(got) == len(rows)


def md5_01(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def test_simulated_logs_do_not_depend_on_partitions(log, spark):
    _, resp, learners, fit = log
    params = irt_many.parameters(learners, [fit]).drop("setting")
    ability = irt.eap(learners, params)
    a, b = (sorted(tuple(r) for r in irt_studies.simulated_logs(resp.repartition(n), ability.repartition(n), params, 2).collect()) for n in (1, 7))
    assert a == b and len(a) == 2 * resp.count()
    nodes, _ = normal_nodes(irt_many.NODES)
    post = {r["user_id"]: np.array(r["post"]) for r in ability.collect()}
    drawn = irt_studies.drawn_abilities(ability, 2).collect()
    for r in drawn[:50]:
        k = int((np.cumsum(post[r["user_id"]]) <= md5_01(r["user_id"], r["grp"], 0)).sum())
        assert r["theta"] == pytest.approx(nodes[min(k, len(nodes) - 1)])


def test_q3_null(log):
    _, resp, _, _ = log
    got = irt_studies.q3_null(resp, reps=3, min_common=20, rounds=60).collect()
    by = {r["rep"]: r for r in got}
    assert set(by) == {-1, 0, 1, 2} and by[-1]["kind"] == "observed" and len({r["threshold"] for r in got}) == 1
    assert by[-1]["pairs"] == 28 and all(abs(r["mean_q3"] + 1 / 7) < 0.1 for r in got)  # about -1 / (items - 1) without dependence
    assert max(r["largest"] for r in got if r["rep"] >= 0) <= by[-1]["threshold"] + 0.1


def test_joint_map_is_the_plain_optimum(spark):
    rng = np.random.default_rng(2)
    rows = [(q, float(t), int(rng.random() < 1 / (1 + np.exp(-(1 + q / 2) * (t - q)))), 0.8 + q / 5) for q in (0, 1, 2) for t in rng.normal(size=300)]
    df = spark.createDataFrame(rows, "question_id long, theta double, y int, abar double")
    got = {r["question_id"]: (r["b"], r["a"]) for r in irt.item_difficulty_slope(df, a0="abar").collect()}
    for q in (0, 1, 2):
        own = [(t, y, a) for k, t, y, a in rows if k == q]
        th, y = np.array([[t for t, _, _ in own]]), np.array([[y for _, y, _ in own]], float)
        l0 = np.log([own[0][2]])
        b, l = newton_ab(th, y, np.ones_like(th), l0, np.zeros(1), np.full(1, 9.0))
        assert got[q] == pytest.approx((b[0], np.exp(l[0])), abs=1e-6)

        def f(b, l):
            z = np.exp(l) * (th[0] - b)
            return float((y[0] * z - np.logaddexp(0, z)).sum() - b * b / 18 - (l - l0[0]) ** 2 / 0.5)

        for d in (1e-3, -1e-3):
            assert f(b[0], l[0]) >= f(b[0] + d, l[0]) and f(b[0], l[0]) >= f(b[0], l[0] + d)


def test_calibration_errors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(q, u, float(rng.normal()), int(rng.random() < 0.5), 1.3) for q in range(5) for u in range(12 + 4 * q)]
    truth = [(q, 0.2 * q - 0.3, q % 5, 0.1 * q * q) for q in range(5)]
    priors = irt_studies.fold_priors(spark.createDataFrame(truth, "question_id long, truth double, fold int, t double"), ["t"])
    got = {(r["question_id"], r["prior"], r["k"]): r["mse"] for r in irt_studies.calibration_errors(spark.createDataFrame(rows, "question_id long, user_id long, theta double, y int, abar double"), priors, (3, 20), 4, "anchors").collect()}
    for q in range(5):
        others = [(t, x) for k, t, f, x in truth if k != q]
        mean, var = np.mean([t for t, _ in others]), np.var([t for t, _ in others])
        line = np.polyfit([x for _, x in others], [t for t, _ in others], 1)
        left = np.var([t - np.polyval(line, x) for t, x in others])
        for name, mu, s2 in (("weak", 0.0, 9.0), ("population", mean, var), ("text:t", np.polyval(line, 0.1 * q * q), left)):
            assert got[q, name, 0] == pytest.approx((mu - truth[q][1]) ** 2)
            for k in (3, 20):
                own = [r for r in rows if r[0] == q]
                if len(own) < k:
                    assert (q, name, k) not in got
                    continue
                errors = []
                for d in range(4):
                    some = sorted(own, key=lambda r: (md5_01(q, r[1], d, 0), r[1]))[:k]
                    b = mu
                    for _ in range(200):
                        p = [1 / (1 + np.exp(-1.3 * (t - b))) for _, _, t, _, _ in some]
                        g = sum(1.3 * (r[3] - v) for r, v in zip(some, p)) + (b - mu) / s2
                        b -= np.clip(g / (sum(1.69 * v * (1 - v) for v in p) + 1 / s2), -2, 2)
                    errors.append((b - truth[q][1]) ** 2)
                assert got[q, name, k] == pytest.approx(np.mean(errors), rel=1e-6)


def test_equivalent_answers():
    weak = {0: 2.0, 5: 1.0, 10: 0.8, 20: 0.5}
    assert irt_studies.equivalent_answers(weak, 0.8) == pytest.approx(10)
    assert irt_studies.equivalent_answers(weak, 2.0) == pytest.approx(5 / 4)
    assert irt_studies.equivalent_answers(weak, 0.65) == pytest.approx(10 * 2**0.5)


def test_cross_fits_leave_own_folds_out(log, spark):
    _, resp, _, _ = log
    rows, fits, items = irt_studies.cross_fits(resp)
    fold = {r["question_id"]: r["fold"] for r in items.collect()}
    for f, fit in enumerate(fits):
        assert not {q for q, g in fold.items() if g == f} & set(fit.items.tolist())
    assert all(fold[r["question_id"]] == r["fold"] for r in rows.collect()) and rows.count() == resp.count()
    halves = {(r["question_id"], r["user_id"]): r["half"] for r in rows.collect()}
    assert 0.35 < np.mean(list(halves.values())) < 0.65
    texts = spark.createDataFrame([(q, float(q)) for q in fold], "question_id long, x double")
    report = irt_studies.calibration_crossfit(resp, texts, ks=(5, 20), draws=5).toPandas()
    assert set(zip(report["treatment"], report["reference"])) == {(t, r) for t in irt_studies.TREATMENTS for r in ("half", "all")}
    weak = report[(report["prior"] == "weak") & (report["treatment"] == "one")]
    assert (weak[weak["k"] == 20]["rmse"].to_numpy() < weak[weak["k"] == 5]["rmse"].to_numpy()).all()


def test_learners_come_in_slices_of_bounded_answers(spark, log, monkeypatch):
    import pandas as pd

    batch = pd.DataFrame({"items": [np.arange(n) for n in (3, 0, 40, 2, 2, 90, 1)], "user": range(7)})
    parts = list(irt_many.slices(iter([batch, batch.iloc[:0]]), 10))
    assert [u for p in parts for u in p["user"]] == list(range(7))  # each learner once, in order
    assert all(len(p) == 1 or sum(map(len, p["items"].iloc[:-1])) <= 10 for p in parts) and len(parts) > 3
    rows, resp, learners, fit = log
    monkeypatch.setattr(irt_many, "RESPONSES", 50)
    (again,) = irt_many.fit_many(learners, resp, [Setting("2PL")])
    assert again.x == pytest.approx(fit.x, abs=1e-9)


def test_learners_and_logs_are_never_broadcast(spark):
    """Small here, but a row a learner and replicate: Spark's estimate of mapped and exploded tables is too low at any size."""
    resp = spark.createDataFrame([(1, 2, 1), (2, 2, 0)], "user_id long, question_id long, y int")
    ability = spark.createDataFrame([(1, 0.1, [1 / irt.NODES] * irt.NODES)], "user_id long, theta double, post array<double>")
    params = spark.createDataFrame([(2, 1.0, 0.0, 0.0)], "question_id long, a double, b double, c double")
    made = [irt_studies.simulated_logs(resp, ability, params, 2), irt_studies.residuals(resp, ability, params), irt_studies.leave_item_out(resp, ability, params), irt.irt_predict(resp, ability, params)]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [user_id" in plan and df.count() >= 1


def test_draws_are_the_first_of_a_hashed_order(spark, monkeypatch):
    from gaugeworks.functions.scalars import hash01

    sizes = {0: 400, 1: 30, 2: 3}
    rows = spark.createDataFrame([(q, u, u / 10, u % 2, 1.0) for q, n in sizes.items() for u in range(n)], "question_id long, user_id long, theta double, y int, abar double")
    every = rows.crossJoin(spark.range(6).select(F.col("id").cast("int").alias("draw"))).withColumn("u", hash01(F.col("question_id"), F.col("user_id"), F.col("draw"), seed=4))
    order = {}
    for r in every.collect():
        order.setdefault((r.question_id, r.draw), []).append((r.u, r.user_id))
    want = {k: [u / 10 for _, u in sorted(v)[:5]] for k, v in order.items()}
    for ahead in (3, 0.2, 0):  # with a low bound some draws, or all, go over all answers
        monkeypatch.setattr(irt_studies, "AHEAD", ahead)
        got = {(r.question_id, r.draw): [x.theta for x in r.s] for r in irt_studies.drawn_samples(rows, 5, 6, 4).collect()}
        assert got == want
