import hashlib
import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels
from gaugeworks.operators import items, metrics, responses
from gaugeworks.operators.graphs import connected_components
from gaugeworks.operators.ordering import indexed, prefix_sums


def test_tails():
    assert kernels.normal_two_sided(np.array([1.959963985, 0])).tolist() == pytest.approx([0.05, 1.0], abs=1e-8)
    assert [kernels.t_two_sided(t, d) for t, d in ((2.228139, 10), (12.7062, 1), (1.984467, 98))] == pytest.approx([0.05] * 3, abs=2e-6)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_order_and_prefix_do_not_depend_on_partitions(spark, parts):
    rnd = random.Random(2)
    rows = [(k, rnd.choice("aaab"), rnd.randint(0, 5)) for k in range(200)]
    rnd.shuffle(rows)
    df = indexed(spark.createDataFrame(rows, "t long, key string, v int").repartition(parts), ["t"])
    got = {r.t: (r.seq, r.s) for r in prefix_sums(df, ["key"], "seq", {"s": F.col("v")}, block=16).collect()}
    total = {}
    for t, key, v in sorted(rows):
        assert got[t] == (t, total.get(key, 0))
        total[key] = total.get(key, 0) + v


def test_auc_with_ties_and_weights(spark):
    rows = [(1, 0.9, 1.0), (0, 0.9, 2.0), (1, 0.4, 1.0), (0, 0.1, 1.0), (0, 0.4, 3.0)]
    df = spark.createDataFrame(rows, "y int, p double, w double")
    for weight in (None, F.col("w")):
        w = [r[2] if weight is not None else 1.0 for r in rows]
        pairs = [(wa * wb, (a[1] > b[1]) + (a[1] == b[1]) / 2) for a, wa in zip(rows, w) if a[0] for b, wb in zip(rows, w) if not b[0]]
        want = sum(x * y for x, y in pairs) / sum(x for x, _ in pairs)
        assert metrics.binary_scores(df, [], weight=weight).first()["auc"] == pytest.approx(want)


def test_holm_and_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    got = {r.id: (r.holm, r.bh) for r in metrics.adjust(spark.createDataFrame(list(enumerate(p)), "id int, p_value double"), "id").collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (False, True), 3: (True, True), 4: (False, False)}


def test_signed_rank(spark):
    a, b = [125, 115, 130, 140, 140, 115, 140, 125, 140, 135], [110, 122, 125, 120, 140, 124, 123, 137, 135, 145]
    r = metrics.signed_rank(spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "k int, a double, b double"), "k", "a", "b").first()
    assert (r.n, r.w_plus) == (9, 27.0)


def test_bootstrap_covers_and_repeats(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k % 100, float(x)) for k, x in enumerate(rng.normal(1, 1, 1000))], "u int, x double")
    one = [metrics.bootstrap(df.repartition(n), ["u"], {"n": F.lit(1.0), "x": F.col("x")}, {"mean": "x / n"}).first() for n in (1, 7)]
    assert one[0].ci_low < one[0].value < one[0].ci_high and 0.08 < one[0].ci_high - one[0].ci_low < 0.2
    assert one[0].ci_low == pytest.approx(one[1].ci_low)


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(500, 500), (None, 3)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in label}


def test_second_key_timeout_repeat_and_prune(spark):
    resp = spark.createDataFrame([(1, 9, 1, 10, "2024-01-02"), (2, 9, 1, 11, "2024-01-01"), (3, 9, 2, None, "2024-01-01"), (4, 9, 3, 30, "2024-01-01"), (5, 8, 1, 12, "2024-01-01")], "id long, user_id long, question_id long, answer_id long, created_at string")
    keys = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (2, 20)], "question_id long, answer_id long")
    scored = responses.score_response(resp, keys)
    assert {r.id: r.y for r in scored.collect()} == {1: 1, 2: 0, 3: 0, 5: 1}
    assert sorted(r.id for r in responses.first_attempt(scored).collect()) == [2, 3, 5]
    rows = spark.createDataFrame([(u, q) for u in range(6) for q in range(6) if (u + q) % 5], "user_id long, question_id long")
    left = {(u, q) for u in range(6) for q in range(6) if (u + q) % 5}
    for _ in range(3):
        left = {x for x in left if sum(y[1] == x[1] for y in left) >= 5}
        left = {x for x in left if sum(y[0] == x[0] for y in left) >= 5}
    assert {tuple(r) for r in responses.prune(rows, 5, 5).collect()} == left


def test_options_use_keys_of_any_question(spark):
    answers = spark.createDataFrame([(1, 1, "12"), (2, 1, "b"), (3, 1, "345"), (4, 2, "z")], "id long, question_id long, text string")
    keys = spark.createDataFrame([(1, 1), (7, 3)], "question_id long, answer_id long")
    got = {r.id: r for r in items.option_features(items.with_options(spark.createDataFrame([(1,), (2,), (3,)], "id long"), answers, keys)).collect()}
    assert got[1].key_numeric == 0 and got[1].numeric_share == 0 and got[1].key_longest == 1 and got[1].len_ratio == 4
    got = {r.id: (r.key_text, r.distractors) for r in items.with_options(spark.createDataFrame([(1,), (2,), (3,)], "id long"), answers, keys).collect()}
    assert got[1] == ("12 | 345", "b") and got[2] == ("", "z") and got[3] == (None, None)


def test_group_that_crosses_the_share_goes_up(spark):
    df = spark.createDataFrame([(k, 1) for k in range(9)] + [(9, 2)], "id long, group long")
    assert {r.split for r in items.group_split(df).where("group = 1").collect()} <= {"val", "test"}


def test_time_split_counts_from_the_shares(spark):
    from gaugeworks.operators.ordering import time_split

    for n in (7, 10, 13):
        got = [r.split for r in time_split(spark.range(n), ["id"]).orderBy("seq").collect()]
        assert got == ["train" if k < 0.6 * n else "val" if k < 0.8 * n else "test" for k in range(n)]


def test_auc_difference_against_brute_force(spark):
    import random

    import numpy as np

    from gaugeworks.operators import metrics

    rnd = random.Random(2)
    rows = [(k % 9, rnd.randint(0, 11), rnd.randint(0, 1), round(rnd.random(), 1), round(rnd.random(), 1)) for k in range(150)]
    df = spark.createDataFrame(rows, "u long, o long, y int, a double, b double").repartition(3)

    def auc(w, p):
        y = np.array([r[2] for r in rows])
        less = (p[:, None] > p[None, :]) + (p[:, None] == p[None, :]) / 2
        both = w[:, None] * w[None, :] * (y[:, None] == 1) * (y[None, :] == 0)
        return (both * less).sum() / both.sum()

    a, b = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    for units in (["u"], ["u", "o"]):
        weights = np.ones((40, len(rows)))
        for k, unit in enumerate(["u", "o"][: len(units)]):
            known = {r[k]: metrics.poisson_weights(str(r[k]), 40) for r in rows}
            weights *= np.stack([known[r[k]] for r in rows]).T
        diffs = [auc(w, a) - auc(w, b) for w in weights]
        got = metrics.auc_difference(df, units, "y", {"a": "a", "b": "b"}, [("a", "b")], reps=40, block=7).first()
        assert got.value == __import__("pytest").approx(auc(np.ones(len(rows)), a) - auc(np.ones(len(rows)), b))
        assert (got.ci_low, got.ci_high) == __import__("pytest").approx(tuple(np.quantile(diffs, [0.025, 0.975])))


def test_weights_are_the_same_in_spark_and_numpy(spark):
    from pyspark.sql import functions as F

    from gaugeworks.operators import metrics

    got = spark.range(5).select("id", *[w.alias(f"w{k}") for k, w in enumerate(metrics.block_weights(["id"], F.lit(3)))]).collect()
    assert all([r[f"w{k}"] for k in range(4)] == metrics.poisson_weights(str(r.id), 16).tolist()[12:] for r in got)


def test_chi_square_tail():
    from gaugeworks.functions.kernels import upper_gamma

    # tabulated: the 95 % points of 1, 10 and 100 degrees, and one far out
    for df, x, p in ((1, 3.841458820694124, 0.05), (10, 18.307038053275146, 0.05), (100, 124.34211340400407, 0.05), (2, 40.0, 2.061153622438558e-09)):
        assert abs(upper_gamma(df / 2, x / 2) - p) < 1e-9 * max(1, p)


def test_tied_scores_are_split_and_change_nothing(spark):
    rows = [(u, k % 3 == 0, float(k % 2), float(k % 7)) for u in range(40) for k in range(30)]
    df = spark.createDataFrame(rows, "u long, y boolean, a double, b double")
    one, many = (metrics.auc_difference(df, ["u"], "y", {"a": "a", "b": "b"}, [("a", "b")], reps=24, block=n).first() for n in (1 << 12, 5))
    assert [one[c] for c in ("value", "ci_low", "ci_high")] == pytest.approx([many[c] for c in ("value", "ci_low", "ci_high")], abs=1e-12)


def test_weights_of_many_units_equal_md5_of_each():
    units = ["7", "é", "x" * 51, "x" * 70, "2024-01-05", "12"]  # of several lengths, and beyond one block
    made = metrics.weights_of_units(units, 1000, 3)
    for u, got in zip(units, made):
        digest = b"".join(hashlib.md5(f"{u}|{b}|3".encode()).digest() for b in range(250))
        share = np.frombuffer(digest, ">u4") / 4294967296.0
        assert (got == [sum(x >= c for c in metrics.POISSON) for x in share]).all()


def test_bootstrap_by_groups_with_nulls_and_two_units(spark):
    rows = [(g, u, o, None if u == 3 else float(u * o), None) for g in ("a", "b") for u in range(20) for o in range(15)]
    df = spark.createDataFrame(rows, "g string, u long, o long, x double, z double")
    moments = {"n": F.lit(1.0), "x": F.col("x"), "z": F.col("z")}
    found = metrics.bootstrap(df, ["u", "o"], moments, {"mean": "x / n", "none": "z / n"}, reps=40, by=["g"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan and "md5(" not in plan  # no row a unit and block of replicates
    got = {(r.g, r.stat): r for r in found.collect()}
    w = {k: metrics.weights_of_units([str(i) for i in range(20)], 40) for k in "uo"}
    means = []
    for rep in range(40):
        ws = [(w["u"][u][rep] * w["o"][o][rep], 0 if x is None else x) for g, u, o, x, _ in rows if g == "a"]
        means.append(sum(a * x for a, x in ws) / sum(a for a, _ in ws))
    for g in "ab":
        assert got[g, "mean"].ci_low == pytest.approx(np.percentile(means, 2.5)) and got[g, "mean"].ci_high == pytest.approx(np.percentile(means, 97.5))
        assert got[g, "none"].value is None and got[g, "none"].ci_low is None


def test_auc_weights_are_made_for_many_units_at_once(spark):
    rows = spark.createDataFrame([(u, v, (u * v) % 2, float(u % 5), float(v)) for u in range(12) for v in range(3)], "u long, v long, y int, a double, b double")
    want = metrics.auc_difference(rows, ["u", "v"], "y", {"a": "a", "b": "b"}, [("a", "b")], reps=24).first()
    again = metrics.auc_difference(rows.repartition(5), ["u", "v"], "y", {"a": "a", "b": "b"}, [("a", "b")], reps=24, block=4).first()
    assert (again.value, again.ci_low, again.ci_high) == pytest.approx((want.value, want.ci_low, want.ci_high))
    source = inspect.getsource(metrics.auc_difference)
    assert "product_weights" in source and "poisson_weights(" not in source
