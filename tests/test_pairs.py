import numpy as np
import pytest

from gaugeworks.operators import pairs, responses


def plain(rows):
    by, out = {}, {}
    for g, u, q, v in rows:
        by.setdefault((g, u), []).append((q, v))
    for (g, _), own in by.items():
        for i, x in own:
            for j, y in own:
                if i < j:
                    out.setdefault((g, i, j), []).append((x, y))
    return out


@pytest.mark.parametrize("block", [3, 128])
def test_moments_are_those_of_a_self_join(spark, block):
    rng = np.random.default_rng(1)
    rows = [(g, u, int(q) * 1000, float(rng.normal())) for g in (0, 1) for u in range(30) for q in rng.choice(11, rng.integers(0, 11), replace=False)]
    df = spark.createDataFrame(rows, "g int, user_id long, question_id long, r double").repartition(5)
    got = {(r["g"], r["i"], r["j"]): r for r in pairs.pair_moments(df, "r", ("g",), block).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for k, both in want.items():
        x, y = np.array(both).T
        assert [got[k][m] for m in pairs.MOMENTS] == pytest.approx([len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()])
    q3 = {(r["g"], r["i"], r["j"]): r["q3"] for r in responses.q3(df, 5, ("g",)).collect()}
    assert q3 == pytest.approx({k: np.corrcoef(np.array(v).T)[0, 1] for k, v in want.items() if len(v) >= 5})


def test_a_learner_with_many_items(spark):
    n = 3000
    df = spark.range(n).selectExpr("1L AS user_id", "id AS question_id")
    assert responses.common_learners(df).count() == n * (n - 1) // 2


def test_empty_log(spark):
    assert responses.common_learners(spark.createDataFrame([], "user_id long, question_id long")).count() == 0
