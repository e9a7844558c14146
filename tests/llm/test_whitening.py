import numpy as np
import pytest

from gaugeworks.llm import whitening as w


def plain(rows, components=4):
    x = {k: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for k, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(total) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for k, row in x.items():
        dev = sum((n * c - s) ** 2 for c, s in zip(row, total))
        out[k] = [(n, dev, float((np.array(row) - np.array(total) / n) @ v[:, j] / np.sqrt(e[j])), e[j] / e.sum()) for j in range(min(components, len(e)))]
    return out


def test_against_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 9)) @ np.diag([3, 2, 1, 0.7, 0.3, 0.3, 0.2, 0.1, 0.05]) @ np.linalg.qr(rng.normal(size=(9, 9)))[0]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)] + [(k, base[5].astype(np.float32).tolist()) for k in range(300, 420)]
    bad = [(900, None), (901, [1.0] * 8 + [None]), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows + bad], "vec_id long, embedding array<float>, n int, x string, component int").repartition(7)
    want = plain(rows)
    got = w.whitened(df).collect()
    assert len(got) == 4 * len(rows) and {r["vec_id"] for r in got} == set(want)
    sign = {}
    for r in got:
        n, dev, value, share = want[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(value), abs=1e-8)
        if abs(value) > 1e-3:
            assert sign.setdefault(r["component"], np.sign(value * r["whitened"])) == np.sign(value * r["whitened"])
        assert 0 <= r["identity_error"] < 1e-9


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(2)
    q, p = np.linalg.qr(rng.normal(size=(40, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    want = np.array([1e6, 1e3, 1.0, 1e-2, 1e-4, 1e-5])
    sigma, v = w.jacobi_svd(np.linalg.qr(q * want @ p.T, mode="r"))
    assert sigma == pytest.approx(want, rel=1e-4) and v.T @ v == pytest.approx(np.eye(6), abs=1e-12)
    assert np.abs(np.abs((v * p).sum(0)) - 1).max() < 1e-6


def test_pairs_come_once():
    for d in (1, 2, 5, 8):
        pairs = [(int(p), int(q)) for a, b in w.rounds(d) for p, q in zip(a, b)]
        assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]


def test_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert w.whitened(spark.createDataFrame([], shape)).count() == 0
    assert w.whitened(spark.createDataFrame([(1, None), (2, [])], shape)).count() == 0
    same = w.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], shape)).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    line = w.whitened(spark.createDataFrame([(k, [float(k), float(2 * k)]) for k in range(5)], shape)).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0}
    assert [r["whitened"] for r in sorted(line, key=lambda r: r["vec_id"]) if r["component"] == 1] == pytest.approx([-2 ** 0.5, -(0.5**0.5), 0, 0.5**0.5, 2**0.5])
    big = w.whitened(spark.createDataFrame([(1, [3e30, 1.0]), (2, [-3e30, 1.0]), (3, [1e10, 1.0])], shape)).collect()
    assert len(big) == 6 and big[0]["deviation"] is None
