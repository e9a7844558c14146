import random

import numpy as np
import pytest

from gaugeworks.llm import hard_negatives as h


def brute(rows, anchors, positives=5, negatives=3):
    rows = sorted({(i, tuple(x), c) for i, x, c in rows if i is not None and x is not None and c is not None}, key=lambda r: r[0])
    out = []
    for i, x, c in {(i, tuple(x), c) for i, x, c in anchors if i is not None and x is not None and c is not None}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, d) for j, y, d in rows)
        for s, p, _ in [t for t in scored if t[2] == c and t[1] != i][:positives]:
            found = [t for t in scored if t[2] != c and t[1] != i and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(found)]
    return sorted(out)


def mined(df, anchors):
    return sorted(tuple(r) for r in h.hard_negatives(df, anchors).collect())


@pytest.mark.parametrize("chunk,leaf,numbers", [(4096, 256, 1 << 18), (40, 5, 200)])
def test_against_brute_force(spark, monkeypatch, chunk, leaf, numbers):
    for name, value in (("CHUNK", chunk), ("LEAF", leaf), ("BLOCK_NUMBERS", numbers)):
        monkeypatch.setattr(h, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 30
    rows = [(k, [int(v) for v in centres[k % 12] + rng.normal(size=6) * 9], int(rng.integers(4))) for k in range(500)]
    rows += [(1000 + k, rows[7][1], k % 3) for k in range(150)] + [(50, rows[50][1], rows[50][2])] * 3 + [(100, rows[3][1], 9), (3, rows[9][1], 2)]
    rows += [(k, [0] * 6, k % 2) for k in range(2000, 2010)] + [(None, [1] * 6, 1), (5000, None, 1), (5001, [1] * 6, None)]
    df = spark.createDataFrame([(a, b, c, "q", 1) for a, b, c in rows], "vec_id long, x array<long>, label int, query string, place int").repartition(5)
    anchors = [r for r in rows if r[0] is not None and r[0] % 25 == 0]
    assert mined(df, df.where("vec_id % 25 = 0")) == brute(rows, anchors)


def test_a_tree_holds_what_it_says():
    rng = np.random.default_rng(5)
    points = h.augmented(rng.integers(-50, 50, size=(900, 5)), 12500.0)
    tree, order = h.grown(points, 20)
    assert sorted(order.tolist()) == list(range(900))
    stack = [tree]
    while stack:
        node = stack.pop()
        if node.point is None:
            assert node.stop - node.start <= 20
            continue
        for child, (low, high) in ((node.near, node.inner), (node.far, node.outer)):
            d = h.distances(points[order[child.start : child.stop]], node.point)
            assert low == d.min() and high == d.max()
            stack.append(child)


def test_annuli_leave_out_most_of_a_clustered_index(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(64, 8)), 64, axis=0) + 0.02 * rng.normal(size=(4096, 8))
    x = np.floor(1000 * x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.int64)
    label, ids, most = rng.integers(0, 5, 4096), np.arange(4096), float((x * x).sum(1).max())
    tree, order = h.grown(h.augmented(x, most), 64)
    met = []
    meet = h.Queries.meet
    monkeypatch.setattr(h.Queries, "meet", lambda self, at, *rest: (met.append(len(at) * len(rest[0])), meet(self, at, *rest))[1])
    q = h.Queries(x[:50].astype(float), label[:50], ids[:50], np.full(50, -1e18), np.full(50, 1e18), True, 5, most)
    q.search(tree, np.arange(50), x[order].astype(float), label[order], ids[order])
    assert sum(met) < 0.3 * 50 * 4096
    score = x[:50] @ x.T
    for k in range(50):
        want = sorted((-int(score[k, j]), int(j)) for j in range(4096) if label[j] == label[k] and j != k)[:5]
        assert [(-int(a), int(b)) for a, b in zip(q.score[k], q.id[k])] == want


def test_edges(spark):
    shape = "vec_id long, x array<long>, label long"
    none = spark.createDataFrame([], shape)
    one = spark.createDataFrame([(0, [1, 2], 1)], shape)
    assert h.hard_negatives(none, none).count() == 0 and h.hard_negatives(one, none).count() == 0 and h.hard_negatives(one, one).count() == 0
    assert h.hard_negatives(none, one).count() == 0
    random.seed(1)
    rows = [(0, [10, 0], 1), (1, [10, 0], 1), (2, [5, 0], 2), (3, [9, 0], 2), (4, [10, 0], 2), (5, [7, 9], 3), (6, [1 << 40, 0], 2)]
    got = h.hard_negatives(spark.createDataFrame(rows, shape), spark.createDataFrame(rows[:1], shape)).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 3, 100, 90), (0, 1, 2, 5, 100, 70), (0, 1, 3, 2, 100, 50)]
