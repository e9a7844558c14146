import random
import re

import numpy as np
import pytest
import xxhash

from gaugeworks.llm import bitslice, simhash


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, near):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if near(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("w,radius", [(1, 2), (1, 0), (4, 50)])
def test_links_in_buckets(w, radius):
    rng = np.random.default_rng(w)
    base = rng.integers(0, 2**63, (30, w), dtype=np.int64).astype(np.uint64)
    prints = base[rng.integers(0, 30, 700)].copy()
    for row in prints:
        for _ in range(rng.integers(0, 4) * max(1, radius // 2)):
            row[rng.integers(0, w)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    bucket = np.sort(rng.integers(0, 9, 700))
    label = bitslice.linked(bucket, prints, radius)
    ints = [[int(x) for x in r] for r in prints]
    want = brute_components(range(700), lambda a, b: bucket[a] == bucket[b] and sum((x ^ y).bit_count() for x, y in zip(ints[a], ints[b])) <= radius)
    assert label.tolist() == [want[k] for k in range(700)]


TEXTS = [None, "", " \n", "one", "One", "one two", "a b c", "A B C", "a b c d e f g h", "é É \x1c ß", "x " * 3000, "the same words here", "the  same\twords here"]


@pytest.mark.parametrize("hot", [simhash.HOT, 5])
def test_query_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash.close_links, "__defaults__", (hot,))
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = TEXTS + [" ".join(rnd.choice(vocabulary) for _ in range(200)) for _ in range(6)]
    for t in texts[-6:]:
        for _ in range(8):
            words = t.split()
            words[rnd.randrange(200)] = "other"
            texts.append(" ".join(words))
    rows = [(k * 3, t, "de", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prints string, component_id int").repartition(3)
    got = {r.doc_id: r for r in simhash.near_copies(docs, 3, None, 2).collect()}
    prints = {k: brute_print(t) for k, t, *_ in rows}
    assert {k: v.prints[0] & (2**64 - 1) for k, v in got.items()} == prints
    want = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {k: v.component_id for k, v in got.items()} == want


def test_keys_miss_no_pair():
    rng = np.random.default_rng(3)
    masks = simhash.chunk_masks(list(range(64)), 4)
    assert len(masks) == 6
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
        assert any(not x & m for m in masks)


def test_similar_texts_and_copies(spark):
    rnd = random.Random(6)
    rows, group = [], {}
    for g in range(30):
        words = [f"v{rnd.randrange(500)}" for _ in range(300)]
        for c in range(3):
            mine = list(words)
            for _ in range(5 if c else 0):  # about 25 of 296 shingles change: similarity 0.84
                mine[rnd.randrange(300)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, 5, 0.8).collect()}
    assert all(group[k] == group[v] for k, v in got.items())
    assert sum(k // 3 * 3 == v for k, v in got.items()) >= 87


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_copies(docs, 3, None).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash.near_copies(docs.limit(0), 3, None).count() == 0


def exact_groups(texts, similarity):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {k: shingles(t) for k, t in texts.items()}
    return brute_components(list(texts), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


@pytest.mark.parametrize("most", [simhash.GROUP, 4])
def test_similar_texts_reach_the_exact_similarity(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", most)
    rnd = random.Random(9)
    texts = {}
    for g in range(12):
        words = [f"v{rnd.randrange(5000)}" for _ in range(300)]
        for edits in (0, 5, 6, 9, 9, 9, 10):  # similarity to the first from 0.84 to 0.71
            mine = list(words)
            for place in rnd.sample(range(10, 290), edits):
                mine[place] = f"new{rnd.randrange(10**6)}"
            texts[len(texts)] = " ".join(mine)
    line = [f"r{k}" for k in range(15)]
    texts[len(texts)] = " ".join(line * 400)
    texts[len(texts)] = " ".join(line * 400 + [f"q{k}" for k in range(60)])  # few of its distinct shingles are shared
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, 5, 0.8).collect()}
    assert got == exact_groups(texts, 0.8)


def test_hot_anchors_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):  # pairs differ in 24 bits and share one anchor, which all rows have
        prints = rng.integers(-(2**62), 2**62, 8)
        for c in (0, 1):
            rows.append((2 * k + c, [int(x) ^ (7 * c) for x in prints], [1, *(int(x) for x in rng.integers(2, 2**60, 5))]))
    nodes = spark.createDataFrame(rows, "node long, prints array<long>, anchors array<long>")
    want = {tuple(r) for r in simhash.similar_links(nodes, 30).collect()}
    assert len(want) == 40 and {tuple(r) for r in simhash.similar_links(nodes, 30, 5).collect()} == want
