import hashlib
import random
import re

import pytest

from gaugeworks.llm import suffix_array as s


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            q = words_of(t)
            n = min(len(q), 10)
            if item is None or not n:
                continue
            for i in range(len(q) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(rnd.choice([10, 11, 14, 25])))) for k in range(30)] + [(100, "zz, Yy!"), (101, None), (102, " .. "), (None, "a b"), (5, "Éa 12-x"), (103, "zz yy"), (104, "one two three four five six seven eight nine ten eleven")]
    docs = [(k, " ".join(word() for _ in range(rnd.randint(0, 40)))) for k in range(60)]
    for k in range(20):
        t = rnd.choice(items)[1] or ""
        docs.append((100 + k, f"{word()} zz-yy {t.upper()} ÉA\x0012.X " + " ".join(word() for _ in range(5))))
    docs += [(900, None), (901, ""), (902, "One two three. four five six seven eight nine"), (903, "TWO three four five six seven eight nine ten eleven"), (None, "zz yy"), (904, "zz yy"), (904, "zz yy"), (905, "q " * 30000 + "zz yy")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, items string").repartition(4)
    got = s.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes)
    assert sorted([tuple(r)[:6] for r in got.collect()], key=str) == brute(docs, items)


def longest(text, items):
    """Length and first word of the longest match that holds a window, and the items that have it."""
    w, best = words_of(text), (0, None, set())
    for item, t in items:
        q = words_of(t)
        for i in range(max(1, len(q) - 9) if item is not None and q else 0):
            for p in range(len(w)):
                n = 0
                while i + n < len(q) and p + n < len(w) and q[i + n] == w[p + n]:
                    n += 1
                if n >= min(10, len(q)):
                    if (-n, p) < (-best[0], best[1] if best[1] is not None else 0):
                        best = (n, p, set())
                    if (n, p) == best[:2]:
                        best[2].add(str(item))
    return best


@pytest.mark.parametrize("block_bytes", [1 << 20, 250])
def test_longest_matches_against_brute_force(spark, block_bytes):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abc") for _ in range(40)) for _ in range(4)]
    cut = lambda n: (lambda t, a: " ".join(t.split()[a : a + n]))(rnd.choice(base), rnd.randint(0, 20))
    items = [(k, f"{cut(rnd.choice([4, 10, 13, 20]))} {rnd.choice('xyz')}{k} {cut(12)}" if k % 3 else cut(rnd.choice([3, 10, 25]))) for k in range(24)]
    items += [(50, "p q r s t u v w k l m1"), (51, "p q r s t u v w k l m2 n o")]  # the longer one must win
    docs = [(k, f"{cut(15)} {rnd.choice('xyz')} {cut(rnd.choice([9, 12, 30]))} {rnd.choice(items)[1]}") for k in range(40)]
    docs += [(100, "zero p q r s t u v w k l m2 n o"), (101, docs[3][1]), (101, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = s.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        n, p, named = longest(texts[r.doc_id], items)
        assert (r.longest_match, r.longest_start) == (n, p)
        assert r.longest_item in named if n else r.longest_item is None
    assert next(r for r in got if r.doc_id == 100).longest_match == 13


def test_match_is_followed_to_its_end(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{k}" for k in range(3, 27)) + " y")], "doc_id long, text string")
    assert s.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()["longest_match"] == 24


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert s.contamination(docs, items).first()["contaminated"] is False
    assert s.contamination(docs.limit(0), items).count() == 0
