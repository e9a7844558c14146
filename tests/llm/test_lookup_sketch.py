import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lookup_sketch as s


def texts(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg\u00e9\U0001f600") for _ in range(rnd.randint(1, 9)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(0, 40))) + rnd.choice([".", "", "!", "..."])
    return ["\n".join(line() for _ in range(rnd.choice([0, 1, 2, 5, 20, 60]))) for _ in range(n)]


def own_digests(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, text string").select("k", s.digests(F.col("text")).alias("d")).collect()
    return {r["k"]: set(r["d"]) for r in rows}


def test_peeling_names_every_difference(spark):
    rnd = random.Random(1)
    key = lambda: rnd.randint(-(1 << 63), (1 << 63) - 1)
    pairs = []
    for k in range(60):
        both = [key() for _ in range(rnd.choice([0, 1, 30, 500]))]
        a, b = [key() for _ in range(rnd.choice([0, 1, 4, 40, 900]))], [key() for _ in range(rnd.choice([0, 2, 15, 300]))]
        pairs.append((k % 5, k, both + a, both[::-1] + b, sorted(a), sorted(b)))
    sets = s.bucketed(spark.createDataFrame([p[:4] for p in pairs], "block int, id int, a array<long>, b array<long>"), "block", "sets")
    named = {r["id"]: (r["gone"], r["came"]) for r in s.differences(sets, ["block", "id"], "block", named=True).collect()}
    counts = {r["id"]: (r["gone"], r["came"]) for r in s.differences(sets, ["block", "id"], "block").collect()}
    for _, k, _, _, gone, came in pairs:
        assert named.get(k, ([], [])) == (gone, came)
        assert counts.get(k, (0, 0)) == (len(gone), len(came))


def test_printed_sketch_is_the_cells_of_the_set(spark):
    some = texts(30)
    sets = own_digests(spark, some)
    got = spark.createDataFrame(list(enumerate(some)), "k int, text string").select("k", s.printed(s.sketch(s.digests(F.col("text")))).alias("f")).collect()
    marks = {r["d"]: r["m"] for r in spark.createDataFrame([(d,) for d in set().union(*sets.values())], "d long").select("d", s.check_value(F.col("d")).alias("m")).collect()}
    for r in got:
        cells = [[0, 0, 0] for _ in range(s.TABLES * s.SLOTS)]
        for d in sets[r["k"]]:
            u = d & ((1 << 64) - 1)
            for t in range(s.TABLES):
                c = cells[t * s.SLOTS + ((u >> (61 - s.MOST_BITS * t)) & 7)]
                c[0], c[1], c[2] = c[0] + 1, c[1] ^ u, c[2] ^ marks[d]
        assert base64.b64decode(r["f"]) == b"".join(n.to_bytes(2, "big") + key.to_bytes(8, "big") + mark.to_bytes(4, "big") for n, key, mark in cells)


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_documents_against_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(s, "BLOCK_ROWS", block_rows)
    some = texts(40) + ["", None, "x", "same.\n" * 50, "one two " * 30000]
    docs = [(7 * k % 45 if k % 9 else k, t) for k, t in enumerate(some)]
    docs = [(2 * k, t) for k, t in enumerate(t for _, t in docs)] + [(2 * 4, some[4]), (2 * 4, some[4]), (None, "last one.\nof all")]
    df = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in docs], "doc_id long, text string, row string, block int, next string").repartition(4)
    got = sorted(s.fingerprints(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    clear = [t or "" for _, t in order]
    edits = []
    for k, t in enumerate(clear):
        cut = len(t) // 4
        edits.append(t[: len(t) - cut] + clear[(k + 1) % len(clear)][:cut])
    own, new = own_digests(spark, clear), own_digests(spark, edits)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(docs)
    for k, r in enumerate(got):
        assert (r["doc_id"], r["n_chars"]) == (order[k][0], len(clear[k]))
        assert r["edited_sha256"] == hashlib.sha256(edits[k].encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(own[k], new[k])) and r["near_next"] == pytest.approx(like(own[k], own[(k + 1) % len(clear)]))
        assert (r["n_paragraphs"], r["n_gone"], r["n_came"]) == (len(own[k]), len(own[k] - new[k]), len(new[k] - own[k]))
    prints = {}
    for k, r in enumerate(got):
        assert prints.setdefault(clear[k], r["fingerprint"]) == r["fingerprint"]


def test_small_tables(spark):
    shape = "doc_id long, text string"
    assert s.fingerprints(spark.createDataFrame([], shape)).count() == 0
    one = s.fingerprints(spark.createDataFrame([(1, "abcdefgh")], shape)).first()
    assert (one["n_chars"], one["edited_sha256"], one["near_next"]) == (8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)


def test_no_python_and_one_shuffle_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(texts(30))), "doc_id long, text string")
    plan = s.neighbours(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow") and plan.count("Exchange hashpartitioning") == 1
    cells = s.peeled(s.subtracted(s.bucketed(spark.createDataFrame([(1, 1, [1], [2])], "block int, id int, a array<long>, b array<long>"), "block", "sets"), ["block", "id"]), ["block", "id"])
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
