import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import lang_by_script, norm_text
from gaugeworks.operators import audit, items, text

NAMES = ["red green blue", "red green blue!", "green blue red", "small  Red box", "", None, "қазақ тілі", "русский язык", "red", "red green blue white"]


def test_normal_form_and_script(spark):
    df = spark.createDataFrame([("  Élan—VITAL_1?! ",), ("Ёлка, 5",), (None,), ("қаз",), ("123",)], "t string")
    assert [r[0] for r in df.select(norm_text(F.col("t"))).collect()] == ["élan vital_1", "ёлка 5", "", "қаз", "123"]
    assert [r[0] for r in df.select(lang_by_script(F.col("t"))).collect()] == ["en", "ru", "en", "kz", "en"]


def grams_of(name):
    w = "".join(c if c.isalnum() or c == "_" else " " for c in (name or "").lower()).split()
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def vectors():
    rows = {k: grams_of(n) for k, n in enumerate(NAMES)}
    df = {}
    for g in rows.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1
    out = {}
    for k, g in rows.items():
        v = {x: (1 + math.log(g.count(x))) * (math.log((1 + len(NAMES)) / (1 + df[x])) + 1) for x in set(g)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        out[k] = {x: w / norm for x, w in v.items()}
    return out


def test_tfidf_and_pairs_against_plain_sums(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string").repartition(3)
    v = text.tfidf(df, "id", text.word_grams(F.col("name")))
    want = vectors()
    got = {(r.id, r.gram): r.weight for r in v.collect()}
    assert got == pytest.approx({(k, g): w for k, row in want.items() for g, w in row.items()})
    for threshold in (0.5, 0.8):
        pairs = {(r.i, r.j): r.cosine for r in text.similar_pairs(v, "id", threshold).collect()}
        plain = {(i, j): sum(w * want[j].get(g, 0) for g, w in want[i].items()) for i in want for j in want if i < j}
        assert pairs == pytest.approx({p: c for p, c in plain.items() if c >= threshold})


def test_char_grams(spark):
    got = spark.createDataFrame([("ab C",), (None,)], "t string").select(text.char_grams(F.col("t"), 3, 4)).collect()
    assert sorted(got[0][0]) == sorted([" ab", "ab ", " ab ", " c "]) and got[1][0] == []


def test_groups_empty_forms_and_links(spark):
    df = spark.createDataFrame([(1, "", None), (2, "?!", None), (3, None, None), (4, "A b", None), (5, "a  B", None), (6, "z", 4), (7, "y", 99)], "id long, text string, main_question_id long")
    assert {r.id: r.group for r in items.item_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_release_maps_links_and_drops_columns(spark):
    df = spark.createDataFrame([(10, None, "secret", 1), (20, 10, "secret", 2), (30, 99, "secret", 3)], "id long, link long, text string, v int")
    out, mapping = audit.release(df, "id", ["link"], ["v"])
    m = {r.old_id: r.new_id for r in mapping.collect()}
    assert sorted(m.values()) == [1, 2, 3] and out.columns == ["id", "link", "v"]
    assert {(r.id, r.link, r.v) for r in out.collect()} == {(m[10], None, 1), (m[20], m[10], 2), (m[30], None, 3)}


def test_runs_pivot_seeds_and_checksums(spark, tmp_path):
    for seed, pred in ((1, 0.5), (2, 0.7)):
        (tmp_path / f"bert__stem__s{seed}__test.csv").write_text(f"id,pred\n7,{pred}\n")
    runs = audit.read_runs(spark, f"{tmp_path}/*.csv").withColumn("pred", F.col("pred").cast("double"))
    assert sorted((r.model, r.input, r.seed, r.split) for r in runs.collect()) == [("bert", "stem", 1, "test"), ("bert", "stem", 2, "test")]
    assert audit.seed_summary(runs, "pred").first()["mean"] == pytest.approx(0.6)
    assert audit.pivot_predictions(runs.where("seed = 1")).first()["bert"] == 0.5
    sums = {r.file: r.sha256 for r in audit.checksums(spark, str(tmp_path)).collect()}
    assert sums["bert__stem__s1__test.csv"] == hashlib.sha256(b"id,pred\n7,0.5\n").hexdigest()


def test_catalog_ignores_bad_dates(spark):
    df = spark.createDataFrame([("2024-01-02",), ("not a date",), (None,)], "created_at string")
    r = audit.catalog({"a": df, "b": df.limit(0)}, limit=3).orderBy("table").collect()
    assert (r[0].rows, r[0].truncated, str(r[0]["first"])[:10], r[1].rows, r[1].truncated) == (3, True, "2024-01-02", 0, False)
    assert audit.catalog_summary(audit.catalog({"a": df})).first()["tables"] == 1


def test_comparison_and_leave_one_out(spark):
    ref = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    new = spark.createDataFrame([("a", 1.0 + 1e-9), ("c", 2.0)], "k string, value double")
    assert {r.k: r.ok for r in audit.compare_metrics(ref, new, ["k"]).collect()} == {"a": True, "b": False, "c": False}
    rows = [(0, 1.0, 2.0), (1, 2.0, 1.0), (2, 4.0, 7.0), (3, 5.0, 5.0)]
    import numpy as np

    got = {r.k: r.r for r in audit.leave_one_out(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y").collect()}
    for k in range(4):
        rest = np.array([r[1:] for r in rows if r[0] != k])
        assert got[k] == pytest.approx(np.corrcoef(rest.T)[0, 1])


def test_pruned_nearest_is_the_whole_search(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary, frequent = [f"g{k}" for k in range(400)], [f"f{k}" for k in range(6)]
    rows = []
    for k in range(120):
        base = rng.sample(vocabulary, 5) if k % 4 else rows[rng.randrange(len(rows))][1][:4] if rows else []
        rows.append((k, [*base, *rng.sample(frequent, 3)]))
    rows.append((500, list(rows[7][1])))
    vectors = text.tfidf(spark.createDataFrame(rows, "id long, grams array<string>"), "id", F.col("grams")).cache()
    src, dst = vectors.where("id < 60"), vectors.where("id >= 60")
    made = []
    write = text.written
    monkeypatch.setattr(text, "written", lambda df, name, *rest: (made.append((name, out := write(df, name, *rest))), out)[1])
    got = {(r["id"], r["nearest"], r["cosine"]) for r in text.nearest(src, dst, "id", levels=(4, 30)).collect()}
    table = {}
    for r in vectors.collect():
        table.setdefault(r["id"], {})[r["gram"]] = r["weight"]
    want = set()
    for i in range(60):
        found = [(-round(sum(w * table[j].get(g, 0) for g, w in table[i].items()), 9), j) for j in table if j >= 60 and set(table[i]) & set(table[j])]
        if found:
            c, j = min(found)
            want.add((i, j, -c))
    assert {(i, j) for i, j, _ in got} == {(i, j) for i, j, _ in want} and sorted(c for _, _, c in got) == pytest.approx(sorted(c for _, _, c in want))
    candidates = sum(out[0].count() for name, out in made if name == "nearest-candidates")
    assert candidates < sum(bool(set(table[i]) & set(table[j])) for i in range(60) for j in table if j >= 60)


COPIED = [(k, n) for k, n in enumerate(NAMES + [NAMES[0].upper(), NAMES[1] + "!", NAMES[0], "?!", None])]


@pytest.mark.parametrize("members", [1, 2, 4096])
def test_copies_stand_for_one_vector(spark, monkeypatch, members):
    """Classes with copies give the weights and pairs of all rows, and only classes are joined on grams."""
    monkeypatch.setattr(text, "MEMBERS", members)
    df = spark.createDataFrame(COPIED, "id long, name string").repartition(3)
    plain = text.tfidf(df, "id", text.word_grams(F.col("name")), min_df=2)
    classes = text.text_classes(df, "id", "name").cache()
    assert classes.count() < df.count()
    v = text.tfidf(classes, "id", text.word_grams(F.col("name")), min_df=2, copies="copies")
    want = {(r.id, r.gram): r.weight for r in plain.collect()}
    got = {(r.id, r.gram): r.weight for r in v.collect()}
    assert got == pytest.approx({k: want[k] for k in got}) and len({k for k, _ in got}) < len({k for k, _ in want})
    known = classes.join(v.select("id"), "id", "left_semi")
    pairs = text.similar_pairs(v, "id", 0.5)
    whole = [(r.i, r.j, round(r.cosine, 9)) for r in text.similar_pairs(plain, "id", 0.5).collect()]
    rows = df.select(text.norm_text(F.col("name")).alias("form"), "id")
    assert sorted((r.i, r.j, round(r.cosine, 9)) for r in text.expanded_pairs(known, rows, pairs).collect()) == sorted(whole)
    each = text.near_duplicate_counts(spark.createDataFrame(whole, "i long, j long, cosine double"), (0.5, 0.9)).first()
    assert text.near_duplicate_classes(known, pairs, (0.5, 0.9)).first() == each


def test_copies_of_one_text_are_many_tasks(spark, monkeypatch):
    """Pairs of one class are dealt by their number, though its members are few bytes; Spark holds the pairs of two lots at once."""
    assert text.MEMBERS**2 <= 1 << 18
    monkeypatch.setattr(text, "MEMBERS", 16)
    classes = spark.createDataFrame([("a", 0)], "form string, id long")
    made = text.expanded_pairs(classes, spark.range(256).select(F.lit("a").alias("form"), "id"), spark.createDataFrame([], "i long, j long, cosine double"))
    tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 256 * 255 // 2 == made.distinct().count() and max(tasks) < sum(tasks) / 2


def test_words_are_made_once_for_all_grams(spark):
    """The words of a text are split once, not once for each gram; a row's grams are as before."""
    df = spark.createDataFrame([(n,) for n in NAMES], "t string")
    plan = df.select(text.word_grams(F.col("t"), 1, 3).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1
    got = [r[0] for r in df.select(text.word_grams(F.col("t"))).collect()]
    assert got == [grams_of(n) for n in NAMES]
