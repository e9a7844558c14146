import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gaugeworks.llm import language as g

SYLLABLES = {"en": "the ing tion and ou er".split(), "de": "sch ung der ein ich ü".split(), "fr": "eau oi que é ment les".split()}


def made(n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = list(SYLLABLES)[k % 3]
        rows.append((k, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(40)), lang))
    return rows


def test_trigrams_stay_inside_texts():
    codes, n = g.trigrams(pa.array(["abc", "", "ab", "Abcd", "x"]))
    alone, _ = g.trigrams(pa.array(["abcd"]))
    assert n.tolist() == [1, 0, 0, 2, 0] and codes.tolist() == [alone[0], *alone]


def test_against_likelihoods_by_hand(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string").repartition(4)
    got = {r.doc_id: r for r in g.identified(docs, ["doc_id"]).collect()}
    assert all(got[k].language == lang and got[k].kept and got[k].confidence > 0.9 for k, _, lang in rows)
    languages, table, share = g.fitted(docs)
    for k, text, _ in rows[:5]:
        codes, _ = g.trigrams(pa.array([text]))
        log = table[codes].sum(axis=0) * min(1, g.TRUST / len(codes)) + np.log(share)
        assert got[k].text_language == languages[int(np.argmax(log))]


def test_rejects_and_edges(spark):
    rows = made() + [(900, None, "en"), (901, "", None), (902, "\x01\x02\x03ЖЖЖ" * 30, None), (903, "the", None), (None, "sch ung der", "de"), (904, "the ing tion " * 9000, "en"), (904, "the ing tion " * 9000, "en")]
    got = g.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[900].kept and not by[901].kept and not by[902].kept and by[902].language == "und" and by[904].language == "en" and by[None].language == "de"
    none = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, lang string")
    assert not g.identified(none, ["doc_id"]).first()["kept"]
    assert g.identified(none.limit(0), ["doc_id"]).count() == 0


def test_host_suffix_and_markup_decide_short_texts(spark):
    rows = [(k, t, lang, f"http://www.site{k % 4}.{lang}/x", lang) for k, t, lang in made(240)]
    rows += [(1000, "xyz", None, "http://new.site1.fr/", "fr"), (1001, "xyz", None, "http://www.site2.de/", "")]
    docs = spark.createDataFrame(rows, "page_id long, text string, lang string, url string, html_lang string")
    got = {r.page_id: r for r in g.identified(docs, ["page_id"], url=F.col("url"), markup=F.col("html_lang")).select("page_id", "confidence", "text_language", "language").collect()}
    fused = g.identified(docs, ["page_id"], url=F.col("url"), markup=F.col("html_lang"), trained=g.fitted(docs.select(F.col("page_id").alias("doc_id"), "text", "lang")))
    assert got[1000].confidence > 0.8 and got[1001].confidence > 0.6
    assert fused.count() == len(rows)



def fused_by_hand(rows, trained, skip=None, weight=g.WEIGHT):
    """(best language, its probability, best of the text) of (text, host, markup), from the definitions."""
    from collections import Counter

    languages, table, share = trained
    text_log = []
    for text, _, _ in rows:
        codes, _ = g.trigrams(pa.array([text or ""]))
        text_log.append(table[codes].astype(float).sum(axis=0) * min(1, g.TRUST / max(1, len(codes))) + np.log(share))
    guess = [int(np.argmax(x)) for x in text_log]
    host = [h or "" for _, h, _ in rows]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h
    suffix = [h.rsplit(".", 1)[1] if "." in h else "" for h in host]
    markup = [m or "" for _, _, m in rows]
    n_host, n_domain = Counter(zip(host, guess)), Counter((domain(h), k) for h, k in zip(host, guess) if h)
    out = []
    for i, log in enumerate(text_log):
        log = log.copy()
        for k in range(len(languages)):
            if host[i] and skip != "host":
                d = (n_domain[domain(host[i]), k] + weight * share[k]) / (sum(n_domain[domain(host[i]), j] for j in range(len(languages))) + weight)
                log[k] += np.log((n_host[host[i], k] + weight * d) / (sum(n_host[host[i], j] for j in range(len(languages))) + weight)) - np.log(share[k])
            for name, values in (("suffix", suffix), ("markup", markup)):
                if values[i] and skip != name:
                    spread = values.count(values[i]) / sum(v != "" for v in values)
                    n = sum(v == values[i] and j == k for v, j in zip(values, guess))
                    t = sum(v != "" and j == k for v, j in zip(values, guess))
                    log[k] += np.log((n + weight * spread) / (t + weight)) - np.log(spread)
        p = np.exp(log - log.max())
        out.append((languages[int(np.argmax(log))], float(p.max() / p.sum()), languages[guess[i]]))
    return out


def test_fusion_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(t, rnd.choice([f"www.site{k % 4}.{lang}", f"site{k % 3}.{lang}", "src7", "", None]), rnd.choice([lang, lang, "en", "", None])) for k, t, lang in made(150)]
    rows += [("xy", "www.site1.fr", "fr"), ("the ", "site2.de", "de"), ("que ", "src7", None), ("ü", "new.site1.fr", "de"), (None, "site0.de", "de")] * 2
    docs = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, text string, host string, declared string, log string").repartition(3)
    trained = g.fitted(spark.createDataFrame(made(), "doc_id long, text string, lang string"))
    without = {x: fused_by_hand(rows, trained, x) for x in g.SOURCES}
    for hot in (g.HOT_ROWS, 20):  # the second joins src7 and others as hot values
        monkeypatch.setattr(g, "HOT_ROWS", hot)
        got = {r.doc_id: r for r in g.identified(docs, ["doc_id"], host=F.col("host"), markup=F.col("declared"), trained=trained).collect()}
        assert len(got) == len(rows)
        moved = 0
        for k, (best, sure, text_best) in enumerate(fused_by_hand(rows, trained)):
            r = got[k]
            assert abs(r.confidence - sure) < 1e-6 and r.text_language == text_best
            assert r.language == (best if r.kept else "und")
            moved += r.kept and best != text_best
            assert r.moved_by == ",".join(x for x in g.SOURCES if without[x][k][0] != best)
        assert moved


def test_ties_go_to_the_first_language(spark):
    rows = [(k, "abc", "b" if k % 2 else "a") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = g.identified(docs, ["doc_id"]).collect()
    assert {(r.language, round(r.confidence, 9)) for r in got} == {("a", 0.5)}


def test_address_parts(spark):
    df = spark.createDataFrame([("https://u:p@Www.A.de:80/x", '<html class=a lang="FR-fr">'), ("nothing", "no"), (None, None)], "u string, t string")
    assert [tuple(r) for r in df.select(g.host_of(F.col("u")), g.markup_of(F.col("t"))).collect()] == [("www.a.de", "fr"), ("", ""), (None, None)]


def test_rare_languages_are_learned(spark):
    rnd = random.Random(8)
    word = lambda lang: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3)))
    rows = [(k, " ".join(word(lang) for _ in range(20)), lang) for k, lang in enumerate(["en", "de"] * 6000 + ["fr"] * 12)]  # fr: 0.1 %
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    rare = docs.where("lang = 'fr'")
    trained = g.fitted(docs, max_rows=100)
    assert np.allclose(trained[1][:, trained[0].index("fr")], g.fitted(rare)[1][:, 0])  # all its rows are used
    got = g.identified(rare, ["doc_id"], trained=trained).collect()
    assert len(got) == 12 and all(r.language == "fr" for r in got)


def test_all_languages_have_a_column(spark):
    rows = [(k, f"text of {k % 70}", f"l{k % 70}") for k in range(70 * g.LEAST)]
    assert len(g.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0]) == 70
