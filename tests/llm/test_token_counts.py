import pytest

from gaugeworks.llm.token_counts import section_tokens
from gaugeworks.llm.word_tokens import word_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The incomprehensible cat's  mat,\n\nÉlańske ÑANDÚ straße 日本語😀 x", "", "one", "a" * 300 + " antidisestablishmentarianism " * 20, " \n lead"]


def brute(text, sections, rule):
    spans = word_encoder(FILE).tokenizer.encode(text, add_special_tokens=False).offsets
    counts, crossing = [0.0] * len(sections), [0] * len(sections)
    for a, b in spans:
        part = [(k, min(b, e) - max(a, s)) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s)]
        if not part:
            continue
        if len(part) > 1 or a < sections[part[0][0]][0] or b > sections[part[0][0]][1]:
            for k, _ in part:
                crossing[k] += 1
        if rule == "proportional":
            for k, n in part:
                counts[k] += n / (b - a)
        else:
            k = {"majority": lambda: max(part, key=lambda x: (x[1], -x[0]))[0], "first": lambda: part[0][0], "last": lambda: part[-1][0]}[rule]()
            counts[k] += 1
    return [round(c, 9) for c in counts], crossing


def cut(text, width):
    out, at = [], 0
    for line in text.split("\n"):
        out += [(at + k, min(at + k + width, at + len(line))) for k in range(0, max(1, len(line)), width)]
        at += len(line) + 1
    return out


@pytest.mark.parametrize("rule", ["majority", "first", "last", "proportional"])
def test_passages(spark, rule):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "the cat", "x")]
    got = section_tokens(spark.createDataFrame(rows, "doc_id long, text string, section string").repartition(2), FILE, 7, rule).collect()
    assert not [r for r in got if r.doc_id == 99] and [r.n_tokens for r in got if r.doc_id is None] == [2]
    for k, t in enumerate(TEXTS):
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.section)
        sections = cut(t, 7)
        assert [(r.start, r.end) for r in mine] == sections
        counts, crossing = brute(t, sections, rule)
        assert ([round(float(r.n_tokens), 9) for r in mine], [r.n_crossing for r in mine]) == (counts, crossing)


def test_given_sections(spark):
    sections = [(0, 5), (5, 9), (20, 26), (40, 400)]
    df = spark.createDataFrame([(1, TEXTS[0], sections), (2, TEXTS[3], []), (3, "a", None)], "doc_id long, text string, fields array<struct<a:long,b:long>>")
    got = sorted(section_tokens(df, FILE, sections="fields").collect())
    counts, crossing = brute(TEXTS[0], sections, "majority")
    assert [(r.doc_id, r.n_tokens, r.n_crossing) for r in got] == [(1, c, x) for c, x in zip(counts, crossing)]


def test_no_rows(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


@pytest.mark.parametrize("rule", ["majority", "first", "last", "proportional"])
def test_empty_sections_take_nothing(spark, rule):
    sections = [(0, 0), (0, 5), (5, 5), (5, 8), (8, 8), (9, 40)]
    text = TEXTS[0] * 40
    df = spark.createDataFrame([(1, text, sections), (1, text, sections), (2, text, [(3, 3)])], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    got = section_tokens(df, FILE, rule=rule, sections="parts").collect()
    counts, crossing = brute(text, sections, rule)
    for k in range(6):
        assert {(round(float(r.n_tokens), 9), r.n_crossing) for r in got if (r.doc_id, r.section) == (1, k)} == {(counts[k], crossing[k])}
    assert len(got) == 13 and [(r.n_tokens, r.n_crossing) for r in got if r.doc_id == 2] == [(0, 0)]


@pytest.mark.parametrize("sections", [[(0, 5), (4, 6)], [(5, 6), (0, 2)], [(3, 1)]])
def test_unordered_sections_are_refused(spark, sections):
    df = spark.createDataFrame([(1, "some text", sections)], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    with pytest.raises(Exception, match="ascending"):
        section_tokens(df, FILE, sections="parts").collect()
