import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def made():
    rnd = random.Random(11)
    lexicon = {"en": "the ing tion and ou er sh".split(), "de": "sch ung der ein ich ü be".split()}
    text = lambda lang, n: " ".join("".join(rnd.choice(lexicon[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(k, text("de" if k % 3 else "en", 120), "de" if k % 3 else "en", f"s{k % 5}", 0) for k in range(150)]
    item = text("en", 20)
    rows.append((200, rows[7][1], "de", "s1", 0))
    words = rows[8][1].split()
    words[60] = "changed"
    rows.append((201, " ".join(words), "de", "s1", 0))
    rows.append((202, f"{text('en', 30)} {item} {text('en', 30)}", "en", "s2", 0))
    rows.append((203, text("en", 50) + " mail a.b@mail.example now " + text("en", 50), "en", "s2", 0))
    rows += [(204, None, "en", "s2", 0), (205, "", None, None, None), (206, "\x01\x02ЖЖ" * 40, None, "s1", 0)]
    return rows, [(1, item)]


def test_stages(spark, tmp_path):
    from gaugeworks.llm.pieces import piece_model

    rows, items = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = [{204, 205, 206}, {200, 201}, {202}, set()]
    left = {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left -= gone[k]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "[EMAIL]" in texts[203] and all(texts[k] == rows[k][1] for k in range(150))
    import public_tokenizers

    library = piece_model(public_tokenizers.path("piece_bpe_32k.model")).library
    last = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in last} == {k: library.encode(t) for k, t in texts.items()} and all(r.decodes for r in last)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
