import random

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The quick  brown fox\njumps over", "", None, " ", "   lead and trail  ", "日本語 ①\x00 é ▁x", "aaaa" * 50, "tab\tand\r\nline\n\n", "x" * 3000, "(){\r\n;};", "<s> <0x41>"]


def random_texts(n=1500):
    rnd = random.Random(4)
    signs = [chr(c) for c in range(1, 500)] + list("   \n\netaoinshr") * 12 + ["the", "ing", "tion", "▁", "日", "😀", "ﬁ"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_ids_of_the_library():
    model = pieces.piece_model(FILE)
    assert model.merges
    texts = [t or "" for t in TEXTS] + random_texts()
    for a in range(0, len(texts), 400):
        some = texts[a : a + 400]
        ids, counts = model.encode(pa.array(some))
        at = np.concatenate(([0], np.cumsum(counts)))
        for k, t in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == model.library.encode(t), repr(t)
        back = model.decode(ids, counts).to_pylist()
        assert back == [t.replace("▁", " ").encode() for t in some]


def test_unigram_models_take_the_best_sum():
    model = pieces.PieceModel(FILE)
    model.merges = False
    rnd = random.Random(1)
    model.score = [-rnd.random() * 10 - 1 for _ in model.score]
    for word in ["▁station", "▁therein", "onwards"]:
        best = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + model.score[model.id[word[s:end]]], best[s][1] + [model.id[word[s:end]]]) for s in range(end) if s in best and word[s:end] in model.id]
            best[end] = max(ways)
        assert model._run(word) == best[len(word)][1]


def test_rows(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "the", 1), (0, TEXTS[0], 1)]
    got = pieces.piece_ids(spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3), FILE, with_ids=True).collect()
    library = pieces.piece_model(FILE).library
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(k), library.encode(t or "")) for k, t, _ in rows)
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got)
    assert pieces.piece_ids(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
