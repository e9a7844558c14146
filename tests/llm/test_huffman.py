import zlib

import numpy as np
import pytest

from gaugeworks.llm import huffman as h
from gaugeworks.llm.word_tokens import word_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The Cat's  sat,\n\ton the mat.", "", None, "x" * 5000, "Élań ÑANDÚ ß     \x1c <|endoftext|>a", "12.5% (don't) — 日本語 😀", "the cat", "the cat"]


def test_words_give_the_ids_of_whole_texts():
    import random

    import pyarrow as pa

    rnd, e = random.Random(3), word_encoder(FILE)
    signs = [chr(c) for c in range(1, 600)] + ["́", "Σ", "İ", "<|startoftext|>", " ", " ", "\n", "'re", "'S"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(2000)]
    ids, counts = e.encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_code_lengths_are_optimal_or_limited():
    import heapq
    from itertools import count

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        c = rng.integers(1, 1000, n)
        lengths, tick = h.code_lengths(c), count()
        heap = [(int(x), next(tick), 0) for x in c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], next(tick), 0))
        assert n < 2 or int((lengths * c).sum()) == cost
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = h.code_lengths(np.array(fib), 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) <= 1


@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49000)
    lengths = h.code_lengths(np.bincount(ids))
    codes = h.canonical_codes(lengths)
    sizes = np.array([n - n // 3, 0, n // 3])
    out, got = h.unpack_shard(h.pack_shard(ids, sizes, lengths, codes), h.decode_table(lengths, codes))
    assert out.tolist() == ids.tolist() and got.tolist() == sizes.tolist()


def test_files_against_whole_text_encoding(spark, monkeypatch):
    rows = [(5 * k if k != 2 else None, t, "extra") for k, t in enumerate(TEXTS)] + [(0, "again", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = h.huffman_roundtrip(docs, FILE, 2).toPandas()
    t = word_encoder(FILE).tokenizer
    want = {}
    for doc, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen = {}
    for r in got.sort_values("start").itertuples():
        doc = None if r.doc_id != r.doc_id else int(r.doc_id)
        seen.setdefault(doc, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    got = got.sort_values("start")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    assert got.doc_id.fillna(-1).is_monotonic_increasing


def test_no_rows(spark):
    assert h.huffman_roundtrip(spark.createDataFrame([], "doc_id long, text string"), FILE, 2).count() == 0
