import math
import random
import re
from collections import Counter

import pytest

from gaugeworks.llm.pieces import piece_model
from gaugeworks.llm.quality import quality

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    ids = piece_model(FILE).library.encode(text or "")
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) if ids else 0
    chars = sum(map(len, words))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)), (chars / max(1, len(ids)), bits / math.log2(max(2, len(ids))))


def test_figures_and_bands(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice(["the", "ing", "er", "on", "at", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(300)), "en") for k in range(150)]
    rows += [(200, None, "en"), (201, "", None), (202, "a b\na b\n\n \na b\r\na b", "de"), (203, "x y z x y z w", "en"), (204, "é#*\x1c ß<> \x0b|", None), (None, "one", "en"), (205, "the " * 20000, "en")]
    rows += [(300 + k, " ".join(rnd.choice(vocabulary) + "$$$" for _ in range(300)), "en") for k in range(5)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int").repartition(3), FILE).collect()}
    for doc, text, _ in rows:
        r = got[doc]
        base, method = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert (r.chars_per_token, r.token_entropy) == pytest.approx(method)
    assert all(got[k].kept for k in range(150)) and not any(got[300 + k].kept for k in range(5)) and not got[200].kept


def test_no_rows(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string, lang string"), FILE).count() == 0
