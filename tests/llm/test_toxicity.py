import random
import zlib

import numpy as np
import pyarrow as pa

from gaugeworks.llm import toxicity as t


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in t.fresh(rng, np.zeros(t.BUCKETS), np.zeros(t.BUCKETS)).items()}
    coded, counts = t.words_of(pa.array(["the mean old dog ran off", "a b"]))
    feats = t.word_features(coded.dictionary)
    codes = coded.indices.to_numpy().astype(np.int64)
    index = np.zeros((6, 2), np.int64)
    index[:, 0], index[:2, 1] = codes[:6], codes[6:]
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0], [1, 0], [1, 0]], float)
    target, weight = np.array([1, 0]), np.array([1.0, 0.5])

    def loss():
        x = t.forward(p, t.embedded(p, *feats), index, mask)[0]
        q = t.sigmoid(x.astype(np.float64))
        return -(weight * (target * np.log(q) + (1 - target) * np.log(1 - q))).sum() / weight.sum()

    g = t.gradients(p, feats, index, mask, target, weight)
    for key in p:
        places = np.argwhere(np.abs(g[key]) > 1e-4)
        for place in places[rng.permutation(len(places))[:4]]:
            at = tuple(place)
            old = p[key][at]
            p[key][at] = old + 1e-2
            up = loss()
            p[key][at] = old - 1e-2
            down = loss()
            p[key][at] = old
            assert abs((up - down) / 2e-2 - g[key][at]) < 2e-3 + 0.02 * abs(g[key][at]), key


def test_windows_cover_all_words():
    start, length, many = t.windows_of(np.array([0, 1, 24, 25, 60]))
    assert many.tolist() == [1, 1, 1, 2, 4]
    first = np.concatenate(([0], np.cumsum(many)))
    for k, n in enumerate([0, 1, 24, 25, 60]):
        base = sum([0, 1, 24, 25, 60][:k])
        covered = {x - base for a, b in zip(start[first[k] : first[k + 1]], length[first[k] : first[k + 1]]) for x in range(a, a + b)}
        assert covered == set(range(n))


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice(["the", "on", "er", "at", "sh", "ea"]) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    bad = ["idiot", "moron", "trash", "scum"]
    rows, labels = [], []
    for k in range(600):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        toxic = int(k % 4 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, toxic))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "the on " * 20000, "en"), (None, "idiot", "en"), (1003, "?! ...", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    got = t.toxicity(docs, spark.createDataFrame(labels + [(1001, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(by[k].held_out == (k in set(held)) for k in range(600)) and by[None].held_out is False
    assert np.mean([by[k].predicted == labels[k][1] for k in held]) > 0.9
    assert by[1000].score == by[1001].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.toxicity(docs, none).first()["score"] == 0 and t.toxicity(docs.limit(0), none).count() == 0


def test_words_do_not_depend_on_marks_or_neighbours():
    texts = ["Idiot!", "'idiot' (Idiot) *idiot*", "don't", "\u201cIDIOT\u201d caf\u00e9, 3.5", "a <|end|> b", "", "it\u2019s \u2018mean\u2019", "idiot'", "x"]
    want = [["idiot"], ["idiot"] * 3, ["don't"], ["idiot", "caf\u00e9", "3.5"], ["a", "end", "b"], [], ["it\u2019s", "mean"], ["idiot"], ["x"]]

    def words(part):
        coded, counts = t.words_of(pa.array(part, pa.string()))
        flat = coded.to_pylist()
        return [flat[sum(counts[:k]) : sum(counts[: k + 1])] for k in range(len(counts))]

    assert words(texts) == want and [words([x])[0] for x in texts] == want
    assert words([]) == []


def test_scores_are_those_of_the_worst_window(spark):
    """Each window by itself, one after another, against the blocks of the operator; repeated rows alike."""
    import numpy as np
    import pyarrow as pa

    from gaugeworks.llm import toxicity as t

    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(30)] + ["vile", "rotten"]
    docs = [(k, " ".join(rng.choice(words[:30], int(rng.integers(0, 90)))) + (" vile rotten" if k % 3 == 0 else "")) for k in range(60)] + [(3, "same row"), (3, "same row"), (99, None)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, round(r.score, 5), r.n_windows) for r in t.toxicity(df, labels).collect()))
    p = t.train(*t.training_rows(df, labels))
    want = []
    for doc, text in docs:
        coded, counts = t.words_of(pa.array([text or ""]))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = t.embedded(p, *t.word_features(coded.dictionary)) if len(codes) else np.zeros((1, 2 * t.WIDTH), np.float32)
        n = len(codes)
        starts = [0] if n <= t.WINDOW else [k * t.STRIDE for k in range(1 + -(-(n - t.WINDOW) // t.STRIDE))]
        logits = []
        for s in starts:
            mine = codes[s : s + t.WINDOW]
            index = np.zeros((t.WINDOW, 1), np.int64)
            index[: len(mine), 0] = mine
            logits.append(t.forward(p, vectors, index, (np.arange(t.WINDOW)[:, None] < len(mine)).astype(np.float32))[0][0])
        want.append((doc, round(float(t.sigmoid(np.float64(max(logits)))), 5), len(starts)))
    assert [x[::2] for x in got] == [x[::2] for x in sorted(want)]
    assert np.allclose([x[1] for x in got], [x[1] for x in sorted(want)], atol=2e-5)


def test_repeated_rows_are_learned_from_once(spark):
    docs = [(k, f"word{k % 5} fine" if k % 2 else f"vile word{k % 5}") for k in range(40)]
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(40)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    once = t.training_rows(spark.createDataFrame(docs, schema), labels)
    again = t.training_rows(spark.createDataFrame(docs * 20 + [(k, "zz " + x) for k, x in docs], schema), labels)
    assert once[0] == again[0] and (once[1] == again[1]).all() and once[2] == again[2]
