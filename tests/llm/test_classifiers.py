import zlib

import numpy as np

from foliant.llm import quality, toxicity

BAD = ["grumblefoot", "snarkwit", "dunderhead", "muckraker"]


def corpus(n=400, seed=5):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{'aeiou'[rng.integers(5)]}{'bcdfgh'[rng.integers(6)]}{'klmnp'[rng.integers(5)]}er" for _ in range(60)]
        toxic, poor = i % 5 == 0, i % 3 == 0
        if toxic:
            for k in rng.integers(0, 60, 8):
                words[k] = BAD[rng.integers(4)]
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "some text", "x"), (0, docs[0][1], "x")]
    return docs, labels + [(None, 1, 1), (3, None, None)]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id int, text string, score string"), spark.createDataFrame(labels, "doc_id int, quality int, toxic int"), docs, labels


def accuracy(rows, truth):
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth])


def check(rows, docs):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in docs)
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)


def test_toxicity(spark):
    docs, labels, rows, known = frames(spark)
    got = toxicity.classify(docs, labels).collect()
    check(got, rows)
    assert accuracy(got, {i: t for i, _, t in known if t is not None}) > 0.95
    kept = toxicity.score(docs, toxicity.train(docs, labels), keep=True)
    assert kept.columns == ["doc_id", "text", "score", "predicted"]


def test_quality(spark):
    docs, labels, rows, known = frames(spark)
    got = quality.classify(docs, labels).collect()
    check(got, rows)
    assert accuracy(got, {i: q for i, q, _ in known if q is not None}) > 0.95


def test_no_labels_and_no_documents(spark):
    docs, labels, *_ = frames(spark)
    for op in (toxicity, quality):
        assert {r.score <= 0.5 for r in op.classify(docs, labels.limit(0)).collect()} == {True}
        assert op.classify(docs.limit(0), labels).count() == 0


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (0, 1) in model.pairs


def test_commonest_word_counts_all_words():
    at = quality.FEATURES.index("commonest_word")
    late = [f"w{k}" for k in range(64)] + ["same"] * 30
    ends = " ".join(["same\nsame same"] * 2000 + [f"w{k}" for k in range(3000)])
    spaced = [f"w{k}" if k % 2 == 0 else "same" for k in range(256)]
    got = quality.features([" ".join(late), ends, " ".join(spaced), "a b a", None])[:, at]
    assert np.allclose(got, [30 / 94, 6000 / 9000, 128 / 256, 2 / 3, 0])
