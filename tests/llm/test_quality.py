import itertools
import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import quality as Q


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 2, 6, 1]
    offsets = np.cumsum([0, *sizes])
    unary, trans = rng.normal(size=offsets[-1]), rng.normal(size=(2, 2))
    good, moves, z = Q.marginals(unary, offsets, trans)
    want_good, want_moves, want_z = np.zeros(len(unary)), np.zeros((2, 2)), 0.0
    for a, b in zip(offsets[:-1], offsets[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        logs = np.array([sum(unary[a + i] * y for i, y in enumerate(p)) + sum(trans[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        total = np.logaddexp.reduce(logs)
        want_z += total
        for p, w in zip(paths, np.exp(logs - total)):
            want_good[a:b] += w * np.array(p)
            for i in range(len(p) - 1):
                want_moves[p[i], p[i + 1]] += w
    assert np.allclose(good, want_good) and np.allclose(moves, want_moves) and np.isclose(z, want_z)


def test_features_of_slices():
    texts = ["One line.\nTwo!! lines 12 34", None, "", "x\n\n  \nABC | def", "ünï\ncödé,"] * 3
    whole = pa.array(texts)
    x, size, offsets = Q.line_features(whole)
    assert np.diff(offsets).tolist() == [2, 1, 1, 4, 2] * 3 and size[:2].tolist() == [9, 17]
    for a, n in ((0, 15), (3, 5), (14, 1), (6, 9)):
        part, _, at = Q.line_features(whole.slice(a, n))
        assert np.allclose(part, x[offsets[a] : offsets[a + n]]) and at[-1] == len(part)


def corpus(spark, n=600):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.6)
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            words = list(rng.choice(vocabulary, int(rng.integers(4, 20))))
            lines.append(" ".join(words).capitalize() + "." if y else " | ".join(w + "***" for w in words))
        docs.append((i, "\n".join(lines), "src"))
        labels.append((i, y, 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus(spark)
    docs += [(5, docs[5][1], "again"), (None, "A null id.", "x"), (9_000, None, "x"), (9_001, "", "x")]
    labels += [(7, 1 - labels[7][1], 0), (8_000, None, 0), (None, 1, 0)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = Q.classify(df, lab).collect()
    assert len(rows) == len(docs)
    truth = dict((i, y) for i, y, _ in labels[:600])
    right = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth and r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    # labels of the held-out fold change nothing
    flipped = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    again = Q.classify(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.classify(docs, none).collect()] == [0.5]
    assert Q.classify(docs.limit(0), none).collect() == []


def test_score_keeps_columns(spark):
    docs, labels = corpus(spark, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Q.score(df, model).columns == ["doc_id", "text", "source", "score"]
