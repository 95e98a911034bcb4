import random
import zlib

import numpy as np
import pyarrow as pa

from sheetwise.llm._text import block
from sheetwise.llm.toxicity import best_cut, features, fit, score, train


def invented(seed, n=700):
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(10, 200))]
        bad = i % 3 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(["vilest", "rotter", "zorgix" + "".join(r.choice("abc") for _ in range(3))])
        texts.append(" ".join(w).capitalize() + ".")
        y.append(int(bad))
    return texts, y


def test_learns_words_and_stems():
    model = train(*invented(1), langs=["xx"] * 700)
    texts, y = invented(2)
    s = model.scores(block(pa.array(texts)))
    assert ((s >= 0.7) == np.array(y, bool)).mean() > 0.97 and 0.01 < model.thresholds["xx"] < 0.99


def test_whole_texts_count():
    model = train(*invented(1), langs=[None] * 700)
    long = "abc def " * 20_000
    s = model.scores(block(pa.array([long, long + "vilest", "vilest " + long, "", None])))
    assert s[0] < 0.7 < min(s[1], s[2]) and s[3] == s[4] < 0.7


def test_features_end_with_padding():
    rows, first = features(block(pa.array(["One two", "", "one"])))
    assert first.tolist() == [0, 4, 6, 9] and (rows[0] == rows[6]).all() and not rows[2:6].any()


def test_best_cut_is_in_the_widest_gap():
    assert best_cut(np.array([5.0, 4.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 2.5


def test_held_out_rows_teach_nothing(spark):
    texts, y = invented(3, 300)
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = [(i, v) for i, v in enumerate(y)]
    spoiled = [(i, 1 - v if i in out else v) for i, v in labels]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, spoiled))
    assert np.array_equal(a.table, b.table) and a.shift == b.shift
    got = {r.doc_id: r for r in score(docs, a).collect()}
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.9


def test_odd_inputs(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, None), (7, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    model = fit(odd_documents, labels)
    assert score(odd_documents.withColumnRenamed("source", "score"), model).count() == 11
    assert score(odd_documents, None).filter("score = 0 and predicted = 0").count() == 11
    assert fit(no_documents, labels) is None and score(no_documents, model).count() == 0
