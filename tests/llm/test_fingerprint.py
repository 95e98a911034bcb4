import hashlib
import re

import numpy as np

from sheetwise.llm.fingerprint import edited_fingerprints, fingerprints


def sets(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        j = lambda a, b: 1.0 if not a and not b else len(a & b) / max(1, len(a | b))
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), j(sets(t), sets(e)), j(sets(t), sets(nxt)), len(sets(t)))
    return out


def test_edits_and_likeness(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = expected(docs)
    for parts in (1, 7):
        got = {r.doc_id: r for r in edited_fingerprints(docs, parts=parts).collect()}
        assert got.keys() == want.keys()
        assert all((got[d].n_chars, got[d].edited_sha256) == w[:2] for d, w in want.items())
        large = [d for d, w in want.items() if w[4] >= 200]
        errors = np.array([(got[d].near_edited - want[d][2], got[d].near_next - want[d][3]) for d in large])
        assert np.abs(errors).max() < 0.15 and np.abs(errors.mean(axis=0)).max() < 0.01


def test_equal_texts_have_equal_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    by_text = {}
    for r in fingerprints(docs).collect():
        by_text.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) < docs.count()


def test_odd_inputs(spark, odd_documents, no_documents):
    out = edited_fingerprints(odd_documents, parts=3)
    assert out.count() == 11 and out.filter("near_edited < 0 or near_edited > 1 or near_next is null").count() == 0
    assert edited_fingerprints(no_documents, parts=3).count() == 0
    one = edited_fingerprints(odd_documents.filter("doc_id = 7"), parts=3).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(odd_documents.withColumnRenamed("lang", "fingerprint")).columns.count("fingerprint") == 1
