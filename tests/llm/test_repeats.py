import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sheetwise.llm import repeats
from sheetwise.llm._text import block


def brute(docs, length, keep="none"):
    at = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            at[raw[p : p + length]].append((docs[i][0], p, i))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in docs]
    for places in at.values():
        places.sort()
        for k, (_, p, i) in enumerate(places):
            if len(places) > 1 and (keep == "none" or k):
                gone[i][p : p + length] = True
    out = {}
    for i, (d, t) in enumerate(docs):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        g = gone[i]
        out[d] = (len(raw), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()), hashlib.sha256(raw[~g].tobytes()).hexdigest())
    return out


def random_documents(seed, n=60, vocabulary=400):
    r = random.Random(seed)
    words = lambda k: " ".join(f"w{r.randrange(vocabulary)}é"[: r.randrange(2, 7)] for _ in range(k))
    shared = [words(r.randrange(20, 160)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [words(r.randrange(0, 120)) for _ in range(3)]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            cut = r.randrange(len(s) // 2)
            parts.insert(r.randrange(len(parts)), s[cut:] if r.random() < 0.5 else s)
        docs.append((i, " ".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, "ab" * 900), (n + 2, ""), (n + 3, None), (n + 4, words(30) * 3), (n + 5, "ab" * 300)]
    return docs


@pytest.mark.parametrize(("keep", "most"), [("none", 256), ("first", 256), ("none", 1), ("first", 1)])
def test_matches_brute_force(spark, keep, most):
    docs = random_documents(3)
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), length=100, keep=keep, most_runs=most, texts=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(docs, 100, keep)
    assert all(hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 for r in got)


def brute_windows(docs, words):
    holders, per = defaultdict(set), {}
    for d, t in docs:
        w = (t or "").split()
        per[d] = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
        for x in per[d]:
            holders[x].add(t)
    same = Counter(t for _, t in docs)
    return {d: sum(len(holders[x]) > 1 or same[t] > 1 for x in per[d]) for d, t in docs}


def test_shared_windows_of_words(spark, small):
    docs = random_documents(5)
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), words=9).collect()
    assert {r.doc_id: r.n_shared_windows for r in got} == brute_windows(docs, 9) and any(r.n_shared_windows for r in got)
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = repeats.remove_repeats(table).collect()
    assert {r.doc_id: r.n_shared_windows for r in got} == brute_windows([(r.doc_id, r.text) for r in table.collect()], 51)


def test_short_words_over_fifty(spark):
    """A passage of 51 words under 400 bytes is told by its words."""
    passage = " ".join(f"w{i}" for i in range(51))
    docs = [(1, "some start " + passage), (2, passage + " another end"), (3, passage[:-3]), (4, "w0 w1 " * 60)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].n_shared_windows for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and not got[1].n_removed


def test_nearest_smaller():
    r = np.random.default_rng(1)
    for _ in range(50):
        age, group = r.permutation(40), np.sort(r.integers(0, 6, 40))
        want = [next((j for j in range(i - 1, -1, -1) if group[j] == group[i] and age[j] < age[i]), -1) for i in range(40)]
        assert repeats.nearest_smaller(age, group).tolist() == want


def test_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = repeats.remove_repeats(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(docs, 400)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    text = " ".join(f"x{i % 1700}" for i in range(5000))
    found, hashes = repeats.word_runs(block(pa.array([text, "a b", " ".join(["y"] * 60)])), 51)
    assert found["n"].sum() == 4950 + 10 and [len(h) for h in hashes] == found["n"].tolist()
    by_place = {(d, a + i): h for d, a, hs in zip(found["doc"].tolist(), found["at"].tolist(), hashes, strict=True) for i, h in enumerate(hs.tolist())}
    assert by_place[0, 7] == by_place[0, 1707] == by_place[0, 3407] and len(set(by_place.values())) == 1700 + 1
    r = random.Random(2)
    text = "".join(r.choice("abc ") for _ in range(5000))
    found = repeats.runs(block(pa.array([text])), 100)
    assert found["n"].sum() == 4901 and sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(found["at"], found["n"], strict=True)])) == list(range(4901))


def test_longest_previous_factor():
    r = random.Random(4)
    for _ in range(30):
        s = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60)))
        want = [max([next((k for k in range(len(s) - p) if s[q + k] != s[p + k]), len(s) - p) for q in range(p)], default=0) for p in range(len(s))]
        assert repeats.longest_previous_factor(np.frombuffer(s, np.uint8)).tolist() == want


def test_odd_inputs(spark, odd_documents, no_documents):
    out = {(r.doc_id, r.n_bytes): r for r in repeats.remove_repeats(odd_documents).collect()}
    assert out[(3, 816)].n_removed == 816 and out[(4, 816)].n_removed == 816 and out[(None, 360)].n_removed == 0
    assert repeats.remove_repeats(odd_documents).count() == 11 and repeats.remove_repeats(no_documents).count() == 0
