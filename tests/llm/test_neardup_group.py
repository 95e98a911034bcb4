"""A group of near copies right at the threshold: what is linked already isn't compared with all of the group."""

import random

from sheetwise.llm import neardup


def _group(n=150, words=1500):
    r = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    out = []
    for d in range(n):
        mine = list(base)
        for at in r.sample(range(words), 11 + d % 5):
            mine[at] = f"d{d}x{at}"
        out.append((d, " ".join(mine)))
    return out


def _expected(docs):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    top = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            if top[i] != top[j] and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                lo, hi = sorted((top[i], top[j]))
                top = [lo if t == hi else t for t in top]
    return dict(enumerate(top))


def test_pairs_of_a_group_at_the_threshold(spark, monkeypatch):
    docs, pairs, stored = _group(), [], neardup.stored

    def counted(df):
        out = stored(df)
        if out.columns[:3] == ["a", "b", "d"] and "k" not in out.columns:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == _expected(docs)
    assert sum(pairs) < 2000  # 4034 if all close pairs come out at once
