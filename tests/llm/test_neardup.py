import random
import re

import numpy as np
import pyarrow as pa

from sheetwise.llm._text import block
from sheetwise.llm.components import components
from sheetwise.llm.neardup import BITS, SAMPLES, bands_for, document_sets, most_bits, near_duplicates, signatures


def brute(docs, percent):
    sets = []
    for _, t in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by_shingle[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def check(spark, docs, percent):
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), percent=percent).collect()
    want = brute(docs, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_matches_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, 85)


def test_groups_of_near_copies_and_chains(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    docs = [(1000, " ".join(base)), (1001, " ".join(base).upper()), (1002, ""), (1003, None), (1004, "too short"), (1005, "too short"), (1006, "too  Short")]
    for i in range(150):  # copies with 1 to 12 words changed: pairs on both sides of the threshold
        w = list(base)
        for _ in range(r.randrange(1, 13)):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    chain = list(base)
    for i in range(30):  # each near the one before, the last far from the first
        chain = chain[4:] + [f"c{i}_{k}" for k in range(4)]
        docs.append((2000 + i, " ".join(["chain"] * 1 + chain)))
    for percent in (85, 80):
        check(spark, docs, percent)


def test_odd_sketch_estimates_high_similarities():
    r = random.Random(1)
    base = [f"w{i}" for i in range(1000)]
    other = [w if r.random() > 0.02 else w + "x" for w in base]
    bands = bands_for(85)
    h, first = document_sets(block(pa.array([" ".join(base), " ".join(other)])))
    a, b = (set(h[first[i] : first[i + 1]].tolist()) for i in (0, 1))
    true = len(a & b) / len(a | b)
    _, sketch = signatures(h, first, bands)
    bits = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
    estimate = 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * bits / BITS)
    assert abs(estimate - true) < 0.05 and most_bits(85) < most_bits(80) < BITS / 2


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 200), (300, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100, 200: 0, 300: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_inputs(spark, odd_documents, no_documents):
    out = near_duplicates(odd_documents.withColumnRenamed("source", "component_id")).collect()
    assert len(out) == 11 and {r.component_id for r in out if r.doc_id in (3, 4)} == {3}
    assert near_duplicates(no_documents).count() == 0
