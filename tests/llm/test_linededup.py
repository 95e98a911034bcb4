import random

import numpy as np
import pyarrow as pa

from sheetwise.llm._text import block
from sheetwise.llm.linededup import Lines, dedup_lines, fingerprints


def brute(docs, gram=2, win=2, min_words=8):
    """The method, line by line."""
    lines = {d: [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")] for d, t in docs}
    h = {d: fingerprints(Lines(block(pa.array([t or ""]))), gram, win) for d, t in docs}
    firsts = {}
    for d in sorted(lines):
        for p, f in zip(h[d][1].tolist(), h[d][2].tolist(), strict=True):
            firsts.setdefault(f, (d, p))
    out = {}
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    for d, ls in lines.items():
        gone = set()
        for p, f in zip(h[d][1].tolist(), h[d][2].tolist(), strict=True):
            e, q = firsts[f]
            if (e, q) == (d, p):
                continue
            lo, hi = p, p + gram
            while lo > 0 and q - (p - lo) > 0 and strip(ls[lo - 1]) == strip(lines[e][q - (p - lo) - 1]):
                lo -= 1
            while hi < len(ls) and q + hi - p < len(lines[e]) and strip(ls[hi]) == strip(lines[e][q + hi - p]):
                hi += 1
            if sum(len(x.split()) for x in ls[lo:hi]) >= min_words:
                gone |= set(range(lo, hi))
        out[d] = (len(ls), gone)
    return lines, out


def check(spark, docs):
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    lines, want = brute(docs)
    assert len(got) == len(docs)
    for d, (n, gone) in want.items():
        assert (got[d].n_lines, got[d].n_removed) == (n, len(gone)), d
        left = [x for x in (got[d].clean_text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert left == [x for i, x in enumerate(lines[d]) if i not in gone]
    return lines, want


def invented(seed):
    r = random.Random(seed)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 9))) + "."
    shared = [[line() for _ in range(r.randrange(1, 8))] for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [line() for _ in range(r.randrange(0, 6))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            lo = r.randrange(len(s))
            parts += s[lo:] + [line() for _ in range(r.randrange(0, 3))]
        docs.append((i, "\n".join(parts) + r.choice(["", "\n", "\n\n  \n"])))
    return [*docs, (100, docs[5][1]), (101, docs[5][1]), (102, ""), (103, None), (104, "again and again here\n" * 9)]


def test_matches_the_method_done_line_by_line(spark, small):
    lines, want = check(spark, invented(1))
    # every line that goes has an earlier equal one; of repeated runs of three lines at most the ends stay
    seen, runs = set(), {}
    for d in sorted(lines):
        ls, gone = lines[d], want[d][1]
        for i, x in enumerate(ls):
            assert i not in gone or x in seen
            seen.add(x)
        for i in range(len(ls) - 2):
            run = tuple(ls[i : i + 3])
            if run in runs and sum(len(x.split()) for x in run) >= 16:
                assert i + 1 in gone
            runs.setdefault(run, d)
    check(spark, [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])


def test_selection_is_guaranteed():
    r = random.Random(3)
    run = [f"line {i} of the run" for i in range(3)]
    picks = set()
    for _ in range(50):
        text = "\n".join([f"a{r.random()}" for _ in range(r.randrange(4))] + run + [f"b{r.random()}" for _ in range(r.randrange(4))])
        picks.add(frozenset(fingerprints(Lines(block(pa.array([text]))))[2].tolist()))
    assert frozenset.intersection(*picks)


def test_odd_inputs(spark, odd_documents, no_documents):
    out = dedup_lines(odd_documents.withColumnRenamed("source", "n_lines"))
    assert out.count() == 11 and out.columns == ["doc_id", "text", "lang", "n_chars", "n_lines", "n_removed", "n_runs", "clean_text"]
    assert dedup_lines(no_documents).count() == 0
    assert np.array_equal([r.n_removed for r in out.filter("doc_id = 2").collect()], [0])


def brute_whole(docs, min_words=8):
    """Lines within any run of min_words words that has an earlier place, by trying all runs that could matter."""
    lines = {d: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")] for d, t in docs}
    firsts, gone = {}, {d: set() for d in lines}
    for d in sorted(lines):
        ls = lines[d]
        for lo in range(len(ls)):
            for hi in range(lo + 1, min(len(ls), lo + 2 * min_words) + 1):
                if firsts.setdefault(tuple(ls[lo:hi]), (d, lo)) != (d, lo) and sum(len(x.split()) for x in ls[lo:hi]) >= min_words:
                    gone[d] |= set(range(lo, hi))
    return {d: (len(lines[d]), gone[d]) for d in lines}, lines


def check_whole(spark, docs):
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), whole=True).collect()}
    want, lines = brute_whole(docs)
    assert len(got) == len(docs)
    for d, (n, gone) in want.items():
        assert (got[d].n_lines, got[d].n_removed) == (n, len(gone)), d
        assert [x.strip() for x in (got[d].clean_text or "").split("\n") if x.strip()] == [x for i, x in enumerate(lines[d]) if i not in gone]
    return got


def test_every_repeated_run_of_enough_words_goes(spark, small):
    one, two = " ".join(f"p{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "qr"]
    own = lambda d: [f"own{d} x{k}" for k in range(3)]
    docs = [(d, "\n".join([*own(d), one, *own(d + 50), *two, f"end{d}"])) for d in range(12)]
    got = check_whole(spark, docs)
    assert all(one not in got[d].clean_text and two[0] not in got[d].clean_text and two[1] not in got[d].clean_text for d in range(1, 12))
    assert got[0].n_removed == 0 and got[1].n_removed == 3 and got[1].n_runs == 2
    check_whole(spark, invented(1))
    check_whole(spark, [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])


def test_whole_takes_odd_inputs(spark, odd_documents, no_documents):
    out = dedup_lines(odd_documents, whole=True)
    assert out.count() == 11 and dedup_lines(no_documents, whole=True).count() == 0
    assert sorted(r.n_removed for r in out.filter("doc_id in (3, 4)").collect()) == [0, 1, 1]
