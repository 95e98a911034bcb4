import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetwise.llm._text import block
from sheetwise.llm._tokens import encoder
from sheetwise.llm.packing import Nested, Schedule, pack, place

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, first = encoder(PATH).encode(block(pa.array(texts)))
    return [ids[first[i] : first[i + 1]].tolist() for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é.'s1\n\t \r\x0b  　¿😀_don't", max_size=40), min_size=1, max_size=6))
def test_ids_equal_the_library(texts):
    assert ours(texts) == reference(texts)


def test_ids_of_documents(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ["<|endoftext|> x", "", "a  b \n\n c\n", " \n "]
    assert ours(texts) == reference(texts)


def test_special_strings_have_their_own_ids():
    assert ours(["a <|endoftext|> b", "<|endoftext|>"]) == [[64, 220, 50256, 275], [50256]]


def check_schedule(queues, weights, window):
    s = Schedule(queues, weights, window)
    taken = np.full(s.total, -1)
    r = random.Random(3)
    for i, (k, n) in enumerate(sorted(queues.items())):
        at = 0
        while at < n:
            m = min(n - at, r.randrange(1, 50))
            got = s.stretches(k, at, m)
            assert sum(x for _, x in got) == m
            for place_, length in got:
                assert (taken[place_ : place_ + length] == -1).all()
                taken[place_ : place_ + length] = i
            at += m
    assert (taken >= 0).all()
    return s, taken


def test_schedule_fills_windows_to_proportions():
    s, taken = check_schedule({"a": 5000, "b": 3000, "c": 2000}, None, 100)
    assert len(s.phases) == 1
    for j in range(100):
        got = Counter(taken[j * 100 : j * 100 + 100].tolist())
        assert abs(got[0] - 50) <= 1 and abs(got[1] - 30) <= 1 and abs(got[2] - 20) <= 1
    s, taken = check_schedule({"a": 777, "b": 3001, "c": 200, "tiny": 3}, {"a": 0.5, "b": 0.25, "c": 0.25, "tiny": 1e-6}, 64)
    assert abs((taken[:640] == 0).mean() - 0.5) < 0.01
    for seed in range(20):
        r = random.Random(seed)
        q = {f"q{i}": r.choice([0, 1, 2, 5, 100, 1000]) for i in range(8)}
        check_schedule(q, None if seed % 2 else {k: r.random() for k in q}, 128)


def test_places_fill_sequences_without_padding():
    total = 5 * 64 + 41
    seen = defaultdict(list)
    for at in range(total):
        seq, offset, room = place(at, total, 64)
        seen[seq].append(offset)
        assert room >= 1
    assert [len(v) for v in seen.values()] == [64] * 5 + [32, 8, 1] and all(v == list(range(len(v))) for v in seen.values())


def test_every_id_in_one_piece(spark, small, odd_documents):
    for docs, unique in ((spark.read.parquet(f"{small}/documents.parquet"), True), (odd_documents, False)):
        rows = docs.select("doc_id", "text").collect()
        got = pack(docs.repartition(5), PATH, with_ids=True).collect()
        sequences = defaultdict(list)
        for p in got:
            assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
            sequences[p.sequence_id].append((p.offset, p.length))
        for v in sequences.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0
        if unique:
            want = {r.doc_id: ids + [1] for r, ids in zip(rows, reference([r.text or "" for r in rows]), strict=True)}
            by_doc = defaultdict(list)
            for p in got:
                by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
                assert p.doc_tokens == len(want[p.doc_id])
            assert {d: [x for _, part in sorted(v) for x in part] for d, v in by_doc.items()} == want
        else:
            assert sum(p.length for p in got) == sum(len(x) + 1 for x in reference([r.text or "" for r in rows]))


def test_no_documents(spark, no_documents):
    assert pack(no_documents, PATH).count() == 0


def check_nested(queues, window):
    s, at = Nested(queues, window), dict.fromkeys(queues, 0)
    taken, r = np.full(s.total, -1), random.Random(5)
    for i, (k, n) in enumerate(queues.items()):
        while at[k] < n:
            m = min(n - at[k], r.randrange(1, 50))
            got = s.stretches(k, at[k], m)
            assert sum(x for _, x in got) == m
            for p, x in got:
                assert (taken[p : p + x] == -1).all()
                taken[p : p + x] = i
            at[k] += m
    assert (taken >= 0).all()
    return taken


def test_any_number_of_queues_keep_their_proportions():
    # a big queue, a middle one and 300 too small for two tokens a window
    queues = {"big": 600_000, "middle": 200_000, **{f"small{i}": 600 + i % 9 for i in range(300)}}
    taken, total = check_nested(queues, 512), sum(queues.values())
    for j in range(total // 512):
        got = np.bincount(taken[j * 512 : j * 512 + 512], minlength=302)
        assert abs(got[0] - 512 * 600_000 / total) <= 2 and abs(got[1] - 512 * 200_000 / total) <= 2
    part = total // 1024 * 512  # whole windows
    half = np.bincount(taken[:part], minlength=302)[2:]
    assert np.abs(half - 300).max() < 130 and abs(half.sum() - (total - 800_000) * part / total) <= 2  # to a window of the shared queue
    check_nested({f"q{i}": 100 for i in range(700)}, 64)  # all too small
    check_nested({"big": 100_000, "one": 1}, 64)
    for seed in range(20):
        r = random.Random(seed)
        check_nested({f"q{i}": r.choice([0, 1, 2, 5, 100, 3000]) for i in range(r.randrange(60))}, 128)


def test_many_sources_stay_what_they_are(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('words of ', id) text", "if(id % 2 = 0, 'hot', concat('site', id)) source")
    want = {r.doc_id: r.source for r in docs.collect()}
    pieces = pack(docs, PATH, length=64, window=512).collect()
    assert {(p.doc_id, p.source) for p in pieces} == set(want.items())
    places = sorted((p.sequence_id, p.offset, p.length, p.source == "hot") for p in pieces)
    hot = np.concatenate([np.full(n, h) for _, _, n, h in places])
    share = hot.mean()
    assert all(abs(hot[j : j + 512].sum() - 512 * share) <= 2 for j in range(0, len(hot) - 512, 512))
