import numpy as np
import pyarrow as pa
import public_tokenizers
from test_linededup import brute_whole
from test_neardup import brute as brute_near
from tokenizers import Tokenizer

import corpus_pipeline
from sheetwise.llm._text import block
from sheetwise.llm.quality import measure


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        out = stages[name](spark, docs, small).cache()
        docs = out
        return {r.doc_id: r for r in out.collect()}

    got = step("quality_rules")
    m = measure(block(pa.array([r.text or "" for r in rows.values()])))
    assert set(got) == {d for d, k in zip(rows, m["kept"], strict=True) if k} and docs.columns == columns
    assert all(r.n_chars == len(r.text) for r in got.values())

    before, got = got, step("line_dedup")
    want, lines = brute_whole([(d, r.text) for d, r in before.items()])
    assert set(got) == {d for d, (n, gone) in want.items() if not gone or len(gone) < n} and docs.columns == columns
    for d, r in got.items():
        assert [x.strip() for x in r.text.split("\n") if x.strip()] == [x for i, x in enumerate(lines[d]) if i not in want[d][1]]

    before, got = got, step("near_duplicates")
    groups = brute_near([(d, r.text) for d, r in before.items()], corpus_pipeline.NEAR)
    assert set(got) == {d for d, (_, c) in groups.items() if c == d} and docs.columns == columns

    before, got = got, step("mixing")
    assert set(got) <= set(before) and docs.columns == columns and len(got) > 0.3 * len(before)

    before = got
    pieces = stages["packing"](spark, docs, small).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(t.encode(r.text).ids) + 1 for r in before.values())
    sizes = np.bincount([p.sequence_id for p in pieces], [p.length for p in pieces]).astype(int)
    assert all(x == 2048 or x & (x - 1) == 0 for x in sizes)


def test_odd_inputs(spark, odd_documents, no_documents):
    for docs in (odd_documents.withColumn("kept", odd_documents.doc_id), no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.near(spark, odd_documents, "").count() == 9


def test_line_dedup_leaves_no_repeated_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.collect()
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, small).collect()}
    want, lines = brute_whole([(r.doc_id, r.text) for r in before])
    assert set(got) == {d for d, (n, gone) in want.items() if not gone or len(gone) < n}
    for d, r in got.items():
        assert [x.strip() for x in (r.text or "").split("\n") if x.strip()] == [x for i, x in enumerate(lines[d]) if i not in want[d][1]]
