import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sheetwise.llm._rank import global_rank
from sheetwise.llm.sharding import shard


def laws(got, shards=8):
    count = Counter(r.shard for r in got)
    assert set(count) <= set(range(shards))
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut_edges(got, lines):
    at = defaultdict(set)
    where = {r.doc_id: r.shard for r in got}
    for d, ls in lines.items():
        for x in ls:
            at[x].add(d)
    shared = [v for v in at.values() if 1 < len(v) < 30]
    return sum(len({where[d] for d in v}) - 1 for v in shared), sum(len(v) - 1 for v in shared)


def test_laws_and_groups(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = shard(docs).collect()
    laws(got)
    text = {r.doc_id: r.text or "" for r in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    assert {r.doc_id for r in got} == set(text)
    where = {r.doc_id: r.shard for r in got}
    groups = defaultdict(set)
    for d, t in text.items():
        groups[t].add(where[d])
    assert sum(len(g) - 1 for g in groups.values()) <= 7  # one at most across each cut
    cut, links = cut_edges(got, {d: {x for x in t.split("\n") if len(x) > 16} for d, t in text.items()})
    assert cut < 0.5 * links


def test_propagation_finds_communities(spark):
    docs = [(i, "\n".join([f"a line that is common to community {i % 40} part {(i // 40 + k) % 3}" for k in range(2)] + [f"an own line of document {i}"])) for i in range(400)]
    got = shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    laws(got)
    cut, links = cut_edges(got, {d: t.split("\n") for d, t in docs})
    assert cut <= 0.35 * links


def test_a_group_larger_than_a_shard(spark):
    docs = [(i, "the same text for a third") for i in range(100)] + [(100 + i, f"text number {i} that stands alone") for i in range(203)]
    got = shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    laws(got)
    assert len({r.shard for r in got if r.doc_id < 100}) <= 4


def test_odd_inputs(spark, odd_documents, no_documents):
    laws(shard(odd_documents.withColumnRenamed("source", "shard")).collect())
    assert shard(no_documents).count() == 0


def test_global_rank(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    got = sorted((r.k, r.id, r["rank"]) for r in global_rank(df, F.col("k"), F.col("id")).collect())
    assert [x[2] for x in got] == list(range(1000))
