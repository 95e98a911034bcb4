import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import mixing
from sheetwise.llm.mixing import mix_sources, rake


def test_raking_meets_all_marginals():
    r = np.random.default_rng(1)
    cells = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = r.integers(1, 1000, len(cells)).astype(float)
    share = lambda d: np.bincount(cells[:, d], tokens) / tokens.sum()
    targets = [(x := share(d) ** 0.5) / x.sum() for d in range(3)]
    w = rake(cells, tokens, targets, trim=10.0)
    for d, t in enumerate(targets):
        got = np.bincount(cells[:, d], w * tokens)
        assert np.abs(got / got.sum() - t).max() < 1e-6


def test_expected_and_sampled_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    docs = docs.withColumn("topic", F.concat(F.lit("t"), F.col("doc_id") % 3))
    out = mix_sources(docs, targets=targets, keep=["doc_id", "source", "lang"], trim=4.0).cache()
    assert out.count() == docs.count() and out.filter("probability <= 0 or probability > 1").count() == 0
    expected = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("n")).collect()}
    total = sum(expected.values())
    assert all(abs(v / total - targets["lang"][k]) < 1e-3 for k, v in expected.items())
    sampled = {r.lang: r.n for r in out.filter("kept").groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(abs(v / sum(sampled.values()) - targets["lang"][k]) < 0.04 for k, v in sampled.items())
    words = {r.doc_id: len(r.text.split()) for r in docs.limit(200).collect()}
    assert all(r.n_tokens == words[r.doc_id] for r in out.filter(F.col("doc_id").isin(list(words))).collect())


def test_joins_give_the_same_weights(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 60")
    a, b = ({r.doc_id: r.probability for r in mix_sources(docs, keep=["doc_id"], rounds=2, most_cells=n).collect()} for n in (10**5, 1))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_joins_keep_empty_cells_and_all_rounds(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", "source", "lang")
    empty = spark.createDataFrame([(1000, "", "nothing", "en"), (1001, None, "nothing", "xx")], docs.schema)
    docs = docs.unionByName(empty).coalesce(1)
    a, b = ({r.doc_id: (r.weight, r.probability) for r in mix_sources(docs, keep=["doc_id"], rounds=2, most_cells=n).collect()} for n in (10**5, 1))
    assert len(a) == docs.count() and a.keys() == b.keys() and b[1000][1] == b[1001][1] == 1
    assert all(abs(x - y) <= 1e-6 * max(abs(x), abs(y)) for k in a for x, y in zip(a[k], b[k], strict=True))
    seen = []
    monkeypatch.setattr(mixing, "_rake_joined", lambda cells, targets, rounds, trim: seen.append(rounds) or cells.withColumn("weight", F.lit(1.0)))
    mix_sources(docs, keep=["doc_id"], most_cells=1)
    assert seen == [mixing.ROUNDS]


def test_defaults_meet_their_targets_and_names_may_clash(spark):
    """Default targets, temper and trim on a table in which one source holds a third of all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumns({"_source": F.lit("x"), "_lang": F.lit(1), "_own": F.lit(2.0)})
    out = mix_sources(docs, keep=["doc_id", "source", "lang", "_source", "_lang", "_own"]).cache()
    assert out.columns[:6] == ["doc_id", "source", "lang", "_source", "_lang", "_own"] and out.count() == docs.count()
    for d in ("source", "lang", "topic"):
        rows = out.groupBy(d).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("probability") * F.col("n_tokens")).alias("p"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("k")).collect()
        whole, wanted = sum(r.p for r in rows), sum(r.n**mixing.TEMPER for r in rows)
        assert all(abs(r.p / whole - r.n**mixing.TEMPER / wanted) < 0.02 for r in rows), (d, rows)
        assert all(abs(r.k / sum(x.k for x in rows) - r.p / whole) < 0.05 for r in rows), (d, rows)


def test_odd_inputs(spark, odd_documents, no_documents):
    out = mix_sources(odd_documents.withColumnRenamed("n_chars", "topic"))
    assert out.count() == 11 and out.columns == ["doc_id", "text", "lang", "source", "n_tokens", "topic", "weight", "probability", "kept"]
    assert mix_sources(odd_documents).count() == 11 and mix_sources(no_documents).count() == 0
