import hashlib
import re

from pyspark.sql import functions as F

from sheetwise.llm import pii, queries

# The base patterns.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y..z .@a.b -a@b-c.d. a@b.c.d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (366) 555-9807 +12 +1-2-3 +1 234 567 89 0123456 (+49) 30 901820.", "é😀 x@mail.example.com 😀 +1 (283) 555-6500", "", "a" * 60_000, "a@" + "b." * 20_000 + "c", "1." * 30_000, "+1" * 9_000, "x@y.z@a.b",
]


def test_base_spans_match_brute_force(spark, small, odd_documents):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd_documents, tricky):
        rows = docs.select("doc_id", "text").collect()
        got = pii.disclosures(docs).select("doc_id", pii.listed(F.col("spans"), True).alias("b")).collect()
        assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(r.doc_id), ",".join(f"{k}:{s}:{e}" for k, s, e in brute(r.text))) for r in rows)


def test_query_columns(spark, small):
    out = queries.op1_pii(spark, small)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in out.collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert r.n_email == base.count("email:") and r.n_phone == base.count("phone:")


def test_terms_that_disclose_an_entity(spark):
    fill = [f"alpha beta gamma delta number{i} ordinary words the and for" for i in range(200)]
    seen = [f"{w} please write to Wintermute the owner at boss@corp.example today {w}" for w in ("spring", "summer", "autumn", "winter")]
    copies = ["tell Copycat at twin@corp.example now"] * 5  # one context five times is no evidence
    docs = spark.createDataFrame(list(enumerate(fill + seen + copies)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i in range(200, 204):
        assert "Wintermute" not in out[i].clean_text and "boss@corp" not in out[i].clean_text and "[EMAIL]" in out[i].clean_text and " the " in out[i].clean_text
    assert all("Copycat" in out[i].clean_text and "twin@" not in out[i].clean_text for i in range(204, 209))
    assert all(out[i].clean_text == fill[i] for i in range(200))


def test_telling_terms_go_wherever_they_stand(spark):
    far = "ordinary words the and for " * 12
    fill = [f"alpha beta gamma delta number{i} {far}" for i in range(200)]
    seen = [f"{w} mail boss@corp.example {far} é😀 Wintermute, {far}\x01 WINTERMUTE {w}" for w in ("spring", "summer", "autumn", "winter")]
    alone = [f"number{i} {far} wintermute {far}" for i in range(2)]  # without the entity
    docs = spark.createDataFrame(list(enumerate(fill + seen + alone)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i, text in enumerate(fill + seen + alone):
        want = [(m.start(), m.end()) for m in re.finditer("wintermute", text, re.IGNORECASE)]
        assert [(s.start, s.end) for s in out[i].spans if s.kind == 4 and text[s.start : s.end].lower() == "wintermute"] == want
        assert "wintermute" not in out[i].clean_text.lower() and out[i].clean_text.count("ordinary") == text.count("ordinary")
    assert [out[i].clean_text == fill[i] for i in range(200)] == [True] * 200


def test_rows_of_one_id_keep_their_own_spans(spark):
    docs = spark.createDataFrame([(1, "write to bob@example.com now", 5), (1, "no personal data in this one at all", 6)], "doc_id long, text string, _row int")
    out = {r._row: r for r in pii.sanitise(docs).collect()}
    assert out[5].clean_text == "write to [EMAIL] now" and out[6].clean_text == "no personal data in this one at all"


def test_odd_inputs(spark, odd_documents, no_documents):
    assert pii.sanitise(odd_documents.withColumnRenamed("source", "spans")).count() >= 11
    assert pii.disclosures(no_documents).count() == 0
