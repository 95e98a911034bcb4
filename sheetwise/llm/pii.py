"""Personal data and what discloses it, by DataFrame functions alone.

Base entities (email, ip, card, phone) are found by patterns. Their values are the protected entities c. Terms t
in their sentences disclose c by the share of its information that they give away over the whole corpus,

    disclosure(c; t) = PMI(c; t) / IC(c),  PMI = log2(N n_ct / (n_c n_t)),  IC = log2(N / n_c)

with n counted in documents (n_ct: those where a sentence has both, however long it is). It is 1 if t occurs with c
only. A pair needs `support` different contexts of c (CONTEXT code points on each side, within the sentence) as
evidence, so copies of one passage prove nothing. Whole documents are no unit of evidence: long ones share rare terms
by chance. A term's disclosure is the
largest over the entities; at `generalise` it is replaced by its kind, at `remove` it is deleted, wherever it stands in
any document, with the entity or without.

Null texts count as empty. Rows are told apart by position, so repeated rows and null or equal ids stay apart in
`disclosures`; `sanitise` joins on id and text, so rows of one id and different texts keep their own spans. Spans are code
points, end exclusive. Texts of any length are searched whole, an empty table gives an empty one, and columns but id and
text are only carried by `sanitise`, where those named like a new one give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import cut, stored

# The kinds in order of listing, and their patterns. Possessive quantifiers and the look-behind (a run
# that fails from its start fails from within; \G lets a run go on after a match) keep the search linear.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{L}\p{N}@_%+-])"
SENTENCE = r"(?<=[.!?])\s+|[\r\n]+"
#: Code points on each side of an entity that tell its contexts apart.
CONTEXT = 80


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + weigh(i)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(kind == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == 3, n.between(9, 15))
    )


def _hits(docs: DataFrame) -> DataFrame:
    """A row for each pattern match with its place, and one without kind for each document that has none."""
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    base = KINDS[:4]
    none = F.array().cast("array<string>")
    found = docs.select("*", *[F.when(needs.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in base])
    found = found.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"g_{k}") for k in base])

    def listed(i: int, k: str) -> Column:
        m, g = F.col(f"m_{k}"), F.col(f"g_{k}")
        one = lambda j: F.struct(
            F.lit(i).alias("kind"), j.alias("i"), F.get(m, j).alias("match"), F.char_length(F.get(g, j)).alias("gap"),
            F.right(F.get(g, j), F.lit(CONTEXT + 1)).alias("left"), F.left(F.get(g, j + 1), F.lit(CONTEXT + 1)).alias("right"),
        )
        # sequence(0, -1) would count down, so an empty list is filtered out
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(m) - 1, F.lit(1) * F.when(F.size(m) > 0, 1).otherwise(-1)), lambda j: (j >= 0) & (j < F.size(m))), one)

    rows = found.select("rid", "id", F.explode_outer(F.concat(*[listed(i, k) for i, k in enumerate(base)])).alias("h")).select("rid", "id", "h.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(before).cast("long"))
    ok = _valid(F.col("kind"), F.col("match"))
    return rows.select(
        "rid", "id", F.when(ok, F.col("kind")).alias("kind"), (F.col("end") - F.char_length("match")).alias("start"), "end",
        F.when(ok, F.concat(F.col("kind").cast("string"), F.lit(":"), F.lower("match"))).alias("entity"), F.when(ok, F.col("left")).alias("left"), F.when(ok, F.col("right")).alias("right"),
    )


def _words(docs: DataFrame) -> DataFrame:
    """(rid, term): the different terms of each document."""
    return docs.select("rid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))


def _telling(docs: DataFrame, hits: DataFrame, support: int, generalise: float) -> DataFrame:
    """(term, d): the terms that disclose some entity by `generalise` or more."""
    total = docs.count()
    held = hits.filter("kind is not null").select("entity", "rid").distinct()
    known = stored(held.groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= support))
    most = known.agg(F.max("n_c")).first()[0] or 0
    # As n_ct <= n_c, PMI <= log2(N / n_t): what is more frequent can't reach the threshold, what is rarer than `support` has
    # no evidence. Frequent terms, most of the text, so never meet the entities; the exact test comes after.
    cap = lambda n_c: F.pow(F.lit(float(max(total, 1))), F.lit(1 - generalise)) * F.pow(n_c, F.lit(generalise)) * 1.000001
    n_t = _words(docs).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = stored(n_t.filter((F.col("n_t") >= support) & (F.col("n_t") <= cap(F.lit(float(most))))))
    some = docs.join(held.join(known, "entity").select("rid").distinct(), "rid", "left_semi")
    sentences = some.select(F.col("rid").alias("id"), F.posexplode(F.split("text", SENTENCE, -1)).alias("sid", "text"))
    sentences = stored(sentences.filter(F.col("text").rlike("[@0-9]")).select(F.struct("id", "sid").alias("rid"), "id", "text"))
    within = _hits(sentences).filter("kind is not null").select("rid", F.col("id").alias("doc"), "entity", F.xxhash64("left", "right").alias("ctx")).join(known, "entity")
    pairs = within.join(_words(sentences).join(n_t, "term"), "rid").filter(F.col("n_t") <= cap(F.col("n_c").cast("double")))
    pairs = pairs.groupBy("entity", "term", "doc", "n_c", "n_t").agg(F.min("ctx").alias("ctx")).groupBy("entity", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct"), F.countDistinct("ctx").alias("n_ctx")).filter(F.col("n_ctx") >= support)
    log_n = F.lit(math.log2(max(total, 1)))
    share = (log_n + F.log2("n_ct") - F.log2("n_c") - F.log2("n_t")) / F.nullif(log_n - F.log2("n_c"), F.lit(0.0))
    return stored(pairs.groupBy("term").agg(F.max(share).alias("d")).filter(F.col("d") >= generalise))


def _places(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(rid, id, start, end, d): every occurrence of the telling terms."""
    holders = stored(_words(docs).join(telling, "term").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("tell")))
    mark = "\x01"  # no part of a term, nor of what may not stand beside one; texts that have it get a space instead
    found = docs.join(holders.hint("merge"), "rid").select("rid", "id", "tell", F.translate("text", mark, " ").alias("text"))
    found = found.select("rid", "id", "tell", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"), F.split("text", TERM, -1).alias("g"))
    one = lambda x, j: F.concat(F.get("g", j), F.when(F.map_contains_key("tell", F.lower(x)), F.concat(F.lit(mark), x, F.lit(mark))).otherwise(x))
    pieces = F.split(F.array_join(F.concat(F.transform("m", one), F.array(F.get("g", F.size("m")))), ""), mark, -1)  # every second one is a telling term
    sized = F.transform(pieces, lambda x, j: F.struct(F.char_length(x).alias("n"), F.when(j % 2 == 1, F.try_element_at("tell", F.lower(x))).alias("d")))
    rows = found.select("rid", "id", F.posexplode(sized).alias("i", "p")).select("rid", "id", "i", "p.n", "p.d")
    rows = rows.withColumn("end", F.sum("n").over(Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.filter("i % 2 = 1").select("rid", "id", (F.col("end") - F.col("n")).alias("start"), "end", "d")


def disclosures(df: DataFrame, id: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.5, remove: float = 0.9) -> DataFrame:
    """One row per row of df: id, spans array<struct<kind int (of KINDS), start, end, action>>, sorted."""
    docs = stored(df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "zstd")
    hits = cut(_hits(docs))
    more = _places(docs, _telling(docs, hits, support, generalise))
    base = hits.select("rid", "id", "kind", "start", "end", F.lit("remove").alias("action"))
    more = more.select("rid", "id", F.lit(4).alias("kind"), "start", "end", F.when(F.col("d") >= remove, "remove").otherwise("generalise").alias("action"))
    spans = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "action"))))
    got = base.unionByName(more).groupBy("rid", "id").agg(spans.alias("spans"))
    got = got.select("id", "spans", F.filter("spans", lambda t: t["kind"] < 4).alias("base"))
    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    # base spans stay; a term that one of them covers adds nothing
    return got.select(F.col("id").alias(id), F.filter("spans", lambda t: (t["kind"] < 4) | ~inside(t)).alias("spans"))


def listed(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] < 4) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """df with `spans` and `clean_text`: base entities and generalised terms become [KIND], removed terms go."""
    rest = df.drop("spans", "clean_text")
    tag = "_row"
    while tag in rest.columns:
        tag += "_"
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = rest.select(F.struct(F.col(id).alias("id"), digest.alias("digest")).alias(tag), F.col(text))
    spans = disclosures(keyed, tag, text, **thresholds).dropDuplicates([tag])
    out = rest.join(spans, rest[id].eqNullSafe(spans[tag]["id"]) & (digest == spans[tag]["digest"]), "left").drop(tag)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    flat = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.when((s["kind"] == 4) & (s["action"] == "remove"), "").otherwise(F.get(names, s["kind"])).alias("r"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(acc, s):
        fresh = s["s"] >= acc["at"]  # spans of different kinds may overlap: the first wins, the rest of the other goes too
        upto = F.when(fresh, F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["s"] - acc["at"]).cast("int")), s["r"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), upto.alias("out"))

    done = F.aggregate(flat, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return out.withColumn("clean_text", F.when(F.size("spans") > 0, done).otherwise(F.col(text)))
