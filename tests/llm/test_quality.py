import re
from collections import Counter

from sheetwise.llm.quality import FIELDS, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 3))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


def test_base_columns_match_brute_force(spark, small, odd_documents):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd_documents):
        texts = sorted(str(brute(r.text)) for r in docs.collect())
        got = sorted(str(tuple(r)[:6]) for r in quality_rules(docs, keep=[], clean=False).collect())
        assert got == texts


def test_lines_go_first_then_documents(spark):
    good = "Sentence {0} holds proper words{0} like apple{0} pear{0} plum{0} and grape{0} here.\n"
    nav = "Home | News | Sport | Contact | About\n"
    docs = [(0, "".join(good.format(i) for i in range(10)) + nav + "We use cookies to improve this site.\n"), (1, "".join(good.format(i) for i in range(4)) + nav * 40)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].kept and out[0].n_bad_lines == 2 and "Home" not in out[0].clean_text and "cookies" not in out[0].clean_text and out[0].clean_text.count("proper") == 10
    assert not out[1].kept


def test_boilerplate_needs_whole_words_in_short_lines(spark):
    prose = ["The villa shows a bold design in the classical style of the valley.", "She keeps a popular blog in the city.", "People who want to read more find the old library across the long street open."]
    buttons = ["Please log in now.", "Read more.", "Datenschutzerklärung und Impressum.", "Nous utilisons des cookies."]
    filler = [f"Sentence {i} holds proper words{i} like apple{i} pear{i} plum{i} and grape{i} here." for i in range(10)]
    row = quality_rules(spark.createDataFrame([(0, "\n".join(prose + buttons + filler))], "doc_id long, text string")).first()
    assert row.n_bad_lines == 4 and all(p in row.clean_text for p in prose)
    one = quality_rules(spark.createDataFrame([(0, "only line")], "doc_id long, text string")).first()
    assert one.n_bad_lines == 0 and one.base_failed


def test_odd_inputs(spark, odd_documents, no_documents):
    out = quality_rules(odd_documents.withColumnRenamed("n_chars", "n_words"))
    assert out.count() == 11 and out.columns.count("n_words") == 1
    assert quality_rules(no_documents).count() == 0
    assert [n for n, _ in FIELDS] == quality_rules(no_documents).columns[-len(FIELDS) :]
