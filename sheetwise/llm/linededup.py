"""Removal of repeated runs of lines by winnowing over line hashes.

Lines with a word are hashed (without white space at their ends). Each GRAM lines in a row make a gram; of each WIN
grams in a row the least is selected, so every repeated run of GRAM + WIN - 1 lines shares a selected gram wherever it
stands. Each selected gram that occurs earlier, by (id, line), is joined with its first place, the match is extended
both ways over the line hashes, and the later run goes if it has `min_words` words or more. As WIN <= GRAM, what is
selected within a run leaves no gap, whatever the first places are: of a repeated run of GRAM + WIN - 1 lines all lines
go but at most WIN - 1 at each end (those too, if the first place has them). A line goes only if an earlier equal line
exists.

Matches of two documents that lie on one diagonal are merged before lines are fetched, so a copy costs one row, and no
pairs are made of what shares a run. With `whole` (the query and the pipeline) nothing is sampled: a line goes exactly if a run of lines with `min_words`
words or more around it has an earlier place. Every such run is covered by its shortest windows of `min_words` words
that begin or end at one of its lines, so those, two for each line at most, are hashed and meet their first place; no
match needs extending, and no lines of other documents are fetched.

Null texts count as empty. Equal ids follow one another by a hash of their texts;
rows with equal id and text count as one document for each other, and both stay as the first of them does. Texts of any
length are read whole; an empty table gives an empty one; columns that are named like a new one give way, others are
carried within one struct, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import Bitmap
from ._store import stored
from ._text import U64, Block, blocks, hash_runs, lists, mix, randoms, tidy, tokens

GRAM, WIN, MIN_WORDS = 2, 2, 8
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_NULL_ID = 2**63 - 1


class Lines:
    """The lines with a word of a block: begin and end (to the newline), hash, words, and each document's first."""

    def __init__(self, b: Block):
        ws, we, _ = tokens(b)
        begin, end, _ = tokens(b, _NEWLINE)
        w0, w1 = np.searchsorted(ws, begin), np.searchsorted(ws, end)
        some = w1 > w0
        self.begin, self.end, w0, w1 = begin[some], end[some], w0[some], w1[some]
        self.words = w1 - w0
        self.hash = hash_runs(b.buf, ws[w0], we[w1 - 1]) if len(w0) else np.zeros(0, U64)
        self.first = np.searchsorted(self.begin, b.start)


def fingerprints(lines: Lines, gram: int = GRAM, win: int = WIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected grams: document, line of the gram's begin, hash. A document with fewer grams than WIN selects its least."""
    n = len(lines.hash)
    doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    mult = randoms(gram, 61)
    at = np.arange(max(0, n - gram + 1))
    at = at[doc[at] == doc[at + gram - 1]] if len(at) else at
    if not len(at):
        return at, at, np.zeros(0, U64)
    h = np.zeros(len(at), U64)
    for j in range(gram):
        h += lines.hash[at + j] * mult[j]
    h, gdoc = mix(h), doc[at]
    first = np.searchsorted(gdoc, np.arange(len(lines.first)))
    chosen = np.zeros(len(at), bool)
    big = np.append(h, np.full(win, np.iinfo(np.uint64).max, U64))
    size = (first[1:] - first[:-1])[gdoc]
    last = first[1:][gdoc]
    w = np.arange(len(at))
    starts = w[(w + win <= last) | ((size < win) & (w == first[:-1][gdoc]))]
    inside = np.stack([np.where(starts + j < last[starts], big[starts + j], np.iinfo(np.uint64).max) for j in range(win)])
    chosen[starts + inside.argmin(axis=0)] = True
    pick = np.flatnonzero(chosen)
    return gdoc[pick], at[pick] - lines.first[gdoc[pick]], h[pick]


def windows(lines: Lines, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line the shortest runs of `min_words` words or more that begin and that end with it, within its document:
    document, first line, line after the last, hash."""
    n = len(lines.hash)
    doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    before = np.concatenate([[0], np.cumsum(lines.words)])  # each line has a word, so it grows
    need = max(1, min_words)
    at = np.arange(n)
    upto = np.searchsorted(before, before[:-1] + need)
    begin = np.flatnonzero(upto <= lines.first[1:][doc]) if n else at
    since = np.searchsorted(before, before[1:] - need, "right") - 1
    end = np.flatnonzero((since >= 0) & (since >= lines.first[:-1][doc])) if n else at
    pairs = np.unique(np.stack([np.concatenate([begin, since[end]]), np.concatenate([upto[begin], end + 1])]), axis=1)
    lo, hi = pairs[0].astype(np.int64), pairs[1].astype(np.int64)
    size = hi - lo
    h = size.astype(U64)
    mult = randoms(int(size.max()) if len(size) else 0, 61)
    for j, m in enumerate(mult):
        some = np.flatnonzero(size > j)
        h[some] += lines.hash[lo[some] + j] * m
    d = doc[lo] if len(lo) else lo
    return d, lo - lines.first[d], hi - lines.first[d], mix(h)


def _key() -> Column:
    """A row's key in the bitmap of documents."""
    return F.xxhash64("id", "digest")


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def extend(later: np.ndarray, p: int, first: np.ndarray, q: int, gram: int) -> tuple[int, int]:
    """The lines lo .. hi of `later` that match around later[p] = first[q]."""
    k = min(p, q)
    differ = np.flatnonzero(later[p - k : p][::-1] != first[q - k : q][::-1])
    lo = p - (int(differ[0]) if len(differ) else k)
    m = min(len(later) - p, len(first) - q)
    differ = np.flatnonzero(later[p + gram : p + m] != first[q + gram : q + m])
    return lo, p + (gram + int(differ[0]) if len(differ) else m)


def repeated_runs(docs: DataFrame, gram: int = GRAM, win: int = WIN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (id not null, text, digest, key) -> (id, digest, lo, hi): runs of lines to remove, by number among the lines with a word."""

    def scan(batches):
        for batch, b in blocks(batches):
            lines = Lines(b)
            doc, line, h = fingerprints(lines, gram, win)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_numbers(batch, "id")[doc]), pa.array(_numbers(batch, "digest")[doc]), pa.array(line)], names=["fp", "id", "digest", "line"])

    prints = stored(docs.mapInArrow(tidy(scan), "fp long, id long, digest long, line long"))
    firsts = prints.groupBy("fp").agg(F.count("*").alias("m"), F.min(F.struct("id", "digest", "line")).alias("f")).filter("m > 1").select("fp", F.col("f.id").alias("fid"), F.col("f.digest").alias("fdigest"), F.col("f.line").alias("fline"))
    same = (F.col("id") == F.col("fid")) & (F.col("digest") == F.col("fdigest")) & (F.col("line") == F.col("fline"))
    shift = (F.col("line") - F.col("fline")).alias("shift")
    met = prints.join(firsts, "fp").filter(~same).groupBy("id", "digest", "fid", "fdigest", shift).agg(F.collect_set("line").alias("at"))
    met = stored(met)
    both = met.select("id", "digest").union(met.select("fid", "fdigest")).distinct()
    owners = Bitmap(both.select(_key().alias("key")), "key", met.count() * 2)

    def read(batches):
        for batch, b in blocks(batches):
            lines = Lines(b)
            hit = pa.array(np.flatnonzero(owners.perhaps(_numbers(batch, "key"))))
            hashes, words = lists(lines.hash.view(np.int64), lines.first, pa.int64()), lists(lines.words, lines.first, pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(_numbers(batch, c)).take(hit) for c in ("id", "digest")], hashes.take(hit), words.take(hit)], names=["id", "digest", "lines", "words"])

    lines = stored(docs.mapInArrow(tidy(read), "id long, digest long, lines array<long>, words array<long>").dropDuplicates(["id", "digest"]))
    fetched = met.join(lines, ["id", "digest"]).join(lines.select(F.col("id").alias("fid"), F.col("digest").alias("fdigest"), F.col("lines").alias("flines")), ["fid", "fdigest"])

    def match(batches):
        for batch in batches:
            out = []
            cols = [batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                later, first = (cols[k][i].values.to_numpy() for k in (4, 5))
                words, move, upto = cols[3][i].values.to_numpy(), cols[2][i].as_py(), -1
                for p in sorted(batch.column(6)[i].as_py()):
                    if p < upto:
                        continue
                    lo, hi = extend(later, p, first, p - move, gram)
                    upto = hi
                    if words[lo:hi].sum() >= min_words:
                        out.append((cols[0][i].as_py(), cols[1][i].as_py(), lo, hi))
            c = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["id", "digest", "lo", "hi"])

    return fetched.select("id", "digest", "shift", "words", "lines", "flines", "at").mapInArrow(tidy(match), "id long, digest long, lo long, hi long")


def all_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Like repeated_runs(), for every line that has to go."""

    def scan(batches):
        for batch, b in blocks(batches):
            doc, lo, hi, h = windows(Lines(b), min_words)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_numbers(batch, "id")[doc]), pa.array(_numbers(batch, "digest")[doc]), pa.array(lo), pa.array(hi)], names=["fp", "id", "digest", "lo", "hi"])

    prints = stored(docs.mapInArrow(tidy(scan), "fp long, id long, digest long, lo long, hi long"))
    firsts = stored(prints.groupBy("fp").agg(F.count("*").alias("m"), F.min(F.struct("id", "digest", "lo")).alias("f")).filter("m > 1").select("fp", "f"))
    return prints.join(firsts, "fp").filter(F.struct("id", "digest", "lo") > F.col("f")).select("id", "digest", "lo", "hi")


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, win: int = WIN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """df with n_lines, n_removed, n_runs and clean_text, for every row. Columns of these names give way. whole: every
    repeated run of `min_words` words goes (gram and win have no part in it), not only what winnowing finds."""
    new = ["n_lines", "n_removed", "n_runs", "clean_text"]
    rest = [c for c in df.columns if c not in new]
    place = F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)).alias("id")
    docs = df.select(place, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text")).withColumn("key", _key())
    runs_of = all_repeated_runs(docs, min_words) if whole else repeated_runs(docs, gram, win, min_words)
    found = stored(runs_of.distinct())
    owners = Bitmap(found.select(_key().alias("key")), "key", found.count())
    runs = stored(found.groupBy("id", "digest").agg(F.collect_list("lo").alias("_lo"), F.collect_list("hi").alias("_hi")).select(F.col("id").alias("_i"), F.col("digest").alias("_d"), "_lo", "_hi"))

    kinds = dict(df.dtypes)
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    src = df.select(row, place, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest")).withColumn("key", _key())
    row_type = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in rest) + ">"

    def with_text(batches):  # once in a row, so that shuffles carry it once
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, batch.column(0).field(text)], names=[*batch.schema.names, "text"])

    def mark(batches):
        for batch, b in blocks(with_text(batches)):
            n = np.diff(Lines(b).first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(owners.perhaps(_numbers(batch, "key"))), pa.array(n)], names=["row", "id", "digest", "hit", "n_lines"])

    marked = src.mapInArrow(tidy(mark), f"row {row_type}, id long, digest long, hit boolean, n_lines long")
    clear = marked.filter(~F.col("hit")).select("row.*", "n_lines", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_runs"), F.col("row")[text].alias("clean_text"))
    hit = marked.filter("hit").join(runs, (F.col("id") == F.col("_i")) & (F.col("digest") == F.col("_d")), "left").select("row", "n_lines", "_lo", "_hi")

    def cut(batches):
        for batch, b in blocks(with_text(batches)):
            lines = Lines(b)
            removed, count, texts = [], [], []
            for d, (lo, hi) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                f, g = lines.first[d], lines.first[d + 1]
                raw = b.text(d)
                if not lo.is_valid:
                    removed.append(0), count.append(0), texts.append(raw.decode())
                    continue
                cover = np.zeros(g - f + 1, np.int64)
                np.add.at(cover, lo.values.to_numpy(), 1)
                np.add.at(cover, hi.values.to_numpy(), -1)
                gone = np.cumsum(cover)[:-1] > 0
                keep = np.ones(len(raw), bool)
                for k in np.flatnonzero(gone):
                    keep[lines.begin[f + k] - b.start[d] : min(lines.end[f + k] - b.start[d] + 1, len(raw))] = False  # with its newline
                removed.append(int(gone.sum()))
                count.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                texts.append(np.frombuffer(raw, np.uint8)[keep].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(texts, pa.string())], names=["row", *new])

    done = hit.mapInArrow(tidy(cut), f"row {row_type}, n_lines long, n_removed long, n_runs long, clean_text string").select("row.*", *new)
    return clear.unionByName(done)

