"""Exact removal of repeated passages by longest previous factors.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere in the corpus (keep="none"), or
elsewhere at an earlier place by (id, offset) (keep="first"). Matches never cross documents. Building one suffix
array over a corpus is out of reach, so the work is cut into pieces that can't lose a match:

1. Winnowing: each window of LENGTH bytes has an anchor, its K-byte substring of least hash. Equal windows have equal
   anchors at equal offsets, so only windows with an anchor that occurs again can repeat. The windows of one anchor
   form a run: a stretch of consecutive starts.
2. Runs with equal bytes are all copies of each other; counting them needs no text.
3. Of anchors whose runs differ, one copy of each different run is fetched. Their bytes are put in suffix order,
   and for every window the nearest suffixes at a smaller (and larger) place on both sides of it in that order, which
   share the longest prefix with it, tell whether its longest previous (and next) factor reaches LENGTH.
4. An anchor with more than MOST_RUNS different runs isn't put into one task; its windows are counted by hash,
   combined before the shuffle.
5. Each document's stretches are joined and cut out.

Beside the bytes, `n_shared_windows` counts a document's windows of WORDS words (runs between white space) that another
document has too, whatever their length in bytes: 51 short words are under 400 bytes. They are found alike, over hashes
of words instead of bytes: anchors, runs that are equal as a whole, and single windows by hash where runs differ.

Texts move only for documents that a bitmap of bounded size can't rule out. Null texts count as empty. Rows with equal
id and text are copies of each other (with keep="first", all but one of them lose what the others have; as they can't
be told apart, each is cut like the later one).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import Bitmap
from ._store import parts_for, stored
from ._text import U64, Block, blocks, hash_runs, mix, randoms, tidy, tokens

#: Runs of one anchor that a task compares: some 4 MB of text.
LENGTH, MOST_RUNS, WORDS = 400, 8192, 51
#: Bytes of text whose places fit beside a hash in 64 bits; longer texts are taken in overlapping pieces.
PIECE, PLACE_BITS = 1 << 20, 21

_BASE = U64(0x9E3779B97F4A7C15)
_BYTES = randoms(256, 77, odd=False)
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64."""
    global _POWERS
    if _POWERS is None:
        inverse, base = 1, int(_BASE)
        for _ in range(7):
            inverse = inverse * (2 - base * inverse) % (1 << 64)
        n = (1 << PLACE_BITS) + 1
        up, down = np.full(n, _BASE, U64), np.full(n, U64(inverse), U64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive numbers, in linear time (prefix and suffix minima of blocks of w)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(b: Block, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The runs of windows of a block: doc, at (first start within the document), n (starts), anchor, seg (hash of
    the run's bytes and its anchor's place)."""
    return _in_pieces(lambda lo, hi: _BYTES[b.buf[lo:hi]], b.start, length)[0]


def word_runs(b: Block, words: int = WORDS) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Like runs(), over words; and the hashes of each run's windows."""
    ws, we, first = tokens(b)
    h = hash_runs(b.buf, ws, we)
    return _in_pieces(lambda lo, hi: h[lo:hi], first, words, windows=True)


_RUN = ("doc", "at", "n", "anchor", "seg")


def _in_pieces(symbols, start: np.ndarray, length: int, windows: bool = False) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """_runs() of documents of symbols; a document longer than PIECE is taken in pieces that overlap."""
    out: list[tuple[np.ndarray, ...]] = []
    hashes: list[np.ndarray] = []

    def add(lo, hi, starts, docs, shift):
        x = symbols(lo, hi)
        out.append(_runs(x, starts, docs, shift, length))
        if windows:
            w = window_hashes(x, max(0, len(x) - length + 1), length)
            first = starts[np.searchsorted(docs, out[-1][0])] + out[-1][1] - shift[np.searchsorted(docs, out[-1][0])]
            hashes.extend(w[i : i + n] for i, n in zip(first.tolist(), out[-1][2].tolist(), strict=True))

    n = len(start) - 1
    if start[-1] <= PIECE + length:
        add(0, int(start[-1]), start, np.arange(n), np.zeros(n, np.int64))
    else:  # one long document
        for d in range(n):
            lo, hi = int(start[d]), int(start[d + 1])
            for c in range(lo, max(hi - length + 1, lo + 1), PIECE):
                end = min(c + PIECE + length - 1, hi)
                add(c, end, np.array([0, end - c]), np.array([d]), np.array([c - lo]))
    return dict(zip(_RUN, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)), hashes


def _runs(x: np.ndarray, start: np.ndarray, docs: np.ndarray, shift: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """x: a number for each symbol."""
    k = (length + 1) // 2
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    up, down = _powers()
    pre = np.zeros(len(x) + 1, U64)
    np.cumsum(x * up[: len(x)], out=pre[1:])
    grams = mix((pre[k:] - pre[:-k]) * down[: len(x) - k + 1])
    places = U64((1 << PLACE_BITS) - 1)
    least = slide_min((grams & ~places) | np.arange(len(grams), dtype=U64), length - k + 1)  # by first symbol of the window
    inside = np.zeros(len(least) + 1, np.int64)
    first, last = start[:-1], start[1:] - length + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    p = np.flatnonzero(np.cumsum(inside[:-1]) > 0)  # windows within one document
    if not len(p):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    doc = np.searchsorted(start, p, "right") - 1
    fresh = np.ones(len(p), bool)
    fresh[1:] = (least[p[1:]] != least[p[:-1]]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(fresh)
    n = np.diff(np.append(opens, len(p)))
    a, doc = p[opens], doc[opens]
    at = (least[a] & places).astype(np.int64)
    seg = mix((pre[a + n - 1 + length] - pre[a]) * down[a] + mix((at - a).astype(U64) * U64(1 << 20) + n.astype(U64)))
    return docs[doc], a - start[doc] + shift[doc], n, grams[at], seg


def window_hashes(x: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """Hashes of the first n windows of symbols."""
    up, down = _powers()
    pre = np.zeros(len(x) + 1, U64)
    np.cumsum(x * up[: len(x)], out=pre[1:])
    return mix((pre[length : length + n] - pre[:n]) * down[:n])


def suffix_ranks(buf: np.ndarray, cap: int) -> tuple[np.ndarray, int]:
    """Ranks of all suffixes by their first `reach` bytes (prefix doubling, only ties are sorted again), with
    cap / 2 <= reach <= cap."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(U64)
    word = np.zeros(n, U64)
    for i in range(8):
        word = (word << U64(8)) | padded[i : i + n]
    order = np.argsort(word, kind="stable")
    same = np.concatenate([[False], word[order[1:]] == word[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    reach = 8
    while reach * 2 <= cap:
        tied = same | np.append(same[1:], False)
        if not tied.any():
            return rank, cap
        spot = np.flatnonzero(tied)  # spots in the order; a tied group keeps its spots
        idx = order[spot]
        later = np.where(idx + reach < n, rank[np.minimum(idx + reach, n - 1)] + 1, 0)
        key = (rank[idx].astype(U64) << U64(32)) | later.astype(U64)
        by = np.argsort(key, kind="stable")
        order[spot] = idx[by]
        key = key[by]
        equal = np.concatenate([[False], key[1:] == key[:-1]])
        same[spot] = equal
        rank[order[spot]] = np.maximum.accumulate(np.where(equal, 0, spot))
        reach *= 2
    return rank, reach


def nearest_smaller(age: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it in its group (groups are stretches) with a smaller age, or -1.

    All candidates move at once: what lies between a place and its candidate is older than neither, so a candidate
    that isn't smaller hands over its own candidate, and the paths double."""
    near = np.arange(-1, len(age) - 1)
    near[np.flatnonzero(group != np.concatenate([[-1], group[:-1]]))] = -1
    while True:
        wrong = np.flatnonzero(near >= 0)
        wrong = wrong[age[near[wrong]] >= age[wrong]]
        if not len(wrong):
            return near
        near[wrong] = near[near[wrong]]


def factors(buf: np.ndarray, places: np.ndarray, age: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at `places`: does their longest previous factor, and their longest next factor, reach
    `length`? age: the order of the places in the corpus.

    The longest previous factor of a suffix is the longer of its common prefixes with the nearest suffixes of smaller
    age before and after it in suffix order. Suffixes with equal first `length` bytes are neighbours in that order, so
    it reaches `length` if one of the two lies in the same stretch. Next factors: with larger ages.
    """
    rank, reach = suffix_ranks(buf, length)
    key = rank[places].astype(U64) << U64(32)
    if reach < length:
        key |= rank[np.minimum(places + length - reach, len(buf) - 1)].astype(U64)
    order = np.lexsort((places, key))
    key = key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(key) else key.astype(np.int64)
    shared = np.flatnonzero(np.bincount(group)[group] > 1) if len(key) else group  # other suffixes have none
    seen, group, at = age[order][shared], group[shared], order[shared]
    previous, following = np.zeros(len(places), bool), np.zeros(len(places), bool)
    for found, by in ((previous, seen), (following, -seen)):
        before = nearest_smaller(by, group) >= 0
        after = nearest_smaller(by[::-1], -group[::-1])[::-1] >= 0
        found[at] = before | after
    return previous, following


def longest_previous_factor(buf: np.ndarray) -> np.ndarray:
    """The LPF array of a short byte string, from previous and next smaller places in suffix order."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    rank, _ = suffix_ranks(buf, max(8, 2 * n))
    order = np.lexsort((-np.arange(n), rank))  # a suffix that ends first comes first
    before, after = np.full(n, -1), np.full(n, -1)
    stack: list[int] = []
    for p in order.tolist():
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)

    def common(p: int, q: int) -> int:
        m = n - max(p, q)
        differ = np.flatnonzero(buf[p : p + m] != buf[q : q + m])
        return int(differ[0]) if len(differ) else m

    return np.array([max((common(p, q) for q in (before[p], after[p]) if q >= 0), default=0) for p in range(n)])


def _key() -> Column:
    """A row's key in the bitmaps of documents, from its id and its text's digest."""
    return F.xxhash64(F.coalesce(F.col("id"), F.lit(-(2**63))), F.col("digest"))


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("id"))


def _stretches(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged windows of one owner: owner, first offset, last offset."""
    at = np.flatnonzero(flags)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(at)) - 1
    return owner[at[lo]], offset[at[lo]], offset[at[hi]]


class _Repeats:
    def __init__(self, df: DataFrame, length: int, keep: str, most_runs: int):
        self.docs, self.length, self.keep, self.most_runs = df, length, keep, most_runs

    def _scan(self, wanted: Bitmap | None) -> DataFrame:
        """The runs of all documents; with `wanted`, of the anchors it may hold, and with their places."""
        length = self.length

        def run(batches):
            for batch, b in blocks(batches, "text", PIECE):
                r = runs(b, length)
                anchor, seg = r["anchor"].view(np.int64), r["seg"].view(np.int64)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg)], names=["anchor", "seg"])
                    continue
                hit = np.flatnonzero(wanted.perhaps(anchor))
                if not len(hit):
                    continue
                doc = r["doc"][hit]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[hit]), pa.array(seg[hit]), _ids(batch).take(pa.array(doc)), pa.array(_numbers(batch, "digest")[doc]), pa.array(r["at"][hit]), pa.array(r["n"][hit])], names=["anchor", "seg", "id", "digest", "at", "n"])

        return self.docs.mapInArrow(tidy(run), "anchor long, seg long" if wanted is None else "anchor long, seg long, id long, digest long, at long, n long")

    def intervals(self) -> DataFrame:
        """(id, digest, s, e): bytes to remove; they may overlap."""
        length = self.length
        again = stored(self._scan(None).groupBy("anchor").agg(F.count("*").alias("m"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("m > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")))
        known = Bitmap(again, "anchor", again.count())
        placed = stored(self._scan(known).join(again, "anchor"))
        order = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("o"), "digest", "at", "id", "n")
        kinds = stored(placed.groupBy("anchor", "seg", "mixed").agg(F.count("*").alias("m"), F.min(order).alias("first")))

        copied = kinds.filter("m > 1").select("anchor", "seg", F.col("first.digest").alias("fd"), F.col("first.at").alias("fa"), F.col("first.id").alias("fi"))
        whole = placed.join(copied, ["anchor", "seg"])
        if self.keep == "first":
            alone = whole.groupBy("anchor", "seg", "id", "digest", "at").agg(F.count("*").alias("same"), F.first("n").alias("n"), F.first("fd").alias("fd"), F.first("fa").alias("fa"), F.first("fi").alias("fi"))
            whole = alone.filter((F.col("same") > 1) | ~(F.col("id").eqNullSafe(F.col("fi")) & (F.col("digest") == F.col("fd")) & (F.col("at") == F.col("fa"))))
        whole = whole.select("id", "digest", F.col("at").alias("s"), (F.col("at") + F.col("n") + (length - 1)).alias("e"))
        return whole.unionByName(self._compared(kinds.filter("mixed")))

    def _compared(self, kinds: DataFrame) -> DataFrame:
        """Stretches of the first copies of different runs that occur in other runs of their anchor."""
        length, keep = self.length, self.keep
        count = kinds.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("m").alias("rare"))
        if keep == "none":  # else runs that occur twice are gone already
            count = count.filter("rare = 1")
        wanted = stored(kinds.join(count, "anchor").select("anchor", "seg", "m", "runs", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"), F.col("first.at").alias("at"), F.col("first.n").alias("n"), F.col("first.o").alias("o")))
        owners = Bitmap(wanted.select(_key().alias("key")), "key", wanted.count())

        def texts(batches):
            for batch, b in blocks(batches, "text", PIECE):
                hit = pa.array(np.flatnonzero(owners.perhaps(_numbers(batch, "key"))))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([_ids(batch).take(hit), pa.array(_numbers(batch, "digest")).take(hit), batch.column(batch.schema.get_field_index("text")).take(hit)], names=["id", "digest", "text"])

        found = self.docs.mapInArrow(tidy(texts), "id long, digest long, text string").withColumnRenamed("id", "tid").withColumnRenamed("digest", "td")
        joined = wanted.join(found, (F.col("id").eqNullSafe(F.col("tid"))) & (F.col("digest") == F.col("td"))).select("anchor", "seg", "m", "runs", "id", "digest", "at", "n", "o", "text")

        def cut_out(batches):
            for batch, b in blocks(batches, "text", PIECE):
                at, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("at", "n"))
                bits = [b.buf[b.start[i] + at[i] : b.start[i] + at[i] + n[i] + length - 1].tobytes() for i in range(b.n)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(9)] + [pa.array(bits, pa.binary())], names=[*batch.schema.names[:9], "bytes"])

        schema = "anchor long, seg long, m long, runs long, id long, digest long, at long, n long, o long, bytes binary"
        pieces = stored(joined.mapInArrow(tidy(cut_out), schema).dropDuplicates(["anchor", "seg"]))  # equal rows of the corpus give one piece
        small, large = pieces.filter(F.col("runs") <= self.most_runs), pieces.filter(F.col("runs") > self.most_runs)
        parts = parts_for(pieces)

        def compare(batches):
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                anchor = batch.column(0).to_numpy()
                size += batch.nbytes
                held.append(batch)
                if size < 2 * PIECE:
                    continue
                lo = int(np.searchsorted(anchor, anchor[-1]))  # sorted by anchor: the last one may go on
                if lo or len(held) > 1:
                    held[-1], rest = batch.slice(0, lo), batch.slice(lo)
                    if not lo and held[-2].column(0)[-1].as_py() == anchor[-1]:
                        held[-1] = batch
                        continue
                    yield from _compare(held, length, keep)
                    held, size = [rest], rest.nbytes
            yield from _compare(held, length, keep)

        out = "id long, digest long, s long, e long"
        near = small.repartition(parts, "anchor").sortWithinPartitions(F.col("anchor")).mapInArrow(tidy(compare), out)
        return near.unionByName(self._counted(large))

    def _counted(self, large: DataFrame) -> DataFrame:
        """Anchors with very many different runs: their windows meet by hash."""
        length, keep = self.length, self.keep

        def explode(batches):
            for batch, b in blocks(batches, "bytes", 1 << 18):
                n = batch.column(batch.schema.get_field_index("n")).to_numpy()
                piece = np.repeat(np.arange(b.n), n)
                step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                hashes = np.concatenate([window_hashes(_BYTES[b.buf[b.start[i] : b.start[i + 1]]], int(n[i]), length) for i in range(b.n)]).view(np.int64)
                take = pa.array(piece)
                cols = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("anchor", "m", "id", "digest", "o")]
                at = batch.column(batch.schema.get_field_index("at")).to_numpy()[piece] + step
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array(hashes)], names=["anchor", "m", "id", "digest", "o", "at", "window"])

        windows = large.mapInArrow(tidy(explode), "anchor long, m long, id long, digest long, o long, at long, window long")
        order = F.struct("o", "digest", "at")
        seen = windows.groupBy("anchor", "window").agg(F.count("*").alias("k"), F.min(order).alias("least")).filter("k > 1")
        hit = windows.join(seen, ["anchor", "window"])
        hit = hit.filter("m = 1") if keep == "none" else hit.filter(F.struct("o", "digest", "at") > F.col("least"))
        return hit.select("id", "digest", F.col("at").alias("s"), (F.col("at") + length).alias("e"))


def shared_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, digest, n): the number of windows of `words` words that another document of docs (id, text, digest, key) has
    too."""

    def anchors(batches):
        for batch, b in blocks(batches, "text"):
            r, _ = word_runs(b, words)
            yield pa.RecordBatch.from_arrays([pa.array(r["anchor"].view(np.int64)), pa.array(r["seg"].view(np.int64)), pa.array(_numbers(batch, "key")[r["doc"]])], names=["anchor", "seg", "own"])

    other = F.min("own") != F.max("own")
    again = stored(docs.mapInArrow(tidy(anchors), "anchor long, seg long, own long").groupBy("anchor").agg(other.alias("other"), (F.min("seg") != F.max("seg")).alias("mixed")).filter("other").select("anchor", "mixed"))
    mixed = again.filter("mixed")
    known, differ = Bitmap(again, "anchor", again.count()), Bitmap(mixed, "anchor", mixed.count())

    def candidates(batches):
        """Runs as a whole, or window by window where they differ; what the bitmaps let through by chance meets nobody."""
        for batch, b in blocks(batches, "text"):
            r, hashes = word_runs(b, words)
            anchor = r["anchor"].view(np.int64)
            hit = known.perhaps(anchor)
            one = differ.perhaps(anchor) & hit
            whole, single = np.flatnonzero(hit & ~one), np.flatnonzero(one)
            if not len(whole) + len(single):
                continue
            own, digest = _numbers(batch, "key"), _numbers(batch, "digest")
            doc = np.concatenate([r["doc"][whole], np.repeat(r["doc"][single], r["n"][single])])
            what = np.concatenate([r["seg"][whole], *[hashes[i] for i in single]]).view(np.int64)
            n = np.concatenate([r["n"][whole], np.ones(len(doc) - len(whole), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(own[doc]), _ids(batch).take(pa.array(doc)), pa.array(digest[doc]), pa.array(n)], names=["what", "own", "id", "digest", "n"])

    met = stored(docs.mapInArrow(tidy(candidates), "what long, own long, id long, digest long, n long").groupBy("what", "own", "id", "digest").agg(F.sum("n").alias("n")))
    both = met.groupBy("what").agg(other.alias("other")).filter("other").select("what")
    return met.join(both, "what").groupBy("id", "digest").agg(F.sum("n").alias("n"))


def _compare(held: list[pa.RecordBatch], length: int, keep: str):
    held = [x for x in held if x.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    cols = {c: t.column(c).combine_chunks() for c in t.column_names}
    from ._text import block

    b = block(cols["bytes"])
    n, m, at = (cols[c].to_numpy() for c in ("n", "m", "at"))
    owner = np.repeat(np.arange(b.n), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    o, digest = cols["o"].to_numpy(), cols["digest"].to_numpy()
    age_of = np.empty(b.n, np.int64)
    age_of[np.lexsort((at, digest, o))] = np.arange(b.n)
    previous, following = factors(b.buf, b.start[owner] + step, age_of[owner], length)
    flags = (previous | following) & (m[owner] == 1) if keep == "none" else previous
    who, lo, hi = _stretches(flags, owner, step)
    take = pa.array(who)
    yield pa.RecordBatch.from_arrays([cols["id"].take(take), cols["digest"].take(take), pa.array(at[who] + lo), pa.array(at[who] + hi + length)], names=["id", "digest", "s", "e"])


OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_windows long, kept_text binary"


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none", texts: bool = False, most_runs: int = MOST_RUNS, words: int = WORDS) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_windows (null if words is 0) and,
    on demand, kept_text (bytes: a cut may fall inside a character). Other columns of df aren't read, so their names
    can't clash; an empty table gives an empty one."""
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text")).withColumn("key", _key())
    found = stored(_Repeats(docs, length, keep, most_runs).intervals())
    cuts = found.select("id", "digest", F.struct("s", "e").alias("span"), F.lit(0).cast("long").alias("n"))
    if words:
        cuts = cuts.unionByName(shared_windows(docs, words).withColumn("span", F.lit(None).cast("struct<s:bigint,e:bigint>")))
    spans = cuts.groupBy("id", "digest").agg(F.collect_list("span").alias("spans"), F.sum("n").alias("n")).select(F.col("id").alias("si"), F.col("digest").alias("sd"), "spans", "n")
    owners = Bitmap(found.select(_key().alias("key")), "key", found.count())

    def prepare(batches):
        """Rows without repeats are finished here and move without their text."""
        for batch, b in blocks(batches, "text", PIECE):
            hit = owners.perhaps(_numbers(batch, "key"))
            sha = [None if hit[d] else hashlib.sha256(b.text(d)).hexdigest() for d in range(b.n)]
            body = [b.text(d).decode() if hit[d] or texts else None for d in range(b.n)]
            yield pa.RecordBatch.from_arrays([_ids(batch), pa.array(_numbers(batch, "digest")), pa.array(np.diff(b.start)), pa.array(sha, pa.string()), pa.array(body, pa.string())], names=["id", "digest", "n_bytes", "sha", "text"])

    ready = docs.mapInArrow(tidy(prepare), "id long, digest long, n_bytes long, sha string, text string")
    shared = F.coalesce("n", F.lit(0)) if words else F.lit(None)
    both = ready.join(spans, F.col("id").eqNullSafe(F.col("si")) & (F.col("digest") == F.col("sd")), "left").select("id", "n_bytes", "sha", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"), shared.cast("long").alias("n"))

    def finish(batches):
        for batch in batches:
            rows = []
            for i, size, sha, body, s, e, n in zip(*(batch.column(k) for k in range(7)), strict=True):
                size = size.as_py()
                if not s.is_valid or not len(s):
                    raw = body.as_py().encode() if body.is_valid else None
                    rows.append((i.as_py(), size, 0, 0, sha.as_py() or hashlib.sha256(raw).hexdigest(), n.as_py(), raw if texts else None))
                    continue
                raw = body.as_py().encode()
                cover = np.zeros(size + 1, np.int64)
                np.add.at(cover, s.values.to_numpy(zero_copy_only=False), 1)
                np.add.at(cover, e.values.to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                rows.append((i.as_py(), size, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), n.as_py(), kept if texts else None))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=[f.split()[0] for f in OUT.split(", ")])

    out = both.mapInArrow(tidy(finish), OUT).withColumnRenamed("id", id)
    return out if texts else out.drop("kept_text")
