"""Near duplicates by banded MinHash, verified by odd sketches and then exactly.

A document's set holds the hashes of its distinct 5-word shingles, in lower case (fewer words: the whole sequence;
no words: the empty set, linked with nothing). Documents with equal sets form a class, and only classes go on.

1. Bands of ROWS MinHash values make buckets. The number of bands follows from the threshold: a pair at the
   threshold misses every bucket with a probability below MISS.
2. The MinHash samples are folded into an odd sketch: a bitmap of parities. The XOR of two sketches counts the
   differing samples, and its population count estimates high similarities closely. A pair goes on if the count lies
   within five standard deviations of what the threshold gives.
3. What is left is confirmed on the full sets.

No bucket is expanded into all its pairs. In each round every class of a bucket is compared with one pivot of it,
confirmed links join components, and buckets within one component are done. In the buckets that remain, classes
outside the largest component are compared with the rest, the closest pairs first, in steps between which confirmed links
join components, so a group of copies costs its size times its strays.
The result is exact up to the misses of 1 and 2 (about 1e-6 for a pair right at the threshold).

Null and empty texts have the empty set; texts of any length are read whole; ties go to the least id; an empty table gives
an empty one. Only id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bitmap import Bitmap
from ._store import stored, sweep
from ._text import U64, Block, blocks, distinct, hash_runs, lists, mix, randoms, rows, shingles, tidy, tokens
from .components import components

ROWS, MISS = 6, 1e-6
#: MinHash samples folded into a sketch (the bands use the first of them), and its size.
SAMPLES, BITS = 720, 2048
WORDS = BITS // 64
#: Of the pairs between two components as many are confirmed at a time, closest first; at last all that are left.
TRIES = (4, None)
#: The rest is compared in steps of rising counts, up to so many standard deviations: what a step links isn't compared again.
STEPS = (-1.5, 0, 1.5)
#: Documents whose samples a task holds at once: some 40 KB each.
SIGNED = 256


def bands_for(percent: int) -> int:
    t = percent / 100
    return max(1, math.ceil(math.log(MISS) / math.log(1 - t**ROWS)))


def most_bits(percent: int, deviations: float = 5) -> int:
    """The largest population count of a pair's XOR that the threshold allows, with five standard deviations: of the
    number of differing samples, and of the bits that meet."""
    t = percent / 100
    balls = 2 * SAMPLES * (1 - t)
    odd = lambda m: BITS / 2 * (1 - (1 - 2 / BITS) ** m)
    sampled = odd(balls + 2 * math.sqrt(SAMPLES * t * (1 - t))) - odd(balls)
    return math.ceil(odd(balls) + deviations * math.hypot(sampled, balls * math.sqrt(2 / BITS)))


def document_sets(b: Block) -> tuple[np.ndarray, np.ndarray]:
    ws, we, first = tokens(b)
    return distinct(*shingles(hash_runs(b.buf, ws, we, lower=True), first, 5))


def digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, 0 for an empty one."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    c1, c2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(some):
        c1[some] = np.add.reduceat(mix(h), first[some])
        c2[some] = np.add.reduceat(mix(h ^ U64(0xA5A5A5A55A5A5A5A)), first[some])
    return c1.view(np.int64), c2.view(np.int64)


def signatures(h: np.ndarray, first: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the bands' keys (n x bands) and the odd sketch (n x WORDS)."""
    n, k = len(first) - 1, max(SAMPLES, bands * ROWS)
    some = np.flatnonzero(np.diff(first))
    keys, sketch = np.zeros((n, bands), np.int64), np.zeros((n, WORDS), np.int64)
    if not len(some):
        return keys, sketch
    small = (h >> U64(32)).astype(np.uint32)
    mult, flip = randoms(k, 41), randoms(k, 43)
    least = np.empty((k, len(some)), np.uint32)
    for i in range(k):
        least[i] = np.minimum.reduceat((small * np.uint32(mult[i] >> U64(32) | U64(1))) ^ np.uint32(flip[i] >> U64(32)), first[some])
    values = least.astype(U64)
    salt = randoms(bands, 47)
    for j in range(bands):
        key = np.full(len(some), salt[j], U64)
        for i in range(ROWS):
            key = mix(key ^ values[j * ROWS + i]) + U64(i)
        keys[some, j] = key.view(np.int64)
    values = values[:SAMPLES]
    bit = (mix(values ^ (np.arange(SAMPLES, dtype=U64)[:, None] << U64(33))) % U64(BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(len(some)) * BITS).ravel(), minlength=len(some) * BITS) & 1
    sketch[some] = np.packbits(odd.astype(np.uint8).reshape(len(some), BITS), axis=1, bitorder="little").view(np.int64)
    return keys, sketch


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


_SKETCH = [f"s{i}" for i in range(WORDS)]


class _Search:
    """The state of one search over the classes (node, rep, c1, c2, n, keys, s0..)."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, percent: int, limit: int):
        self.nodes, self.percent, self.limit = nodes, percent, limit
        banded = nodes.select("node", F.posexplode("keys").alias("band", "key"))
        shared = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
        self.buckets = stored(banded.join(shared, "key"))  # only what two classes share
        self.sketches = nodes.select("node", *_SKETCH)
        self.sets = self._sets(texts)
        self.labels: DataFrame | None = None

    def _sets(self, texts: DataFrame) -> DataFrame:
        """(node, set) for each class with a bucket: read again from one of its documents, known by its digest."""
        wanted = stored(self.buckets.select("node").distinct().join(self.nodes.select("node", "rep", "c1", "c2"), "node"))
        ids = Bitmap(wanted.select(F.xxhash64("rep").alias("key")), "key", wanted.count())

        def pick(batches):
            for batch in batches:
                yield batch.filter(pa.array(ids.perhaps(batch.column(2).to_numpy()))).select([0, 1])

        likely = texts.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(tidy(pick), "id long, text string")  # other texts needn't move
        found = likely.join(wanted, likely["id"].eqNullSafe(wanted["rep"])).select("node", "c1", "c2", "text")

        def run(batches):
            for batch, b in blocks(batches):
                h, first = document_sets(b)
                c1, c2 = digests(h, first)
                col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                same = np.flatnonzero((c1 == col("c1")) & (c2 == col("c2")))
                yield pa.RecordBatch.from_arrays([pa.array(col("node")[same]), pa.array([h[first[d] : first[d + 1]].tobytes() for d in same], pa.binary())], names=["node", "set"])

        return stored(found.mapInArrow(tidy(run), "node long, set binary").dropDuplicates(["node"]))

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold on their full sets."""
        percent = self.percent
        s = self.sets
        both = pairs.join(s.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(s.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")

        def run(batches):
            for batch in batches:
                keep = []
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
                yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

        return both.mapInArrow(tidy(run), "a long, b long")

    def _join(self, links: DataFrame) -> None:
        """Takes new links into the components: only links between what are components already go on, as links of those."""
        fresh = stored(links)
        if self.labels is None:
            self.labels = components(fresh)
            return
        if not fresh.limit(1).count():
            return
        ends = fresh.select(F.col("a").alias("node")).union(fresh.select("b")).distinct()
        known = stored(self.labels.unionByName(ends.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("comp"))))
        of = lambda n: known.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
        lifted = fresh.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        top = components(lifted).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        self.labels = stored(known.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))

    def _placed(self) -> DataFrame:
        """The buckets (key, band, node, comp)."""
        if self.labels is None:
            return self.buckets.withColumn("comp", F.col("node"))
        return self.buckets.join(self.labels, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))

    def star(self, seed: int) -> None:
        """Compares each class with its buckets' pivots and confirms the closest one: what else links them is left to the
        next rounds, so that sets move once for each class."""
        sweep(self.nodes.sparkSession)
        placed = stored(self._placed())
        rank = F.struct((F.col("node") if not seed else F.xxhash64("node", F.lit(seed))).alias("o"), F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
        active = placed.groupBy("key").agg(F.min(rank).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "p.pivot", "p.pivot_comp")
        pairs = placed.join(active, "key").filter("comp <> pivot_comp").select(F.col("node").alias("own"), "pivot").distinct()
        x, y = self.sketches.alias("x"), self.sketches.alias("y")
        close = pairs.join(x, F.col("own") == F.col("x.node")).join(y, F.col("pivot") == F.col("y.node")).select("own", "pivot", _apart("x", "y").alias("d")).filter(F.col("d") <= self.limit)
        nearest = close.groupBy("own").agg(F.min(F.struct("d", "pivot")).alias("p")).select("own", "p.pivot")
        self._join(self._confirm(stored(nearest.select(F.least("own", "pivot").alias("a"), F.greatest("own", "pivot").alias("b")).distinct())))

    def rest(self) -> None:
        """Compares, in buckets that still span components, what lies outside the largest one with everything: the closest
        pairs first, so that of a group of copies few are left apart when it comes to the many that are less close."""
        done = -1
        for limit in sorted({min(max(most_bits(self.percent, z), 0), self.limit) for z in STEPS} | {self.limit}):
            if not self._rest(done, limit):
                return
            done = limit

    def _rest(self, done: int, limit: int) -> bool:
        """rest for the pairs that differ in more than `done` bits and `limit` at most; False if no bucket spans components."""
        sweep(self.nodes.sparkSession)
        placed = stored(self._placed())
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
        main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("top.comp").alias("main"))
        # 32 bits of a key tell which of two classes' bands is the first that they share. As Parquet, in the order of the
        # classes, each class's numbers are kept once, however many buckets it is in.
        short = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys")
        rows_ = stored(placed.join(main, "key").select("key", "band", "node", "comp", "main").join(self.nodes.select("node", short, *_SKETCH), "node").sortWithinPartitions("node"))
        if not rows_.limit(1).count():
            return False
        sweep(self.nodes.sparkSession)
        x, y = rows_.filter("comp <> main").alias("x"), rows_.alias("y")
        once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        # a pair that shares several bands comes out of the first
        first = F.array_position(F.zip_with("x.keys", "y.keys", lambda a, b: a == b), True) == F.col("x.band") + 1
        apart = _apart("x", "y")
        close = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & once & apart.between(done + 1, limit) & first)
        ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), apart.alias("d"), F.least("x.comp", "y.comp").alias("lo"), F.greatest("x.comp", "y.comp").alias("hi")]
        left = stored(close.select(*ends).distinct())
        for i, most in enumerate(TRIES):
            open_ = left
            if i:  # the first time, the components are those of the search
                side = lambda n: F.coalesce(F.col(f"c{n}.comp"), F.col(n))
                at = left.join(self.labels.alias("ca"), F.col("a") == F.col("ca.node"), "left").join(self.labels.alias("cb"), F.col("b") == F.col("cb.node"), "left")
                open_ = at.select("a", "b", "d", F.least(side("a"), side("b")).alias("lo"), F.greatest(side("a"), side("b")).alias("hi")).filter("lo <> hi")
            if most:
                best = F.row_number().over(Window.partitionBy("lo", "hi").orderBy("d", "a", "b"))
                open_ = stored(open_.withColumn("k", best))
                left, open_ = open_.filter(F.col("k") > most).select("a", "b", "d"), open_.filter(F.col("k") <= most)
            self._join(self._confirm(stored(open_.select("a", "b"))))
        return True


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85, stars: int = 2) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the least id reachable), kept (id = component_id).

    Rows with equal texts, equal ids or null ids each keep their row. An id that is null counts as the largest; a
    component of null ids only has the null component_id, and all its rows are kept.
    """
    bands = bands_for(percent)
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def sign(b: Block, _):
        h, first = document_sets(b)
        c1, c2 = digests(h, first)
        keys, sketch = signatures(h, first, bands)
        return {"c1": c1, "c2": c2, "n": np.diff(first), "keys": lists(keys.ravel(), np.arange(b.n + 1) * bands, pa.int64()), **{f"s{i}": np.ascontiguousarray(sketch[:, i]) for i in range(WORDS)}}

    fields = [("c1", "bigint"), ("c2", "bigint"), ("n", "bigint"), ("keys", "array<bigint>"), *[(s, "bigint") for s in _SKETCH]]
    signed = stored(rows(texts, sign, fields, keep=["id"], most=SIGNED))
    grouped = signed.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), *[F.first(s).alias(s) for s in _SKETCH])
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "*"))

    search = _Search(nodes, texts, percent, most_bits(percent))
    for seed in range(stars):
        search.star(seed)
    search.rest()

    placed = nodes.select("node", "c1", "c2", "n", "rep").join(search.labels, "node", "left").select("c1", "c2", "n", "rep", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    classes = placed.join(least, "comp").select("c1", "c2", "n", "component_id")
    out = signed.filter("n > 0").select("id", "c1", "c2", "n").join(classes, ["c1", "c2", "n"]).select("id", "n", "component_id")
    out = out.union(signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
