"""One-permutation MinHash fingerprints.

Each 5-word shingle is hashed once; the upper bits choose one of BINS bins, the lower ones compete for its minimum.
An empty bin takes the value of the first filled bin on its own fixed random route over all bins (optimal
densification: routes depend on the bin alone, so two documents agree on a borrowed value as often as on an own
one). The lowest BITS bits of each bin are packed. Two fingerprints agree on a bin by chance with probability
2**-BITS; `likeness` removes that bias: J = (agreeing - 2**-BITS) / (1 - 2**-BITS).

A text without words has the empty fingerprint "": likeness 1 to another such text and 0 to any other. Null texts
count as empty, and texts of any length are read whole. Rows with equal ids and texts are neighbours; an empty table gives
an empty one. Only id and text are read, so other columns' names can't clash (`fingerprints` keeps them; one of its own
column's name gives way).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import parts_for
from ._text import U64, Block, block, blocks, hash_runs, mix, per_document, rows, shingles, small_batches, tidy, tokens

BINS, BITS, SHINGLE = 512, 4, 5
_ROUTES: np.ndarray | None = None


def _routes() -> np.ndarray:
    """_routes()[t, j]: the bin that the empty bin j asks at its t-th try (a permutation of all bins for each j)."""
    global _ROUTES
    if _ROUTES is None:
        keys = mix(np.arange(1, BINS * BINS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(BINS, BINS)
        _ROUTES = np.ascontiguousarray(np.argsort(keys, axis=0).astype(np.int32))
    return _ROUTES


def sketch(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each document the low bits of its bins (n x BINS, uint8), and whether it has words."""
    ws, we, first = tokens(b)
    h, first = shingles(hash_runs(b.buf, ws, we, lower=True), first, SHINGLE)
    n, none = b.n, np.iinfo(np.uint64).max
    least = np.full(n * BINS, none, dtype=U64)
    if len(h):
        shift = U64(64 - BINS.bit_length() + 1)
        np.minimum.at(least, per_document(first) * BINS + (h >> shift).astype(np.int64), h & ((U64(1) << shift) - U64(1)))
    least = least.reshape(n, BINS)
    filled = least != none
    some = filled.any(axis=1)
    d, j = np.nonzero(~filled & some[:, None])
    routes = _routes()
    for t in range(BINS):
        if not len(d):
            break
        ask = routes[t, j]
        ok = filled[d, ask]
        least[d[ok], j[ok]] = least[d[ok], ask[ok]]
        d, j = d[~ok], j[~ok]
    return (least & U64((1 << BITS) - 1)).astype(np.uint8), some


def pack(low: np.ndarray, some: np.ndarray) -> list[str]:
    nibbles = (low[:, 0::2] << BITS) | low[:, 1::2]
    return [base64.b64encode(nibbles[i].tobytes()).decode() if some[i] else "" for i in range(len(some))]


def unpack(packed: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(packed), np.uint8)
    return np.stack([data >> BITS, data & ((1 << BITS) - 1)], axis=1).reshape(-1)


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, row by row."""
    chance = 2.0**-BITS
    j = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, j, np.where(a_some | b_some, 0.0, 1.0))


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df plus `fingerprint`."""
    return rows(df, lambda b, _: {"fingerprint": pa.array(pack(*sketch(b)), pa.string())}, [("fingerprint", "string")], text, keep)


# -- each document against its successor -----------------------------------------------------------------------------

PAIR_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ordered(df: DataFrame, parts: int) -> DataFrame:
    """df (id, text) in buckets of descending id, each with the first rows of the next bucket as `halo` behind its
    own; the last bucket's is the very first row. Only one pass shuffles the texts."""
    spark = df.sparkSession
    small_batches(spark)
    least = -(2**63)
    ids = df.select(F.coalesce("id", F.lit(least)).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)  # at most one for each partition

    def bucket(values: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, values, side="right")

    @F.pandas_udf("int")
    def bucket_of(x):
        import pandas as pd

        return pd.Series(bucket(x.to_numpy(dtype=np.int64)))

    heads = {r.b: r.id for r in ids.groupBy(bucket_of("id").alias("b")).agg(F.max("id").alias("id")).collect()}  # one for each bucket
    full = sorted(heads)
    before = {heads[b]: full[i - 1] for i, b in enumerate(full)}
    halo = spark.createDataFrame(list(before.items()), "id long, halo int") if before else spark.createDataFrame([], "id long, halo int")
    keyed = df.select(F.coalesce("id", F.lit(least)).alias("key"), "id", "text").withColumn("bucket", bucket_of("key"))
    keyed = keyed.join(F.broadcast(halo.withColumnRenamed("id", "key")), "key", "left")  # as many rows as buckets
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo")), F.struct(F.col("halo").alias("bucket"), F.lit(True).alias("halo")))
    placed = keyed.select("key", "id", "text", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("p")).select("p.bucket", "p.halo", "key", "id", "text")
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc("key"), F.xxhash64("text"))


def _compare(texts: list[str]) -> list:
    """Each text but the last against the edited text and the next one."""
    edited, n = [], [len(t) for t in texts]
    for i in range(len(texts) - 1):
        m = n[i] // 3
        edited.append(texts[i][: n[i] - m] + texts[i + 1][:m])
    own, own_some = sketch(block(pa.array(texts, pa.large_string())))
    new, new_some = sketch(block(pa.array(edited, pa.large_string())))
    k = len(edited)
    return [
        pa.array(n[:k], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(pack(own[:k], own_some[:k])), pa.array(pack(new, new_some)),
        pa.array(likeness(own[:k], own_some[:k], new, new_some)), pa.array(likeness(own[:k], own_some[:k], own[1:], own_some[1:])),
    ]


def edited_fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last third of its code points replaced by the first
    as many of the next document, by descending id; the last is followed by the first), and the likenesses.

    Equal ids follow one another in the order of a hash of their texts; null ids come last.
    """
    parts = parts or parts_for(df)
    src = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        names = [f.split()[0] for f in PAIR_FIELDS.split(", ")]
        held: list = []  # (bucket, halo, id, text) not yet compared; the last one waits for its successor

        def flush(rows_):
            own = [r for r in rows_ if not r[1]]
            if own:
                tail = rows_[len(own)] if len(rows_) > len(own) else None
                texts = [r[3] for r in own] + ([tail[3]] if tail else [])
                k = len(texts) - 1
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in own[:k]], pa.int64()), *_compare(texts)], names=names)

        for batch, b in blocks(batches, "text", 1 << 20):
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "halo", "id")]
            for i in range(b.n):
                row = (cols[0][i], cols[1][i], cols[2][i], b.text(i).decode())
                if held and held[0][0] != row[0]:
                    yield from flush(held)
                    held = []
                if not (row[1] and held and held[-1][1]):  # of equal first ids, one will do
                    held.append(row)
            if held and not held[-1][1] and len(held) > 1:
                yield from flush(held)
                held = held[-1:]
        yield from flush(held)

    return _ordered(src, parts).mapInArrow(tidy(run), PAIR_FIELDS)
