"""Vectorised text kernels over Arrow string buffers, shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of a block of documents at once. Separators are ASCII, so splitting
bytes equals splitting code points. Hashes are 64 bits: a sum of bytes times per-position odd random
multipliers, finished by a mixer, hence no structured collisions.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel handles at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Documents that a kernel handles at once, for those that keep numbers for each.
BLOCK_ROWS = 1024

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(n: int, seed: int = 1, odd: bool = True) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers; a longer request has the shorter one as its prefix."""
    with np.errstate(over="ignore"):
        r = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1B54A32D192ED03))
    return r | U64(1) if odd else r


_POSITIONS = randoms(256, seed=11)


def position_table(n: int) -> np.ndarray:
    global _POSITIONS
    if n > len(_POSITIONS):
        _POSITIONS = randoms(max(n, 2 * len(_POSITIONS)), seed=11)
    return _POSITIONS


#: Rows and bytes of documents that Spark hands to Python at once: they may be long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_LIBC: ctypes.CDLL | None = None


def release() -> None:
    """Gives freed memory back to the system; a worker lives on between tasks and would keep it."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    try:
        _LIBC = _LIBC or ctypes.CDLL(None)
        _LIBC.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(fn):
    """fn(batches) for mapInArrow; what its last batch needed is given back once it has ended, as the worker stays."""

    def run(batches):
        yield from fn(batches)
        release()

    return run


def small_batches(spark) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES, where they are higher."""
    conf = "spark.sql.execution.arrow."
    now = int(spark.conf.get(f"{conf}maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(f"{conf}maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"{conf}maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set(f"{conf}maxBytesPerBatch", str(BATCH_BYTES))


class Block:
    """Adjacent documents: `buf` bytes, document d is buf[start[d]:start[d + 1]]."""

    def __init__(self, buf: np.ndarray, start: np.ndarray):
        self.buf, self.start, self.n = buf, start, len(start) - 1

    def text(self, d: int) -> bytes:
        return self.buf[self.start[d] : self.start[d + 1]].tobytes()


def block(column: pa.Array) -> Block:
    """A null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return Block(buf, at - at[0])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, most: int = BLOCK_ROWS) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with at most `limit` bytes of text and `most` documents, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = block(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < whole.n:
            hi = int(np.searchsorted(whole.start, whole.start[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), lo + most, whole.n)
            s = whole.start[lo : hi + 1]
            yield batch.slice(lo, hi - lo), Block(whole.buf[s[0] : s[-1]], s - s[0])
            lo = hi
        del batch, whole
        release()


def tokens(b: Block, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators, and for each document its first run (n + 1 numbers)."""
    if not len(b.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(b.n + 1, np.int64)
    inside = ~separators[b.buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = b.start[(b.start > 0) & (b.start < len(b.buf))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    ws, we = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return ws, we, np.searchsorted(ws, b.start)


def hash_runs(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each buf[ws:we]; runs must not be empty."""
    if not len(ws):
        return np.zeros(0, U64)
    size = we - ws
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    data = buf[at + np.repeat(ws, size)]
    if lower:
        data = _LOWER[data]
    value = (data.astype(U64) + U64(1)) * position_table(int(size.max()))[at]
    return mix(np.add.reduceat(value, first) + size.astype(U64))


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words (h: word hashes, first: each document's first word, n + 1) and each
    document's first window (n + 1). A document of 1 to k - 1 words has one: its whole sequence."""
    n = np.diff(first)
    mult = randoms(k, seed=23)
    padded = np.concatenate([h, np.zeros(k, U64)])
    full = np.zeros(len(h), U64)
    for j in range(k):
        full += padded[j : j + len(h)] * mult[j]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(int(count.sum())) + np.repeat(first[:-1] - out_first[:-1], count)
    out = mix(full[at]) if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in short])
        place = np.concatenate([np.arange(n[d]) for d in short])
        sums = np.add.reduceat(h[at] * mult[place], np.cumsum(n[short]) - n[short])
        out[out_first[short]] = mix(sums + n[short].astype(U64) * U64(0x9E3779B97F4A7C15))
    return out, out_first


def per_document(first: np.ndarray) -> np.ndarray:
    """Each item's document, from the documents' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, sorted, and the new firsts."""
    doc = per_document(first)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(first) - 1))])


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


def rows(df, fn, fields: list[tuple[str, str]], text: str = "text", keep: list[str] | None = None, limit: int = BLOCK_BYTES, most: int = BLOCK_ROWS):
    """df plus the columns `fields` (name, SQL type) that fn(Block, batch) returns as a dict of arrays.

    keep: the input columns that stay (all by default); an input column named like a new one gives way.
    A narrow map over Arrow batches: no shuffle, memory bounded by a batch and `limit`.
    """
    names = [n for n, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` {k}" for n, k in fields])

    def run(batches):
        for batch, b in blocks(batches, text, limit, most):
            out = fn(b, batch)
            got = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(got + [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=keep + names)

    need = list(dict.fromkeys([*keep, text]))
    small_batches(df.sparkSession)
    return df.select(*[f"`{c}`" for c in need]).mapInArrow(tidy(run), schema)
