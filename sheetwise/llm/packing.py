"""Mixture-controlled packing of token ids into sequences.

Each source is a queue of documents. Windows of WINDOW tokens are filled by deficit round-robin: in every window each
queue is served its share of the window, and what rounding leaves it short or ahead (less than a token) is carried
to the next window. The carried deficit has a closed form: after j windows the first i queues together have been served
floor(j * WINDOW * (w_1 + .. + w_i) / w) tokens. So every partition knows the deficits it starts from, and a document
finds its windows from its place in its queue alone: no ids move, whatever the order in which tasks run.

By default (the input's proportions) any number of sources are queues of their own: those too small for two tokens a
window share a queue, within which they are scheduled by the same rule over longer windows (Nested), so each has its
proportion over as many windows as that takes. The schedule, some numbers for each source, is made on the driver and
sent to the tasks.

Where weights are given, a queue that runs dry leaves its part to the rest (a new phase), and queues too small for two
tokens a window follow at the end. So does the last token or two of a queue. Windows are cut into sequences of LENGTH; what remains after the last
full one is cut into powers of two, so nothing is padded.

Null and empty texts have the end id alone. A null source is a queue of its own, "". Each row is a document of its own,
whatever its id. Order within a queue: by input partition, then row. Texts of any length are encoded whole; an empty table
gives an empty one; only id, text and source are read, so other columns' names can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored
from ._text import blocks, tidy
from ._tokens import encoder

LENGTH, WINDOW = 2048, 32 * 2048
#: Tokens that the sources of a shared queue get in one of its windows on average, at least.
QUANTUM = 64


class Schedule:
    """Which tokens of which queue stand where. queues: tokens in each; weights: the target proportions."""

    def __init__(self, queues: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW):
        self.names = sorted(k for k, n in queues.items() if n > 0)
        self.window = window
        left = {k: queues[k] for k in self.names}
        target = {k: left[k] if weights is None else int(round(weights.get(k, 0) * 1_000_000)) for k in self.names}
        self.total = sum(left.values())
        #: begin (of all tokens), length, cumulative weights, sum of weights, tokens of each queue served before
        self.phases: list[tuple[int, int, list[int], int, list[int]]] = []
        done, begin = dict.fromkeys(self.names, 0), 0
        while True:
            active = {k: target[k] for k in self.names if left[k] > 2 and target[k] > 0}
            whole = sum(active.values())
            while active and min(active.values()) * window < 2 * whole:  # such a queue waits for the end
                target[min(active, key=lambda k: (active[k], k))] = 0
                active = {k: target[k] for k in active if target[k] > 0}
                whole = sum(active.values())
            if not active:
                break
            rest = sum(left[k] for k in active)
            if all(left[k] * whole == active[k] * rest for k in active):
                length = rest  # all run dry together
            else:
                length = min((left[k] - 1) * whole // active[k] for k in active)
            if length < 1:
                break
            sums = np.cumsum([0, *[active.get(k, 0) for k in self.names]], dtype=object).tolist()
            self.phases.append((begin, length, sums, whole, [done[k] for k in self.names]))
            for i, k in enumerate(self.names):
                served = length * sums[i + 1] // whole - length * sums[i] // whole
                done[k], left[k] = done[k] + served, left[k] - served
            begin += length
        self.tail = (begin, np.cumsum([0, *[left[k] for k in self.names]]).tolist(), [done[k] for k in self.names])
        self.index = {k: i for i, k in enumerate(self.names)}
        self._starts = {k: [p[4][i] for p in self.phases] for i, k in enumerate(self.names)}

    def stretches(self, queue: str, at: int, n: int) -> list[tuple[int, int]]:
        """The tokens at .. at + n of a queue as (place among all tokens, length), in order."""
        i, out, end = self.index[queue], [], at + n
        while at < end:
            if at >= self.tail[2][i]:
                out.append((self.tail[0] + self.tail[1][i] + at - self.tail[2][i], end - at))
                break
            k = bisect_right(self._starts[queue], at) - 1
            begin, length, sums, whole, done = self.phases[k]
            stop = self.phases[k + 1][4][i] if k + 1 < len(self.phases) else self.tail[2][i]
            lo, hi = sums[i], sums[i + 1]
            served = lambda j: (x := min(j * self.window, length)) * hi // whole - x * lo // whole  # noqa: B023, E731
            y = at - done[i]
            j = max(0, y * whole // ((hi - lo) * self.window) - 1)
            while served(j + 1) <= y:
                j += 1
            m = min(done[i] + served(j + 1), stop, end) - at
            x, y0 = min(j * self.window, length), served(j)
            before = min((j + 1) * self.window, length) * lo // whole - x * lo // whole
            out.append((begin + x + before + y - y0, m))
            at += m
        return out


class Nested:
    """A schedule by the queues' own proportions, like Schedule, for any number of queues of any size."""

    def __init__(self, queues: dict[str, int], window: int = WINDOW, shared: bool = False):
        queues = {k: n for k, n in queues.items() if n > 0}
        total, order = sum(queues.values()), sorted(queues, key=lambda k: (queues[k], k))
        while shared and window < QUANTUM * len(order):
            window *= 2
        while True:
            small, held = 0, 0
            if order and queues[order[0]] * window < 2 * total:
                while small < len(order) and (queues[order[small]] * window < 2 * total or held * window < 2 * total):
                    held += queues[order[small]]
                    small += 1
            if not small or small < len(order):
                break
            window *= 2  # all are small: longer windows
        self.inner, self.members = None, frozenset(order[:small])
        own = {f"q{k}": queues[k] for k in order[small:]}
        if small:
            self.inner = Nested({k: queues[k] for k in order[:small]}, window, True)
            own["shared"] = held
        self.outer = Schedule(own, None, window)
        self.total = total

    def stretches(self, queue: str, at: int, n: int) -> list[tuple[int, int]]:
        if queue not in self.members:
            return self.outer.stretches(f"q{queue}", at, n)
        return [y for p, m in self.inner.stretches(queue, at, n) for y in self.outer.stretches("shared", p, m)]


def place(at: int, total: int, length: int = LENGTH) -> tuple[int, int, int]:
    """Sequence, offset in it and room from there on, for a place among all tokens. The last tokens that don't fill a
    sequence form ones of powers of two."""
    full = total // length
    if at < full * length:
        return at // length, at % length, length - at % length
    rest, start, seq = total - full * length, full * length, full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < start + size:
            return seq, at - start, start + size - at
        rest, start, seq = rest - size, start + size, seq + 1


def tokenised(df: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(part, id, source, n, at, ids): ids as packed integers with end_id, at: tokens of the source before it in its
    partition. Written out, as places depend on how rows lie in partitions."""

    def run(batches):
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch, b in blocks(batches, limit=2 << 20):
            ids, first = enc.encode(b)
            source = batch.column(batch.schema.get_field_index("source")).to_pylist()
            end = np.array([end_id], enc.dtype).tobytes()
            n = np.diff(first) + 1
            at = np.empty(b.n, np.int64)
            for d, s in enumerate(source):
                at[d] = seen.get(s, 0)
                seen[s] = int(at[d] + n[d])
            raw = [ids[first[d] : first[d + 1]].tobytes() + end for d in range(b.n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.n, part), pa.int32()), batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("source")), pa.array(n), pa.array(at), pa.array(raw, pa.binary())], names=["part", "id", "source", "n", "at", "ids"])

    return stored(df.mapInArrow(tidy(run), "part int, id long, source string, n long, at long, ids binary"), "zstd")


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset,
    source and, on demand, ids (packed integers). weights: the target proportion of each source (those missing come
    last); by default the proportions of the input's tokens."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    src = df.select(F.col(id).cast("long").alias("id"), name.alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = tokenised(src, path, end_id)
    counts = ids.groupBy("part", "source").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stored(counts.select("part", "source", ahead.alias("base"), "n"))  # a number for each partition and source: broadcast if found small, else joined
    queues = {r.source: r.n for r in bases.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # as many as queues
    schedule = Nested(queues, window) if weights is None else Schedule(queues, weights, window)
    dtype = encoder(path).dtype

    def run(batches):
        for batch in batches:
            c = {f: batch.column(k).to_pylist() if f != "ids" else batch.column(k) for k, f in enumerate(batch.schema.names)}
            out: list[tuple] = []
            for d in range(batch.num_rows):
                raw = np.frombuffer(c["ids"][d].as_buffer(), dtype).astype("<u4")
                n, start = c["n"][d], 0
                for at, m in schedule.stretches(c["source"][d], c["base"][d] + c["at"][d], n):
                    while m:
                        seq, offset, room = place(at, schedule.total, length)
                        k = min(room, m)
                        part = raw[start : start + k].tobytes()
                        out.append((c["id"][d], start, k, zlib.crc32(part), n, seq, offset, c["source"][d], part if with_ids else None))
                        start, at, m = start + k, at + k, m - k
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    placed = ids.join(bases.select("part", "source", "base"), ["part", "source"]).select("id", "source", "n", "at", "base", "ids").mapInArrow(tidy(run), PIECES)
    placed = placed.withColumnRenamed("id", id)
    return placed if with_ids else placed.drop("ids")
