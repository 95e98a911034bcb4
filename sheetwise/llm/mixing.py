"""Mixing by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked until the weighted tokens
have the wanted share in every source, language and topic at once; a cell's weight, divided by the largest, is then the
probability with which its documents are sampled, so every expected marginal is met. Sampling is a hash of the document
against the probability: the same document is drawn in every run.

By default the wanted shares are the present ones to the power `temper`, which lifts what is rare. Shares given by the
caller count for the values that occur; values without one get none. Without a topic column, a document's topic is the
signs of three random projections of its words.

Null texts have no tokens, null categories are the value "". Rows with equal ids and equal contents share a fate. An
empty table gives an empty one. Columns of df named like a new one give way; no other name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, stored
from ._text import Block, hash_runs, rows, tokens

TOPIC_BITS, MOST_CELLS, ROUNDS, TEMPER, TRIM = 3, 100_000, 50, 0.7, 3.0
DIMENSIONS = ("source", "lang", "topic")


def measure(b: Block) -> dict:
    """Tokens (words) and topic of each document."""
    ws, we, first = tokens(b)
    h = hash_runs(b.buf, ws, we, lower=True)
    topic = np.zeros(b.n, np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for i in range(TOPIC_BITS):
            side = ((h >> np.uint64(7 + 11 * i)) & np.uint64(1)).astype(np.int64) * 2 - 1
            topic[some] |= (np.add.reduceat(side, first[some]) > 0).astype(np.int64) << i
    return {"n_tokens": np.diff(first), "topic": pa.array([f"t{x}" for x in topic])}


def _wanted(present: dict[str, float], given: dict[str, float] | None, temper: float) -> dict[str, float]:
    some = {k: v for k, v in present.items() if v > 0}
    raw = {k: v**temper for k, v in some.items()} if given is None else {k: float(given.get(k, 0)) for k in some}
    total = sum(raw.values())
    return {k: (v / total if total else 0.0) for k, v in raw.items()}


def rake(cells: np.ndarray, tokens_: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, trim: float = TRIM) -> np.ndarray:
    """Weights of the cells (cells: a code for each dimension) such that the weighted tokens' shares meet the targets.
    Between rounds weights above `trim` times the mean are cut, so that no tiny cell sets the scale; targets that
    contradict the data by more than that are met as far as this bound allows."""
    w = np.ones(len(tokens_))
    for i in range(rounds):
        if i:
            w = np.minimum(w, trim * (w * tokens_).sum() / max(1.0, tokens_.sum()))
        moved = 0.0
        for d, target in enumerate(targets):
            now = np.bincount(cells[:, d], w * tokens_, minlength=len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            factor *= 1.0 / max(1e-300, (target * (now > 0)).sum() or 1.0)
            w *= factor[cells[:, d]]
            moved = max(moved, float(np.abs(np.divide(now, now.sum() or 1.0) - target).max()))
        if moved < 1e-9:
            break
    return w


def _rake_joined(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, trim: float) -> DataFrame:
    """rake() by Spark joins, for very many cells: the same rounds, rule to stop and trim."""
    cells = cells.withColumn("weight", F.lit(1.0))
    for i in range(rounds):
        if i:
            mean = cells.agg(F.sum(F.col("weight") * F.col("n_tokens")) / F.greatest(F.sum("n_tokens"), F.lit(1))).first()[0] or 0.0
            cells = cells.withColumn("weight", F.least("weight", F.lit(trim * mean)))
        moved = 0.0
        for d in DIMENSIONS:
            now = cells.groupBy(d).agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("now"))
            now = now.join(targets[d], d, "left").select(d, "now", F.coalesce("share", F.lit(0.0)).alias("share"))
            whole = now.agg(F.sum("now").alias("whole"), F.sum(F.when(F.col("now") > 0, F.col("share"))).alias("met"))
            apart = F.abs(F.col("now") / F.when(F.col("whole") > 0, F.col("whole")).otherwise(1.0) - F.col("share"))
            met, far = now.crossJoin(F.broadcast(whole)).agg(F.max("met"), F.max(apart)).first()  # one row is broadcast
            moved = max(moved, far or 0.0)
            factor = now.select(d, F.when(F.col("now") > 0, F.col("share") / F.col("now") / F.lit(met or 1.0)).otherwise(0.0).alias("factor"))
            cells = cut(cells.join(factor, d).select(*DIMENSIONS, "n_tokens", (F.col("weight") * F.col("factor")).alias("weight")))
        if moved < 1e-9:
            break
    return cells


def weights(measured: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, most_cells: int = MOST_CELLS, trim: float = TRIM) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells of a measured table."""
    spark = measured.sparkSession
    targets = targets or {}
    cells = stored(measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")))
    if cells.count() <= most_cells:
        found = cells.toPandas().sort_values(list(DIMENSIONS))
        tokens_ = found["n_tokens"].to_numpy(np.float64)
        codes, shares = [], []
        for d in DIMENSIONS:
            names, code = np.unique(found[d].to_numpy(dtype=object).astype(str), return_inverse=True)
            present = dict(zip(names, np.bincount(code, tokens_, minlength=len(names)), strict=True))
            want = _wanted(present, targets.get(d), temper)
            codes.append(code)
            shares.append(np.array([want.get(n, 0.0) for n in names]))
        w = rake(np.stack(codes, axis=1), tokens_, shares, rounds, trim) if len(found) else tokens_
        top = w[tokens_ > 0].max() if (tokens_ > 0).any() else 1.0
        data = [(*map(str, k), float(x), float(min(1.0, x / top)) if t > 0 else 1.0) for k, x, t in zip(found[list(DIMENSIONS)].itertuples(index=False), w, tokens_, strict=True)]
        return spark.createDataFrame(data, "source string, lang string, topic string, weight double, probability double")
    tables = {}
    for d in DIMENSIONS:
        now = cells.groupBy(d).agg(F.sum("n_tokens").alias("n")).filter("n > 0")
        given = targets.get(d)
        raw = F.pow(F.col("n").cast("double"), F.lit(temper)) if given is None else F.lit(0.0) if not given else F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(d)], F.lit(0.0))
        raw_table = stored(now.select(d, raw.cast("double").alias("raw")))
        total = raw_table.agg(F.sum("raw")).first()[0] or 1.0
        tables[d] = raw_table.select(d, (F.col("raw") / total).alias("share"))
    raked = stored(_rake_joined(cells, tables, rounds, trim))
    top = raked.filter("n_tokens > 0").agg(F.max("weight")).first()[0] or 1.0
    return raked.select(*DIMENSIONS, "weight", F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.col("weight") / top)).otherwise(1.0).alias("probability"))


def mix_sources(df: DataFrame, id: str = "doc_id", text: str = "text", targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, seed: int = 1, keep: list[str] | None = None, rounds: int = ROUNDS, most_cells: int = MOST_CELLS, trim: float = TRIM) -> DataFrame:
    """df (or its columns `keep`) with n_tokens, topic, weight, probability and kept. Columns source and lang are read;
    an own column topic is used as it is."""
    new = ["n_tokens", "weight", "probability", "kept"]
    src = df.select(*[f"`{c}`" for c in df.columns if c not in new])
    names = src.columns if keep is None else [*keep]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = "topic" in src.columns
    tag = "_"
    while any(c.startswith(tag) for c in src.columns):  # names of its own that no column of df has
        tag += "_"
    s_, l_, t_, o_ = (f"{tag}{c}" for c in ("source", "lang", "topic", "own"))
    fields = [("n_tokens", "bigint"), (t_, "string")]
    base = src.select("*", name("source").alias(s_), name("lang").alias(l_), *([name("topic").alias(o_)] if own else []))

    def fn(b: Block, _: pa.RecordBatch) -> dict:
        m = measure(b)
        return {"n_tokens": m["n_tokens"], t_: m["topic"]}

    def measured(columns: list[str]) -> DataFrame:
        out = rows(base, fn, fields, text, [*columns, s_, l_, *([o_] if own else [])])
        return out.withColumn(t_, F.col(o_)) if own else out

    cells = measured([]).select(F.col(s_).alias("source"), F.col(l_).alias("lang"), F.col(t_).alias("topic"), "n_tokens")
    fitted = weights(cells, targets, temper, rounds, most_cells, trim).select(F.col("source").alias(s_), F.col("lang").alias(l_), F.col("topic").alias(t_), "weight", "probability")
    luck = F.shiftrightunsigned(F.xxhash64(F.col(f"`{id}`"), F.col(s_), F.col(l_), F.col("n_tokens"), F.lit(seed)), 11) / float(1 << 53)
    out = measured(list(dict.fromkeys([*names, id]))).join(fitted, [s_, l_, t_])
    got = [F.col(f"`{c}`") for c in names if not (c == "topic" and own)]
    return out.select(*got, "n_tokens", F.col(t_).alias("topic"), "weight", "probability", (luck < F.col("probability")).alias("kept"))
