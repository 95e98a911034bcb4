"""A convolutional text classifier, trained in numpy.

Words (runs of letters and digits, in lower case) become vectors by hashing: the word, and its first four and five
bytes so that inflected forms share what they have in common. Filters of widths 1 to 3 slide over them, the largest
answer of each filter in the whole text is kept, and a logistic unit weighs those. Gradients flow through the chosen
places only, so a step costs little more than its forward pass.

The classifier is fitted on the driver on a bounded sample of labelled rows (at most MOST_ROWS of each class, those of
least hash of id). A part of the sample is kept back to move the score's decision to DECISION and to find a threshold
for each language. Language takes no part in a score; it only chooses the threshold of the extra column.

Null and empty texts get the score of a text without words. Without rows of both classes every score is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, Block, block, hash_runs, mix, rows, tokens

MOST_ROWS = 2000  # of each class
DECISION = 0.7
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
PREFIXES = (4, 5)
PAD = max(WIDTHS) - 1
STEPS, BATCH = 900, 32

_APART = np.ones(256, bool)  # all but letters, digits and non-ASCII bytes
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (words x kinds; 0 is the zero vector) with PAD empty words behind
    each document, and each document's first word (n + 1)."""
    ws, we, first = tokens(b, _APART)
    kinds = [hash_runs(b.buf, ws, we, lower=True)]
    for k in PREFIXES:
        kinds.append(mix(hash_runs(b.buf, ws, np.minimum(we, ws + k), lower=True) + U64(k)))
    at = np.arange(len(ws)) + PAD * np.repeat(np.arange(b.n), np.diff(first))
    out = np.zeros((len(ws) + PAD * b.n, len(kinds)), np.int32)
    for i, h in enumerate(kinds):
        out[at, i] = 1 + i * BUCKETS + (h % U64(BUCKETS)).astype(np.int64)
    return out, first + PAD * np.arange(b.n + 1)


@dataclass
class Classifier:
    table: np.ndarray
    weights: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    shift: float = 0.0
    slope: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Classifier:
        r = np.random.default_rng(seed)
        table = (r.standard_normal((1 + BUCKETS * (1 + len(PREFIXES)), DIM)) * 0.05).astype(np.float32)
        table[0] = 0
        weights = [(r.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        return cls(table, weights, [np.full(FILTERS, 0.02, np.float32) for _ in WIDTHS], (r.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32))

    def _answers(self, x: np.ndarray, i: int) -> np.ndarray:
        w = self.weights[i]
        s = x @ w[0] + self.bias[i]
        for j in range(1, len(w)):
            s[:-j] += x[j:] @ w[j]
        return s

    def logits(self, rows_: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.table[rows_].sum(axis=1)
        pooled = [np.maximum(np.maximum.reduceat(self._answers(x, i), first[:-1]), 0) for i in range(len(WIDTHS))]
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias

    def scores(self, b: Block) -> np.ndarray:
        if not b.n:
            return np.zeros(0)
        z = self.logits(*features(b)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.shift) + math.log(DECISION / (1 - DECISION)), -40, 40)))

    def fit(self, rows_: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        squares = np.full(len(self.table), 1e-6, np.float32)
        dense = [*self.weights, *self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        bias_moment = [0.0, 0.0]
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(c, BATCH // 2) for c in classes])  # as many of each class
            n = first[pick + 1] - first[pick]
            start = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(start[-1]) + np.repeat(first[pick] - start[:-1], n)
            own = rows_[at]
            x = self.table[own].sum(axis=1)
            place, pooled = [], []
            for i in range(len(WIDTHS)):
                s = self._answers(x, i)
                arg = np.stack([s[start[d] : start[d + 1]].argmax(axis=0) + start[d] for d in range(len(pick))])
                place.append(arg)
                pooled.append(np.maximum(s[arg, np.arange(FILTERS)], 0))
            p = np.concatenate(pooled, axis=1)
            z = p @ self.out + self.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[pick]).astype(np.float32) / len(pick)
            grads = [np.zeros_like(w) for w in self.weights] + [np.zeros_like(b) for b in self.bias] + [p.T @ g + 1e-4 * self.out]
            back = (g[:, None] * self.out[None, :]) * (p > 0)
            touched, change = [], []
            for i, w in enumerate(self.weights):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[len(WIDTHS) + i] += part.sum(axis=0)
                for j in range(len(w)):
                    where = np.minimum(place[i] + j, len(x) - 1)
                    grads[i][j] += np.einsum("dfk,df->kf", x[where], part)
                    touched.append(own[where].reshape(-1, own.shape[1]))
                    change.append((part[:, :, None] * w[j].T[None]).reshape(-1, DIM))
            ids, change = np.concatenate(touched), np.concatenate(change)
            keep = np.abs(change).sum(axis=1) > 0
            ids, change = ids[keep], change[keep]
            if len(ids):
                some, inverse = np.unique(ids.ravel(), return_inverse=True)
                total = np.zeros((len(some), DIM), np.float32)
                np.add.at(total, inverse, np.repeat(change, ids.shape[1], axis=0))
                total[some == 0] = 0
                squares[some] += (total**2).mean(axis=1)
                self.table[some] -= 0.1 * total / np.sqrt(squares[some])[:, None]
            for k, (param, grad, (m, v)) in enumerate(zip(dense, grads, moments, strict=True)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                param -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            gb = float(g.sum())
            bias_moment[0] += 0.1 * (gb - bias_moment[0])
            bias_moment[1] += 0.01 * (gb**2 - bias_moment[1])
            self.out_bias -= 0.01 * (bias_moment[0] / (1 - 0.9**step)) / (math.sqrt(bias_moment[1] / (1 - 0.99**step)) + 1e-7)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Between the two values that part the classes with the highest F1; in the middle of the widest such gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # equal values aren't parted
    top = np.flatnonzero(f1 == f1.max())
    below = np.append(z[1:], z[-1] - 2.0)
    k = top[np.argmax((z - below)[top])]
    return float((z[k] + below[k]) / 2)


def train(texts: list[str], y: list[int], langs: list[str | None], seed: int = 7) -> Classifier | None:
    y = np.asarray(y, np.int64)
    if y.sum() == 0 or y.sum() == len(y):
        return None
    model = Classifier.fresh(seed)
    r = np.random.default_rng(seed)
    back = r.random(len(y)) < 0.2  # kept back for the decision
    for c in (0, 1):
        if (back & (y == c)).sum() in (0, (y == c).sum()):
            back[:] = False  # too few to part
    rows_, first = features(block(pa.array(texts, pa.large_string())))
    fit_on = np.flatnonzero(~back)
    n = np.diff(first)[fit_on]
    at = np.concatenate([np.arange(first[d], first[d + 1]) for d in fit_on])
    model.fit(rows_[at], np.concatenate([[0], np.cumsum(n)]), y[fit_on], seed=seed)
    z = np.concatenate([model.logits(rows_[first[d] : first[d + 1]], np.array([0, first[d + 1] - first[d]])) for d in range(len(y))]).astype(np.float64)
    judged = back if back.any() else np.ones(len(y), bool)
    model.shift = best_cut(z[judged], y[judged])
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs]) & judged
        if 0 < y[own].sum() < own.sum():
            cut = model.slope * (best_cut(z[own], y[own]) - model.shift) + math.log(DECISION / (1 - DECISION))
            model.thresholds[lang] = float(1 / (1 + math.exp(-max(-40.0, min(40.0, cut)))))
    return model


def held_out(id: str):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", most: int = MOST_ROWS) -> Classifier | None:
    """On at most `most` rows of each class that aren't held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).filter(~held_out(id)).groupBy(id).agg(F.max(label).alias("y"))
    picked = [known.filter(F.col("y") == c).orderBy(F.xxhash64(F.col(id)), id).limit(most) for c in (0, 1)]
    sample = df.select(id, text, lang).join(picked[0].union(picked[1]), id).select(id, text, lang, "y").toPandas()
    sample = sample.sort_values([id, text], na_position="first").drop_duplicates(id)
    return train(sample[text].fillna("").tolist(), sample["y"].tolist(), [x if isinstance(x, str) else None for x in sample[lang]])


def score(df: DataFrame, model: Classifier | None, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, score, predicted (score >= DECISION), and flagged by the threshold of the document's language."""
    if model is None:
        scored = df.select(F.col(id), F.col(lang).alias("_lang"), F.lit(0.0).alias("score"))
        thresholds: dict[str, float] = {}
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
        thresholds = model.thresholds
        src = df.select(F.col(id), F.col(lang).alias("_lang"), F.col(text).alias("text"))
        scored = rows(src, lambda b, _: {"score": shared.value.scores(b)}, [("score", "double")], keep=[id, "_lang"], limit=256 << 10)
    by_lang = F.lit(DECISION)
    for k, v in thresholds.items():
        by_lang = F.when(F.col("_lang") == k, F.lit(v)).otherwise(by_lang)
    return scored.select(id, held_out(id).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), (F.col("score") >= by_lang).cast("int").alias("flagged"))
