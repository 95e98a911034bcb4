"""Line-first cleaning of documents by rules.

Every line is judged on its own (navigation, boilerplate, symbols, missing sentence end), failing lines are
removed, and a document that loses more than `max_loss` of its word characters is rejected, as is one that
fails the base rules on words and repetition.

Null and empty texts have no words and are rejected. Rows are independent, so ties, repeated rows and extra
columns (those named like a result column give way to it) need no care; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import U64, Block, hash_runs, mix, per_document, randoms, rows, tokens

# Whole words that mark a line as boilerplate, in lower case: phrases that hardly occur in prose, for lines of
# up to 25 words, and labels of buttons and links, which do, for lines of up to 6 words. English, German, French, Spanish.
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "we use cookies", "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter",
    "skip to content", "share this article", "follow us on", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "wir verwenden cookies", "cookies akzeptieren", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "nous utilisons des cookies", "accepter les cookies", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "utilizamos cookies", "aceptar cookies", "saltar al contenido",
)
LABELS = (
    "click here", "read more", "back to top", "log in", "sign in", "add to cart", "powered by",
    "hier klicken", "weiterlesen", "nach oben", "anmelden", "in den warenkorb",
    "cliquez ici", "lire la suite", "haut de page", "se connecter", "ajouter au panier",
    "haga clic aquí", "leer más", "volver arriba", "iniciar sesión", "añadir al carrito",
)
BOILERPLATE = [(p, 25) for p in PHRASES] + [(p, 6) for p in LABELS]
# What ends a sentence, what separates navigation entries, and the symbols of the base rule.
SENTENCE_END = b".!?:;\"')]}*_"
NAVIGATION = b"|>\\/"
SYMBOLS = b"#*$%&|<>"

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_SYMBOL, _IS_END, _IS_NAV, _IS_DIGIT = _set(SYMBOLS), _set(SENTENCE_END), _set(NAVIGATION), _set(b"0123456789")
_IS_END[0x80:] = True  # the last byte of any non-ASCII sign: closing quotes, ellipses and full stops of other scripts
_IN_WORD = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

FIELDS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines", "bigint"), ("n_bad_lines", "bigint"), ("lost_chars", "bigint"), ("clean_text", "string")]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its key occur again in its group; is it a later occurrence."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        joint = mix(keys ^ mix(group.astype(U64)))
        order = np.argsort(joint, kind="stable")
        same = joint[order][1:] == joint[order][:-1]
        again[order[1:][same]] = again[order[:-1][same]] = True
        later[order[1:][same]] = True
    return again, later


def measure(b: Block, max_loss: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> dict:
    ws, we, first = tokens(b)
    doc = per_document(first)
    n_words = np.diff(first)
    points = np.concatenate([[0], np.cumsum(_STARTS[b.buf], dtype=np.int64)])
    chars = points[we] - points[ws]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[b.buf], dtype=np.int64)])

    # words in 3-word windows found twice or more
    h = hash_runs(b.buf, ws, we)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        mult = randoms(3, seed=31)
        at = np.flatnonzero(inside)
        window = h[at] * mult[0] + h[at + 1] * mult[1] + h[at + 2] * mult[2]
        again, _ = _repeats(mix(window), doc[at])
        np.add.at(covered, at[again], 1)
        np.subtract.at(covered, np.minimum(at[again] + 3, len(h)), 1)
    n_repeat = _sums(np.cumsum(covered)[:-1] > 0, first)

    # lines with a word
    ls, le, _ = tokens(b, _NEWLINE)
    w0, w1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    has = w1 > w0
    ls, le, w0, w1 = ls[has], le[has], w0[has], w1[has]
    line_first = np.searchsorted(ls, b.start)
    line_doc = per_document(line_first)
    _, dup = _repeats(hash_runs(b.buf, ls, le), line_doc)
    words, cum = w1 - w0, np.concatenate([[0], np.cumsum(chars)])
    line_chars = cum[w1] - cum[w0]
    only = np.diff(line_first)[line_doc] == 1
    bad = _bad_lines(b, ls, le, we[w1 - 1] - 1 if len(ls) else np.zeros(0, np.int64), words, line_chars, symbols, only)
    lost = _sums(np.where(bad, line_chars, 0), line_first)
    word_chars = _sums(chars, first)
    failed = (n_words < min_words) | (n_repeat > max_repeat * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[b.start[1:]] - symbols[b.start[:-1]],
        "n_dup_lines": _sums(dup, line_first), "n_repeat_words": n_repeat, "base_failed": failed,
        "kept": ~failed & (lost <= max_loss * word_chars), "n_lines": np.diff(line_first), "n_bad_lines": _sums(bad, line_first), "lost_chars": lost,
        "_bad": (ls[bad], le[bad], line_doc[bad]),
    }


def _bad_lines(b: Block, ls, le, last, words, chars, symbols, only) -> np.ndarray:
    """A line fails if it is navigation (separators for every third word), mostly symbols and digits, a short
    line with a boilerplate phrase as whole words, or a short line (under 4 words) that neither ends a sentence nor is the
    document's only line."""
    if not len(ls):
        return np.zeros(0, bool)
    count = lambda table: (lambda c: c[le] - c[ls])(np.concatenate([[0], np.cumsum(table[b.buf], dtype=np.int64)]))
    nav = count(_IS_NAV)
    marks = symbols[le] - symbols[ls] + count(_IS_DIGIT)
    bad = ((nav >= 3) & (3 * nav >= words)) | ((marks > 5) & (3 * marks > chars))
    bad |= (words < 4) & ~_IS_END[b.buf[last]] & ~only
    low = b.buf.tobytes().lower()  # bytes.lower folds ASCII only
    for phrase, most in BOILERPLATE:
        raw = phrase.encode()
        at = low.find(raw)
        while at >= 0:
            end = at + len(raw)
            if not (at and _IN_WORD[low[at - 1]]) and not (end < len(low) and _IN_WORD[low[end]]):
                i = int(np.searchsorted(ls, at, "right")) - 1
                if i >= 0 and at < le[i] and words[i] <= most:
                    bad[i] = True
            at = low.find(raw, at + 1)
    return bad


def _clean(b: Block, bad: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list:
    """The texts without the failing lines (each with its line end)."""
    out, (ls, le, doc) = [], bad
    where = np.searchsorted(doc, np.arange(b.n + 1))
    for d in range(b.n):
        lo, hi = where[d], where[d + 1]
        at, parts = b.start[d], []
        for i in range(lo, hi):
            parts.append(b.buf[at : ls[i]].tobytes())
            at = min(le[i] + 1, b.start[d + 1])
        parts.append(b.buf[at : b.start[d + 1]].tobytes())
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


def quality_rules(df: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, clean: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df plus FIELDS; clean_text is the text without failing lines (left out if clean is false)."""

    def fn(b: Block, batch: pa.RecordBatch) -> dict:
        m = measure(b, max_loss, min_words, max_repeat)
        return m | ({"clean_text": pa.array(_clean(b, m["_bad"]), pa.string())} if clean else {})

    return rows(df, fn, FIELDS if clean else FIELDS[:-1], text, keep)
