"""Statistics of whole texts, computed per Arrow batch on the UTF-8 bytes.

``base_counts`` returns the plain counts of the quality rules; ``shape_vector`` the transformed
statistics that the classifiers use. Neither sees ids, labels, language or source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import LEAD, SPACE, SYMBOL, byte_class, counts_per_row, utf8

_ASCII_SPACE = " \t\n\v\f\r"
_DIGIT = byte_class(b"0123456789")
_UPPER = byte_class(bytes(range(65, 91)))
_PUNCT = byte_class(b".,;:!?'\"()-")
_NEWLINE = byte_class(b"\n")
_PIPE = byte_class(b"|")
_OTHER = byte_class(b"@#$%^&*_=+~<>{}[]\\/`")


def words_in(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words per row: bytes outside the six ASCII blanks that follow a blank or start a row."""
    return counts_per_row(word_starts(data, off), off)


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    blank = SPACE[data]
    start = np.empty(len(data), bool)
    if len(data):
        start[0] = True
        start[1:] = blank[:-1]
        start[off[:-1][off[:-1] < len(data)]] = True
    return start & ~blank


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_ASCII_SPACE)]
    return len(lines) - len(set(lines))


def word_ids(text: bytes) -> np.ndarray:
    """Dense ids of the words of one text, by first appearance."""
    words = text.split()
    ids = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more in the same text."""
    if len(ids) < 4:
        return 0
    v = int(ids.max()) + 1
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for d in range(3):
        covered[d:d + len(key)] |= twice
    return int(covered.sum())


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, off = utf8(texts)
    blank = SPACE[data]
    raw = data.tobytes()
    rows = [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    ids = [word_ids(x) for x in rows]
    return {
        "n_words": words_in(data, off),
        "word_chars": counts_per_row(LEAD[data] & ~blank, off),
        "n_symbols": counts_per_row(SYMBOL[data], off),
        "n_dup_lines": np.array([duplicate_lines(x.decode("utf-8", "replace")) for x in rows], np.int64),
        "n_repeat_words": np.array([repeated_words(x) for x in ids], np.int64),
        "n_distinct": np.array([int(x.max()) + 1 if len(x) else 0 for x in ids], np.int64),
        "n_adjacent": np.array([int((x[1:] == x[:-1]).sum()) for x in ids], np.int64),
        "n_top": np.array([int(np.bincount(x).max()) if len(x) else 0 for x in ids], np.int64),
        "n_bytes": off[1:] - off[:-1],
    }


SHAPE = ("log_words", "word_length", "long_word_share", "symbols", "pipes", "marks", "digits", "capitals", "punctuation",
         "lines", "adjacent_repeats", "top_share", "window_repeats", "distinct")


def shape_vector(texts: pa.Array) -> np.ndarray:
    """Rows of transformed statistics (``SHAPE``): log counts and logs of smoothed rates."""
    c = base_counts(texts)
    data, off = utf8(texts)
    n, chars = c["n_words"].astype(float), c["word_chars"].astype(float)
    rate = lambda k, of: np.log((k + 0.5) / (of + 50.0))
    starts = np.flatnonzero(word_starts(data, off))
    blanks = np.flatnonzero(SPACE[data])
    ends = np.minimum(np.concatenate([blanks, [len(data)]])[np.searchsorted(blanks, starts)],
                      off[np.searchsorted(off, starts, "right")] if len(starts) else 0)
    long_word = np.zeros(len(data), bool)
    long_word[starts[ends - starts > 12]] = True
    return np.column_stack([
        np.log1p(n), chars / np.maximum(n, 1), rate(counts_per_row(long_word, off), n), rate(c["n_symbols"], chars),
        rate(counts_per_row(_PIPE[data], off), n), rate(counts_per_row(_OTHER[data], off), chars),
        rate(counts_per_row(_DIGIT[data], off), chars), rate(counts_per_row(_UPPER[data], off), chars),
        rate(counts_per_row(_PUNCT[data], off), chars), rate(counts_per_row(_NEWLINE[data], off), n),
        rate(c["n_adjacent"], n), np.sqrt(c["n_top"] / np.maximum(n, 1)),
        np.sqrt(c["n_repeat_words"] / np.maximum(n, 1)), np.log((c["n_distinct"] + 1) / (n + 1)),
    ])
