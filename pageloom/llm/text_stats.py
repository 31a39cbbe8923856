"""Counts over the words and lines of whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:!?"
#: Words are runs of bytes other than these; ``bytes.split`` breaks at the same ones.
SPACES = b" \t\n\x0b\x0c\r"

COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct",
)


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(codes: np.ndarray, sizes: np.ndarray, span: int = 3) -> np.ndarray:
    """Words of each text that lie in a run of ``span`` words found twice or more there.

    ``codes`` number the words of all texts one after another, alike where the
    words are alike.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(codes) - span + 1
    if n < 1:
        return np.zeros(len(sizes), np.int64)
    inside = owner[:n] == owner[span - 1 :]
    runs = codes[:n].astype(np.int64)
    for k in range(1, span):  # pairs are numbered afresh, so the product stays small
        runs = pd.factorize(runs * (codes.max() + 1) + codes[k : n + k])[0]
    at = np.flatnonzero(inside)
    key = runs[at].astype(np.int64) * len(sizes) + owner[at]
    number = pd.factorize(key)[0]
    again = at[np.bincount(number)[number] > 1]
    covered = np.zeros(len(codes), bool)
    for k in range(span):
        covered[again + k] = True
    return np.bincount(owner[covered], minlength=len(sizes))


def counted(texts: list[str]) -> dict[str, np.ndarray]:
    """``COLUMNS`` for each text."""
    out = {c: np.zeros(len(texts), np.int64) for c in COLUMNS}
    words: list[bytes] = []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        own = data.split()
        words += own
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - _without(data, SPACES)
        for name, chars in (
            ("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGITS), ("n_stops", STOPS)
        ):
            out[name][i] = _without(data, chars)
        lines = [x for x in data.split(b"\n") if not x.isspace() and x]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_distinct"][i] = len(set(own))
    if words:
        column = np.empty(len(words), object)
        column[:] = words
        out["n_repeat_words"] = repeated_words(pd.factorize(column)[0], out["n_words"])
    return out
