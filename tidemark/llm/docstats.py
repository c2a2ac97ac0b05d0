"""Statistics of whole texts, counted in numpy from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import map_column

#: Exact counts of a text, in the order of ``counts``.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What models see, in the order of ``features``: ratios and log sizes, never ids, labels, lang or source.
FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "symbols", "bangs", "bars", "digits", "stops",
    "lines", "dup_lines", "distinct", "repeated", "short_words", "non_ascii", "other_marks",
]

_SPACES = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")
_STOPS = list(b".,;:?")
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _SYMBOLS + _STOPS + [0x21]]


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """(distinct words, words in 3-word windows that the text holds twice or more)."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    k = len(seen)
    if len(words) < 4 or k > 2_000_000:  # k cubed must stay below 2**63
        pairs = _window_ids_by_steps(ids, k) if len(words) >= 4 else None
    else:
        pairs = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    if pairs is None:
        return k, 0
    order = np.argsort(pairs, kind="stable")
    ranked = pairs[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(pairs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(pairs)] |= twice
    return k, int(hit.sum())


def _window_ids_by_steps(ids: np.ndarray, k: int) -> np.ndarray:
    """Ids of 3-word windows without overflow: pairs are numbered first, then pairs with the third word."""
    _, pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
    _, triples = np.unique(pairs.astype(np.int64) * k + ids[2:], return_inverse=True)
    return triples


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of one whole text. Null counts as empty; an empty text is all zeros."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(octets[0x80:0xC0].sum())
    words = text.split()  # of bytes: at ASCII white space only
    n = len(words)
    word_chars = chars - int(octets[_SPACES].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    distinct, repeated = _repeated(words)
    symbols = int(octets[_SYMBOLS].sum())
    lower, upper = int(octets[0x61:0x7B].sum()), int(octets[0x41:0x5B].sum())
    per_word, per_char = 1.0 / max(n, 1), 1.0 / max(chars, 1)
    features = [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        word_chars * per_word,
        upper / max(lower + upper, 1),
        symbols * per_word,
        int(octets[0x21]) * per_word,
        int(octets[0x7C]) * per_word,
        int(octets[0x30:0x3A].sum()) * per_char,
        int(octets[_STOPS].sum()) * per_word,
        len(lines) * per_word,
        dup_lines / max(len(lines), 1),
        distinct * per_word,
        repeated * per_word,
        sum(len(w) <= 3 for w in words) * per_word,
        int(octets[0xC0:].sum()) * per_char,
        int(octets[_MARKS].sum()) * per_word,
    ]
    return [n, word_chars, symbols, dup_lines, repeated], features


def measured(rows: DataFrame, text: str, kept: list[str], finish, schema: str) -> DataFrame:
    """``kept`` of every row with what ``finish(counts, features)`` makes of a batch of texts.

    ``finish`` gets two numpy matrices and returns a dict of columns; ``schema`` is their DDL. Rows
    stay in their partitions, and a batch is all that a task holds at once.
    """

    def make(texts: list[bytes | None]) -> dict:
        counts = np.zeros((len(texts), len(COUNTS)), np.int64)
        features = np.zeros((len(texts), len(FEATURES)))
        for i, value in enumerate(texts):
            counts[i], features[i] = measure(value)
        return finish(counts, features)

    return map_column(rows, kept, F.col(text).cast("binary"), make, schema)
