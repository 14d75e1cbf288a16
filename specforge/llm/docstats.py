"""Statistics of one text that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.array([9, 10, 11, 12, 13, 32])
RUN = 8
_MIX = np.random.default_rng(5).integers(1, 1 << 63, RUN, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight words that stand in the text twice or more."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = own[:n] * _MIX[0]
    for j in range(1, RUN):
        window = window + own[j : j + n] * _MIX[j]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[inverse] >= 2
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + RUN, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[bytes, list[bytes], np.ndarray, list[bytes], int, int]:
    """The text's bytes, words, byte histogram, lines that hold a word, lines repeated, words in repeated windows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return raw, words, histogram, lines, len(lines) - len(set(lines)), repeated_words(words)


def rule_stats(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper."""
    raw, words, histogram, lines, again, repeated = base_counts(text)
    chars = len(raw) - int(histogram[128:192].sum())
    return len(words), chars - int(histogram[SPACES].sum()), int(histogram[SYMBOLS].sum()), again, repeated, len(lines), int(histogram[65:91].sum())


FEATURES = ("log_words", "log_chars", "word_length", "symbols", "upper", "digits", "stops", "commas", "marks", "bars", "newlines", "repeated_lines", "repeated_words", "distinct", "top_word", "short_words", "long_words", "high_bytes", "entropy", "line_words", "ends_with_stop", "word_length_spread", "distinct_lines", "other_marks")


def features(text: str | None) -> list[float]:
    """The statistics that the quality classifier reads; an empty text gives zeros."""
    raw, words, h, lines, again, repeated = base_counts(text)
    n, chars = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    length = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    p = h[h > 0] / chars
    stop = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [
        np.log1p(n), np.log1p(chars), length.mean(), h[SYMBOLS].sum() / n, h[65:91].sum() / chars, h[48:58].sum() / chars,
        h[46] / n, h[44] / n, h[[33, 63]].sum() / n, h[124] / n, h[10] / n, again / len(lines), repeated / n, len(counts) / n,
        max(counts.values()) / n, (length <= 3).mean(), (length >= 12).mean(), h[128:].sum() / chars, float(-(p * np.log2(p)).sum()),
        np.log1p(n / len(lines)), stop / len(lines), length.std(), (len(lines) - again) / len(lines), h[[34, 39, 40, 41, 58, 59, 95, 64]].sum() / n,
    ]
