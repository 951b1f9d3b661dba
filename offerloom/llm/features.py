"""Form features of whole texts, computed over slices of many texts at a time."""

from __future__ import annotations

import numpy as np

from offerloom.llm.tokens import span_hashes

NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "distinct", "repeated", "top_word", "caps_words", "symbol_ends", "stops", "line_words", "line_copies", "wide"]
SLICE_BYTES = 1 << 18

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _WIDE = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    for c in range(128):
        ch = chr(c)
        out[c] = _LOWER if ch.islower() else _UPPER if ch.isupper() else _DIGIT if ch.isdigit() else _SPACE if ch.isspace() else _STOP if ch in ".,;:?'\"()-" else _SYMBOL
    out[128:] = _WIDE
    return out


CLASSES = _classes()


def _runs(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct spans, and how often the most frequent one occurs."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    owner = (key[start] >> np.uint64(40)).astype(np.int64)
    size = np.diff(np.append(start, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=n).astype(np.float64), top


def _slice(raw: list[bytes]) -> np.ndarray:
    n = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, n) + 1
    stops = np.cumsum(sizes)
    cls = CLASSES[data]
    capital = np.zeros(len(data), bool)  # second byte of a Latin-1 capital
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = (cls == _UPPER) | capital

    def per_doc(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return (upto[stops] - upto[stops - sizes]).astype(np.float64)

    def spans(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(stops, start, side="right")

    start, end, doc = spans(cls == _SPACE)
    h = span_hashes(data, start, end)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = cls[end - 1] if len(end) else np.empty(0, np.uint8)
    long_word = end - start >= 3
    caps = long_word & upper[start + (cls[start] == _WIDE)] & upper[np.minimum(start + 2 + (cls[start] == _WIDE), len(data) - 1)]
    distinct, top = _runs(doc, h, n)
    l_start, l_end, l_doc = spans(data == 10)
    lines = np.bincount(l_doc, minlength=n).astype(np.float64)
    line_kinds, _ = _runs(l_doc, span_hashes(data, l_start, l_end), n)
    size = sizes - 1.0
    letters = np.maximum(per_doc((cls == _LOWER) | (cls == _UPPER)) + per_doc(cls == _WIDE) / 2, 1)
    width = np.maximum(size, 1)

    def words_where(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / some

    columns = [
        np.log1p(size), np.log1p(words), (size - per_doc(cls == _SPACE) + 1) / some, per_doc(upper) / letters, per_doc(cls == _DIGIT) / width, per_doc(cls == _SYMBOL) / width,
        per_doc(data == 33) / some, distinct / some, np.bincount(doc[1:][again], minlength=n) / some, top / some, words_where(caps), words_where(last == _SYMBOL),
        per_doc(data == 46) / some, words / np.maximum(lines, 1), 1 - line_kinds / np.maximum(lines, 1), per_doc(cls == _WIDE) / width,
    ]
    return np.stack(columns, 1)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES per text; a null text counts as empty."""
    out, at = [np.empty((0, len(NAMES)))], 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < SLICE_BYTES):
            raw.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            at += 1
        out.append(_slice(raw))
    return np.concatenate(out)
