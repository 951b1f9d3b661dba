"""Words of many texts at once: arrays of places, hashes and kinds, over code points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from offerloom.llm.common import HASH_BASE, hash_powers, worker_value

SLICE_CHARS = 1 << 18
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
PLACEHOLDERS = np.array([0, 11, 13, 17], np.uint64)  # canonical hash of every kind but LITERAL

# Words that are units when they follow a number.
UNITS = [
    "mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers", "centimetre", "centimetres", "centimeter", "centimeters", "inch", "inches", "ft", "foot", "feet",
    "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "tonne", "tonnes", "ton", "tons", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ml", "l", "litre", "litres",
    "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "degree",
    "degrees", "dollar", "dollars", "cent", "cents", "euro", "euros", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "volt", "volts", "watt", "watts", "kb", "mb", "gb", "tb", "byte", "bytes", "mph", "kmh",
]

_B1, _B2 = HASH_BASE, 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of every code point: 0 separator, 1 letter, 2 digit, 3 capital letter."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            kind[i] = 2 if c.isdigit() else 3 if c.isupper() else 1
            small = c.lower()
            if len(small) == 1:
                low[i] = ord(small)
    return kind, low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(_B2)
    return h ^ h >> np.uint64(29)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span: equal spans have equal hashes wherever they stand."""
    up, down = hash_powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of some texts in order. doc: text number; start, end: code points in the text; value: hash of
    the lower-cased word; kind: LITERAL, NUMBER, UNIT or NAME; canon: value, or one hash per other kind;
    capital: whether it has one capital in front, wherever it stands."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    canon: np.ndarray
    capital: np.ndarray


def words(texts: list[str]) -> Words:
    """Runs of letters or of digits (with points and commas between digits).

    A number is a run of digits, a unit one of UNITS behind a number, a name a word with one capital in front
    that does not begin a sentence or line.
    """
    kinds, lower = worker_value("word tables", None, _tables)
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    kind = kinds[points]
    mark = np.flatnonzero((points == 44) | (points == 46))
    mark = mark[(mark > 0) & (mark < len(points) - 1)]
    mark = mark[(kind[mark - 1] == 2) & (kind[mark + 1] == 2)]
    kind[mark] = 2
    group = np.where(kind == 3, 1, kind)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    stop = np.append(edge[1:], len(points))
    is_word = group[edge] > 0
    start, end = edge[is_word], stop[is_word]
    value = span_hashes(_mixed(lower[points].astype(np.uint64) + np.uint64(1)), start, end)
    first = kind[start]
    out = np.zeros(len(start), np.uint8)
    out[first == 2] = NUMBER
    capital = (first == 3) & ((end - start == 1) | (kind[np.minimum(start + 1, len(kind) - 1)] == 1))
    # the last visible character before a word tells whether it begins a sentence
    blank = (points == 32) | (points == 9)
    seen = np.maximum.accumulate(np.where(blank, -1, np.arange(len(points)))) if len(points) else np.empty(0, np.int64)
    before = np.where(start > 0, seen[start - 1] if len(start) else start, -1)
    mark_before = np.where(before >= 0, points[np.maximum(before, 0)], 10)
    out[capital & ~np.isin(mark_before, [10, 13, 33, 46, 58, 63])] = NAME
    units = worker_value("unit hashes", None, lambda: np.sort(_word_hashes(UNITS)))
    doc = np.searchsorted(stops, start, side="right")
    if len(out) > 1:
        follows = np.flatnonzero((out[:-1] == NUMBER) & (doc[1:] == doc[:-1]) & (out[1:] != NUMBER)) + 1
        out[follows[np.isin(value[follows], units)]] = UNIT
    canon = np.where(out == LITERAL, value, PLACEHOLDERS[out])
    begin = stops - (np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Words(doc, start - begin[doc], end - begin[doc], value, out, canon, capital)


def _word_hashes(plain: list[str]) -> np.ndarray:
    points = np.array([ord(c) for c in "".join(plain)], np.uint64)
    end = np.cumsum([len(w) for w in plain])
    return span_hashes(_mixed(points + np.uint64(1)), end - [len(w) for w in plain], end)


def windows(values: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of *size* words that lies in one text."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(_B1) + values[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return _mixed(h[at] + np.uint64(size)), at


def slices(texts: list[str | None], size: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) of about *size* characters each; null texts are empty."""
    at = 0
    while at < len(texts):
        begin, held, part = at, 0, []
        while at < len(texts) and (not part or held < size):
            part.append(texts[at] or "")
            held += len(part[-1])
            at += 1
        yield begin, part
