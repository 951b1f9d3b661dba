"""Token ids of whole texts with the tokenizers library, one library call per distinct word of a worker.

Texts are cut, in UTF-8 bytes, only where a byte-level BPE pre-tokenizer of the GPT-2 kind always starts a new
piece: before a run of white space, after a lone white space other than a blank, and between an ASCII letter,
digit or symbol and a neighbour of another class (not behind an apostrophe, whose contractions span classes).
Encoding the pieces one by one therefore gives the ids of the whole text. Added tokens of the vocabulary can
span pieces, so a text that holds the content of one is encoded whole. Pieces repeat, so each distinct one
is encoded once and found again by its 64-bit hash; the table of known pieces has a fixed size.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

from offerloom.llm.common import hash_powers, worker_value

SLICE_BYTES = 1 << 18
TABLE_BITS = 21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_LETTER, _DIGIT, _SPACE, _SYMBOL, _WIDE = 1, 2, 3, 4, 0


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[128:] = _WIDE
    for c in range(128):
        ch = chr(c)
        if ch.isalpha():
            out[c] = _LETTER
        elif ch.isdigit():
            out[c] = _DIGIT
        elif ch in " \t\n\r\x0b\x0c":
            out[c] = _SPACE
        elif c < 32 or c == 127:
            out[c] = _WIDE
    return out


CLASSES = _classes()
VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span [start, end) of *data*; equal bytes give equal hashes wherever they stand."""
    up, down = hash_powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= MULTIPLIER
    h ^= h >> np.uint64(29)
    return h


def piece_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces start: at every document and at every safe cut inside documents."""
    cls = CLASSES[data]
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        prev, here = cls[:-1], cls[1:]
        space = here == _SPACE
        cut[1:] = space & (prev != _SPACE)
        both = (prev != _WIDE) & (here != _WIDE) & (prev != here) & ~space & (prev != _SPACE)
        cut[1:] |= both & (data[:-1] != 39)
        if n > 2:
            lone = (cls[:-2] != _SPACE) & (cls[1:-1] == _SPACE) & (data[1:-1] != 32) & (cls[2:] != _SPACE)
            cut[2:] |= lone
    cut[doc_starts[doc_starts < n]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Token ids of texts. *path* names the vocabulary file of the tokenizers library."""

    def __init__(self, path: str, table_bits: int = TABLE_BITS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        contents = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.bits = table_bits
        self._reset()

    def _reset(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.slots = np.zeros(size, np.int32)
        self.known = 0
        self.ids = np.empty(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 12, np.int64)
        self.odd = np.zeros(1 << 12, bool)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known piece, -1 for unknown ones (linear probing, all probes of a step at once)."""
        mask = (1 << self.bits) - 1
        at = self._home(h)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            k = self.keys[at]
            same = k == h[open_]
            out[open_[same]] = self.slots[at[same]]
            go = ~same & (k != 0)
            open_, at = open_[go], at[go]
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = self._home(h)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[at[todo]] == 0
            first = np.unique(at[todo][free], return_index=True)[1]
            won = todo[free][first]
            self.keys[at[won]] = h[won]
            self.slots[at[won]] = numbers[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & mask

    def _add(self, texts: list[str], h: np.ndarray) -> np.ndarray:
        lists = self._library(texts)
        numbers = np.arange(self.known, self.known + len(texts))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint16)
        ends = np.cumsum([len(x) for x in lists]) + (self.ends[self.known - 1] if self.known else 0)
        need = self.known + len(texts)
        if need > len(self.ends):
            grow = max(need, 2 * len(self.ends)) - len(self.ends)
            self.ends = np.concatenate([self.ends, np.zeros(grow, np.int64)])
            self.odd = np.concatenate([self.odd, np.zeros(grow, bool)])
        if int(ends[-1]) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(int(ends[-1]), 2 * len(self.ids)) - len(self.ids), np.uint16)])
        begin = int(ends[-1]) - len(flat)
        self.ids[begin : begin + len(flat)] = flat
        self.ends[self.known : need] = ends
        # A piece with other white space at an edge may hide a longer run: its document is encoded whole.
        self.odd[self.known : need] = [_odd(t) for t in texts]
        self._insert(h, numbers)
        self.known = need
        return numbers

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of every text, in order."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            raw, size, begin = [], 0, at
            while at < len(texts) and (size < SLICE_BYTES or not raw):
                raw.append(texts[at].encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                at += 1
            out.extend(self._slice(texts[begin:at], raw))
        return out

    def _slice(self, texts: list[str], raw: list[bytes]) -> list[np.ndarray]:
        if self.known > (1 << self.bits) * 6 // 10:
            self._reset()
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts = piece_starts(data, bounds[:-1])
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        number = self._find(h).astype(np.int64)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.known + len(new) > (1 << self.bits) * 9 // 10:  # a slice of mostly new pieces: no table
                return [np.asarray(x, np.uint32) for x in self._library(texts)]
            pick = missing[first]
            added = self._add([joined[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[pick].tolist(), ends[pick].tolist())], new)
            number[missing] = added[back]
        stop = self.ends[number]
        begin = np.where(number > 0, self.ends[number - 1], 0)
        count = stop - begin
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])].astype(np.uint32)
        cut = upto[np.searchsorted(starts, bounds)]
        odd = np.array([self.added is not None and self.added.search(t) is not None for t in texts], bool)
        if (o := np.flatnonzero(self.odd[number])).size:
            odd[np.searchsorted(bounds, starts[o], side="right") - 1] = True
        return [np.asarray(self._library([texts[i]])[0], np.uint32) if odd[i] else ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _odd(piece: str) -> bool:
    """Whether white space at an edge of the piece could belong to a longer run than the byte classes show."""
    body = piece[1:] if piece[:1] == " " else piece
    if not body:
        return True
    if body.isspace():
        return len(body) > 1 or piece[:1] == " " or ord(body) > 127
    return body[0].isspace() or body[-1].isspace() or any(ord(c) > 127 and c.isspace() for c in body) or "\x1c" <= min(body) <= "\x1f"


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for *path*; it is kept for later tasks of the same worker."""
    return worker_value("encoder", path, lambda: PieceEncoder(path))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
