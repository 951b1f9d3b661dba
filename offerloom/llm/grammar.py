"""Re-Pair grammars over token ids: frequent neighbouring pairs become nonterminals, round after round."""

from __future__ import annotations

import numpy as np

ROUNDS = 4
LEAST_COUNT = 12  # a rule pays off from about this count on
BUCKET_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, rounds: int = ROUNDS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, rules, lengths, first): symbols from *first* on are nonterminals.

    rules[k] holds the two symbols of nonterminal first + k and lengths[k] the ids it expands to. A round
    counts all pairs exactly, takes those that occur *least* times or more, and replaces them all; where two
    chosen pairs overlap, the more frequent one wins. One pair of each hash bucket is counted by its bucket,
    the pairs behind it in buckets that may hold another frequent one are sorted.
    """
    first = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.uint32)
    rules, lengths = [], []
    size_of = np.ones(first, np.int64)
    holder = np.zeros(1 << BUCKET_BITS, np.uint64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        pair = seq[:-1].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= seq[1:]
        bucket = (pair * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        at = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least)[bucket]).astype(np.int32)
        pair, bucket = pair[at], bucket[at]
        holder[bucket] = pair
        hit = holder[bucket] == pair
        behind = np.flatnonzero(~hit)
        behind = behind[(np.bincount(bucket[behind], minlength=1 << BUCKET_BITS) >= least)[bucket[behind]]]
        others, which, n_others = np.unique(pair[behind], return_inverse=True, return_counts=True)
        code = bucket.astype(np.int64)  # a number per distinct pair: its bucket, or behind the buckets
        code[behind] = which + (1 << BUCKET_BITS)
        hit[behind] = True
        at, code = at[hit], code[hit]
        count = np.concatenate([np.bincount(code[code < 1 << BUCKET_BITS], minlength=1 << BUCKET_BITS), n_others])
        hit = count[code] >= least
        at, code = at[hit], code[hit]
        if not len(at):
            break
        # a place wins over touching ones of lower count
        mine = count[code] << 40 | code
        touch = np.diff(at) == 1
        same = touch & (mine[1:] == mine[:-1])  # a run of one pair: every other place
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(at)), 0))
        win = (np.arange(len(at)) - begin) % 2 == 0
        win[1:] &= ~touch | same | (mine[1:] > mine[:-1])
        win[:-1] &= ~touch | (mine[:-1] >= mine[1:])
        at, code = at[win], code[win]
        present = np.zeros(len(count), bool)
        present[code] = True
        used = np.flatnonzero(present)
        place = np.zeros(len(count), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        number = place[code]
        base = len(size_of)
        chosen = np.concatenate([holder, others])[used]
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rules.append(np.stack([left, right], 1))
        lengths.append(size_of[left] + size_of[right])
        size_of = np.concatenate([size_of, lengths[-1]])
        seq[at] = (base + number).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    flat = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    sizes = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    return seq, flat, sizes, first


def expansions(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): nonterminal k expands to ids[ends[k] - lengths[k] : ends[k]]. Every level of rules at once."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    begin = ends - lengths
    done = np.zeros(len(rules), bool)
    while not done.all():
        ready = ~done
        for side in (0, 1):
            inner = rules[:, side] >= first
            ready &= ~inner | done[np.where(inner, rules[:, side].astype(np.int64) - first, 0)]
        at = begin[ready].copy()
        for side in (0, 1):
            symbol = rules[ready, side].astype(np.int64)
            plain = symbol < first
            out[at[plain]] = symbol[plain]
            k = symbol[~plain] - first
            size = lengths[k]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at[~plain], size) + step] = out[np.repeat(begin[k], size) + step]
            at += np.where(plain, 1, lengths[np.where(plain, 0, symbol - first)] if len(lengths) else 1)
        done |= ready
    return out, ends


class Decoder:
    """Random access to the ids of a compressed block through the expansion lengths of its symbols."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> None:
        self.symbols, self.first = symbols, first
        self.flat, ends = expansions(rules, lengths, first)
        size = np.ones(len(symbols), np.int64)
        inner = symbols >= first
        k = symbols[inner].astype(np.int64) - first
        size[inner] = lengths[k]
        self.begin = np.zeros(len(symbols), np.int64)
        self.begin[inner] = ends[k] - lengths[k]
        self.inner, self.size = inner, size
        self.upto = np.concatenate([[0], np.cumsum(size)])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the block; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a = int(np.searchsorted(self.upto, start, side="right")) - 1
        b = int(np.searchsorted(self.upto, stop, side="left"))
        size, inner = self.size[a:b], self.inner[a:b]
        out = np.empty(int(size.sum()), np.uint32)
        at = self.upto[a:b] - self.upto[a]
        out[at[~inner]] = self.symbols[a:b][~inner]
        n, to, src = size[inner], at[inner], self.begin[a:b][inner]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(src, n) + step]
        return out[start - self.upto[a] : stop - self.upto[a]]
