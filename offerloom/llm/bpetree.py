"""Byte-level BPE as a tree reduction over two nested monoids, and decoding by concatenation up the tree.

Matches. An element is a stretch of text with the list of pattern matches it has when it stands alone. A text is
halved down to leaves; two neighbours are joined by matching again from the last match of the left one that the
right one can change, until a match ends where a match of the right one ends. The pattern looks at nothing
behind a match, so all later matches of the right one hold.

Tokens. An element is a byte string with its token ids. Two neighbours are joined by encoding a window of tokens
around the boundary again; the window grows on the side whose outer pair of tokens does not fit. Two tokens fit
if their bytes, encoded alone, give these two tokens. A token list whose neighbours all fit is the encoding of
its bytes: the first merge over a boundary would also happen in the pair alone, as merges are chosen by rank,
leftmost first, and those inside the two tokens come in the same order in both. So the tokens outside the
window are final as soon as both outer pairs fit.
"""

from __future__ import annotations

import base64
import heapq
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, small, table, worker_value

LEAF_CHARS = 4096  # of a text
LEAF_BYTES = 48  # of a match
REACH = 2  # a match that ends this far before the end of a stretch cannot be changed by what follows
KNOWN_PIECES = 150_000  # encoded matches, twice, and token pairs that a worker remembers
SMALL_BYTES = 64  # characters of the longest piece that is remembered
DECODE_IDS = 4096  # of a leaf


class TreeEncoder:
    """Encodes and decodes with the ranks of a vocabulary file (base64 bytes and rank a line) and a pattern.

    Every single byte must have a rank, and the pattern must match at every place of a text without looking
    behind it. leaf_chars and leaf_bytes only set how deep the trees go.
    """

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.no_rank = max(self.token) + 1
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # the generation before, from which pieces that come again are taken over
        self._fits: dict[tuple[int, int], bool] = {}

    # Tokens of one match

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short byte string: the pair of lowest rank is merged first, leftmost on ties."""
        if len(data) > 2 * SMALL_BYTES:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks, none = self.ranks, self.no_rank
        known = ranks.get
        pairs = [known(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            whole = parts[at] = parts[at] + parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = known(whole + parts[at + 1], none)
            if at:
                pairs[at - 1] = known(parts[at - 1] + whole, none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs and a linked list of parts, for windows that had to grow."""
        n, ranks = len(data), self.ranks
        stop = list(range(1, n + 1))  # end of the part that begins at i
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n

        def pair(i: int) -> int | None:
            j = stop[i]
            return ranks.get(data[i : stop[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if not alive[i] or j >= n or stop[j] != end:
                continue
            alive[j] = 0
            stop[i] = end
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, stop[stop[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : stop[i]]])
            i = stop[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= KNOWN_PIECES:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        i = j = 0  # tokens of the window on either side
        window: list[int] = []
        while True:
            first = window[0] if window else (right[j] if j < len(right) else None)
            last = window[-1] if window else (left[len(left) - i - 1] if i < len(left) else None)
            bad_left = i < len(left) and first is not None and not self.fits(left[len(left) - i - 1], first)
            bad_right = j < len(right) and last is not None and not self.fits(last, right[j])
            if not bad_left and not bad_right:
                return left[: len(left) - i] + window + right[j:]
            if bad_left:
                i = min(len(left), max(1, 2 * i))
            if bad_right:
                j = min(len(right), max(1, 2 * j))
            window = self.merge(b"".join(map(self.token.__getitem__, left[len(left) - i :] + right[:j])))

    def reduce_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.reduce_bytes(data[:middle]), self.reduce_bytes(data[middle:]))

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one match, packed; a match that is itself a token is that token."""
        packed = self._pieces.get(piece) or self._older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            packed = _pack([whole] if whole is not None else self.reduce_bytes(data))
        if len(piece) <= SMALL_BYTES:
            if len(self._pieces) >= KNOWN_PIECES:
                self._older, self._pieces = self._pieces, {}
            self._pieces[piece] = packed
        return packed

    # Matches of one text

    def reduce_text(self, text: str, begin: int, end: int) -> tuple[list[int], list[bytes]]:
        """(ends, packed ids) of the matches of text[begin:end] as if it stood alone."""
        if end - begin <= max(2, self.leaf_chars):
            pieces = self.pattern.findall(text, begin, end)
            known = self._pieces.get
            return list(accumulate(map(len, pieces), initial=begin))[1:], [known(p) or self.encode_piece(p) for p in pieces]
        middle = (begin + end) // 2
        return self._join_text(text, begin, middle, end, self.reduce_text(text, begin, middle), self.reduce_text(text, middle, end))

    def _join_text(self, text: str, begin: int, middle: int, end: int, left: tuple, right: tuple) -> tuple[list[int], list[bytes]]:
        ends, ids = left
        r_ends, r_ids = right
        keep = bisect_right(ends, middle - REACH)
        at = ends[keep - 1] if keep else begin
        new_ends, new_ids, skip = [], [], 0
        while at < middle or (at > middle and (skip == 0 or r_ends[skip - 1] != at)):
            stop = self.pattern.match(text, at, end).end()
            skip = bisect_right(r_ends, stop)
            new_ids.append(self._piece_over(text, at, stop, middle, ends, ids, r_ends, r_ids))
            new_ends.append(stop)
            at = stop
        return ends[:keep] + new_ends + r_ends[skip:], ids[:keep] + new_ids + r_ids[skip:]

    def _piece_over(self, text: str, start: int, stop: int, middle: int, ends: list, ids: list, r_ends: list, r_ids: list) -> bytes:
        """Ids of a match; a long one made of a match on either side of the boundary is joined from their ids."""
        if stop - start > self.longest and start < middle < stop and ends and r_ends and ends[-1] == middle and r_ends[0] == stop:
            last = len(ends) - 1
            if start == (ends[last - 1] if last else start):
                return _pack(self.join(self._tokens(ids[last]), self._tokens(r_ids[0])))
        return self.encode_piece(text[start:stop])

    def _tokens(self, packed: bytes) -> list[int]:
        ids = np.frombuffer(packed, "<u4").tolist()
        return ids if len(ids) > 1 else self.merge(self.token[ids[0]])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.reduce_text(text, 0, len(text))[1])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of the ids, concatenated up a balanced tree."""
        ids = np.frombuffer(packed, "<u4")

        def up(begin: int, end: int) -> bytes:
            if end - begin <= DECODE_IDS:
                return b"".join(map(self.token.__getitem__, ids[begin:end].tolist()))
            middle = (begin + end) // 2
            return up(begin, middle) + up(middle, end)

        return up(0, len(ids))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encoder(path: str, pattern: str) -> TreeEncoder:
    return worker_value("tree encoder", (path, pattern), lambda: TreeEncoder(path, pattern))


def _with_column(rows: DataFrame, source: str, out: str, compute) -> DataFrame:
    """*rows* with a binary column *out* that compute() gives for each value of *source*, batch by batch."""
    rest = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = batch.column(batch.schema.get_field_index(source)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([compute(v) for v in values], pa.binary())], names=[*batch.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{kept}, {out} binary")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """*docs* with column ids: the token ids of every whole text, little-endian unsigned 32-bit integers.

    *path* names a vocabulary file of base64 bytes and ranks, *pattern* what splits texts first. Null texts are
    empty, empty texts have no ids. Rows that repeat are encoded each; other columns pass through, a column of
    the name ids is replaced. An empty table gives an empty result.
    """
    return _with_column(docs.withColumn("text", F.col("text").cast("string")), "text", "ids", lambda text: _encoder(path, pattern).encode(text or ""))


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """*coded* with column decoded: the bytes that ids stand for; null ids are none. A clashing column is replaced."""
    return _with_column(coded, "ids", "decoded", lambda ids: _encoder(path, pattern).decode(ids or b""))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op11_bpe_tree")
def op11(spark, sf_dir):
    path, pattern = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    coded = encode_documents(docs, path, pattern).select("doc_id", "ids")
    both = decode_documents(coded, path, pattern)
    n = F.expr("cast(octet_length(ids) div 4 as long)")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
