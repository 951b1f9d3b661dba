"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A worker tokenises its documents in order and packs them in loads of about LOAD_TOKENS, so memory is bounded
and nothing is shuffled. Within a load, documents go in descending length to the sequence of lowest estimated
cost (linear plus quadratic attention cost) that has capacity left, and are cut where it ends. Capacities
add up to the load exactly: full sequences, and one sequence for each power of two in the rest, which needs no
padding either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, small, table
from offerloom.llm.tokens import default_path, encoder, ids_crc32

SEQUENCE_TOKENS = 2048
END_ID = 1
LOAD_TOKENS = 2 << 20
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / 1024
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, length: int = SEQUENCE_TOKENS) -> list[int]:
    """Sizes of the sequences of a load: full ones, then the powers of two that make up the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], length: int = SEQUENCE_TOKENS, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) pieces that fill every sequence of `capacities` exactly.

    Stretches of a whole sequence are cut off long documents first: no other assignment of them is cheaper.
    The remainders go in descending length to the sequence of lowest cost with capacity left; what exceeds
    the capacity is cut off and goes on as a shorter remainder. Sequences shorter than full ones take
    what is left when all full ones are filled. Ties go by document, then sequence.
    """
    sizes = capacities(sum(lengths), length)
    pieces, waiting, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            pieces.append((d, start, length, sequence, 0))
            sequence += 1
        if n % length:
            waiting.append((-(n % length), d, n - n % length))
    heapq.heapify(waiting)
    full = total_full = len([s for s in sizes if s == length])
    open_ = [(0.0, s) for s in range(sequence, full)]
    used = dict.fromkeys(range(sequence, len(sizes)), 0)
    short = total_full
    while waiting:
        size, d, start = heapq.heappop(waiting)
        size = -size
        if not open_:
            open_.append((0.0, short))
            short += 1
        cost, s = heapq.heappop(open_)
        take = min(size, sizes[s] - used[s])
        pieces.append((d, start, take, s, used[s]))
        used[s] += take
        if used[s] < sizes[s]:
            heapq.heappush(open_, (cost + linear * take + quadratic * take * take, s))
        if take < size:
            heapq.heappush(waiting, (take - size, d, start + take))
    return pieces


def _pack_documents(path: str, end_id: int, length: int, load_tokens: int):
    def packed(docs: list[tuple[int | None, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        rows = [
            (docs[d][0], start, size, ids_crc32(docs[d][1][start : start + size]), len(docs[d][1]), first + s, offset)
            for d, start, size, s, offset in pack([len(ids) for _, ids in docs], length)
        ]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")]), max(r[5] for r in rows) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        first = TaskContext.get().partitionId() << 40
        load, held = [], 0
        for batch in small(batches):
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                begin, size = at, 0
                while at < len(texts) and (at == begin or size + len(texts[at]) < 1 << 20):
                    size += len(texts[at])
                    at += 1
                for name, ids in zip(names[begin:at], tokens.encode(texts[begin:at])):
                    load.append((name, np.append(ids, np.uint32(end_id))))
                    held += len(ids) + 1
                    if held >= load_tokens:
                        done, first = packed(load, first)
                        yield done
                        load, held = [], 0
        if load:
            yield packed(load, first)[0]

    return run


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = SEQUENCE_TOKENS, load_tokens: int = LOAD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    *path* names a vocabulary file of the tokenizers library. A document's ids are those of its whole text
    and the end id; null and empty texts are the end id alone. Every id lies in one piece, every sequence is
    filled from 0 without gaps, to *length* or a power of two. Rows that repeat an id, or have none, are
    packed as documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack_documents(path, end_id, length, load_tokens), PIECE_SCHEMA)


@query("op4_packing")
def op4(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
