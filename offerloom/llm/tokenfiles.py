"""Token-id files: documents in ascending id order, each block of ids compressed by a Re-Pair grammar.

A file is a Parquet file, so commits, retries and any store that Spark writes to are Spark's business. A row is
a block: the ids and token counts of its documents, where it starts in its part, its rules with expansion
lengths, and its symbols (low 16 bits, then packed higher bits). Parts are ranges of document ids in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from offerloom.llm.common import query, shared_folder, small, table
from offerloom.llm.grammar import Decoder, compress
from offerloom.llm.tokens import default_path, encoder, ids_crc32

END_ID = 2
BLOCK_TOKENS = 1 << 19
FILE_SCHEMA = "part int, block int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, first long, rules binary, lengths binary, n_symbols long, symbols binary"
_FILE_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), *[(n, pa.int64()) for n in ("before", "n_tokens")], *[(n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_tokens")]]
    + [("first", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("n_symbols", pa.int64()), ("symbols", pa.binary())]
)


def pack_symbols(symbols: np.ndarray) -> bytes:
    """Low 16 bits of every symbol, then as many planes of packed higher bits as the largest symbol needs."""
    planes = max(0, int(symbols.max()).bit_length() - 16) if len(symbols) else 0
    parts = [(symbols & np.uint32(0xFFFF)).astype("<u2").tobytes()]
    parts += [np.packbits((symbols >> np.uint32(16 + b) & np.uint32(1)).astype(bool)).tobytes() for b in range(planes)]
    return b"".join(parts)


def unpack_symbols(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, "<u2", n).astype(np.uint32)
    width = (n + 7) // 8
    for b, at in enumerate(range(2 * n, len(data), width) if width else ()):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, width, at))[:n].astype(np.uint32) << np.uint32(16 + b)
    return out


def _encode_blocks(path: str, end_id: int, block_tokens: int):
    def block(part: int, number: int, before: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in docs])
        symbols, rules, lengths, first = compress(ids)
        row = {
            "part": part, "block": number, "before": before, "n_tokens": len(ids), "doc_ids": [d for d, _ in docs], "doc_tokens": [len(x) for _, x in docs], "first": first,
            "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "n_symbols": len(symbols), "symbols": pack_symbols(symbols),
        }
        return pa.RecordBatch.from_pylist([row], schema=_FILE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(path), TaskContext.get().partitionId()
        docs, held, number, before = [], 0, 0, 0
        for batch in small(batches):
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                begin, size = at, 0
                while at < len(texts) and (at == begin or size + len(texts[at]) < 1 << 20):
                    size += len(texts[at])
                    at += 1
                for name, ids in zip(names[begin:at], tokens.encode(texts[begin:at])):
                    docs.append((name, np.append(ids, np.uint32(end_id))))
                    held += len(ids) + 1
                    if held >= block_tokens:
                        yield block(part, number, before, docs)
                        docs, before, number, held = [], before + held, number + 1, 0
        if docs:
            yield block(part, number, before, docs)

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenise (doc_id, text) and write token files to *folder* in ascending doc_id order.

    Null and empty texts are the end id alone. Null ids come first; rows that repeat an id stand next to each
    other in an order fixed by their text. An empty table writes an empty folder of files.
    """
    path = path or default_path()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_encode_blocks(path, end_id, block_tokens), FILE_SCHEMA).write.parquet(folder)


def _decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
            decoder = Decoder(unpack_symbols(r["symbols"], r["n_symbols"]), rules, np.frombuffer(r["lengths"], "<u4").astype(np.int64), r["first"])
            counts = np.array(r["doc_tokens"], np.int64)
            stops = np.cumsum(counts)
            crc = [ids_crc32(decoder.read(b, e)) for b, e in zip((stops - counts).tolist(), stops.tolist())]
            columns = [r["doc_ids"], r["base"] + r["before"] + stops - counts, counts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    start counts the ids of all documents before it: within the block, before the block in its part, and in
    the parts before, of which there are as many as range partitions.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return blocks.join(F.broadcast(base), "part").mapInArrow(_decode_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_token_files")
def op8(spark, sf_dir):
    folder = shared_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
