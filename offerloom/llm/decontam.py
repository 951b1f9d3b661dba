"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of documents and benchmark items become typed placeholders. Windows of canonical
words meet in a hash join; along each diagonal of a document and an item every value of the item behind a
placeholder must stand for one value of the document (slot consistency), so a question with other numbers or
names is caught and a text that merely has the same form is not. Texts are read in four forms (FORMS), as a
capital at the start of a sentence or line does not tell a name and a copy can lose its capitals. A fixed-size
bit filter of the items' windows keeps other windows out of the shuffle; it never decides a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, share, small, table, written
from offerloom.llm.words import LITERAL, NAME, PLACEHOLDERS, Words, slices, windows, words

WINDOW = 8
LEAST_LITERALS = 4  # a window with fewer ordinary words is no evidence, unless it is the same word by word
# Typed as read; capitals that begin sentences are names too; only numbers and units are typed; word by word.
FORMS = TYPED, CAPITALS, NUMBERS, PLAIN = range(4)
_SALTS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
COVERAGE = 0.5  # share of an item's words that matching windows must cover
FILTER_BITS_PER_WINDOW = 32
LEAST_FILTER_BITS, MOST_FILTER_BITS = 20, 28  # log2; 32 MB at most

_ROWS = "item_id long, n_words int, form int, size int, place int, h long, slots array<long>"
_HITS = "row long, doc_id long, text_hash long, place int, size int, h long, slots array<long>"


def _kinds(w: Words, form: int) -> np.ndarray:
    """Kinds of the words as *form* reads them."""
    if form == CAPITALS:
        return np.where(w.capital & (w.kind == LITERAL), NAME, w.kind)
    if form == NUMBERS:
        return np.where(w.kind == NAME, LITERAL, w.kind)
    return w.kind if form == TYPED else np.zeros_like(w.kind)


def _form_windows(w: Words, kind: np.ndarray, form: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows with enough ordinary words; of all windows word by word."""
    h, at = windows(np.where(kind == LITERAL, w.value, PLACEHOLDERS[kind]), w.doc, size)
    h = h ^ _SALTS[form]
    if form == PLAIN:
        return h, at
    upto = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    good = upto[at + size] - upto[at] >= min(LEAST_LITERALS, size)
    return h[good], at[good]


def _slots(w: Words, kind: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Per window the values of its words behind placeholders, 0 for ordinary words."""
    value = np.where(kind == LITERAL, np.uint64(0), w.value | np.uint64(1)).view(np.int64)
    return list(value[at[:, None] + np.arange(size)]) if len(at) else []


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for item, text in zip(pdf["item_id"], pdf["text"]):
            w = words([text or ""])
            size = min(WINDOW, len(w.doc))
            if size < LEAST_LITERALS:
                continue
            for form in FORMS:
                kind = _kinds(w, form)
                h, at = _form_windows(w, kind, form, size)
                if not len(h):
                    continue
                yield pd.DataFrame({"item_id": item, "n_words": len(w.doc), "form": form, "size": size, "place": at.astype(np.int32), "h": h.view(np.int64), "slots": _slots(w, kind, at, size)})


def _bits(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter bits of every hash."""
    return (h >> np.uint64(64 - log2)).astype(np.int64), ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - log2)).astype(np.int64)


def _filter_words(log2: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bit in _bits(pdf["h"].to_numpy(np.int64).view(np.uint64), log2):
                yield pd.DataFrame({"place": bit >> 5, "bits": np.left_shift(np.int64(1), bit & 31)})

    return run


def _window_filter(items: DataFrame) -> np.ndarray:
    """Packed bit filter of the items' windows. Its size follows their number up to a fixed bound."""
    log2 = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (items.count() * FILTER_BITS_PER_WINDOW).bit_length()))
    out = np.zeros(1 << (log2 - 5), np.uint32)
    for r in items.select("h").mapInPandas(_filter_words(log2), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r.place] = r.bits
    return out


def _doc_hits(shared, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        log2 = len(bits).bit_length() + 4
        row = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            ids, texts, hashes = batch.columns
            for begin, part in slices(texts.to_pylist()):
                w = words(part)
                for form, size in product(FORMS, sizes):
                    kind = _kinds(w, form)
                    h, at = _form_windows(w, kind, form, size)
                    a, b = _bits(h, log2)
                    keep = (bits[a >> 5] >> (a & 31).astype(np.uint32) & 1 & (bits[b >> 5] >> (b & 31).astype(np.uint32))).astype(bool)
                    h, at = h[keep], at[keep]
                    if len(h):
                        doc = w.doc[at] + begin
                        first = np.searchsorted(w.doc, w.doc[at])
                        columns = [row + doc, ids.take(pa.array(doc)), hashes.take(pa.array(doc)), (at - first).astype(np.int32), np.full(len(at), size, np.int32), h.view(np.int64), pa.array(_slots(w, kind, at, size), pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["row", "doc_id", "text_hash", "place", "size", "h", "slots"])
            row += batch.num_rows

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage) of every document of (doc_id, text) that holds an item's text.

    coverage is the share of the item's words in windows that match slot by slot, in any of the forms. On a
    diagonal whose slots contradict each other only an unbroken copy, word by word, counts. Items shorter than a
    window are one window; items of fewer than LEAST_LITERALS words, null and empty texts hold no evidence. Repeated
    rows and null ids are documents of their own; an item that repeats under one id counts once. Empty tables
    give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInPandas(_item_windows, _ROWS))
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most WINDOW values
    shared = share(spark, _window_filter(items))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    hits = plain.mapInArrow(_doc_hits(shared, sizes), _HITS)
    own = items.select("item_id", "n_words", "form", "size", F.col("place").alias("item_place"), "h", F.col("slots").alias("item_slots"))
    met = hits.join(own, ["h", "size"]).withColumn("diagonal", F.col("place") - F.col("item_place"))
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != 0)
    of = lambda form, value: F.collect_set(F.when(F.col("form") == form, value))
    values = [F.array_distinct(F.flatten(of(f, pairs))).alias(f"pairs_{f}") for f in FORMS if f != PLAIN]
    run = met.groupBy("row", "doc_id", "text_hash", "item_id", "n_words", "diagonal").agg(*values, *[of(f, F.struct("item_place", "size")).alias(f"places_{f}") for f in FORMS])
    one = {f: F.size(f"pairs_{f}") == F.size(F.array_distinct(f"pairs_{f}.item_slots")) for f in FORMS if f != PLAIN}
    words_of = {f: F.array_distinct(F.flatten(F.transform(f"places_{f}", lambda p: F.sequence(p["item_place"], p["item_place"] + p["size"] - 1)))) for f in FORMS}
    whole = F.size(words_of[PLAIN]) == F.col("n_words")
    holds = {TYPED: one[TYPED], CAPITALS: one[TYPED] & one[CAPITALS], NUMBERS: one[TYPED] & one[NUMBERS], PLAIN: one[TYPED] & one[NUMBERS] | whole}
    covered = F.array_distinct(F.concat(*[F.when(holds[f], words_of[f]).otherwise(F.expr("array()").cast("array<int>")) for f in FORMS]))
    consistent = run.select("row", "doc_id", "text_hash", "item_id", "n_words", covered.alias("covered"))
    part = F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.max("n_words")
    found = consistent.groupBy("row", "doc_id", "text_hash", "item_id").agg(part.alias("coverage"))
    return found.where(F.col("coverage") >= coverage).select("doc_id", "text_hash", "item_id", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item, with all columns; told by id and text, so null ids work."""
    gone = written(contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct())
    here = [F.xxhash64(docs["text"]) == gone["_gone_hash"], docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"])]
    return docs.join(gone, here[0] & here[1], "left_anti")


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
