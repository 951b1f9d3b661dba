"""SimHash near-duplicates: every fingerprint meets its neighbours in balls of half the radius.

Two fingerprints at most four bits apart have a variant in common that is at most two flips from each. The space of
variants is cut into buckets by a binary tree over bit positions: a bucket holds the variants with some bits fixed.
A fingerprint goes to just the buckets that hold one of its variants, those whose fixed bits are at most two flips
away, so a bucket's task sees a share of the fingerprints that shrinks as buckets are added. There it derives its
variants in the bucket, and fingerprints that share one are linked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import add_columns, query, release_memory, table, written
from offerloom.llm.components import connected_components, forest

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BUCKET_PRINTS = 2048  # fingerprints of a bucket's own; with two flips of the others' it sees some dozen times as many
SAMPLE_PRINTS = 1 << 20  # that the tree is built from on the driver, at most
SAMPLE_SHARE = 1 / 16  # and at most this share of all
LEAST_SAMPLE = 16  # of a bucket
MOST_PARTITIONS = 1 << 14
BROADCAST_IDS = 1_000_000  # of 8 bytes
SORT_ROWS = 1 << 20  # variants that a task holds in memory at a time


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, stops)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for b in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[b : b + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every document; fp is the unsigned fingerprint's bits as a long."""

    def compute(texts: list) -> dict:
        return {"fp": np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts)).view(np.int64)}

    return add_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), compute, "fp long").drop("text")


def _flips(free: list[int], most: int) -> np.ndarray:
    """Masks of up to *most* of the bits in *free*."""
    return np.array([sum(1 << i for i in bits) for r in range(most + 1) for bits in itertools.combinations(free, r)], np.uint64)


def _split_bit(prints: np.ndarray, mask: int) -> int | None:
    """The bit outside *mask* that halves the fingerprints best; None if they agree in all of these."""
    ones = np.array([int((prints >> np.uint64(i) & np.uint64(1)).sum()) if not mask >> i & 1 else 0 for i in range(64)])
    smaller = np.minimum(ones, len(prints) - ones)
    smaller[[i for i in range(64) if mask >> i & 1]] = 0
    return int(smaller.argmax()) if smaller.any() else None


class Buckets:
    """leaves[i]: (mask, bits) of bucket i; it holds the variants v with v & mask == bits."""

    def __init__(self, sample: np.ndarray, size: int) -> None:
        self.nodes: list[tuple[int, int, int]] = []  # bit, nodes for 0 and 1; bit -1: number of the bucket
        self.leaves: list[tuple[int, int]] = []
        self._build(sample, 0, 0, size)

    def _build(self, sample: np.ndarray, mask: int, bits: int, size: int) -> int:
        number = len(self.nodes)
        self.nodes.append((-1, len(self.leaves), 0))
        bit = _split_bit(sample, mask) if len(sample) > size else None
        if bit is None:
            self.leaves.append((mask, bits))
            return number
        one = (sample >> np.uint64(bit) & np.uint64(1)).astype(bool)
        self.nodes[number] = (bit, self._build(sample[~one], mask | 1 << bit, bits, size), self._build(sample[one], mask | 1 << bit, bits | 1 << bit, size))
        return number

    def route(self, prints: np.ndarray, flips: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of the fingerprints that have a variant of at most *flips* flips in it)."""
        stack = [(0, np.arange(len(prints)), np.zeros(len(prints), np.int8))]
        while stack:
            node, rows, used = stack.pop()
            bit, zero, one = self.nodes[node]
            if bit < 0:
                yield zero, rows
                continue
            x = (prints[rows] >> np.uint64(bit) & np.uint64(1)).astype(np.int8)
            for child, cost in ((zero, used + x), (one, used + 1 - x)):
                near = cost <= flips
                if near.any():
                    stack.append((child, rows[near], cost[near]))


def ball_edges(prints: np.ndarray, mask: int, bits: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest over the distinct fingerprints that share a variant v with v & mask == bits.

    Fingerprints that differ from *bits* in some fixed bits spend these flips on them and have the rest for free
    bits. Too many variants are cut in two by one more bit, so memory is bounded whatever the bucket holds.
    Fingerprints next to each other on one variant are within the radius, as each is half of it away.
    """
    half = radius // 2
    need = (prints ^ np.uint64(bits)) & np.uint64(mask)
    spent = np.bitwise_count(need)
    prints, need, spent = prints[spent <= half], need[spent <= half], spent[spent <= half]
    if len(prints) < 2:
        return prints[:0], prints[:0]
    free = [i for i in range(64) if not mask >> i & 1]
    sizes = [sum(math.comb(len(free), r) for r in range(half - c + 1)) for c in range(half + 1)]
    if sum(int((spent == c).sum()) * sizes[c] for c in range(half + 1)) > SORT_ROWS and (bit := _split_bit(prints, mask)) is not None:
        parts = [ball_edges(prints, mask | 1 << bit, bits | side << bit, radius) for side in (0, 1)]
        return forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    order = np.argsort(spent, kind="stable")
    prints, inside, spent = prints[order], (prints ^ need)[order], spent[order]
    variants, places = [], []
    for c in range(half + 1):
        own = np.flatnonzero(spent == c)
        variants.append((inside[own, None] ^ _flips(free, half - c)).ravel())
        places.append(np.repeat(own, sizes[c]))
    variant, place = np.concatenate(variants), np.concatenate(places)
    place_bits = np.uint64(max(1, (len(prints) - 1).bit_length()))
    place_mask = (np.uint64(1) << place_bits) - np.uint64(1)
    key = np.sort(variant * np.uint64(0x9E3779B97F4A7C15) & ~place_mask | place.astype(np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= place_mask)
    a, b = prints[(key[same] & place_mask).astype(np.int64)], prints[(key[same + 1] & place_mask).astype(np.int64)]
    if (np.bitwise_count(a ^ b) > radius).any():  # two variants with one shortened hash: sort the variants themselves
        order = np.argsort(variant, kind="stable")
        same = np.flatnonzero(variant[order[1:]] == variant[order[:-1]])
        a, b = prints[place[order[same]]], prints[place[order[same + 1]]]
    return forest(a, b)


def _deal(buckets: Buckets, flips: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            met = list(buckets.route(prints, flips))
            rows = np.concatenate([r for _, r in met]) if met else np.empty(0, np.int64)
            yield pd.DataFrame({"bucket": np.repeat(np.array([b for b, _ in met], np.int32), [len(r) for _, r in met]), "fp": prints[rows].view(np.int64)})

    return run


def _bucket_edges(buckets: Buckets, radius: int):
    leaves = buckets.leaves

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        a, b = ball_edges(pdf["fp"].to_numpy(np.int64).view(np.uint64), *leaves[int(key[0])], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def near_print_edges(classes: DataFrame, radius: int = RADIUS, bucket_prints: int = BUCKET_PRINTS) -> DataFrame:
    """(a, b) edges that connect all fingerprints (column fp, distinct) linked by at most *radius* bits.

    The tree of buckets comes from a bounded sample. A fingerprint is copied to 1 + d + d (d - 1) / 2 buckets, d being
    the depth of the tree, which grows with the logarithm of the fingerprints.
    """
    distinct = classes.count()
    share = min(SAMPLE_SHARE, SAMPLE_PRINTS / max(1, distinct))
    sample = np.empty(0, np.uint64)
    if distinct > bucket_prints:
        mixed = (F.xxhash64("fp").cast("double") + 2.0**63) / 2.0**64
        sample = classes.where(mixed < share).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    buckets = Buckets(sample, max(LEAST_SAMPLE, int(bucket_prints * share)))
    dealt = classes.select("fp").mapInPandas(_deal(buckets, radius // 2), "bucket int, fp long").repartition(min(len(buckets.leaves), MOST_PARTITIONS), "bucket")
    return dealt.groupBy("bucket").applyInPandas(_bucket_edges(buckets, radius), "a long, b long")


def simhash_groups(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every document of (doc_id, text).

    Fingerprints link at *radius* or fewer differing bits; component_id is the smallest doc_id reachable.
    Documents of one fingerprint are one class, so groups of copies add one fingerprint. Null, empty and
    blank texts have fingerprint 0 and link like any other. Rows that repeat an id are rows of their own.
    Null ids never name a group unless all its ids are null. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    prints = written(fingerprints(docs, words_per_shingle))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(near_print_edges(classes, radius))
    named = classes.join(roots.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    per_print = written(named.join(lowest, "root").select("fp", "component_id"))
    return prints.join(per_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The documents that are the smallest id of their group, with all columns.

    The ids to drop are counted: up to *broadcast_ids* they are broadcast and no text is shuffled, beyond that
    the join is left to the engine.

    Rows that repeat an id stay only once (the one whose columns hash lowest). Rows without an id cannot be
    named as copies and stay.
    """
    groups = simhash_groups(docs, words_per_shingle, radius)
    names = [f"`{x}`" for x in docs.columns]
    groups = written(groups)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    repeated = groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*names)
    repeated = written(repeated)
    if repeated.isEmpty():
        return kept
    whole = F.struct(*names)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*names).unionByName(once)


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
