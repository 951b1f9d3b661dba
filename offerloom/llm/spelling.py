"""Spelling variants: range searches in k-d trees over letter counts, letter order verified.

An inserted or deleted letter moves a word's vector of letter counts by 1, a replaced one by at most 2 (sum of
absolute differences). So the near words of a word lie, for each length of at most one letter more or less, in a
small box of the tree of that length. Trees have two levels. The upper one is built on the driver from a bounded
sample of words; its leaves are cells. Every word is dealt as data to the one cell that holds it and as a query to
all cells its box touches, so searches are spread by cell and a cell is searched by a tree of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, small, table, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
DOMINANCE = 5  # a form is at least so many times as frequent
SLIP = 199  # of op12: one in so many pairs of document and word loses a letter
CELL_WORDS = 8192  # data words that one task searches at a time
CELL_QUERIES = 1 << 16
SAMPLE_WORDS = 50_000  # words that the upper trees are built from, on the driver
LEAST_SAMPLE = 8  # of a cell
LEAF = 48  # words of a cell's leaf
BATCH = 4096  # queries searched at a time
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on
PAIRS = 1 << 18  # compared at a time
DIMS = 32  # a to z, and six for the letters from U+00C0 on
MOST = 255  # counts beyond are cut to it, which makes no distance larger

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_DIM = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])


def _count(slip: int | None, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in small(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                found = Counter(_RUN.findall(lowered))
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    if slip and (h := zlib.crc32(word.encode(), seed)) % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = None) -> DataFrame:
    """(word, n) of the runs of Latin-1 letters in (doc_id, text), A-Z lower-cased, that are long and frequent enough.

    With *slip*, a run loses one letter where crc32("doc_id:run") is divisible by it: a stated source of typing
    errors. Null and empty texts have no words; a null id counts as an empty one; repeated rows count each.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(_count(slip, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Letter counts of Latin-1 words, a row each."""
    out = np.zeros((len(words), DIMS), np.int32)
    letters = np.frombuffer(b"".join(words), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(words)), [len(w) for w in words]), _DIM[letters]), 1)
    return np.minimum(out, MOST).astype(np.int16)


def _split(v: np.ndarray) -> tuple[int, int] | None:
    """(dimension, cut): values up to the cut go left; the dimension whose cut halves the rows best. None: all rows are equal."""
    middle = np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = np.where(middle == v.max(axis=0), middle - 1, middle)
    left = (v <= middle).sum(axis=0)
    balance = np.minimum(left, len(v) - left)
    dim = int(balance.argmax())
    return (dim, int(middle[dim])) if balance[dim] else None


class Tree:
    """k-d tree over vectors of letter counts. leaves[i]: the rows of a leaf of at most *size* rows, or of equal vectors.

    The boxes of the leaves cover all vectors once, also those that the tree was not built from.
    """

    def __init__(self, vectors: np.ndarray, size: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, cut, left, right; dimension -1: left is the leaf
        self.leaves: list[np.ndarray] = []
        self._build(vectors, np.arange(len(vectors)), max(1, size))

    def _build(self, v: np.ndarray, rows: np.ndarray, size: int) -> int:
        number = len(self.nodes)
        self.nodes.append((-1, 0, len(self.leaves), 0))
        cut = _split(v[rows]) if len(rows) > size else None
        if cut is None:
            self.leaves.append(rows)
            return number
        left = v[rows, cut[0]] <= cut[1]
        self.nodes[number] = (*cut, self._build(v, rows[left], size), self._build(v, rows[~left], size))
        return number

    def search(self, v: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of *v* within *radius* of its box); radius 0 gives each row its own leaf.

        A cut changes the distance from the box in one dimension only.
        """
        by_dim = np.ascontiguousarray(v.T)
        stack = [(0, np.arange(len(v)), np.zeros(len(v), np.int16), (0,) * DIMS, (MOST,) * DIMS)]
        while stack:
            node, rows, far, low, high = stack.pop()
            dim, cut, left, right = self.nodes[node]
            if dim < 0:
                yield left, rows
                continue
            x = by_dim[dim][rows]
            below = far + np.maximum(x - cut, 0) - np.maximum(x - high[dim], 0)
            above = far + np.maximum(cut + 1 - x, 0) - np.maximum(low[dim] - x, 0)
            for child, reached, ends in ((left, below, (low, (*high[:dim], cut, *high[dim + 1 :]))), (right, above, ((*low[:dim], cut + 1, *low[dim + 1 :]), high))):
                near = reached <= radius
                if near.any():
                    stack.append((child, rows[near], reached[near], *ends))


def _marks(v: np.ndarray) -> np.ndarray:
    """64 bits per vector: which letters occur, and which occur twice. Vectors differ by at least as much as their marks do in bits."""
    bits = np.concatenate([v >= 1, v >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of *a* and of *b* (letters, b as long as a or one longer) differ by exactly one letter."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :n], a != b[:, 1:]
    first = np.where(front.any(axis=1), front.argmax(axis=1), n)
    last = np.where(back.any(axis=1), n - 1 - back[:, ::-1].argmax(axis=1), -1)
    return last < first


def _hole_pairs(queries: list[bytes], data: list[bytes]) -> tuple[list[int], list[int]]:
    """The same for a large set of words with equal letter counts: words meet on what is left without one letter."""
    def without(w: bytes, hole: bytes) -> set[bytes]:
        return {w[:i] + hole + w[i + 1 :] for i in range(len(w))}

    rows, found = [], []
    length = len(data[0])
    for size, hole_q, hole_d in ((length, b"\0", b"\0"), (length + 1, b"", None), (length - 1, None, b"")):
        own = [i for i, w in enumerate(queries) if len(w) == size]
        if not own:
            continue
        places = defaultdict(list)
        for j, w in enumerate(data):
            for key in {w} if hole_d is None else without(w, hole_d):
                places[key].append(j)
        for i in own:
            w = queries[i]
            near = {j for key in ({w} if hole_q is None else without(w, hole_q)) for j in places.get(key, ()) if data[j] != w}
            rows += [i] * len(near)
            found += near
    return rows, found


class Cell:
    """Data words of one length with their tree."""

    def __init__(self, data: list[bytes]) -> None:
        self.data, self.length = data, len(data[0])
        self.letters = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), self.length)
        self.vectors = letter_counts(data)
        self.marks = _marks(self.vectors)
        self.tree = Tree(self.vectors, LEAF)

    def near(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(query, data) numbers of all pairs that are one edit apart."""
        sizes = np.array([len(w) for w in queries])
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for size in (self.length - 1, self.length, self.length + 1):
            own = np.flatnonzero(sizes == size)
            if len(own) and size:
                q, d = self._near([queries[i] for i in own], size)
                out.append((own[q], d))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _near(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        v = letter_counts(words)
        marks, radius = _marks(v), 2 if size == self.length else 1
        pairs, sure = [], []
        for leaf, rows in self.tree.search(v, radius):
            inside = self.tree.leaves[leaf]
            if len(rows) * len(inside) > PAIRS:
                i, j = _hole_pairs([words[r] for r in rows], [self.data[k] for k in inside])
                sure.append((rows[i], inside[j]))
            else:
                i, j = np.nonzero(np.bitwise_count(marks[rows][:, None] ^ self.marks[inside]) <= radius)
                pairs.append((rows[i], inside[j]))
        if pairs:
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            step = max(1, PAIRS // (self.length + DIMS))
            for b in range(0, len(i), step):
                q, d = i[b : b + step], j[b : b + step]
                close = np.abs(v[q] - self.vectors[d]).sum(axis=1) <= radius
                q, d = q[close], d[close]
                x, y = letters[q], self.letters[d]
                found = one_edit(x, y) if size <= self.length else one_edit(y, x)
                sure.append((q[found], d[found]))
        if not sure:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([s[0] for s in sure]), np.concatenate([s[1] for s in sure])


def _search(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words of one cell's queries: how many, and the most frequent (smallest in code-point order on ties)."""
    data = pdf[pdf["is_data"]].sort_values("word")
    asked = pdf[~pdf["is_data"]]
    d_words, q_words = [[w.encode("latin-1") for w in x["word"]] for x in (data, asked)]
    d_n = data["n"].to_numpy(np.int64)
    cell = Cell(d_words) if d_words else None
    parts = []
    for b in range(0, len(q_words) if cell else 0, BATCH):
        q, d = cell.near(q_words[b : b + BATCH])
        if not len(q):
            continue
        order = np.lexsort((d, -d_n[d], q))
        q, d = q[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        best = d[first]
        parts.append(pd.DataFrame({"word": asked["word"].to_numpy()[b + q[first]], "n_near": np.diff(np.append(first, len(q))), "form": data["word"].to_numpy()[best], "form_n": d_n[best]}))
    return pd.concat(parts) if parts else pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype=np.int64), "form": pd.Series(dtype=str), "form_n": pd.Series(dtype=np.int64)})


def _deal(trees: dict[int, tuple[int, Tree]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in range(0, len(pdf), BATCH):
                part = pdf.iloc[b : b + BATCH]
                words = [w.encode("latin-1") for w in part["word"]]
                sizes, v = np.array([len(w) for w in words]), letter_counts(words)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    for other, radius, is_data in ((size, 0, True), (size, 2, False), (size - 1, 1, False), (size + 1, 1, False)):
                        if other in trees:
                            first, tree = trees[other]
                            met = [(own[rows], first + leaf) for leaf, rows in tree.search(v[own], radius)]
                            at, cell = np.concatenate([m[0] for m in met]), np.repeat([m[1] for m in met], [len(m[0]) for m in met])
                            yield pd.DataFrame({"cell": cell, "is_data": is_data, "word": part["word"].to_numpy()[at], "n": part["n"].to_numpy()[at]})

    return run


def upper_trees(counted: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, tuple[int, Tree]]:
    """(number of the first cell, tree) per word length that occurs, from about *sample_words* words (those whose hashes are lowest)."""
    total = counted.count()
    share = min(1.0, sample_words / max(1, total))
    lengths = [r.length for r in counted.select(F.length("word").alias("length")).distinct().collect()]  # few: distinct word lengths
    chance = (F.xxhash64("word").cast("double") + 2.0**63) / 2.0**64
    sample = defaultdict(list)
    for r in counted.where(chance <= share).select("word").collect():
        sample[len(r.word)].append(r.word.encode("latin-1"))
    trees, cells = {}, 0
    for length in sorted(lengths):
        tree = Tree(letter_counts(sample[length]), max(LEAST_SAMPLE, int(cell_words * share)))
        trees[length] = cells, tree
        cells += len(tree.leaves)
        tree.leaves.clear()  # cells hold other words than the sample's
    return trees


def spelling_variants(counted: DataFrame, dominance: int = DOMINANCE, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n): distinct Latin-1 words with their counts.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. A word's form is its
    near word of largest n (smallest word on ties) if that is *dominance* times its own n or more; root follows
    forms to the last. A cell with more words than planned (equal letter counts cannot be cut) is searched in
    parts by several tasks, so no task holds more than about *cell_words* data words and CELL_QUERIES queries. Other
    columns are not read. An empty table gives an empty result.
    """
    counted = written(counted.select("word", "n"))
    dealt = written(counted.mapInPandas(_deal(upper_trees(counted, cell_words)), "cell long, is_data boolean, word string, n long"))
    sizes = dealt.groupBy("cell").agg(F.count_if("is_data").alias("data"), F.count_if(~F.col("is_data")).alias("queries"))
    sizes = sizes.select("cell", F.ceil(F.col("data") / cell_words).cast("int").alias("d_parts"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("q_parts")).where("d_parts > 0 AND q_parts > 0")
    own = lambda parts: F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    cut = dealt.join(F.broadcast(sizes), "cell")  # at most SAMPLE_WORDS / LEAST_SAMPLE cells and one per length
    cut = cut.withColumn("d_part", F.explode(F.when(F.col("is_data"), own("d_parts")).otherwise(every("d_parts"))))
    cut = cut.withColumn("q_part", F.explode(F.when(F.col("is_data"), every("q_parts")).otherwise(own("q_parts"))))
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = cut.select("cell", "d_part", "q_part", "is_data", "word", "n").repartition(parts, "cell", "d_part", "q_part").groupBy("cell", "d_part", "q_part")
    found = groups.applyInPandas(_search, "word string, n_near long, form string, form_n long")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form")).alias("best"))
    joined = counted.join(near, "word", "left")
    strong = F.col("best.form_n") >= dominance * F.col("n")
    named = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, F.col("best.form_n")).alias("form_n")))
    roots = _last_forms(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _last_forms(steps: DataFrame) -> DataFrame:
    """(word, root): chains followed to their ends, twice as far each round. Counts grow along a chain, so none is a circle."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spelling_variants(word_counts(docs, slip=SLIP))
