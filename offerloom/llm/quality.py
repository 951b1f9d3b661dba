"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on one binned feature at a time, then on the pairs of features that explain
most of what is left, adds up to one look-up table per feature and pair. A score is a sum of table cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import add_columns, held_out, keep_rows, query, share, table
from offerloom.llm.features import NAMES, features

SAMPLE_ROWS = 20_000  # labelled documents that the model is fitted on
BINS = 48
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 300
RATE = 0.1
PATIENCE = 20
RIDGE = 2.0
THRESHOLD = 0.7
_VALIDATION = 0.15


@dataclass
class Gam:
    """log odds = intercept + sum of tables[f][bin] + sum of the pairs' tables[bin, bin]."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, cells) in enumerate(zip(self.edges, self.tables)):
            out += cells[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, cells in self.pairs:
            out += cells[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step per bin of a tree of up to four leaves."""
    cuts = [0, len(g)]
    for _ in range(3):
        found = [(*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:])]
        gain, k, a = max(found)
        if gain <= 1e-9:
            break
        cuts = sorted({*cuts, a + k})
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step per cell): the best cut of the first feature with the best cuts of the second on both sides."""
    best, step = 0.0, np.zeros(g.shape)
    for k in range(1, g.shape[0]):
        cells, gain = np.zeros(g.shape), 0.0
        for rows in (slice(0, k), slice(k, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            more, c = _best_cut(gs, hs)
            gain += more + gs.sum() ** 2 / (hs.sum() + RIDGE)
            for cols in (slice(0, c), slice(c, None)) if c else (slice(None),):
                cells[rows, cols] = gs[cols].sum() / (hs[cols].sum() + RIDGE)
        if gain > best:
            best, step = gain, cells
    return best - g.sum() ** 2 / (h.sum() + RIDGE), step


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Gam:
    """Fit tables by cyclic boosting; a part of the rows decides when to stop. One class or no rows: a constant."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    model = Gam(float(np.log(prior / (1 - prior))), [_quantiles(x[:, f], BINS) for f in range(width)], [], [_quantiles(x[:, f], PAIR_BINS) for f in range(width)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n < 20 or y.min() == y.max():
        return model
    check = np.random.default_rng(seed).random(n) < _VALIDATION
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    odds = np.full(n, model.intercept)
    train = np.flatnonzero(~check)

    def slopes(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds[train]))
        return np.bincount(cells[train], y[train] - p, size), np.bincount(cells[train], p * (1 - p), size)

    def loss() -> float:
        rows = check if check.any() else ~check
        return float(np.mean(np.logaddexp(0, odds[rows]) - y[rows] * odds[rows]))

    def boost(cells: list[np.ndarray], tables: list[np.ndarray], step) -> None:
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for c, t in zip(cells, tables):
                move = RATE * step(*slopes(c, t.size), t.shape)
                t += move
                odds[:] += move.ravel()[c]
            now = loss()
            since = 0 if now < best - 1e-6 else since + 1
            if not since:
                best, kept = now, [t.copy() for t in tables]
            if since >= PATIENCE:
                break
        for c, t, k in zip(cells, tables, kept):
            odds[:] += (k - t).ravel()[c]
            t[:] = k

    boost(bins, model.tables, lambda g, h, shape: _tree(g, h))
    gains = []
    for f, g in itertools.combinations(range(width), 2):
        shape = (len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1)
        cells = coarse[f] * shape[1] + coarse[g]
        a, b = slopes(cells, shape[0] * shape[1])
        gains.append((_pair_tree(a.reshape(shape), b.reshape(shape))[0], f, g, shape, cells))
    chosen = sorted(gains, key=lambda z: -z[0])[:PAIRS]
    model.pairs = [(f, g, np.zeros(shape)) for _, f, g, shape, _ in chosen]
    boost([z[4] for z in chosen], [p[2] for p in model.pairs], lambda a, b, shape: _pair_tree(a.reshape(shape), b.reshape(shape))[1])
    return model


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"quality": pdf["quality"], "x": list(features(pdf["text"].tolist()))})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """Fit the model to at most *sample_rows* labelled documents of the learning folds (lowest id hashes first).

    The features of that bounded sample are what the driver fits the tables to. Null labels are left out.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated ids count once
    rows = texts.select("text", "quality").mapInPandas(_feature_rows, "quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r.quality, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(NAMES))
    order = np.random.default_rng(5).permutation(len(rows))
    return fit(x[order], np.array([r.quality for r in rows], np.float64)[order])


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """*docs* with score (0..1) for its column text and predicted (1 from THRESHOLD on).

    Texts are scored whole; null texts count as empty ones, which have a score like any other. Columns of
    *docs* named score or predicted are replaced.
    """
    shared = share(docs.sparkSession, (model.intercept, model.edges, model.tables, model.pair_edges, model.pairs))

    def compute(texts: list) -> dict:
        s = Gam(*shared.value).score(features(texts))
        return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return add_columns(docs, compute, "score double, predicted int")


def drop_poor(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of *threshold* or more. A model that has learned nothing drops nothing."""
    if not any(t.any() for t in model.tables):
        return docs
    shared = share(docs.sparkSession, (model.intercept, model.edges, model.tables, model.pair_edges, model.pairs))
    return keep_rows(docs, lambda texts: Gam(*shared.value).score(features(texts)) >= threshold)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
