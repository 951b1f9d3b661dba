"""A hierarchical navigable small-world graph over unit vectors, built and searched in whole batches.

Every layer is a proximity graph over a nested random subset of the nodes. A search descends through the upper
layers to an entry node and then walks the bottom layer with a beam per query; all queries of a batch take
their steps together, so a step is a few array operations.
"""

from __future__ import annotations

import numpy as np

SCALE = 16  # an upper layer holds one node in so many of the layer below
BATCH = 256
STEP = 4  # beam nodes expanded at once


def _diverse(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Per row of candidates, up to *keep* ids (-1: none): a candidate that is closer to a kept one than to
    the node itself only fills places that are left over."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    valid = np.isfinite(sims)
    rows, width = ids.shape
    mutual = np.matmul(v := vectors[ids], v.transpose(0, 2, 1))
    nearest = np.full((rows, width), -np.inf, np.float32)
    kept = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for j in range(width):
        take = valid[:, j] & (sims[:, j] > nearest[:, j]) & (count < keep)
        kept[:, j] = take
        count += take
        if take.any():
            nearest[take] = np.maximum(nearest[take], mutual[take, j, :])
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    pick = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(ids, pick, 1)
    out[~np.take_along_axis(valid, pick, 1)] = -1
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """links[l]: neighbours (-1: none) of the nodes of layer l, nodes[l]: their numbers; layer 0 holds all."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 1) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(SCALE)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")  # upper nodes first: a layer is a prefix of this order
        self.base = self.vectors[self.order]
        self.sizes = [n]
        while (k := int((level >= len(self.sizes)).sum())) > 1:
            self.sizes.append(k)
        self.links: list[np.ndarray] = []
        for k in self.sizes[1:]:
            self.links.append(self._exact(k, 2 * degree))
        self.bottom = np.full((n, 2 * degree), -1, np.int32)
        first = min(n, max(BATCH, self.sizes[1] if len(self.sizes) > 1 else 0))
        self.bottom[:first] = self._exact(first, 2 * degree)
        for begin in range(first, n, BATCH):
            self._insert(begin, min(n, begin + BATCH), degree, beam)

    def _exact(self, k: int, keep: int) -> np.ndarray:
        """Diverse neighbours among the first k nodes, found by comparing them all, in blocks."""
        out = np.full((k, keep), -1, np.int32)
        width = min(k - 1, 2 * keep)
        for b in range(0, k if width > 0 else 0, BATCH):
            e = min(k, b + BATCH)
            sims = self.base[b:e] @ self.base[:k].T
            sims[np.arange(e - b), np.arange(b, e)] = -np.inf
            ids = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            out[b:e] = _diverse(np.take_along_axis(sims, ids, 1), ids, self.base, keep)
        return out

    def _insert(self, b: int, e: int, degree: int, beam: int) -> None:
        queries = self.base[b:e]
        sims, ids = self._walk(queries, self._entries(queries), beam, b)
        inner = queries @ queries.T
        np.fill_diagonal(inner, -np.inf)
        near = np.argsort(-inner, axis=1)[:, : min(degree, e - b)]
        sims = np.concatenate([sims, np.take_along_axis(inner, near, 1)], 1)
        ids = np.concatenate([np.maximum(ids, 0), near + b], 1)
        chosen = _diverse(sims, ids, self.base, degree)
        self.bottom[b:e, :degree] = chosen
        source = np.repeat(np.arange(b, e), degree)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        self._reverse(source, target)

    def _reverse(self, source: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        cap = self.bottom.shape[1]
        extra = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(start, count)
        extra[np.repeat(np.arange(len(nodes)), count), place] = source
        for b in range(0, len(nodes), 512):
            own = nodes[b : b + 512]
            ids = np.sort(np.concatenate([self.bottom[own], extra[b : b + 512]], 1), axis=1)[:, ::-1]
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids = np.sort(ids, axis=1)[:, ::-1]
            full = (ids >= 0).sum(1) > cap
            new = ids[:, :cap].copy()
            if full.any():
                wide = ids[full][:, : int((ids[full] >= 0).sum(1).max())]
                sims = np.einsum("ij,ikj->ik", self.base[own[full]], self.base[np.maximum(wide, 0)])
                sims[wide < 0] = -np.inf
                new[full] = _diverse(sims, np.maximum(wide, 0), self.base, cap)
            self.bottom[own] = new

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """Entry nodes per query: greedy descent through the upper layers."""
        at = np.zeros(len(queries), np.int64)
        best = queries @ self.base[0]
        for links in reversed(self.links):
            moving = np.arange(len(queries))
            while len(moving):
                near = links[at[moving]]
                sims = np.einsum("ij,ikj->ik", queries[moving], self.base[np.maximum(near, 0)])
                sims[near < 0] = -np.inf
                j = sims.argmax(1)
                top = sims[np.arange(len(moving)), j]
                up = top > best[moving]
                moving, j, top, near = moving[up], j[up], top[up], near[up]
                at[moving], best[moving] = near[np.arange(len(moving)), j], top
        return at

    def _walk(self, queries: np.ndarray, entries: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, places), best first, of a beam search among the first *limit* nodes; -1: none."""
        m = len(queries)
        seen = np.zeros((m, limit + 1), bool)
        seen[:, limit] = True  # the place of absent neighbours
        ids = np.full((m, beam), limit, np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entries, np.einsum("ij,ij->i", queries, self.base[entries]), False
        seen[np.arange(m), entries] = True
        live = np.arange(m)
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            pick = np.argsort(-waiting, axis=1)[:, :STEP]
            open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
            done[live[:, None], pick] = True
            near = self.bottom[np.where(open_, ids[live[:, None], pick], 0)].astype(np.int64)
            near[~open_] = -1
            near = near.reshape(len(live), -1)
            near[(near < 0) | (near >= limit)] = limit
            near[seen[live[:, None], near]] = limit
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = limit
            seen[live[:, None], near] = True
            fresh = np.einsum("ij,ikj->ik", queries[live], self.base[np.minimum(near, len(self.base) - 1)])
            fresh[near == limit] = -np.inf
            all_sims = np.concatenate([sims[live], fresh], 1)
            all_ids = np.concatenate([ids[live], near], 1)
            all_done = np.concatenate([done[live], near == limit], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, order, 1)
            ids[live] = np.take_along_axis(all_ids, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1)
            live = live[~done[live].all(1)]
        ids[~np.isfinite(sims)] = -1
        return sims, ids

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, node numbers), best first, of the *beam* nearest nodes found per query; -1: none."""
        n = len(self.base)
        beam = min(beam, n)
        all_sims, all_ids = [], []
        for b in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[b : b + BATCH], np.float32)
            sims, ids = self._walk(q, self._entries(q), beam, n)
            all_sims.append(sims)
            all_ids.append(np.where(ids < 0, -1, self.order[np.maximum(ids, 0)]))
        return np.concatenate(all_sims), np.concatenate(all_ids)

    def dump(self) -> dict[str, bytes | list[int]]:
        return {"sizes": self.sizes, "links": b"".join(x.tobytes() for x in self.links), "bottom": self.bottom.tobytes(), "order": self.order.astype(np.int32).tobytes()}

    @classmethod
    def load(cls, vectors: np.ndarray, sizes: list[int], links: bytes, bottom: bytes, order: bytes) -> Graph:
        g = cls.__new__(cls)
        g.vectors = np.ascontiguousarray(vectors, np.float32)
        g.order = np.frombuffer(order, np.int32).astype(np.int64)
        g.base = g.vectors[g.order]
        g.sizes = list(sizes)
        n = len(g.order)
        g.bottom = np.frombuffer(bottom, np.int32).reshape(n, -1)
        width, at, g.links = g.bottom.shape[1], 0, []
        flat = np.frombuffer(links, np.int32)
        for k in g.sizes[1:]:
            g.links.append(flat[at : at + k * width].reshape(k, width))
            at += k * width
        return g
