"""Hard negatives: threshold searches with an inverted index, thresholds lowered until windows are full.

Rows are dealt to shards of a bounded size. A shard orders its dimensions by weight and knows for every row the
norm of its rest from each dimension on. For a threshold, the rest of a row that norms alone keep below it is left
out of the index: the list of a dimension holds the rows whose indexed part reaches it. A search accumulates
partial scores list by list, drops what the remaining norms cannot lift to the threshold, and verifies what is left
in whole numbers. Queries whose windows are not full go on with a lower threshold.

Anchors go in blocks against the shards: those of their own zone (a hash of the label) for positives, all for
negatives. A task holds one block and one shard. Each keeps its first rows per window; the first of all shards
follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.llm.common import query, table, written

SHARD_ROWS = 8192
BLOCK_ANCHORS = 1024
CHUNK = 128  # anchors searched at a time
STEP = 8  # dimensions accumulated between two prunings
LEVELS = (0.8, 0.5, 0.2)  # thresholds of positives, as shares of the largest possible score; then none
WINDOW_LEVELS = (0.7, 0.4, 0.0)  # of negatives, as places between the ends of the anchor's windows
LARGEST = 1 << 23  # of a component: 100 times a score of 1,000 dimensions fits a long

PACKED = "zone int, shard int, ids binary, labels binary, dims binary, values binary"


def pack_shard(keep: int):
    """Rows of one shard as arrays. Of rows with equal label and vector only the first *keep* by id can be in a result."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        raw = [np.asarray(v, np.int32) for v in pdf["v"]]
        again = pd.Series([v.tobytes() for v in raw], dtype=object)
        first = again.groupby([pdf["label"].to_numpy(), again], sort=False).cumcount().to_numpy() < keep
        raw = [v for v, f in zip(raw, first) if f]
        pdf = pdf[first]
        dims = np.array([len(v) for v in raw], np.int32)
        packed = {"ids": pdf["vec_id"].to_numpy(np.int64), "labels": pdf["label"].to_numpy(np.int64), "dims": dims, "values": np.concatenate([*raw, np.empty(0, np.int32)])}
        return pd.DataFrame([{"zone": key[0], "shard": key[1], **{n: a.tobytes() for n, a in packed.items()}}])

    return run


def unpack(dims: bytes, values: bytes, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled with zeros, which add nothing to a score."""
    dims = np.frombuffer(dims, np.int32)
    out = np.zeros((len(dims), max(width, dims.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < dims[:, None]] = np.frombuffer(values, np.int32)
    return out


def _rest_norms(values: np.ndarray) -> np.ndarray:
    """Norm of every row from each dimension on, and 0 behind the last."""
    squares = np.cumsum(np.square(values[:, ::-1], dtype=np.float64), axis=1)[:, ::-1]
    return np.sqrt(np.pad(squares, ((0, 0), (0, 1))))


class Index:
    """Threshold searches over the rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.labels = ids, labels
        self.order = np.argsort(-np.square(values, dtype=np.float64).sum(axis=0), kind="stable")
        self.values = values[:, self.order]
        self.floats = self.values.astype(np.float64)
        self.rest = _rest_norms(self.values)

    def largest(self) -> float:
        return float(self.rest[:, 0].max(initial=0.0))

    def at_least(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score is least[query] or more. *q*: whole numbers in the shard's order."""
        n, width = self.values.shape
        q_rest, q_floats = _rest_norms(q), q.astype(np.float64)
        slack = 0.5 + 1e-9 * q_rest[:, 0].max(initial=0.0) * self.largest()
        least = np.asarray(least, np.float64)
        covered = (least.min(initial=np.inf) - slack) / max(q_rest[:, 0].max(initial=0.0), 1e-300)  # a rest below this norm is left out
        indexed = (self.rest[:, :-1] >= covered).sum(axis=1)
        rows = np.argsort(-indexed, kind="stable")
        rows = rows[: np.count_nonzero(indexed)] if covered > 0 else rows
        partial = np.zeros((len(q), len(rows)))
        out_q, out_r = [], []

        def possible(at: int, columns: slice | np.ndarray) -> np.ndarray:
            return partial[:, columns] + q_rest[:, at, None] * self.rest[rows[columns], at] >= (least - slack)[:, None]

        for at in range(0, width, STEP):
            reach = int(np.searchsorted(-indexed[rows], -at, side="left"))  # the lists of these dimensions hold the first rows
            if reach < len(rows):
                i, j = np.nonzero(possible(at, slice(reach, None)))
                out_q.append(i)
                out_r.append(rows[reach + j])
                rows, partial = rows[:reach], partial[:, :reach]
            if not len(rows):
                break
            to = min(at + STEP, width)
            partial = partial + q_floats[:, at:to] @ self.floats[rows, at:to].T
            alive = possible(to, slice(None))
            some = alive.any(axis=0)
            if 20 * alive.sum() < alive.size:  # few pairs: verified one by one
                i, j = np.nonzero(alive)
                out_q.append(i)
                out_r.append(rows[j])
                rows = rows[:0]
                break
            rows, partial = rows[some], partial[:, some]
        if len(rows):
            i, j = np.nonzero(possible(width, slice(None)))
            out_q.append(i)
            out_r.append(rows[j])
        i, j = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (out_q, out_r))
        score = np.concatenate([np.einsum("ij,ij->i", q[i[b : b + 65536]], self.values[j[b : b + 65536]]) for b in range(0, max(1, len(i)), 65536)])
        sure = score >= least[i]
        return i[sure], j[sure], score[sure]

    def nearest(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the first *k* other rows of the query's label, by score, then id."""
        q = q[:, self.order]
        most = _rest_norms(q)[:, 0] * self.largest()
        found, todo = [], np.arange(len(q))
        for level in (*LEVELS, None):
            least = np.full(len(todo), -np.inf) if level is None else level * most[todo]
            i, j, score = self.at_least(q[todo], least)
            i = todo[i]
            ok = (self.labels[j] == labels[i]) & (self.ids[j] != ids[i])
            i, j, score = self._first(i[ok], j[ok], score[ok], k)
            done = np.bincount(i, minlength=len(q)) >= k if level is not None else np.ones(len(q), bool)
            found.append((i[done[i]], j[done[i]], score[done[i]]))
            todo = todo[~done[todo]]
            if not len(todo):
                break
        return tuple(np.concatenate(x) for x in zip(*found))

    def in_windows(self, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, row, score): the first *k* rows of other labels with low <= 100 * score <= high, per window.

        low, high: queries by windows; a window with low > high is empty.
        """
        q = q[:, self.order]
        real = low <= high
        bottom, top = np.where(real, low, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max), np.where(real, high, -1).max(axis=1, initial=-1)
        open_ = real.copy()
        found = []
        for level in WINDOW_LEVELS:
            todo = np.flatnonzero(open_.any(axis=1))
            if not len(todo):
                break
            least = np.ceil((bottom[todo] + level * (top[todo] - bottom[todo])) / 100) if level else np.floor(bottom[todo] / 100)
            i, j, score = self.at_least(q[todo], least)
            reached = np.full(len(q), np.inf)
            reached[todo] = 100 * least
            i = todo[i]
            other = self.labels[j] != labels[i]
            i, j, score = i[other], j[other], score[other]
            for w in range(low.shape[1]):
                ok = open_[i, w] & (low[i, w] <= 100 * score) & (100 * score <= high[i, w])
                wi, wj, ws = self._first(i[ok], j[ok], score[ok], k)
                full = np.bincount(wi, minlength=len(q)) >= k
                done = open_[:, w] & (full | (reached <= low[:, w]))
                found.append((wi[done[wi]], np.full(int(done[wi].sum()), w), wj[done[wi]], ws[done[wi]]))
                open_[done, w] = False
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(4))

    def _first(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        return i[place < k], j[place < k], score[place < k]


def _pair(r) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchors' vectors, ids, labels) of a row with a shard and a block of anchors; both get the same width."""
    x, q = unpack(r.dims, r.values), unpack(r.q_dims, r.q_values)
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    return Index(np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), x), q, np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_labels, np.int64)


def _find_positives(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                index, q, ids, labels = _pair(r)
                for b in range(0, len(q), CHUNK):
                    i, j, score = index.nearest(q[b : b + CHUNK], ids[b : b + CHUNK], labels[b : b + CHUNK], k)
                    yield pd.DataFrame({"anchor_id": ids[b + i], "positive_id": index.ids[j], "positive_score": score})

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                index, q, ids, labels = _pair(r)
                n = np.frombuffer(r.q_windows, np.int64)
                places, scores = (np.zeros((len(q), n.max(initial=0)), np.int64) for _ in range(2))
                real = np.arange(places.shape[1]) < n[:, None]
                places[real], scores[real] = np.frombuffer(r.q_positives, np.int64), np.frombuffer(r.q_scores, np.int64)
                lows, highs = np.where(real, low * scores, 1), np.where(real, high * scores, 0)
                for b in range(0, len(q), CHUNK):
                    part = slice(b, b + CHUNK)
                    i, w, j, score = index.in_windows(q[part], labels[part], lows[part], highs[part], k)
                    yield pd.DataFrame({"anchor_id": ids[b + i], "positive_id": places[b + i, w], "positive_score": scores[b + i, w], "negative_id": index.ids[j], "negative_score": score})

    return run


def _pack_windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors of one block, with their positives."""
    packed = pack_shard(1)(key, pdf.assign(label=np.arange(len(pdf)))).iloc[0].to_dict()  # one label each: no anchor goes
    pdf = pdf.sort_values("vec_id").reset_index(drop=True)
    packed["labels"] = pdf["label"].to_numpy(np.int64).tobytes()
    packed["windows"] = np.array([len(p) for p in pdf["positives"]], np.int64).tobytes()
    for name, field in (("positives", "positive_id"), ("scores", "positive_score")):
        packed[name] = np.array([p[field] for row in pdf["positives"] for p in row], np.int64).tobytes()
    return pd.DataFrame([packed])


def _met(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every shard with every block of its zone: both are copied to keys (zone, shard, block), so a hot zone is spread."""
    n_shards = shards.groupBy("zone").agg(F.max("shard").alias("last_shard"))
    n_blocks = blocks.groupBy("zone").agg(F.max("shard").alias("last_block"))
    left = shards.join(n_blocks, "zone").withColumn("block", F.explode(F.sequence(F.lit(0), "last_block"))).drop("last_block")
    names = [n for n in blocks.columns if n not in ("zone", "shard")]
    right = blocks.select("zone", F.col("shard").alias("block"), *[F.col(n).alias(f"q_{n}") for n in names]).join(n_shards, "zone")
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), "last_shard"))).drop("last_shard")
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["zone", "shard", "block"]
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each zone dealt to shards of about *size* rows by a hash of the id."""
    counts = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(counts, "zone").withColumn("shard", F.expr(f"int(pmod(xxhash64(vec_id), ceil(total / {size})))")).drop("total")


def _first_rows(rows: DataFrame, keys: Sequence[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, label, v) rows.

    v holds whole numbers; a score is the inner product with the anchor, higher first, ties by smaller vec_id.
    *anchor* tells the anchors. Their positives are the first *positives* other rows of their label; for each,
    the first *negatives* rows of other labels whose score lies between *low* and *high* percent of the positive's.

    Rows take no part if vec_id, label, v or a component is null or a component is LARGEST or more in size. Of rows
    that repeat a vec_id the one with the smallest label and vector takes part. Vectors of other length are
    compared as if filled with zeros. Anchors without positives, and windows without rows, have no result. Other
    columns are not read. An empty table gives an empty result.
    """
    plain = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    fits = F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < {LARGEST})")
    plain = written(plain.where(fits).withColumn("v", F.col("v").cast("array<int>")))
    repeated = plain.groupBy("vec_id").count().where("count > 1")
    if not repeated.isEmpty():
        plain = written(plain.groupBy("vec_id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("r")).select("vec_id", "r.*"))
    total = plain.count()
    zones = max(1, -(-total // shard_rows))
    zoned = plain.withColumn("zone", F.expr(f"int(pmod(xxhash64(label), {zones}))"))
    pack = lambda df, keep: df.groupBy("zone", "shard").applyInPandas(pack_shard(keep), PACKED)

    shards = written(pack(_dealt(zoned, shard_rows), positives + 1))
    anchors = zoned.where("is_anchor")
    blocks = written(pack(_dealt(anchors, block_anchors), 1 << 30))
    schema = "anchor_id long, positive_id long, positive_score long"
    near = _met(shards, blocks).mapInPandas(_find_positives(positives), schema)
    chosen = _first_rows(near, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most *positives*
    asked = anchors.select("vec_id", "label", "v").join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("zone", F.lit(0))

    everywhere = plain.withColumn("zone", F.lit(0))
    others = written(pack(_dealt(everywhere, shard_rows), negatives))
    asked = written(_dealt(asked, block_anchors).groupBy("zone", "shard").applyInPandas(_pack_windows, f"{PACKED}, windows binary, positives binary, scores binary"))
    hard = _met(others, asked).mapInPandas(_find_negatives(negatives, low, high), f"{schema}, negative_id long, negative_score long")
    first = _first_rows(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""


@query("op13_hard_negatives", SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    return hard_negatives(rows.where(finite).select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)
