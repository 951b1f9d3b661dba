"""Near-duplicate vectors: small-world graphs per shard, every shard queried, links verified, components united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import query, table, written
from offerloom.llm.components import connected_components, forest
from offerloom.llm.hnsw import BATCH, Graph

THRESHOLD = 0.93
SHARD_ROWS = 8192
FIRST_BEAM = 32
AUDIT_ROWS = 64
AUDIT_RECALL = 0.98
AUDIT_MOST = 1024
LEAST_LINKS = 32  # of audited queries that are evidence enough
SCAN_RATIO = 256  # a search of beam b costs about as much as a scan of this many times b nodes
SLACK = 1e-4  # of single-precision similarities

SHARD_SCHEMA = "label string, dim int, shard int, nodes binary, copies binary, vectors binary, sizes array<int>, links binary, bottom binary, order binary"


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per shard: its vectors and its graph."""
    pdf = pdf.sort_values("node")
    units = _units(np.array(pdf["vector"].tolist(), np.float64))
    first = pdf.iloc[0]
    parts = {"label": first["label"], "dim": first["dim"], "shard": first["shard"], "nodes": pdf["node"].to_numpy(np.int64).tobytes(), "copies": pdf["copies"].to_numpy(np.int64).tobytes(), "vectors": units.tobytes()}
    return pd.DataFrame([{**parts, **Graph(units).dump()}])


def _scan(q: np.ndarray, index: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(q @ index.T >= threshold)


def _linking(sims: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    return (ids >= 0) & (sims >= threshold - SLACK)


def _links_found(q: np.ndarray, index: np.ndarray, ids: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[int, int]:
    """(links, links found) of a few queries: an exact scan against the nodes that searches gave. *own*: their own nodes, no links."""
    links = q @ index.T >= threshold
    if own is not None:
        links[np.arange(len(q)), own] = False
    found = np.zeros(links.shape, bool)
    rows, cols = np.repeat(np.arange(len(q)), ids.shape[1]), ids.ravel()
    found[rows[cols >= 0], cols[cols >= 0]] = True
    return int(links.sum()), int((links & found).sum())


def _probes(index: np.ndarray, threshold: float) -> np.ndarray:
    """Up to AUDIT_ROWS vectors that just link with a node of the shard: nodes turned in a random direction."""
    nodes = index[np.unique(np.linspace(0, len(index) - 1, AUDIT_ROWS).astype(np.int64))]
    turn = np.random.default_rng(1).normal(size=nodes.shape)
    turn -= np.einsum("ij,ij->i", turn, nodes)[:, None] * nodes
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)  # in one dimension nothing is left to turn to
    cosine = min(1.0, threshold + 1e-6)
    return cosine * nodes + np.sqrt(1 - cosine * cosine) * turn


def _passes(graph: Graph, index: np.ndarray, q: np.ndarray, ids: np.ndarray, own: np.ndarray | None, beam: int, threshold: float) -> bool:
    """Whether searches of width *beam*, which gave *ids* for the queries *q*, find the links.

    Queries are scanned until LEAST_LINKS links are met, an eighth of the queries at most (and AUDIT_MOST). The
    searches must have found these links. Where there are fewer, they must also find those of the probes: vectors
    at the threshold from nodes of the shard, which are there whether the queries have links or not.
    """
    rows = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT_MOST, max(AUDIT_ROWS, len(q) // 8))).astype(np.int64))
    blocks = -(-len(rows) // AUDIT_ROWS)
    links = found = 0
    for k in range(blocks):
        some = rows[k::blocks]  # each block is spread over all queries
        more = _links_found(q[some], index, ids[some], threshold, None if own is None else own[some])
        links, found = links + more[0], found + more[1]
        if links >= LEAST_LINKS:
            break
    if found < AUDIT_RECALL * links:
        return False
    if links >= LEAST_LINKS:
        return True
    probes = _probes(index, threshold)
    sims, ids = graph.search(probes.astype(np.float32), beam)
    few = ~_linking(sims, ids, threshold)[:, beam // 2]
    links, found = _links_found(probes[few], index, ids[few], threshold)
    return links > 0 and found >= AUDIT_RECALL * links


def _beams(graph: Graph, index: np.ndarray, q: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node) pairs from beam searches, and the queries that need an exact scan.

    Every query searches the graph. At every width some of the open queries are audited (`_passes`); with *same*
    query i is node i, and finding itself is no evidence. The beam doubles until the audit passes. A query whose beam
    lies above the threshold by more than half may have more links, and with *same* one that does not find itself has
    lost its way: these stay open for wider beams and are no evidence either. Open queries without evidence, and beams
    that would hold an eighth of the shard or, after the first, cost more than comparing with all of it, are replaced
    by the exact scan.
    """
    n = len(index)
    q32 = q.astype(np.float32)
    todo, beam = np.arange(len(q)), FIRST_BEAM
    got_q, got_i = [], []
    while len(todo) and beam < n // (8 if beam == FIRST_BEAM else SCAN_RATIO):
        sims, ids = graph.search(q32[todo], beam)
        near = _linking(sims, ids, threshold)
        unsure = near[:, beam // 2]
        if same:
            unsure |= ~(ids == todo[:, None]).any(axis=1)
        audit = np.flatnonzero(~unsure)
        if not len(audit):
            break
        passed = _passes(graph, index, q[todo[audit]], ids[audit], todo[audit] if same else None, beam, threshold)
        beam *= 2
        if not passed:
            continue
        rows, cols = np.nonzero(near & ~unsure[:, None])
        got_q.append(todo[rows])
        got_i.append(ids[rows, cols])
        todo = todo[unsure]
    qs = np.concatenate(got_q) if got_q else np.empty(0, np.int64)
    ns = np.concatenate(got_i) if got_i else np.empty(0, np.int64)
    sure = np.einsum("ij,ij->i", q[qs], index[ns]) >= threshold
    return qs[sure], ns[sure], todo


def shard_links(graph: Graph, index: np.ndarray, q: np.ndarray, copies_index: np.ndarray, copies_q: np.ndarray, same: bool, threshold: float = THRESHOLD):
    """(links per query, links per node, forest a, forest b) between the queries and the shard's nodes.

    Queries are numbered 0.., nodes len(q).. in the forest; with *same* both are the shard's own vectors
    and every pair counts once. Links are counted, never listed for more than a block of queries.
    """
    qs, ns, rest = _beams(graph, index, q, threshold, same)
    m = len(q)
    base = 0 if same else m
    count_q, count_n = np.zeros(m, np.int64), np.zeros(len(index), np.int64)
    edges_a, edges_b = [], []
    scanned = np.zeros(m, bool)
    scanned[rest] = True
    extra_q, extra_n = [qs], [ns]
    for b in range(0, len(rest), BATCH):
        r, c = _scan(q[rest[b : b + BATCH]], index, threshold)
        r = rest[b : b + BATCH][r]
        if same:
            r, c = r[r != c], c[r != c]
            back = ~scanned[c]
            extra_q.append(c[back])
            extra_n.append(r[back])
        np.add.at(count_q, r, copies_index[c])
        if not same:
            np.add.at(count_n, c, copies_q[r])
        fa, fb = forest(r, c + base)
        edges_a.append(fa)
        edges_b.append(fb)
    qs, ns = np.concatenate(extra_q), np.concatenate(extra_n)
    if same:
        apart = qs != ns
        qs, ns = qs[apart], ns[apart]
        mirrored = ~scanned[ns]  # found from one end only, perhaps
        qs, ns = np.concatenate([qs, ns[mirrored]]), np.concatenate([ns, qs[mirrored]])
        key = np.unique(qs * np.int64(len(index)) + ns)
        qs, ns = key // len(index), key % len(index)
    np.add.at(count_q, qs, copies_index[ns])
    if not same:
        np.add.at(count_n, ns, copies_q[qs])
    edges_a.append(qs)
    edges_b.append(ns + base)
    a, b = forest(np.concatenate(edges_a), np.concatenate(edges_b))
    return count_q, count_n, a, b


def _search_pairs(threshold: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                index = np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim)
                q = np.frombuffer(r.q_vectors, np.float64).reshape(-1, r.dim)
                graph = Graph.load(index, r.sizes, r.links, r.bottom, r.order)
                nodes, q_nodes = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.q_nodes, np.int64)
                same = r.shard == r.q_shard
                count_q, count_n, a, b = shard_links(graph, index, q, np.frombuffer(r.copies, np.int64), np.frombuffer(r.q_copies, np.int64), same, threshold)
                names = q_nodes if same else np.concatenate([q_nodes, nodes])
                counts = count_q if same else np.concatenate([count_q, count_n])
                yield pd.DataFrame({"node": names, "links": counts, "other": None})[counts > 0].astype({"other": "Int64"})
                yield pd.DataFrame({"node": names[a], "links": np.int64(0), "other": pd.array(names[b], "Int64")})

    return search


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept.

    Vectors of equal, non-null label and equal length link at a cosine (double precision) of *threshold* or
    more. Equal vectors are one class with a count; classes are dealt to shards of about *shard_rows*; every
    shard has a graph, and every shard of a label is queried with every class of that label. A task returns
    link counts and a forest, so a group of copies costs its size, not its square, in rows.

    Null, zero or non-finite vectors, null labels: a row with no links. Rows that repeat an id count as
    vectors of their own. A null id has a null component when alone. Empty input gives an empty result.
    Other columns of the input, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.expr("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    rows = raw.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.col("vector")))
    classes = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dim"), "vector", "low", "copies"))
    members = written(rows.join(classes.select("label", "vector", "node"), ["label", "vector"], "left").select("vec_id", "node"))

    totals = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("total"))
    dealt = classes.join(totals, ["label", "dim"]).withColumn("shard", F.expr(f"int(pmod(xxhash64(node), ceil(total / {shard_rows})))"))
    dealt = dealt.select("node", "label", "dim", "shard", "vector", "copies").repartition(int(parts), "label", "dim", "shard")
    shards = written(dealt.groupBy("label", "dim", "shard").applyInPandas(build_shard, SHARD_SCHEMA))
    queries = shards.select("label", "dim", F.col("shard").alias("q_shard"), *[F.col(x).alias(f"q_{x}") for x in ("nodes", "copies", "vectors")])
    pairs = shards.join(queries, ["label", "dim"]).where("q_shard >= shard").repartition(int(parts), "label", "dim", "shard", "q_shard")
    found = written(pairs.mapInPandas(_search_pairs(threshold), "node long, links long, other long"))

    roots = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "low", "copies").join(counts, "node", "left").join(roots.select(F.col("id").alias("node"), "component"), "node", "left")
    named = written(named.select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    per_node = named.join(lowest, "root").select("node", "n_links", "component_id")
    out = members.join(per_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


@query("op3_embedding_near_dedup")
def op3(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
