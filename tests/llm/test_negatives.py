"""Hard negatives against brute force and against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import negatives
from offerloom.llm.negatives import Index, _rest_norms


def brute(rows, positives=5, negatives=3):
    out = set()
    rows = [(i, lab, np.array(v, np.int64)) for i, lab, v in rows]
    for a, label, v in rows:
        if a % 50:
            continue
        scored = [(-int(v @ w), i, other) for i, other, w in rows if i != a]
        near = sorted(x for x in scored if x[2] == label)[:positives]
        for ps, p, _ in near:
            fit = sorted(x for x in scored if x[2] != label and 50 * -ps <= -100 * x[0] <= 95 * -ps)[:negatives]
            out |= {(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit)}
    return out


def clustered(seed, n, dim, spread=0.6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    v = np.floor(64 * (base[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim)))).astype(int)
    return [(i, int(rng.integers(0, 4)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("seed, dim, shard, block", [(1, 16, 8192, 1024), (2, 16, 40, 3), (3, 3, 100, 5), (4, 64, 150, 4)])
def test_against_brute_force(spark, seed, dim, shard, block):
    rows = clustered(seed, 600, dim)
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(120)]  # a common vector
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, v array<int>, rank string")
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_anchors=block).collect()]
    want = brute(rows)
    assert want and len(got) == len(want) and set(got) == want


def test_threshold_search_finds_exactly_the_pairs():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (500, 20)) * (rng.random((500, 1)) ** 3 * 10).astype(int)
    q = rng.integers(-300, 300, (40, 20))
    index = Index(np.arange(500), np.zeros(500, int), x)
    true = q @ x.T
    for share in (0.9, 0.5, 0.1, 0.0, -1.0):
        least = share * np.sqrt((q**2).sum(1)) * index.largest()
        i, j, score = index.at_least(q[:, index.order], least)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(true >= least[:, None]))))
        assert (score == true[i, j]).all()
    assert np.allclose(_rest_norms(x)[:, 0], np.sqrt((x.astype(float) ** 2).sum(1))) and (_rest_norms(x)[:, -1] == 0).all()


def test_edge_cases(spark):
    rows = [
        (0, 1, [10.0, 0.0]), (1, 1, [10.0, 1.0]), (2, 2, [8.0, 0.0]), (3, 2, [7.0]), (4, 2, [7.0, 5.0]), (5, 2, [6.0, 0.0, 1.0]), (5, 2, [6.0, 0.0, 1.0]), (6, 2, [6.0, 9.0]), (7, None, [8.0, 0.0]), (8, 2, None),
        (None, 2, [8.0, 0.0]), (9, 2, [None, 1.0]), (10, 2, [float("nan"), 1.0]), (11, 2, [8.0, float("inf")]), (12, 2, [1e9, 0.0]), (50, 3, [1.0, 1.0]), (100, 4, [0.0, 0.0]), (101, 4, [5.0, 5.0]), (150, 5, []), (151, 5, [1.0]), (200, 6, [-5.0]), (201, 6, [5.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, v array<double>, zone int")
    anchor = F.col("vec_id") % 50 == 0
    got = {tuple(r) for r in negatives.hard_negatives(df, anchor).collect()}
    usable = {0: (1, [10, 0, 0]), 1: (1, [10, 1, 0]), 2: (2, [8, 0, 0]), 3: (2, [7, 0, 0]), 4: (2, [7, 5, 0]), 5: (2, [6, 0, 1]), 6: (2, [6, 9, 0]), 50: (3, [1, 1, 0]), 100: (4, [0, 0, 0]), 101: (4, [5, 5, 0]), 150: (5, [0, 0, 0]), 151: (5, [1, 0, 0]), 200: (6, [-5, 0, 0]), 201: (6, [5, 0, 0])}
    assert got == brute([(i, *v) for i, v in usable.items()])
    assert {r[:4] for r in got if r[0] == 0} == {(0, 1, 1, 2), (0, 1, 2, 3), (0, 1, 3, 4)}
    assert negatives.hard_negatives(df.limit(0), anchor).count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    frame = negatives.op13(spark, "/root/testdata/sf0.001")
    want = con.sql(negatives.SQL)
    assert frame.columns == want.columns
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got)) and set(got) == set(want.fetchall())
