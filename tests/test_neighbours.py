"""Nearest neighbours: recall against exact search at several sizes, and the cases a graph could get wrong."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours
from millrace.operators.neighbours import nearest

VECTORS = "vec_id long, embedding array<double>, label int"


def exact(ids, v, k):
    """By id: the others with the largest cosine, and the k-th one's."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    n = min(k, len(ids) - 1)
    best = np.argsort(-s, axis=1, kind="stable")[:, :n]
    return {i: (set(np.array(ids)[b].tolist()), s[r, b[-1]]) for r, (i, b) in enumerate(zip(ids, best, strict=True))}


def recall(rows, want):
    """Found at least as near as the k-th of the exact search; equal distances count alike."""
    got = {}
    for i, _, _, cosine in rows:
        got.setdefault(i, []).append(cosine)
    return np.mean([sum(c >= least - 1e-9 for c in got[i][:]) / len(best) for i, (best, least) in want.items()])


def test_recall_against_sql_at_the_tables_sizes(spark):
    import duckdb

    for folder in ("sf0.001", "sf0.1"):
        path = f"/root/testdata/{folder}/embeddings.parquet"
        rows = [tuple(r) for r in nearest(spark.read.parquet(path)).collect()]
        v = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall()
        ids = [r[0] for r in v]
        want = exact(ids, np.array([r[1] for r in v], dtype=float), 10)
        assert len(rows) == 10 * len(ids) and recall(rows, want) >= 0.95


def test_the_exact_search_is_that_of_sql():
    import duckdb

    path = "/root/testdata/sf0.001/embeddings.parquet"
    top = duckdb.sql(f"""
        SELECT a, b FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS r
        FROM '{path}' a JOIN '{path}' b ON a.vec_id <> b.vec_id AND a.vec_id < 40) WHERE r <= 10""").fetchall()
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall()
    want = exact([r[0] for r in v], np.array([r[1] for r in v], dtype=float), 10)
    found = {}
    for a, b in top:
        found.setdefault(a, set()).add(b)
    assert all(found[a] == want[a][0] for a in found) and len(found) == 40


def test_unclustered_vectors_and_rounds(spark):
    """The orders alone don't find them; rounds do."""
    gen = np.random.default_rng(1)
    v = gen.normal(size=(1500, 12))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], VECTORS)
    want = exact(list(range(len(v))), v, 10)
    first, last = (recall([tuple(r) for r in nearest(df, rounds=n).collect()], want) for n in (0, neighbours.ROUNDS))
    assert first < 0.95 < 0.99 <= last


def test_copies_ties_and_what_has_no_direction(spark):
    gen = np.random.default_rng(2)
    v = gen.normal(size=(30, 4))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(100 + i, v[3].tolist(), 0) for i in range(40)] + [(200, (v[4] * 2).tolist(), 0), (5, v[5].tolist(), 0)]
    rows += [(300, None, 0), (301, [0.0] * 4, 0), (302, [1.0, float("nan"), 0.0, 0.0], 0), (303, [1.0, None, 0.0, 0.0], 0), (304, [float("inf")] * 4, 0), (305, [], 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "node", "vector", "a", "b", "s", "rank", "cosine", "o", "born")})
    got = {}
    for r in sorted((tuple(r) for r in nearest(df, k=3).collect()), key=lambda r: (r[0], r[2])):
        got.setdefault(r[0], []).append(r[1:])
    assert sorted(got) == sorted({*range(30), *range(100, 140), 200})
    assert [x[0] for x in got[3]] == [100, 101, 102] and [x[0] for x in got[120]] == [3, 100, 101] and [x[0] for x in got[100]] == [3, 101, 102]
    assert got[4][0][0] == 200 and got[4][0][2] == pytest.approx(1)
    assert all([x[1] for x in found] == [1, 2, 3] and found[0][2] >= found[2][2] for found in got.values())


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 1.0], 0)], VECTORS)
    got = sorted((r.id, r.rank, r.neighbour) for r in nearest(df).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert nearest(df.where("vec_id = 1")).count() == 0 and nearest(df.limit(0)).count() == 0
