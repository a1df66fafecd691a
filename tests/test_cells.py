"""Vector joins over cells against brute force, on clustered vectors and on vectors spread at random."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells
from corpusloom.operators import retrieval as R


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "CELL", 60)
    monkeypatch.setattr(cells, "TILE", 25)


def clustered(seed=1, n=900, groups=30, dim=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    m = centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))
    m[:40] = m[40]  # a group of equal vectors
    m[50:53] = 0
    return m.astype(np.float32)


def table(spark, m):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(len(m), None)]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(3)


def cosine(a, b):
    a, b = a.astype(float), b.astype(float)
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    s = a @ b.T
    return np.round(np.divide(s, norm, out=np.zeros_like(s), where=norm > 0), 6) + 0.0


def nearest(m, ask, k):
    s = cosine(m[ask], m)
    s[np.arange(len(ask)), ask] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return sorted((q, r + 1, int(i), float(s[j, i])) for j, q in enumerate(ask) for r, i in enumerate(order[j]) if i != q)


@pytest.mark.parametrize("kind", ["clustered", "spread"])
def test_knn_is_exact_and_prunes(spark, small, kind):
    m = clustered() if kind == "clustered" else np.random.default_rng(2).standard_normal((300, 12)).astype(np.float32)
    vectors, ask = table(spark, m), [i for i in range(len(m)) if i % 7 == 0 or i in (50, 51)]
    queries = vectors.where(F.col("id").isin(ask)).withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in R.knn(queries, vectors, 10).collect())
    assert got == nearest(m, ask, 10)
    if kind == "clustered":
        centres, members, count = cells.index(vectors.where("v IS NOT NULL"))
        first = cells.assign(queries.select(F.col("query_id").alias("id"), "v"), centres).withColumn("x", F.lit(None).cast("double"))
        found = cells.meet(members, first, count, partial(cells._nearest, k=10, same=False), cells.FOUND)
        asked = [r.cell for r in first.collect()] + [r.cell for r in cells.visits(R.reached(first, found, 10), centres, count).collect()]
        assert sum(count[c][0] for c in asked if c in count) < 0.6 * len(ask) * len(m)


def test_knn_of_few_or_no_vectors(spark, small):
    m = clustered(n=100)[40:60]
    vectors = table(spark, m)
    queries = vectors.withColumnRenamed("id", "query_id")
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in R.knn(queries, vectors, 50).collect()) == nearest(m, list(range(20)), 50)
    assert R.knn(queries, vectors.limit(0), 3).count() == 0 and R.knn(queries.limit(0), vectors, 3).count() == 0
    assert R.knn_lsh(queries, vectors.limit(0), 3).count() == 0 and R.near_dup_pairs(vectors.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("threshold", [0.85, 0.99])
def test_near_dup_pairs_are_exact(spark, small, threshold):
    m = clustered()
    vectors = table(spark, m)
    got = sorted((r.a, r.b, r.score) for r in R.near_dup_pairs(vectors, threshold).collect())
    first = {}
    for i, v in enumerate(m):
        first.setdefault(v.tobytes(), i)
    reps = sorted(i for i in first.values() if m[i].any())
    s = cosine(m[reps], m[reps])
    want = sorted((reps[i], reps[j], float(s[i, j])) for i, j in zip(*np.nonzero(s >= threshold)) if i < j)
    assert got == want and want
    centres, members, count = cells.index(vectors.where(F.col("id").isin(reps)))
    assert len(centres) > 10
    assert cells.borders(members, centres, count, threshold).count() < (6 if threshold < 0.9 else 2) * len(reps)


def test_trained_cells_recall(spark):
    m = clustered(seed=3, n=1500, groups=60, spread=0.2)
    vectors, ask = table(spark, m), list(range(0, 1500, 25))
    queries = vectors.where(F.col("id").isin(ask)).withColumnRenamed("id", "query_id")
    want = {(q, i) for q, _, i, _ in nearest(m, ask, 10)}
    got = {(r.query_id, r.id) for r in R.knn_lsh(queries, vectors, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    _, probes = cells.trained(m.astype(float), 6, 10, 0.95)
    assert probes < 6
