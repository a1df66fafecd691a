"""Approximate nearest neighbours by counting collisions in query-centred windows of single projections.

Vectors are dealt to shards of bounded size. A task sorts its shard's vectors by each of ``PROJECTIONS`` random projections; a query
asks every array for the window around its own projection, of a half width in proportion to a radius (virtual rehashing: the radius
doubles, the same arrays are asked, and only what is new in a window is counted). A vector that has met the query in ``LEAST``
windows or more is verified, its distance computed on the vectors themselves. A query is done in a shard when its k-th verified
distance is within the radius, and at the radius that a bounded sample proves to hold k neighbours at the latest. Queries that have
found fewer than k in all shards by then go on with twice the radius.

A neighbour at the radius falls in a window with probability 0.770, so in 40 of 64 with 0.998, and a nearer one with more. What is
random about a result is only whether a neighbour is found, never its distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._storage import materialise, width

PROJECTIONS, LEAST = 64, 40
#: Half of a window, in radii.
REACH = 1.2
#: Radii of the virtual rehashing, as parts of the last one.
RADII = (0.125, 0.25, 0.5, 1.0)
#: Vectors of the sample that bounds the radii, vectors of a shard and queries of a group, on average.
SAMPLE, SHARD, GROUP = 2048, 4096, 1024


def usable(vec: Column) -> Column:
    """Whether a vector is not null, not zero and without null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in the order of the components."""
    return np.sqrt(np.cumsum((vectors - query) ** 2, axis=1)[:, -1])


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the number of their components."""
    size = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        yield int(d), batch.take(pa.array(np.flatnonzero(size == d)))


def _bounds(batches: Iterator[pa.RecordBatch], ids: np.ndarray, sample: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, rows in _by_size(batch, "vec"):
            mine = [i for i, v in enumerate(sample) if len(v) == d]
            other, (names, which) = np.array([sample[i] for i in mine]).reshape(len(mine), d), np.unique(ids[mine], return_inverse=True)
            out = []
            for q, v in zip(rows.column("id").to_pylist(), _matrix(rows.column("vec"))):
                far = np.full(len(names), math.inf)
                np.minimum.at(far, which, distances(other, v) if len(other) else np.zeros(0))
                far = far[names != q]
                out.append(float(np.partition(far, k - 1)[k - 1]) if len(far) >= k else math.inf)
            yield pa.record_batch([rows.column("id"), rows.column("vec"), pa.array(out, pa.float64())], names=["id", "vec", "bound"])


class Shard:
    """Sorted projections of the distinct vectors of a shard; ids of equal vectors stand in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int):
        raw = np.ascontiguousarray(vectors + 0.0)
        _, first, back = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors = raw[first]
        order = np.lexsort((ids, back.ravel()))
        self.ids = ids[order]
        self.size = np.bincount(back.ravel(), minlength=len(first))
        self.at = np.cumsum(self.size) - self.size
        self.directions = np.random.default_rng(seed).standard_normal((PROJECTIONS, raw.shape[1]))
        places = self.vectors @ self.directions.T
        self.order = np.argsort(places, axis=0).T.astype(np.int32)
        self.sorted = np.take_along_axis(places.T, self.order.astype(np.int64), axis=1)

    def search(self, names: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[list, list, list]:
        """Query, id and distance of the k nearest verified vectors of each query (by distance, then id)."""
        n, m = len(self.vectors), len(queries)
        centre = queries @ self.directions.T
        # Equal vectors may differ in the last digits of their projections.
        slack = 1e-9 * (1 + np.abs(centre) + np.abs(self.sorted).max(initial=0))
        hits, seen = np.zeros((m, n), np.uint8), np.zeros((m, n), bool)
        low, high = (np.zeros((m, PROJECTIONS), np.int64) for _ in range(2))
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
        live, fresh = np.arange(m), True
        for part in RADII:
            radius = np.where(np.isinf(bounds), math.inf, bounds * part)
            to_low, to_high = (np.empty((len(live), PROJECTIONS), np.int64) for _ in range(2))
            for p in range(PROJECTIONS):
                reach = REACH * radius[live] + slack[live, p]
                to_low[:, p] = np.searchsorted(self.sorted[p], centre[live, p] - reach, "left")
                to_high[:, p] = np.searchsorted(self.sorted[p], centre[live, p] + reach, "right")
            left = []
            for j, q in enumerate(live.tolist()):
                if fresh:
                    new = [self.order[p, a:b] for p, a, b in zip(range(PROJECTIONS), to_low[j].tolist(), to_high[j].tolist())]
                else:
                    new = [x for p, a, b, c, d in zip(range(PROJECTIONS), to_low[j].tolist(), low[q].tolist(), high[q].tolist(), to_high[j].tolist()) for x in (self.order[p, a:b], self.order[p, c:d])]
                hits[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                met = np.flatnonzero((hits[q] >= LEAST) & ~seen[q])
                if len(met):
                    seen[q, met] = True
                    far = distances(self.vectors[met], queries[q])
                    near = far <= bounds[q]
                    found[q].append((met[near], far[near]))
                within = sum(int(self.size[c[f <= radius[q]]].sum()) for c, f in found[q])
                # The query's own row may be one of them.
                if within <= k and not np.isinf(radius[q]):
                    left.append(j)
            low[live], high[live], fresh = to_low, to_high, False
            live = live[left]
            if not len(live):
                break
        out: tuple[list, list, list] = ([], [], [])
        for q in range(m):
            if not found[q]:
                continue
            met, far = (np.concatenate(x) for x in zip(*found[q]))
            if len(met) > k + 1:  # ties of the last place stay
                keep = far <= np.partition(far, k)[k]
                met, far = met[keep], far[keep]
            # The smallest ids of each class of equal vectors; one of them may be the query's own.
            take = np.minimum(self.size[met], k + 1)
            place = np.repeat(self.at[met] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            ids, far = self.ids[place], np.repeat(far, take)
            ids, far = ids[ids != names[q]], far[ids != names[q]]
            order = np.lexsort((ids, far))
            _, first = np.unique(ids[order], return_index=True)
            order = order[np.sort(first)][:k]
            out[0].extend([names[q]] * len(order))
            out[1].extend(ids[order].tolist())
            out[2].extend(far[order].tolist())
        return out


def _cells(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, one of which is held at a time."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for d, rows in _by_size(t.combine_chunks().to_batches()[0], "vec"):
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            if not asks.any() or asks.all():
                continue
            ids, vectors, bounds = rows.column("id").to_numpy(), _matrix(rows.column("vec")), rows.column("bound").to_numpy(zero_copy_only=False)
            out = Shard(ids[~asks], vectors[~asks], seed + d).search(ids[asks], vectors[asks], bounds[asks], k)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        cell = t.column("cell").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        for i, j in zip(edge, edge[1:]):
            yield from found(t.slice(i, j - i))
        held = t.slice(edge[-1])
    if held is not None:
        yield from found(held)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 12) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id of ``queries`` the ``k`` nearest ids of ``vectors`` found, its own left out.

    ``score`` is the Euclidean distance of the vectors in double precision; ties go to the smaller id. All other ids come if there
    are at most ``k``. Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part;
    vectors of different lengths do not meet. An id that repeats is one candidate, at its nearest vector, and asks once, with its
    smallest vector. Other columns are not read. ``SAMPLE`` vectors (those of least hash) bound the radii; every row is indexed.

    Each shard of about ``SHARD`` vectors meets each group of about ``GROUP`` queries in one task, which is bounded by both.
    """
    def rows(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>")
        return df.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))

    points = materialise(rows(vectors).dropDuplicates(["id", "vec"]), "points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("id", F.lit(seed)), "id", "vec").limit(SAMPLE).toPandas()
    bounds = partial(_bounds, ids=sample["id"].to_numpy(np.int64), sample=[np.asarray(v, np.float64) for v in sample["vec"]], k=k)
    asking = rows(queries).groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(bounds, "id long, vec array<double>, bound double")
    asking = materialise(asking, "queries")
    found = _round(asking, points, n, k, seed)
    while True:
        found = materialise(found, "found")
        # A finite bound says that there are k others; with an infinite one all others have been met.
        short = asking.join(found.groupBy(F.col("query_id").alias("id")).agg(F.countDistinct("vec_id").alias("n")), "id", "left")
        short = short.where((F.coalesce("n", F.lit(0)) < k) & (F.col("bound") < float("inf")))
        asking = materialise(short.select("id", "vec", (2 * F.col("bound") + 1e-9).alias("bound")), "queries")
        if not asking.limit(1).count():
            break
        found = found.unionByName(_round(asking, points, n, k, seed))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(asking: DataFrame, points: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """Each query's nearest within its bound, of every shard."""
    groups = max(1, -(-asking.count() // GROUP))
    shards = max(1, -(-n // SHARD), min(points.sparkSession.sparkContext.defaultParallelism, -(-n // SAMPLE)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    theirs = points.withColumn("g", every(groups)).select((F.pmod(F.xxhash64("id", "vec"), F.lit(shards)) * groups + F.col("g")).alias("cell"), F.lit(False).alias("asks"), "id", "vec", F.lit(None).cast("double").alias("bound"))
    mine = asking.withColumn("s", every(shards)).select((F.col("s") * groups + F.pmod(F.xxhash64("id"), F.lit(groups))).alias("cell"), F.lit(True).alias("asks"), "id", "vec", "bound")
    cells = theirs.unionByName(mine).repartition(min(shards * groups, max(width(points), shards)), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(partial(_cells, k=k, seed=seed), "query_id long, vec_id long, score double")
