"""Exact and approximate vector joins over Voronoi cells.

Vectors of length one are compared by Euclidean distance, ``d^2 = 2 - 2 cosine``. Pivots, a bounded number of vectors, split space
into cells; each vector is stored once, in the cell of its nearest pivot. By the triangle inequality a vector ``x`` of the cell of
``p`` is no nearer to the vectors of another pivot ``o``'s cell than ``(d(x,o)^2 - d(x,p)^2) / 2 d(p,o)`` and ``d(x,o)`` less the cell's
radius, so most cells of clustered vectors need not be looked at. A cell's members are dealt to tiles of bounded size; what
asks a cell streams past each of its tiles, so neither a great cell nor many queries have to fit in a task or on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import stored

#: Members that a cell should have and the most cells there may be (their pivots go to all tasks); members of a tile.
CELL, CELLS, TILE = 2048, 4096, 2048
#: Rows that meet a tile at once.
ASKS = 256
#: Distances from pivots that a task computes at once, and rows of vectors that it gives out at once.
BLOCK, ROWS = 1 << 18, 4096
#: What rounding to six places may hide of a cosine.
ROUNDING = 1e-6
#: Distance of pivots from which rounding hides less of the planes between them than 1e-9.
NEAR = 1e-3
#: The cell of vectors of length zero, whose cosine with anything is 0.
ZERO = -1


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, which are of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1)[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of length one."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def planes(d: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For rows at ``d`` from the pivots, how far at least the other cells lie behind the planes between them and the own cell. Only the
    rows' own pivots are measured, as all pairs of pivots would be too many; for pivots so near that rounding matters it is 0."""
    at, row = np.unique(own, return_inverse=True)
    between = distances(centres[at], centres)[row]
    behind = d**2 - np.take_along_axis(d, own[:, None], 1) ** 2
    return np.divide(behind, 2 * between, out=np.zeros_like(d), where=between > NEAR)


def pieces(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a part's distances from all centres are ``BLOCK`` at most."""
    step = max(1, BLOCK // max(1, len(centres)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def copies(part: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, x: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of ``part`` by number, each with the cell that it asks and ``x``; however many a part gives, ``ROWS`` at once."""
    for at in range(0, len(row), ROWS):
        take = pa.array(row[at : at + ROWS])
        yield pa.record_batch([part.column("id").take(take), part.column("v").take(take), pa.array(cell[at : at + ROWS], pa.int32()), x.slice(at, ROWS)], names=["id", "v", "cell", "x"])


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """About one vector for each ``CELL`` of the ``n``, ``CELLS`` at most: those of least hash."""
    m = min(CELLS, -(-n // CELL))
    rows = vectors.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(m).select("v").toPandas()["v"]
    return np.unique(unit(np.array([np.asarray(v, np.float64) for v in rows])), axis=0) if len(rows) else np.zeros((0, 1))


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, centres):
        m = unit(matrix(batch.column("v")))
        live = m.any(axis=1)
        cell, far = np.full(len(m), ZERO), np.zeros(len(m))
        if live.any():
            d = distances(m[live], centres)
            cell[live] = d.argmin(axis=1)
            far[live] = d.min(axis=1)
        yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "r"])


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(id, v, cell, r)``: each vector's cell and its distance from the pivot."""
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    if not len(centres):
        return rows.withColumns({"cell": F.lit(ZERO), "r": F.lit(0.0)})
    return rows.mapInArrow(partial(_assigned, centres=centres), "id long, v array<double>, cell int, r double")


def sizes(members: DataFrame) -> dict[int, tuple[int, float]]:
    """Members and radius of each cell: at most ``CELLS + 1`` rows."""
    return {r["cell"]: (r["n"], r["r"]) for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()}


Score = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch]


def _met(batches: Iterator[pa.RecordBatch], score: Score) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, tile), members before those that ask: one tile of members is held."""
    key, held, ids, m = None, [], None, None
    for batch in batches:
        c, t, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "tile", "asks"))
        edge = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (t[1:] != t[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(c)]])
        for i, j in zip(edge, edge[1:]):
            if i == j:
                continue
            if (c[i], t[i]) != key:
                key, held, ids = (c[i], t[i]), [], None
            part = batch.slice(i, j - i)
            if not asks[i]:
                held.append(part)
            elif held:
                if ids is None:
                    ids = np.concatenate([p.column("id").to_numpy() for p in held])
                    order = np.argsort(ids, kind="stable")
                    ids, m = ids[order], np.concatenate([matrix(p.column("v")) for p in held])[order]
                for at in range(0, part.num_rows, ASKS):
                    yield score(ids, m, part.slice(at, ASKS))


def meet(members: DataFrame, asks: DataFrame, count: dict[int, tuple[int, float]], score: Score, schema: str) -> DataFrame:
    """``members(id, v, cell)`` with the rows of ``asks(id, v, cell, x)`` that ask their cell; ``x`` is a number for ``score``."""
    spark = members.sparkSession
    tiles = F.broadcast(spark.createDataFrame([(c, -(-n // TILE)) for c, (n, _) in count.items()] or [(ZERO, 1)], "cell int, tiles int"))
    mine = members.join(tiles, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), F.lit(False).alias("asks"), "id", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("double").alias("x"))
    theirs = asks.join(tiles, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("asks"), "id", F.col("v").cast("array<double>").alias("v"), F.col("x").cast("double").alias("x"))
    return mine.unionByName(theirs).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "asks").mapInArrow(partial(_met, score=score), schema)


def rounded(products: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines to six places, 0 with a vector of length zero."""
    return np.round(np.divide(products, norms, out=np.zeros_like(products), where=norms > 0), 6) + 0.0


def cosines(ids: np.ndarray, m: np.ndarray, asks: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids that ask and their rounded cosines with the members."""
    q = matrix(asks.column("v"))
    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)
    return asks.column("id").to_numpy(), rounded(q @ m.T, norm)


def _nearest(ids: np.ndarray, m: np.ndarray, asks: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
    """Each query's best ``k`` members, of those not below what it has found (``x``). Members are in the order of their ids."""
    least = asks.column("x").to_numpy(zero_copy_only=False).astype(np.float64)
    if np.isnan(least).any():
        names, s = cosines(ids, m, asks)
        if not same:
            s[names[:, None] == ids] = -np.inf
        s[s < np.where(np.isnan(least), -np.inf, least)[:, None]] = -np.inf
        # Only those not below the k-th best score are sorted.
        row, col = np.nonzero(np.isfinite(s) if k >= s.shape[1] else np.isfinite(s) & (s >= np.partition(s, -k, axis=1)[:, -k, None]))
        score = s[row, col]
    else:
        # Most members are below what all queries have found: only the others are divided and rounded.
        names, q = asks.column("id").to_numpy(), matrix(asks.column("v"))
        left, right, s = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1), q @ m.T
        row, col = np.nonzero(s >= ((least - ROUNDING) * left)[:, None] * right)
        score = rounded(s[row, col], left[row] * right[col])
        keep = np.isfinite(score) & (score >= least[row]) & (same | (names[row] != ids[col]))
        row, col, score = row[keep], col[keep], score[keep]
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.record_batch([pa.array(names[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])], names=["query_id", "id", "score"])


def _visits(batches: Iterator[pa.RecordBatch], centres: np.ndarray, radius: np.ndarray, zeros: bool) -> Iterator[pa.RecordBatch]:
    """For each query (with its own cell and the score ``x`` that it has to reach) the other cells that may hold such a vector."""
    for batch in pieces(batches, centres):
        m = unit(matrix(batch.column("v")))
        own, x = batch.column("cell").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.where(np.isnan(x), -1.0, x)
        reach = np.sqrt(np.maximum(0.0, 2 - 2 * (x - ROUNDING)))[:, None] + 1e-9
        d = distances(m, centres)
        may = (planes(d, np.maximum(own, 0), centres) <= reach) & (d - radius <= reach) & (radius >= 0)
        live = m.any(axis=1)
        may[~live] = radius >= 0
        may[live, own[live]] = False
        row, cell = np.nonzero(may)
        if zeros:
            # Vectors of length zero have the score 0 with all others.
            more = np.flatnonzero((own != ZERO) & (x <= ROUNDING))
            row, cell = np.concatenate([row, more]), np.concatenate([cell, np.full(len(more), ZERO)])
        yield from copies(batch, row, cell, batch.column("x").take(pa.array(row)))


def radii(count: dict[int, tuple[int, float]], cells: int) -> np.ndarray:
    """The radius of each cell, -1 for cells without members."""
    return np.array([count[c][1] if c in count else -1.0 for c in range(cells)])


def visits(asked: DataFrame, centres: np.ndarray, count: dict[int, tuple[int, float]]) -> DataFrame:
    """``asked(id, v, cell, x)`` with each other cell that may hold a vector of the score ``x`` or more."""
    if not len(centres):
        return asked.limit(0)
    step = partial(_visits, centres=centres, radius=radii(count, len(centres)), zeros=ZERO in count)
    return asked.select("id", "v", "cell", F.col("x").cast("double").alias("x")).mapInArrow(step, "id long, v array<double>, cell int, x double")


FOUND = "query_id long, id long, score double"


def _pair(ids: np.ndarray, m: np.ndarray, asks: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """Pairs over the threshold; ``x`` is 1 for members of the cell itself, which meet each of the others once."""
    names, s = cosines(ids, m, asks)
    own = asks.column("x").to_numpy(zero_copy_only=False)[:, None] > 0
    row, col = np.nonzero((s >= threshold) & (~own | (names[:, None] < ids)))
    a, b = names[row], ids[col]
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s[row, col])], names=["a", "b", "score"])


def _borders(batches: Iterator[pa.RecordBatch], centres: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its own cell, and copied to later cells to whose vectors it may be within reach."""
    for batch in pieces(batches, centres):
        own, d = batch.column("cell").to_numpy(), distances(unit(matrix(batch.column("v"))), centres)
        may = (planes(d, own, centres) <= reach) & (d - radius <= reach) & (radius >= 0) & (np.arange(len(centres)) > own[:, None])
        may[np.arange(len(own)), own] = True
        row, cell = np.nonzero(may)
        yield from copies(batch, row, cell, pa.array((cell == own[row]).astype(np.float64)))


def borders(members: DataFrame, centres: np.ndarray, count: dict[int, tuple[int, float]], threshold: float) -> DataFrame:
    """``members`` with their copies: ``(id, v, cell, x)``, ``x`` being 1 in the own cell. A pair over the threshold meets in the
    later one of its two cells."""
    reach = math.sqrt(max(0.0, 2 - 2 * (threshold - ROUNDING))) + 1e-9
    step = partial(_borders, centres=centres, radius=radii(count, len(centres)), reach=reach)
    return members.select("id", "v", "cell").mapInArrow(step, "id long, v array<double>, cell int, x double")


def trained(sample: np.ndarray, cells: int, k: int, target: float, seed: int = 7, rounds: int = 10) -> tuple[np.ndarray, int]:
    """Centres of k-means over a bounded sample, and how many cells a query has to probe for ``target`` of the ``k`` nearest
    vectors of the sample to be in them."""
    rng = np.random.default_rng(seed)
    m = unit(sample[sample.any(axis=1)])
    if not len(m):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 1)), 1
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        of = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        full = sums.any(axis=1)
        centres[full] = unit(sums[full])
    near = m @ centres.T
    of = near.argmax(axis=1)
    place = np.argsort(np.argsort(-near, axis=1), axis=1)
    ask = rng.choice(len(m), min(len(m), 256), replace=False)
    like = m[ask] @ m.T
    like[np.arange(len(ask)), ask] = -np.inf
    best = np.argsort(-like, axis=1)[:, : min(k, max(1, len(m) - 1))]
    needed = np.sort(np.take_along_axis(place[ask], of[best], 1).ravel())
    return centres, int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def _probes(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int, zeros: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, centres):
        m = unit(matrix(batch.column("v")))
        cell = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
        if zeros:
            cell = np.hstack([cell, np.full((len(cell), 1), ZERO)])
        row = np.repeat(np.arange(len(cell)), cell.shape[1])
        yield from copies(batch, row, cell.ravel(), pa.nulls(len(row), pa.float64()))


def probed(asked: DataFrame, centres: np.ndarray, probes: int, zeros: bool) -> DataFrame:
    """``asked(id, v)`` with each of its ``probes`` nearest cells."""
    if not len(centres):
        return asked.select("id", "v", F.lit(ZERO).alias("cell"), F.lit(None).cast("double").alias("x"))
    rows = asked.select("id", F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(partial(_probes, centres=centres, probes=probes, zeros=zeros), "id long, v array<double>, cell int, x double")


def index(vectors: DataFrame) -> tuple[np.ndarray, DataFrame, dict[int, tuple[int, float]]]:
    """Pivots, the stored members ``(id, v, cell, r)`` and the cells' sizes, for ``vectors(id, v)``."""
    n = vectors.count()
    if n <= CELL:
        # One cell needs no pivot.
        return np.zeros((0, 1)), vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("cell"), F.lit(2.0).alias("r")), {0: (n, 2.0)} if n else {}
    centres = pivots(vectors, n)
    members = stored(assign(vectors, centres), "cells")
    return centres, members, sizes(members)
