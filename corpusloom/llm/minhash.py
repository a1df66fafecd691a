"""MinHash near-duplicates by min-max hashing.

Each permutation gives two signature values, the least and the greatest image of the shingle set, so 160 permutations
give 320 values for 160 hash evaluations of a shingle. Bands of eight values propose pairs (so wide that documents with
a common line or two do not meet), full shingle sets confirm them.

The plan grows with the documents, not with the pairs of a group:

* equal shingle sets are one class, found by an aggregate; only its representative (smallest id) goes on;
* the members of a band bucket are compared with the bucket's pivot (its smallest id), one pair for each member; most
  groups of near copies are one component then, and their buckets are done;
* in a bucket that still holds several components, the members outside its largest component are compared with all
  members of like set sizes in tiles of bounded size, of which a task holds one at a time: signatures choose whom to compare, full shingle
  sets decide, and one link to each other component leaves a tile. So no candidate is given up, and no pairs of
  a component's own members are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._components import connected_components
from corpusloom.llm._storage import materialise, width
from corpusloom.operators.joins import join_counted, salted_join

PERMUTATIONS, ROWS = 160, 8
#: Members that a pivot may have before its pairs are dealt to several tasks.
MEMBERS = 10_000
#: How far a pair's share of equal signature values may lie below the threshold before its texts are not read (4.5
#: standard deviations of 320 values), and about how many members of a bucket, and shingles in them, a tile has on either side.
SLACK, TILE, TILE_SHINGLES = 0.1, 1000, 1 << 22
U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each row (ASCII lower case), and where each row's begin.
    A row of fewer words is one shingle; a row without words has none."""
    starts, ends, at = _text.words(data, offs)
    h = _text.span_hash(_text.LOWER[data], starts, ends)
    n = np.diff(at)
    grams = _text.rolling(h, k)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.empty(int(per.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(per)])
    keep = np.ones(len(out), bool)
    for i in np.flatnonzero(per):
        a, b = to[i], to[i + 1]
        if n[i] >= k:
            out[a:b] = grams[at[i] : at[i] + n[i] - k + 1]
            out[a:b].sort()
        else:
            out[a] = _text.mix(np.bitwise_xor.reduce(_text.mix(h[at[i] : at[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64)), keepdims=True))[0]
    keep[1:] = out[1:] != out[:-1]
    keep[to[:-1][per > 0]] = True
    seen = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], seen[to]


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    a, b = _text.coefficients(PERMUTATIONS, 101), _text.coefficients(PERMUTATIONS, 202)
    nb = 2 * PERMUTATIONS // ROWS
    for batch in _text.slices(batches, 1):
        sets, at = shingle_sets(*_text.flat(batch.column(1)), k)
        n = np.diff(at)
        full = np.flatnonzero(n)
        sig = np.zeros((len(full), 2 * PERMUTATIONS), np.uint64)
        one = two = np.zeros(0, np.uint64)
        if len(full):
            for p in range(PERMUTATIONS):
                image = sets * a[p] + b[p]
                sig[:, 2 * p] = np.minimum.reduceat(image, at[full])
                sig[:, 2 * p + 1] = np.maximum.reduceat(image, at[full])
            one, two = np.add.reduceat(sets, at[full]), np.add.reduceat(_text.mix(sets ^ U(0xA5A5A5A5DEADBEEF)), at[full])
        sig = _text.mix(sig)
        c = _text.coefficients(ROWS, 303)
        bands = _text.mix((sig.reshape(len(full), nb, ROWS) * c).sum(axis=2, dtype=np.uint64) + np.arange(nb, dtype=np.uint64))
        sums = np.zeros((2, batch.num_rows), np.uint64)
        sums[0, full], sums[1, full] = one, two
        sketch = (sig & U(255)).astype(np.uint8)
        raw = [b""] * batch.num_rows
        for j, i in enumerate(full):
            raw[i] = sketch[j].tobytes()
        ofs = np.concatenate([[0], np.cumsum((n > 0) * nb)]).astype(np.int32)
        yield pa.record_batch([batch.column(0), _text.long_array(n), _text.long_array(sums[0]), _text.long_array(sums[1]), pa.ListArray.from_arrays(pa.array(ofs), _text.long_array(bands.ravel())), pa.array(raw, pa.binary())], names=["id", "n", "s1", "s2", "bands", "sketch"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``(id, n, s1, s2, bands, sketch)``: set size, two sums that identify the set, band hashes, one byte of each value."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(partial(_signatures, k=k), "id long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def _agreement(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose sketches agree in at least the share ``least`` of their values, chance hits taken off."""
    for batch in batches:
        if batch.num_rows:
            x, y = (_text.flat(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            same = (x == y).mean(axis=1)
            yield batch.filter(pa.array((same - 1 / 256) / (1 - 1 / 256) >= least)).select(["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 1, 4 << 20):
        sets, at = shingle_sets(*_text.flat(batch.column(1)), k)
        yield pa.record_batch([batch.column(0), pa.array([sets[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["rep", "grams"])


def _tiles(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile ``(h, z, k, s)``: for each asking member one link to each other component that it has one with in
    the tile. Signatures choose whom to compare, full sets decide."""

    def pairs(t: pa.RecordBatch) -> list[tuple[int, int]]:
        rep, comp, n, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "n", "asks"))
        sketch = _text.flat(t.column("sketch"))[0].reshape(len(rep), -1)
        data, offs = _text.flat(t.column("grams"))
        grams, at = np.frombuffer(data.tobytes(), np.uint64), offs // 8
        other, out = np.flatnonzero(~asks), []
        for i in np.flatnonzero(asks):
            near = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            same = (sketch[near] == sketch[i]).mean(axis=1)
            near = near[(same - 1 / 256) / (1 - 1 / 256) >= least]
            if len(near):
                mine = grams[at[i] : at[i + 1]]
                theirs = _text.gather(grams, at[near], n[near])
                both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs, np.cumsum(n[near]) - n[near], dtype=np.int64)
                near = near[100 * both >= percent * (n[near] + n[i] - both)]
                out += [(max(rep[i], rep[j]), min(rep[i], rep[j])) for j in near[np.unique(comp[near], return_index=True)[1]]]
        return out

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = np.stack([t.column(c).to_numpy() for c in ("h", "z", "k", "s")])
        edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]) if len(t) else [0]
        found = [x for i, j in zip(edge, edge[1:]) for x in pairs(t.slice(i, j - i).combine_chunks().to_batches()[0])]
        held = t.slice(edge[-1])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
    if held is not None and len(held) and (found := pairs(held.combine_chunks().to_batches()[0])):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 2, 2 << 20):
        (x, xa), (y, ya) = (shingle_sets(*_text.flat(batch.column(c)), k) for c in (2, 3))
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok[i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def _rest(open_: DataFrame, info: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different components in the buckets ``(h, rep, comp)``. Only members of buckets with several
    components are read, and their shingle sets go with them to the tiles."""
    parts = open_.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).where("top.c < all")
    rows = materialise(open_.join(parts.select("h", F.col("top.comp").alias("major")), "h"), "members")
    own = rows.select("rep").distinct().join(texts.toDF("rep", "t"), "rep").mapInArrow(partial(_sets, k=k), "rep long, grams binary").dropDuplicates(["rep"])
    # Sets of one size class and its neighbours only can be so like each other; the base is a little larger than their ratio.
    size = F.floor(F.log("n") / math.log(100.01 / percent)).cast("int")
    near = F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))).alias("z")
    rows = rows.join(materialise(info.join(own, "rep"), "sets"), "rep").withColumn("size", size)
    members = rows.groupBy("h", F.col("size").alias("z")).agg(F.count("*").alias("m"), F.sum("n").alias("mn"))
    asking = rows.where("comp <> major").groupBy("h", "size").agg(F.count("*").alias("a"), F.sum("n").alias("an")).select("h", near, "a", "an").groupBy("h", "z").agg(F.sum("a").alias("a"), F.sum("an").alias("an"))
    tiles = lambda c, n: F.greatest(F.ceil(F.col(c) / TILE), F.ceil(F.col(n) / TILE_SHINGLES)).cast("int")
    grid = materialise(members.join(asking, ["h", "z"]).select("h", "z", tiles("a", "an").alias("nk"), tiles("m", "mn").alias("ns")), "grid")
    cols = ["rep", "comp", "n", "sketch", "grams"]
    asks = rows.where("comp <> major").select("h", near, *cols).join(grid, ["h", "z"])
    asks = asks.select("h", "z", F.expr("pmod(hash(rep), nk)").alias("k"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("s"), *cols, F.lit(True).alias("asks"))
    others = rows.withColumnRenamed("size", "z").join(grid, ["h", "z"])
    others = others.select("h", "z", F.explode(F.sequence(F.lit(0), F.col("nk") - 1)).alias("k"), F.expr("pmod(hash(rep, 1), ns)").alias("s"), *cols, F.lit(False).alias("asks"))
    both = asks.unionByName(others).repartition(width(info), "h", "z", "k", "s").sortWithinPartitions("h", "z", "k", "s")
    return both.mapInArrow(partial(_tiles, least=percent / 100 - SLACK, percent=percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, n_shingles, component_id, kept)``.

    Documents are linked whose sets of ``k``-word shingles (ASCII letters in lower case, words split at ASCII white
    space) have a Jaccard similarity of at least ``percent`` / 100; ``component_id`` is the smallest id reachable.
    A null or empty text has no shingles and is linked with nothing. A row without an id is linked with nothing, has a
    null component and is kept. Rows that repeat an id are one document to the components (each is judged alike).
    Equal texts are always one class. Other columns of ``docs`` are not read; an empty table gives an empty table.

    A pair at a similarity of 0.8 shares one of the 40 bands with a probability of 0.9993, one at 0.82 with 0.9999.
    """
    sig = materialise(signatures(docs, id_col, text_col, k), "signatures")
    sets = ["n", "s1", "s2"]
    linked = F.expr("n > 0 AND id IS NOT NULL")
    reps = sig.where(linked).groupBy(*sets).agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sketch"), "id").alias("x"), F.count("*").alias("copies"))
    reps = materialise(reps.select("rep", *sets, "x.bands", "x.sketch", "copies"), "reps")
    # Copies of one text, rows without words and rows without an id do not meet in one task.
    classes = join_counted(sig.where(linked).select("id", *sets), reps.select("rep", "copies", *sets), sets, "copies").select("id", "n", "rep")
    classes = materialise(classes.unionByName(sig.where(~linked).select("id", "n", F.lit(None).cast("long").alias("rep"))), "classes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    info = reps.select("rep", "n", "sketch")
    open_ = reps.select(F.explode("bands").alias("h"), "rep")
    pivots = open_.groupBy("h").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("h", "pivot")
    open_ = materialise(open_.join(pivots, "h").where("rep <> pivot"), "buckets")
    pairs = open_.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(info.toDF("a", "na", "ka"), "a").join(info.toDF("b", "nb", "kb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "ka", "kb")
    pairs = materialise(pairs.mapInArrow(partial(_agreement, least=percent / 100 - SLACK), "a long, b long"), "pairs")

    # A pivot with many members is dealt to several tasks, each with a copy of its text.
    full = salted_join(pairs.join(texts.toDF("a", "ta"), "a"), texts.toDF("b", "tb"), "b", least=MEMBERS, counts=pairs.groupBy("b").agg(F.count("*").alias("__n"))).select("a", "b", "ta", "tb")
    links = materialise(full.mapInArrow(partial(_confirm, k=k, percent=percent), "a long, b long"), "links")
    labels = materialise(connected_components(links), "labels")
    open_ = open_.select("h", "rep").join(labels.toDF("rep", "component"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("comp"))
    more = materialise(_rest(open_, info, texts, k, percent), "links")
    if more.limit(1).count():
        # Of the first links only the components matter now.
        stars = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialise(connected_components(stars.unionByName(more)), "labels")
    labels = materialise(labels.toDF("rep", "component").join(reps.select("rep", "copies"), "rep"), "labels")
    out = join_counted(classes.where("rep IS NOT NULL"), labels, "rep", "copies", how="left").select("id", "n", F.coalesce("component", "rep").alias("rep"))
    out = out.unionByName(classes.where("rep IS NULL").select("id", "n", F.col("id").alias("rep")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"), F.coalesce(F.col("id") == F.col("rep"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their component; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).where("NOT kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
