"""Retrieval for many queries at once (R operators). Hits are rows ``(query_id, id, rank, score, ...)``; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import fixed
from corpusloom.operators import cells
from corpusloom.operators.joins import salted_join
from corpusloom.operators.splitting import split_fixed
from corpusloom.sources.files import stored

def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def top(df: DataFrame, k: int, *by: Column, keys: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank; planned as a group limit before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, same: bool = False) -> DataFrame:
    """R2: exact nearest neighbours by cosine, rounded to six places. ``queries(query_id, v)``, ``vectors(id, v)``, vectors of one
    length; a query's own id is left out unless ``same``. Null vectors take no part, one of length zero has the score 0.

    A query first asks the cell that it is in; the k-th score found there rules out the cells that cannot hold a better one (see
    ``cells``), and the others are asked next. Vectors that lie in no clusters rule out little, and all cells are asked."""
    rows = vectors.where("v IS NOT NULL").select("id", "v")
    asked = queries.where("v IS NOT NULL").select(F.col("query_id").alias("id"), F.col("v").cast("array<double>").alias("v"))
    centres, members, count = cells.index(rows)
    score = partial(cells._nearest, k=k, same=same)
    if not len(centres):
        (only,) = count or (0,)
        first = asked.withColumns({"cell": F.lit(only), "x": F.lit(None).cast("double")})
        return top(cells.meet(members, first, count, score, cells.FOUND), k, F.desc("score"), F.col("id"))
    first = stored(cells.assign(asked, centres).withColumn("x", F.lit(None).cast("double")), "asked")
    found = stored(cells.meet(members, first, count, score, cells.FOUND), "found")
    more = cells.visits(reached(first, found, k), centres, count)
    found = found.unionByName(cells.meet(members, more, count, score, cells.FOUND))
    return top(found, k, F.desc("score"), F.col("id"))


def reached(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``x``, the k-th best score found (null if there are fewer)."""
    bar = top(found, k, F.desc("score"), F.col("id")).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("x"))
    return asked.drop("x").join(bar, "id", "left")


#: Vectors that train the cells of R3, and vectors that such a cell should have.
SAMPLE, SMALL = 4096, 256


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, target: float = 0.95, seed: int = 7) -> DataFrame:
    """Approximate nearest neighbours. Cells are trained by k-means on ``SAMPLE`` vectors (those of least hash); every vector
    is a row of its nearest cell, a query asks as many of its nearest cells as ``target`` of the sample's own neighbours need, and
    what is there is scored exactly. Where recall must be 1, R2 is the exact way. The tests measure over 0.9 of the first ten on
    the given vectors, which are spread at random (most cells are probed then), and on clustered ones (few are)."""
    rows = vectors.where("v IS NOT NULL").select("id", "v")
    asked = queries.where("v IS NOT NULL").select(F.col("query_id").alias("id"), "v")
    some = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(some):
        return top(asked.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")), k, F.desc("score"), F.col("id"))
    centres, probes = cells.trained(np.array([np.asarray(v, np.float64) for v in some]), min(1024, -(-rows.count() // SMALL)), k, target, seed)
    members = stored(cells.assign(rows, centres), "cells")
    count = cells.sizes(members)
    found = cells.meet(members, cells.probed(asked, centres, probes, cells.ZERO in count), count, partial(cells._nearest, k=k, same=False), cells.FOUND)
    return top(found, k, F.desc("score"), F.col("id"))


def terms(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, term)`` for every lower-case word."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_remove(F.split(F.lower(text_col), r"\s+"), "")).alias("term"))


#: Documents of a query's rarest terms that set its first threshold, in multiples of ``k``; what rounding may move a score by.
SEEDS, ROUNDING = 20, 2e-6
#: Terms of queries that are broadcast, so that other words of the texts are not shuffled.
WANTED = 500_000
#: Rows of queries' terms and their documents up to which all are scored; beyond that bounds decide which.
PLAIN = 10_000_000
#: Rows of queries and their terms up to which tasks hold all of them; the most pairs of such a row and a chunk that a task scores
#: at once, and words of chunks (more if one chunk has more) that it counts at once.
HELD, BLOCK, WORDS = 200_000, 1 << 21, 1 << 19


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)``, each once."""
    return stored(terms(queries.withColumnRenamed("query_id", "id"), "id").distinct().withColumnRenamed("id", "query_id"), "terms")


def postings(queries: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The postings ``(term, id, g)`` of the terms of ``queries(query_id, text)`` in ``chunks(id, text)``, ``g`` being a term's
    weight without its idf, and ``(query_id, term, df, idf, bound)``: no document has more of a term than ``bound``. Texts are split
    once; each chunk also has a row for itself, from which the number and mean length of chunks come."""
    asked = query_terms(queries)
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    rows = chunks.select("id", words.alias("w")).select("id", F.size("w").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("w", F.array().cast("array<string>")))).alias("term"))
    wanted = asked.select("term").unionByName(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    if wanted.count() <= WANTED:
        wanted = F.broadcast(wanted)
    tf = stored(rows.join(wanted, "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf")), "terms")
    total = tf.where("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("tf") * F.col("len")) / F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("mean")).first()
    g = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(total["mean"] or 1.0)))
    listed = tf.where("term <> ''").select("term", "id", g.alias("g"))
    known = listed.groupBy("term").agg(F.count("*").alias("df"), F.max("g").alias("top"))
    known = known.withColumn("idf", F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return listed, stored(asked.join(known.withColumn("bound", F.col("idf") * F.col("top")).drop("top"), "term"), "asked")


def _partial(listed: DataFrame, asked: DataFrame) -> DataFrame:
    counts = asked.select("term", F.col("df").alias("__n")).distinct()
    return salted_join(listed, asked.select("query_id", "term", "idf"), "term", counts=counts).groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("g")).alias("part"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """``(query_id, bar)``: the k-th best score so far, which the k-th best in the end is not below."""
    return top(scores, k, F.desc("part"), F.col("id")).where(F.col("rank") == k).select("query_id", F.col("part").alias("bar"))


def _looked_up(listed: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """What each term of ``asked`` adds to the given pairs ``(query_id, id)``; only the postings of their documents are joined."""
    ids = stored(pairs.select("id").distinct(), "ids")
    near = listed.join(F.broadcast(ids) if ids.count() <= WANTED else ids, "id", "left_semi")
    return pairs.select("query_id", "id").join(asked.select("query_id", "term", "idf"), "query_id").join(near, ["term", "id"]).select("query_id", "id", (F.col("idf") * F.col("g")).alias("part"))


def essential_terms(listed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``essential``: whether a document may be among a query's first ``k`` without a term that comes before this
    one (by bounds, the greatest first). Documents with other terms only have too small a sum of bounds (MaxScore). The
    threshold is the k-th best score of the documents that are best by the rarest terms."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    up = Window.partitionBy("query_id").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumns({"place": F.row_number().over(w), "met": F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0)), "rest": F.sum("bound").over(up)})
    seeds = asked.where((F.col("place") == 1) | (F.col("met") <= SEEDS * k))
    good = stored(top(_partial(listed, seeds), 4 * k, F.desc("part"), F.col("id")).select("query_id", "id"), "seeds")
    full = _looked_up(listed, good, asked).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
    out = asked.join(_kth(full, k), "query_id", "left")
    essential = F.col("rest") >= F.coalesce("bar", F.lit(0.0)) - ROUNDING
    return stored(out.select("query_id", "term", "df", "idf", "bound", essential.alias("essential")), "essential")


def _counted(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """How often each chunk ``(id, w)`` holds which of the terms, by their numbers in ascending order."""
    for batch in batches:
        step = max(1, batch.num_rows * WORDS // max(1, len(batch.column("w").flatten())))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            w = part.column("w")
            size, words = pc.list_value_length(w), w.flatten()
            no = pc.index_in(words, value_set=terms.cast(words.type))
            row = pc.list_parent_indices(w).filter(no.is_valid()).to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(row * len(terms) + no.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            row, no = np.divmod(key, max(1, len(terms)))
            postings = [pa.array(no, pa.int32()), pa.array(tf, pa.int32()), size.take(pa.array(row)).cast(pa.int32())]
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            tf = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(postings, names=["no", "tf", "len"]))
            yield pa.record_batch([part.column("id"), size.cast(pa.int32()), tf], names=["id", "len", "tf"])


def _once(counted: DataFrame) -> DataFrame:
    """``(id, tf)`` with one row for each id: rows of an id are one chunk, and those of one length count their words together."""
    repeated = counted.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice"))
    if repeated.isEmpty():
        return counted.select("id", "tf")
    repeated, same = stored(repeated, "repeated"), F.col("id").eqNullSafe(F.col("twice"))
    words = counted.join(repeated, same, "left_semi").select("id", F.inline("tf")).groupBy("id", "no", "len").agg(F.sum("tf").cast("int").alias("tf"))
    merged = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("no", "tf", "len"))).alias("tf"))
    return stored(counted.join(repeated, same, "left_anti").select("id", "tf").unionByName(merged), "counted")


def _best(batches: Iterator[pa.RecordBatch], names: pa.Array, start: np.ndarray, asking: np.ndarray, idf: np.ndarray, mean: float, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """A task's first ``k`` chunks ``(id, tf)`` of each query. The queries ``asking`` for term ``i`` are those from ``start[i]`` to
    ``start[i + 1]``. Of the chunks met so far only the first ``k`` are held, and only scores that reach the last of these are sorted."""
    n, held = len(names), None
    bar, step = np.zeros(n), max(1, BLOCK // max(1, len(asking)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lists, ids = part.column("tf"), part.column("id")
            no, tf, size = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            weight = idf[no] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)))
            # A row for each posting and query with its term; scores add up in the order of the terms, so copies have the same.
            many = start[no + 1] - start[no]
            query = asking[np.repeat(start[no] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.bincount(query * part.num_rows + np.repeat(row, many), np.repeat(weight, many), n * part.num_rows).reshape(n, part.num_rows)
            if part.num_rows >= k:
                bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
            query, row = np.nonzero((s > 0) & (s >= bar[:, None] - ROUNDING))
            if len(query):
                found = pa.table({"query": query, "id": ids.take(pa.array(row)), "score": np.floor(s[query, row] * 1e6 + 0.5) / 1e6})
                held = found if held is None else pa.concat_tables([held, found])
                held = held.take(pc.sort_indices(held, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
                query = held["query"].to_numpy()
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                last = rank == k - 1
                bar[query[last]] = np.maximum(bar[query[last]], held["score"].to_numpy()[last])
                held = held.filter(pa.array(rank < k)).combine_chunks()
    if held is not None:
        for out in held.to_batches(cells.ROWS):
            yield pa.record_batch([names.take(out.column("query")), out.column("id"), out.column("score")], names=["query_id", "id", "score"])


def _scored_in_place(asked: DataFrame, chunks: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """R4 where tasks hold all of ``asked(query_id, term)``: a task counts the queries' terms in its chunks, and once it is known how
    many chunks have them, scores its chunks for all queries. Neither words nor scores are shuffled, only each task's first ``k``."""
    rows, kind = asked.toArrow().combine_chunks(), dict(chunks.dtypes)["id"]
    query, term = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    posting = "array<struct<no: int, tf: int, len: int>>"
    counted = stored(chunks.select("id", words.alias("w")).mapInArrow(partial(_counted, terms=term.dictionary), f"id {kind}, len int, tf {posting}"), "counted")
    total = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    once = _once(counted)
    idf = np.zeros(len(term.dictionary))
    for no, df in once.select(F.explode("tf.no").alias("no")).groupBy("no").count().collect():
        idf[no] = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
    no = term.indices.to_numpy()
    order = np.argsort(no, kind="stable")
    start, asking = np.searchsorted(no[order], np.arange(len(idf) + 1)), query.indices.to_numpy()[order].astype(np.int64)
    best = partial(_best, names=query.dictionary, start=start, asking=asking, idf=idf, mean=total["mean"] or 1.0, k=k, k1=k1, b=b)
    return once.mapInArrow(best, f"query_id {dict(asked.dtypes)['query_id']}, id {kind}, score double")


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, plain: int = PLAIN, held: int = HELD) -> DataFrame:
    """``queries(query_id, text)``, ``chunks(id, text)``; exact. Words are split at white space. Up to ``held`` rows of queries
    and terms go to all tasks, which score their own chunks. Beyond that terms and chunks are joined. If all terms of all queries have
    over ``plain`` postings together, essential terms give the candidates of a query. Those that the bounds of its other terms
    could still lift to the k-th best score are completed by looking up (term, candidate), so a word that most chunks hold
    costs its rows of the index, not one for each query and chunk."""
    asked = query_terms(queries)
    if asked.count() <= held:
        return top(_scored_in_place(asked, chunks, k, k1, b), k, F.desc("score"), F.col("id"))
    listed, asked = postings(queries, chunks, k1, b)
    if (asked.agg(F.sum("df")).first()[0] or 0) <= plain:
        scored = _partial(listed, asked).select("query_id", "id", F.round("part", 6).alias("score"))
        return top(scored, k, F.desc("score"), F.col("id"))
    asked = essential_terms(listed, asked, k)
    first = stored(_partial(listed, asked.where("essential")), "candidates")
    more = asked.where("NOT essential")
    slack = more.groupBy("query_id").agg(F.sum("bound").alias("slack"))
    likely = first.join(slack, "query_id", "left").join(_kth(first, k), "query_id", "left")
    likely = stored(likely.where(F.col("part") + F.coalesce("slack", F.lit(0.0)) >= F.coalesce("bar", F.lit(0.0)) - ROUNDING).select("query_id", "id", "part"), "likely")
    scored = likely.unionByName(_looked_up(listed, likely, more)).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored, k, F.desc("score"), F.col("id"))


def hybrid(vector: DataFrame, keyword: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """Scores of each side scaled to 0..1 within a query, then ``alpha`` of the vector side and the rest of the other."""
    w = Window.partitionBy("query_id")

    def scaled(df: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(vector, "v").join(scaled(keyword, "kw"), ["query_id", "id"], "full_outer")
    score = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("kw", F.lit(0.0)), 6)
    return top(both.select("query_id", "id", score.alias("score")), k, F.desc("score"), F.col("id"))


def score_of(score: Column, distance: Column) -> Column:
    """R6."""
    return F.coalesce(score, 1 - distance, F.lit(0.0))


def filter_meta(df: DataFrame, filters: dict) -> DataFrame:
    """All conditions hold; a list means any of it, within an array column any element; null conditions are ignored."""
    kinds = dict(df.dtypes)
    for name, value in filters.items():
        if value is not None:
            values = value if isinstance(value, list) else [value]
            df = df.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if kinds[name].startswith("array") else F.col(name).isin(values))
    return df


def acl_filter(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, chunk columns)`` that users may see: not archived, and own or shared with them. Public chunks are
    there once, without a user: everyone sees them."""
    live = chunks.where("NOT coalesce(archived, false)")
    private = live.where("visibility IS NULL OR visibility <> 'public'")
    may = private.select("*", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("owner_id"), F.coalesce("allowed_user_ids", F.array().cast("array<string>")))))).alias("user_id"))
    return may.join(users.select("user_id"), "user_id", "left_semi").unionByName(live.where("visibility = 'public'").withColumn("user_id", F.lit(None).cast("string")))


def with_archive_fallback(hits: DataFrame, archived: str = "archived", k: int = 10) -> DataFrame:
    """Live hits; for queries without any, archived ones."""
    live = hits.where(f"NOT {archived}")
    rest = hits.where(archived).join(live.select("query_id").distinct(), "query_id", "left_anti")
    return top(live.unionByName(rest), k, F.desc("score"), F.col("id"))


def topk_per_tenant(hits: DataFrame, k: int = 5) -> DataFrame:
    """R11."""
    return top(hits, k, F.desc("score"), F.col("id"), keys=("query_id", "tenant")).withColumn("is_temporal", F.col("tenant").startswith("temp_"))


def merge_by_score(kb: DataFrame, temporal: DataFrame, total: int) -> DataFrame:
    """The best of both sides, with each query's number of hits from either."""
    both = top(kb.withColumn("side", F.lit("kb")).unionByName(temporal.withColumn("side", F.lit("temporal"))), total, F.desc("score"), F.col("side"), F.col("id"))
    w = Window.partitionBy("query_id")
    return both.withColumns({"n_kb": F.count_if(F.col("side") == "kb").over(w), "n_temporal": F.count_if(F.col("side") == "temporal").over(w)})


def rrf(rankings: list[DataFrame], k: int = 60, payload: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of lists ``(query_id, id, rank, *payload)``. Ranks count from 1; rows without an id are
    skipped but have used up their rank; the first occurrence (list, rank) keeps the payload and settles ties."""
    both = reduce(DataFrame.unionByName, (r.select("query_id", "id", "rank", *payload).withColumn("list", F.lit(i)) for i, r in enumerate(rankings)))
    at = F.struct("list", "rank")
    fused = both.where("id IS NOT NULL").groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"), F.min(at).alias("at"), *(F.min_by(p, at).alias(p) for p in payload))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "at"))).drop("at")


def combine_kb_memory(kb: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """Missing ids are named after their list and place (from 0), then R13 and the first ``k``."""
    named = lambda df, p: df.select("query_id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit(p + "_"), (F.col("rank") - 1).cast("string"))).alias("id"), "rank", F.lit(p).alias("source_type"))
    return rrf([named(kb, "kb"), named(memory, "mem")], payload=("source_type",)).where(F.col("rank") <= k)


def _dedupe(df: pd.DataFrame, threshold: float) -> pd.DataFrame:
    kept: list[np.ndarray] = []
    rows = []
    df = df.sort_values("rank", kind="stable").reset_index(drop=True)
    for i, v in enumerate(df["v"]):
        u = None if v is None else np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
        if u is None or not kept or max(float(u @ w) for w in kept) < threshold:
            rows.append(i)
            if u is not None:
                kept.append(u)
    return df.loc[rows, ["query_id", "id", "rank", "score"]]


def dedupe_near(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """In rank order, a hit stays unless it is too like one that stayed; hits without a vector stay. ``hits`` has
    ``v`` and a query's candidates are bounded (R17) before."""
    return hits.select("query_id", "id", "rank", "score", "v").groupBy("query_id").applyInPandas(partial(_dedupe, threshold=threshold), "query_id long, id long, rank int, score double")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``(id, class_id)``: equal vectors are one class, named after its smallest id."""
    classes = vectors.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("class_id"))
    return vectors.join(classes, "v").select("id", "class_id")


def near_dup_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, score)`` with ``a < b`` of vectors over the threshold (above 0), between the representatives of classes
    of equal vectors (see ``vector_classes``); exact. A cosine of ``threshold`` is a distance of ``sqrt(2 - 2 threshold)``; only
    vectors so near to the border of another cell are copied to it (see ``cells``), and each pair is made once."""
    rows = vectors.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)).groupBy("v").agg(F.min("id").alias("id"))
    rows = stored(rows.select("id", "v"), "classes")
    centres, members, count = cells.index(rows)
    asks = cells.borders(members, centres, count, threshold) if len(centres) else members.withColumn("x", F.lit(1.0))
    return cells.meet(members, asks, count, partial(cells._pair, threshold=threshold), "a long, b long, score double")


def _mmr(df: pd.DataFrame, lam: float, k: int) -> pd.DataFrame:
    df = df.sort_values("rank", kind="stable").reset_index(drop=True)
    if df["v"].iloc[0] is None:
        order = list(range(min(k, len(df))))
    else:
        unit = np.stack([np.zeros(len(df["v"].iloc[0])) if v is None else np.asarray(v, float) / (np.linalg.norm(v) or 1.0) for v in df["v"]])
        rel = df["score"].to_numpy(float)
        order = [int(np.argmax(rel))]
        while len(order) < min(k, len(df)):
            gain = lam * rel - (1 - lam) * np.maximum(0.0, (unit @ unit[order].T).max(axis=1))
            gain[order] = -np.inf
            order.append(int(np.argmax(gain)))
    out = df.loc[order, ["query_id", "id", "score"]]
    return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))[["query_id", "id", "rank", "score"]]


def mmr(hits: DataFrame, lam: float = 0.5, k: int = 8) -> DataFrame:
    """Greedy choice of what is relevant (``score``) and unlike what is chosen; candidates are bounded before."""
    return hits.select("query_id", "id", "rank", "score", "v").groupBy("query_id").applyInPandas(partial(_mmr, lam=lam, k=k), "query_id long, id long, rank int, score double")


def bound_candidates(hits: DataFrame, most: int = 20) -> DataFrame:
    """R17."""
    return top(hits.drop("rank"), most, F.desc("score"), F.col("id"))


def rerank_gate(hits: DataFrame, enabled: bool = True) -> DataFrame:
    """``gated`` is true for hits of queries that are not reranked (small talk and the like, or under two hits)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    off = F.lit(not enabled) | (n < 2) | F.coalesce(F.col("intent").isin("SMALL_TALK", "PERSONAL_CHAT", "CONTROL"), F.lit(False))
    return hits.withColumn("gated", off)


def token_jaccard(a: Column, b: Column) -> Column:
    """The default pair score of R19: shared words over all words."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"\s+"), ""))
    both = F.size(F.array_intersect(words(a), words(b)))
    every = F.size(F.array_union(words(a), words(b)))
    return F.when(every == 0, 0.0).otherwise(both / every)


def combine_pair_scores(hits: DataFrame) -> DataFrame:
    """``hits`` with ``pair_score``: 0.7 of it and 0.3 of the score, or the pair score alone, to six
    places in decimal arithmetic (sums of rounded scores often lie half way)."""
    exact = lambda c: F.col(c).cast("decimal(20,12)")
    mixed = F.lit(Decimal("0.7")) * exact("pair_score") + F.lit(Decimal("0.3")) * exact("score")
    combined = F.round(F.when(F.col("score").isNotNull(), mixed).otherwise(exact("pair_score")), 6).cast("double")
    return hits.withColumn("combined", combined).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "id")))


def rerank(hits: DataFrame, mode: str, top_n: int = 8) -> DataFrame:
    """``none``, ``mmr``, ``pair`` or ``mmr_then_pair``; ``hits`` has ``v`` and ``pair_score``."""
    bounded = bound_candidates(hits)
    if mode == "none":
        return bounded.where(F.col("rank") <= top_n).select("query_id", "id", "rank", "score")
    if mode in ("mmr", "mmr_then_pair"):
        single = bounded.join(dedupe_near(bounded).select("query_id", "id"), ["query_id", "id"])
        chosen = mmr(single, k=top_n if mode == "mmr" else 2 * top_n)
        if mode == "mmr":
            return chosen
        bounded = bounded.join(chosen.select("query_id", "id"), ["query_id", "id"])
    return combine_pair_scores(bounded).where(F.col("rank") <= top_n).select("query_id", "id", "rank", F.col("combined").alias("score"))


def retrieval_stats(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Average score to three places and whether it is low; queries without hits have no average and are not low."""
    stats = queries.select("query_id").join(hits.select("query_id", "score"), "query_id", "left").groupBy("query_id").agg(F.count("score").alias("n"), F.max("score").alias("max_score"), F.bround(F.avg("score"), 3).alias("avg_score"))
    return stats.withColumn("low_relevance", F.coalesce(F.col("avg_score") < 0.5, F.lit(False)))


def fallback_decision(stats: DataFrame) -> DataFrame:
    """``stats`` of R21 with ``intent``, ``error`` and ``n_web``: whether the web is searched, and the outcome."""
    general = F.col("intent") == "GENERAL_KNOWLEDGE"
    web = (F.col("n") == 0) | F.col("error") | (F.col("low_relevance") & general)
    none = (F.col("n") == 0) & ~(web & (F.col("n_web") > 0))
    weak = F.coalesce(F.col("max_score") < 0.05, F.lit(False))
    outcome = F.when(none, F.when(general, "llm_only").otherwise("no_docs_found")).when(weak, F.when(general, "llm_only_low_relevance").otherwise("no_relevant_docs")).otherwise("answer")
    return stats.withColumns({"web_search": web, "outcome": outcome})


def fuse_local_web(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local hits in order, then web hits."""
    both = local.withColumn("side", F.lit(0)).unionByName(web.withColumn("side", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("side", "rank"))).withColumn("is_web", F.col("side") == 1).drop("side")


def unique_sources(hits: DataFrame) -> DataFrame:
    """Each source once, with the score and rank of its first hit."""
    return hits.groupBy("query_id", "source").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))


def best_chunks(hits: DataFrame, docs: DataFrame, queries: DataFrame, size: int = 900, overlap: int = 180) -> DataFrame:
    """``hits(query_id, id, rank, score)`` with ``source`` and, as ``text``, the chunk of the document ``docs(id, source, text)``
    that holds the most distinct words of the query's text; ties, and queries without a text, take the earlier chunk. Documents
    without a text have no chunk and go. Only documents that are hit are split; of a document's chunks one goes through the shuffle
    for each of its queries."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"\s+"), ""))
    found = docs.join(hits.select("id").distinct(), "id", "left_semi")
    chunks = split_fixed(found.select(F.struct("id", "source").alias("doc_id"), "text"), size, overlap)
    chunks = chunks.select("doc_id.*", "chunk_index", "chunk_text", words("chunk_text").alias("held"))
    asked = queries.select("query_id", words("text").alias("words"))
    scored = hits.select("query_id", "id", "rank", "score").join(asked, "query_id", "left").join(chunks, "id")
    n = F.coalesce(F.size(F.array_intersect("words", "held")), F.lit(0))
    best = scored.groupBy("query_id", "id", "rank", "score").agg(F.max_by(F.struct("source", "chunk_text"), F.struct(n, -F.col("chunk_index"))).alias("best"))
    return best.select("query_id", "id", "rank", "score", "best.source", F.col("best.chunk_text").alias("text"))


def build_context(hits: DataFrame) -> DataFrame:
    """``(query_id, context)``: numbered blocks of text joined by a line of dashes."""
    block = F.format_string("[Document %d] (Source: %s, Score: %s)\n%s", F.col("rank"), F.col("source"), fixed(F.col("score").cast("double"), 3), F.col("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return hits.groupBy("query_id").agg(F.array_join(blocks, "\n\n---\n\n").alias("context"))


def compress_hits(hits: DataFrame, min_score: float = 0.3, most: int = 10) -> DataFrame:
    """Weak hits go; of each chunk (or, without an id, of each text's first 80 characters) the best stays."""
    key = F.coalesce(F.col("chunk_id"), F.left("text", F.lit(80)))
    best = top(hits.where(F.col("score") >= min_score).withColumn("key", key), 1, F.desc("score"), F.col("source"), keys=("query_id", "key"), name="n")
    return top(best.drop("n"), most, F.desc("score"), F.col("key")).drop("key")


def rank_evidence(facts: DataFrame, min_score: float = 0.3, most: int = 10, scored: bool = True) -> DataFrame:
    """Facts by pair score above the threshold; without a scorer by score, unfiltered."""
    by = "pair_score" if scored else "score"
    return top(facts.where(F.col(by) >= min_score) if scored else facts, most, F.desc(by), F.col("id"))


def multi_query_union(plan: DataFrame, hits: DataFrame, first: int = 3) -> DataFrame:
    """``plan(query_id, queries array)``, ``hits(text, id, rank, score)``: hits of the first planned queries, each
    chunk once, at its first place."""
    asked = plan.select("query_id", F.posexplode(F.slice("queries", 1, first)).alias("pos", "text"))
    return asked.join(hits, "text").groupBy("query_id", "id").agg(F.min_by("score", F.struct("pos", "rank")).alias("score"), F.min(F.struct("pos", "rank")).alias("at")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).drop("at")


def fallback_plan(queries: DataFrame) -> DataFrame:
    """From ``(query_id, text, rewritten, subquestions, entities)``: up to four vector queries, five graph foci."""
    parts = F.array_compact(F.concat(F.array("rewritten"), F.coalesce("subquestions", F.array().cast("array<string>"))))
    return queries.select("query_id", F.slice(F.when(F.size(parts) > 0, parts).otherwise(F.array("text")), 1, 4).alias("vector_queries"), F.slice("entities", 1, 5).alias("graph_focus"), F.lower("text").rlike("recuerdas|anteriormente|antes|previo").alias("memory_query"))


def to_embed(texts: DataFrame, cache: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Texts without a live cached vector, and one row with hits, misses and the hit rate in percent."""
    live = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select("key").distinct()
    keyed = texts.withColumn("key", F.sha2("text", 256))
    stats = keyed.join(live.withColumn("hit", F.lit(True)), "key", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses")).withColumn("hit_rate", F.round(100.0 * F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 2))
    return keyed.join(live, "key", "left_anti"), stats


def tenant_stats(objects: DataFrame) -> DataFrame:
    """Objects of each tenant, and a row without a tenant for all."""
    return objects.rollup("tenant").agg(F.count("*").alias("n"), F.count_distinct("tenant").alias("n_tenants"))


def batch_exists(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """R32."""
    return ids.join(stored.select("id").distinct().withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def file_location(chunks: DataFrame) -> DataFrame:
    """A file's path, or source, from its first chunk."""
    return chunks.groupBy("file_id").agg(F.min_by(F.coalesce("file_path", "source"), "chunk_index").alias("location"))


def apply_grants(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(key, new_visibility, user_ids)`` by external id or hash; the ACL grows, sorted; ``changed`` tells which
    rows need an audit row."""
    keyed = changes.groupBy("key").agg(F.max("new_visibility").alias("new_visibility"), F.array_distinct(F.flatten(F.collect_list("user_ids"))).alias("grant"))
    by_id = keyed.select(F.col("key").alias("external_id"), F.col("new_visibility").alias("v1"), F.col("grant").alias("g1"))
    by_hash = keyed.select(F.col("key").alias("hash"), F.col("new_visibility").alias("v2"), F.col("grant").alias("g2"))
    none = F.array().cast("array<string>")
    df = chunks.join(by_id, "external_id", "left").join(by_hash, "hash", "left")
    acl = F.array_sort(F.array_distinct(F.concat(F.coalesce("allowed_user_ids", none), F.coalesce("g1", none), F.coalesce("g2", none))))
    return df.withColumns({"changed": F.col("g1").isNotNull() | F.col("g2").isNotNull() | F.col("v1").isNotNull() | F.col("v2").isNotNull(), "visibility": F.coalesce("v1", "v2", "visibility"), "allowed_user_ids": acl}).drop("v1", "v2", "g1", "g2")
