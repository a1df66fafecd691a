"""Importance resampling towards a target by hashed n-gram features with a head-tail vocabulary.

Features are runs of one to ``GRAMS`` words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The bytes of most
features are never walked through: the CRC of two texts together follows from both CRCs and the second one's length, so frequent
words go to the tasks as exact CRC states and frequent pairs as the states (and so buckets) of the whole pair. What is not in
these two tables, the tail, takes its CRC from the bytes. Both ways give the same exact value, hence the same bucket totals.

Frequent words and pairs are found by counts: a batch reports what makes up over ``1 / HEAD`` of its own words, and what the
reports add up to that share of all words is kept, so either table has at most ``HEAD`` rows of bounded length. The tables only
decide how a CRC is computed, never what is counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import materialise, width

GRAMS, BUCKETS, HEAD = 3, 10_000, 1 << 14
#: Bytes of the longest word that may be in the head, and of the longest whose bytes are walked through side by side.
LONG = 64

#: Bytes of words: digits, letters and all bytes of characters beyond ASCII.
INK = np.zeros(256, bool)
INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The CRC-32 table of one byte (reversed polynomial).
STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    STEP = np.where(STEP & 1, (STEP >> 1) ^ np.uint32(0xEDB88320), STEP >> 1)


@lru_cache(1)
def _shifts() -> np.ndarray:
    """``[n, i, v]``: byte ``v`` at place ``i`` of a CRC after ``n`` further zero bytes, for ``n`` up to ``LONG + 1``."""
    out = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    rows = [np.stack(out)]
    for _ in range(LONG + 1):
        rows.append(STEP[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows)


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs of texts that end in parts of ``size`` bytes, from the CRCs of what is before and of these parts."""
    s = _shifts()
    return s[size, 0, first & 255] ^ s[size, 1, first >> 8 & 255] ^ s[size, 2, first >> 16 & 255] ^ s[size, 3, first >> 24] ^ second


def walked(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs ``state`` continued by the bytes of each span."""
    out = state.astype(np.uint32)
    far = np.flatnonzero(size > LONG)
    for i in far.tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]], int(out[i]))
    order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
    least = np.where(size > LONG, 0, size)[order]
    c, at = ~out[order], starts[order]
    for j in range(int(least[0]) if len(least) else 0):
        n = int(np.searchsorted(-least, -j, "left"))
        c[:n] = STEP[(c[:n] ^ data[at[:n] + j]) & 255] ^ (c[:n] >> np.uint32(8))
    out[order] = np.where(least > 0, ~c, out[order])
    return out


class Head:
    """CRC states of frequent words (alone, and after a space) and of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.words = {w: i for i, w in enumerate(sorted(words))}
        self.alone = np.array([zlib.crc32(w) for w in sorted(words)], np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in sorted(words)], np.uint32)
        keys = sorted((self.words[a] << 32 | self.words[b], zlib.crc32(p)) for p in pairs for a, b in [p.split(b" ")] if a in self.words and b in self.words)
        self.keys = np.array([k for k, _ in keys] or [-1], np.int64)
        self.states = np.array([c for _, c in keys] or [0], np.uint32)


class Words:
    """The words of a batch: distinct ones with their first place, and the places of all."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = _text.LOWER[data]
        starts, ends, self.at = _words(self.data, offs)
        self.code, first = _text.unique_spans(self.data, starts, ends)
        self.start, self.size = starts[first], (ends - starts)[first]
        #: Whether the next word is in the same row, and the one after it.
        row = np.repeat(np.arange(len(offs) - 1), np.diff(self.at))
        self.has2 = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
        self.has3 = np.append(self.has2[1:] & self.has2[:-1], False) if len(row) else np.zeros(0, bool)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Bytes that belong to no word become spaces; the runs between are words then.
    return _text.words(np.where(INK[data], data, 32).astype(np.uint8), offs)


def _tables(w: Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word its number in the head (or -1), its CRC, and its CRC after a space."""
    known = np.fromiter((head.words.get(w.text(i), -1) if w.size[i] <= LONG else -1 for i in range(len(w.start))), np.int64, len(w.start))
    alone, after = (np.zeros(len(known), np.uint32) for _ in range(2))
    alone[known >= 0], after[known >= 0] = head.alone[known[known >= 0]], head.after[known[known >= 0]]
    tail = np.flatnonzero(known < 0)
    alone[tail] = walked(np.zeros(len(tail), np.uint32), w.data, w.start[tail], w.size[tail])
    return known, alone, after


def features(w: Words, head: Head) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words: the places at which a run begins, and the run's bucket."""
    known, alone, after = _tables(w, head)
    space = np.array([zlib.crc32(b" ")], np.uint32)

    def more(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRCs continued by a space and a word."""
        out = np.empty(len(state), np.uint32)
        often = known[word] >= 0
        out[often] = joined(state[often], after[word[often]], w.size[word[often]] + 1)
        rest, others = state[~often], word[~often]
        out[~often] = walked(joined(rest, space.repeat(len(rest)), np.ones(len(rest), np.int64)), w.data, w.start[others], w.size[others])
        return out

    n = len(w.code)
    out = [(np.arange(n), alone[w.code])]
    two = np.flatnonzero(w.has2)
    # Equal pairs of a batch are computed once.
    pair, first = _distinct(w.code[two] * max(1, len(known)) + w.code[two + 1])
    a, b = w.code[two][first], w.code[two + 1][first]
    key = np.where((known[a] >= 0) & (known[b] >= 0), known[a] << 32 | known[b], -2)
    at = np.minimum(np.searchsorted(head.keys, key), len(head.keys) - 1)
    hit = head.keys[at] == key
    state = np.empty(len(a), np.uint32)
    state[hit] = head.states[at[hit]]
    state[~hit] = more(alone[a[~hit]], b[~hit])
    of_two = np.zeros(n, np.uint32)
    of_two[two] = state[pair]
    out.append((two, of_two[two]))
    three = np.flatnonzero(w.has3)
    out.append((three, more(of_two[three], w.code[three + 2])))
    return [(p, (c % np.uint32(BUCKETS)).astype(np.int64)) for p, c in out]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, values = pd.factorize(key)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def _parts(data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long text in parts that end outside words: each with the last words of those before (its carry) in front, and the
    carry itself, whose features have been counted."""
    carry, at = np.zeros(0, np.uint8), 0
    while at < len(data):
        to = at + limit
        while to < len(data):
            gap = np.flatnonzero(~INK[data[to : to + limit]])
            if len(gap):
                to += int(gap[0])
                break
            to += limit
        part = np.concatenate([carry, data[at:to]])
        yield part, carry
        starts, ends, _ = _words(part, np.array([0, len(part)]))
        last = range(max(0, len(starts) - GRAMS + 1), len(starts))
        carry = np.concatenate([np.zeros(0, np.uint8), *(np.append(part[starts[i] : ends[i]], np.uint8(32)) for i in last)]).astype(np.uint8)
        at = to


def _each(batches: Iterator[pa.RecordBatch], head: Head, column: int, limit: int, add: Callable[[pa.RecordBatch, Words, list, int], None]) -> Iterator[pa.RecordBatch]:
    """Call ``add(batch, words, features, sign)`` for the texts of all batches; what a text's parts count twice comes again with
    sign -1. Yields each batch when it is done."""
    for batch in _text.slices(batches, column, limit):
        data, offs = _text.flat(batch.column(column))
        if batch.num_rows == 1 and len(data) > 2 * limit:
            for part, carry in _parts(data, limit):
                for text, sign in ((part, 1), (carry, -1)):
                    w = Words(text, np.array([0, len(text)]))
                    add(batch, w, features(w, head), sign)
        else:
            w = Words(data, offs)
            add(batch, w, features(w, head), 1)
        yield batch


def _often(batches: Iterator[pa.RecordBatch], share: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs that make up over ``1 / share`` of a batch's words, with their counts, and (as a null) all its words."""
    for batch in _text.slices(batches, 0, limit):
        w = Words(*_text.flat(batch.column(0)))
        n = len(w.code)
        if not n:
            continue
        least = max(2, -(-n // share))
        short = w.size <= LONG
        count = np.bincount(w.code, minlength=len(w.start))
        some = np.flatnonzero((count >= least) & short)
        two = np.flatnonzero(w.has2 & short[w.code])
        two = two[short[w.code[two + 1]]]
        pair, first = _distinct(w.code[two] * len(w.start) + w.code[two + 1])
        pairs = np.bincount(pair, minlength=len(first))
        both = np.flatnonzero(pairs >= least)
        texts = [w.text(i) for i in some] + [w.text(w.code[two[first[i]]]) + b" " + w.text(w.code[two[first[i]] + 1]) for i in both]
        kinds = [1] * len(some) + [2] * len(both)
        yield pa.record_batch([pa.array([0, *kinds], pa.int32()), pa.array([None, *texts], pa.binary()), pa.array([n, *count[some], *pairs[both]], pa.int64())], names=["kind", "t", "n"])


def head_table(docs: DataFrame, text_col: str = "text", share: int = HEAD, limit: int = 6 << 20) -> Head:
    """The frequent words and pairs of ``docs``: at most ``share`` of either, each of at most ``LONG`` bytes a word."""
    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(partial(_often, share=share, limit=limit), "kind int, t binary, n long")
    found = materialise(found.groupBy("kind", "t").agg(F.sum("n").alias("n")), "head")
    total = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("kind") > 0).where(F.col("n") * share >= total).select("kind", "t").toPandas()
    return Head(*([bytes(x) for x in rows["t"][rows["kind"] == k]] for k in (1, 2)))


def _totals(batches: Iterator[pa.RecordBatch], head: Head, limit: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)

    def add(_: pa.RecordBatch, w: Words, found: list, sign: int) -> None:
        for _, bucket in found:
            total[:] += sign * np.bincount(bucket, minlength=BUCKETS)

    for _ in _each(batches, head, 0, limit, add):
        pass
    if total.any():
        yield pa.record_batch([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(total)], names=["bucket", "n"])


def bucket_totals(texts: DataFrame, head: Head, text_col: str = "text", limit: int = 6 << 20) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall in each bucket, ``BUCKETS`` rows at most; tasks add up their own first."""
    return texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(partial(_totals, head=head, limit=limit), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` for each of the ``BUCKETS`` buckets: a table of fixed size."""
    spark = corpus.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.toDF("bucket", "s"), "bucket", "left").join(target.toDF("bucket", "t"), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c, more: (c + more).cast("double")
    ratio = d(F.col("t"), 1) * d(F.lit(sums[0]), BUCKETS) / (d(F.col("s"), 1) * d(F.lit(sums[1]), BUCKETS))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("g")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"]] = rows["g"]
    return out


def _weights(batches: Iterator[pa.RecordBatch], head: Head, gain: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    sums: list[np.ndarray] = []

    def add(batch: pa.RecordBatch, w: Words, found: list, sign: int) -> None:
        if not sums:
            sums.append(np.zeros((3, batch.num_rows), np.int64))
        out = sums[0]
        out[0] += sign * np.diff(w.at)
        for place, bucket in found:
            cut = np.searchsorted(place, w.at)
            out[1] += sign * np.diff(cut)
            out[2] += sign * np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[cut])

    for batch in _each(batches, head, 1, limit, add):
        words, n, weight = sums.pop()
        yield pa.record_batch([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])


def noise(id_: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))`` with ``h`` from the SHA-256 of ``seed:id``: Gumbel noise that a row keeps for ever."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, most: int, by: list[Column]) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... in the order ``by`` up to ``most``, null beyond. Rows are sorted over ranges and numbered
    by the counts of the ranges before, so no task sees all of them; the driver sees one count for each range."""
    dealt = rows.repartitionByRange(width(rows), *by).withColumn("__range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    counts = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for i in sorted(counts):
        starts.append((i, before))
        before += counts[i]
    offset = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    out = dealt.withColumn("__place", place).join(offset, "__range").withColumn("rank", F.col("__place") + F.col("__before"))
    return out.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("__range", "__place", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = HEAD, limit: int = 6 << 20) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)``, one row for each row of ``docs``.

    ``weight`` says how much likelier the document's features are in ``target`` than in ``docs``; ``score`` adds Gumbel noise, so
    that the highest scores are a draw without replacement in proportion to the weights. ``floor(percent * N / 100)`` of the N
    rows with ``min_words`` words or more are drawn and have a ``rank``; ties go to the smaller id.

    A null or empty text has no features and the weight 0. A row without an id has no score, is not one of the N and not drawn.
    Rows that repeat an id are rows of their own. Without any row, or with an empty target, the same formulas hold. Other columns
    of either table are not read. The texts are read three times and never shuffled; texts of many MB go in parts."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    head = head_table(texts, "t", share, limit)
    gain = gains(bucket_totals(texts, head, "t", limit), bucket_totals(target, head, target_col, limit))
    rows = texts.mapInArrow(partial(_weights, head=head, gain=gain, limit=limit), f"id {kind}, n_words long, n_features long, weight long")
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    able = (F.col("n_words") >= min_words) & F.col("id").isNotNull()
    n = rows.where(able).count()
    out = ranked(rows.where(able), percent * n // 100, [F.col("score").desc(), F.col("id"), F.col("n_features")])
    out = out.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns."""
    taken = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("__id"))
    return docs.join(taken.distinct(), F.col(id_col) == F.col("__id"), "left_semi")
