"""Benchmark decontamination by spaced-seed hashing.

A mask is laid on consecutive words and hashes only the words under its ones, so a substituted word under a zero does
not hide a copy. Hashes of the benchmark and of the documents are joined; each hit names a diagonal (document position
less item position), along which the words are compared. Bloom filters of the benchmark's hashes, of a fixed largest
size, keep documents' hashes without a partner out of the shuffle; they decide nothing. There is one for each class of item
lengths, so a document's words travel only as far around a hit as an item of that class reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import materialise
from corpusloom.operators.joins import join_counted, left_join_present, salted_join

#: Masks for items of at least LONG words, and for shorter ones of at least 5; of items under 5 words, 80 percent are all words
#: and the mask has no gaps. With 13 words and 80 percent, at least one
#: of them fits between the substitutions of every copy that is accepted. A stretch with 26 agreeing words or more has a
#: shorter one that is accepted, so 31 words show all patterns; a test goes through them.
MASKS = ("1111011", "1010001111", "1111000101", "111010101")
SHORT_MASKS = ("1111", "11101", "11011", "10111")
LONG = 12
MAX_FILTER_BITS = 1 << 30
#: Which bits of a hash are its places in a filter; each is looked up only where those before are set.
SHIFTS = (0, 32, 17, 40)
#: The greatest lengths of the classes of items; longer items are in the last one.
CLASSES = (32, 128, 1024)
#: How many words a region's seeds lie within at most (twice the longest item's, if that is more).
SPAN = 1 << 16
U = np.uint64
STRETCHES = "doc long, item long, start_word long, n_words long, n_same long"

#: ASCII letters in lower case, ASCII punctuation and controls as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:48] = FOLD[58:65] = FOLD[91:97] = FOLD[123:128] = 32
FOLD[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every folded word of a text column, and where each row's words begin."""
    data, offs = _text.flat(column)
    data = FOLD[data]
    starts, ends, at = _text.words(data, offs)
    return _text.span_hash(data, starts, ends, 21), at


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at every position that it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = _text.coefficients(len(mask), 22)
    out = np.full(n, U(int(mask, 2)))
    for i, on in enumerate(mask):
        if on == "1":
            out += h[i : i + n] * c[i]
    return _text.mix(out)


def _inside(at: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of every position, and whether a span from it stays in that row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    return row, np.arange(n) + span <= at[row + 1]


def _masks(words: int) -> tuple[str, ...]:
    return MASKS if words >= LONG else SHORT_MASKS if words >= 5 else ("1" * words,)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 1):
        h, at = _words(batch.column(1))
        size = np.diff(at)
        ids = batch.column(0)
        for low, high in ((1, 1), (2, 2), (3, 3), (4, 4), (5, LONG - 1), (LONG, 1 << 60)):
            for mask in _masks(low):
                seed = _masked(h, mask)
                row, ok = _inside(at, len(seed), len(mask))
                ok &= (size[row] >= low) & (size[row] <= high)
                yield pa.record_batch([ids.take(pa.array(row[ok])), pa.array(np.flatnonzero(ok) - at[row[ok]]), _text.long_array(seed[ok]), pa.array(size[row[ok]])], names=["item", "item_pos", "h", "item_words"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 1):
        h, at = _words(batch.column(1))
        yield pa.record_batch([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["item", "item_hashes"])


def _regions(batches: Iterator[pa.RecordBatch], filters: list[tuple[bytes, int]], masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Documents' seeds that pass the filter of a class (its bits and its items' greatest length), in regions of word hashes
    wide enough for the class's items around them."""
    for batch in _text.slices(batches, 1):
        h, at = _words(batch.column(1))
        seeds = [(len(m), _masked(h, m)) for m in masks]
        rows: list[tuple] = []
        for bloom, reach in filters:
            bits = np.frombuffer(bloom, np.uint8)
            top = U(len(bits) * 8 - 1)
            found = []
            for span, seed in seeds:
                where = np.arange(len(seed))
                for shift in SHIFTS:
                    slot = (seed[where] >> U(shift)) & top
                    where = where[(bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1]
                row = np.searchsorted(at, where, "right") - 1
                ok = where + span <= at[row + 1]
                found.append((where[ok], seed[where[ok]], row[ok]))
            pos, seed, row = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(pos, kind="stable")
            pos, seed, row = pos[order], seed[order], row[order]
            # A long stretch of seeds is cut, too; every part keeps the words that its seeds' items can reach.
            part = (pos - at[row]) // max(SPAN, 2 * reach)
            cut = np.append(True, (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + reach) | (part[1:] != part[:-1]))
            first = np.flatnonzero(cut) if len(pos) else []
            for i, j in zip(first, [*first[1:], len(pos)]):
                a, b = max(at[row[i]], pos[i] - reach), min(at[row[i] + 1], pos[j - 1] + reach)
                rows.append((batch.column(0)[int(row[i])].as_py(), reach, int(a - at[row[i]]), h[a:b].tobytes(), (pos[i:j] - at[row[i]]).tolist(), seed[i:j].view(np.int64).tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc", "reach", "region", "hashes", "pos", "h"])


def _verified(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            # The document's words from the diagonal's first place in it on, against the item's that stand there.
            doc, item = np.frombuffer(r["window"], np.uint64), np.frombuffer(r["item_hashes"], np.uint64)
            a = r["skipped"]
            b = min(len(item), a + len(doc))
            if b <= a:
                continue
            same = doc[: b - a] == item[a:b]
            # Of the stretches in which enough words agree, the one with the most: its end's score is at least that of its
            # beginning, a match counting for 100 - percent and a substitution against it with percent.
            score = np.append(0, np.cumsum(np.where(same, 100 - percent, -percent)))
            count = np.append(0, np.cumsum(same))
            first = np.searchsorted(-np.minimum.accumulate(score), -score)
            end = int(np.argmax(count - count[first]))
            begin, n = int(first[end]), int(count[end] - count[first[end]])
            if not n:
                continue
            hit = np.flatnonzero(same[begin:end])
            begin, end = begin + int(hit[0]), begin + int(hit[-1])
            if n >= min(words, -(-percent * len(item) // 100)):
                out.append((r["doc"], r["item"], a + begin + r["diagonal"], end + 1 - begin, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "item", "start_word", "n_words", "n_same"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 13, percent: int = 80, min_words: int = 1) -> DataFrame:
    """``(doc, item, start_word, n_words, n_same)``: stretches of documents that copy a benchmark item.

    Words are compared in ASCII lower case with ASCII punctuation as white space. A stretch is verified if its words
    agree with the item's, position by position, in ``words`` places (or in ``percent`` of an item that is shorter: all words
    of items under 5) and in ``percent`` of the stretch. With lower values than these defaults the masks may miss copies.
    Items under ``min_words`` are left out. Null texts match nothing; documents or items without an id are left out; repeated
    rows give the same result once. Both tables may be empty.

    Seeds that stand in many documents are joined in counted parts; a pair carries as many words as its item has.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")
    size_class = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        size_class = F.when(F.col("item_words") <= most, i).otherwise(size_class)
    seeds = materialise(items.mapInArrow(_item_seeds, "item long, item_pos long, h long, item_words long").where(F.col("item_words") >= min_words).withColumn("class", size_class), "seeds")
    filters, lengths, reach = [], set(), F.lit(0)
    # Of each class at most size / 64 words of the filter come to the driver; the classes share MAX_FILTER_BITS.
    for r in sorted(seeds.groupBy("class").agg(F.count("*").alias("n"), F.max("item_words").alias("reach"), F.collect_set(F.least("item_words", F.lit(LONG))).alias("lengths")).collect()):
        size = min(MAX_FILTER_BITS // (2 * len(CLASSES)), max(1 << 16, 1 << (32 * r.n).bit_length()))
        size = 1 << size.bit_length() - 1
        slots = seeds.where(F.col("class") == r["class"]).select(F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(size - 1) for k in SHIFTS))).alias("s"))
        parts = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")).toArrow()
        bloom = np.zeros(size // 64, np.int64)
        bloom[parts.column("word").to_numpy()] = parts.column("bits").to_numpy()
        filters.append((bloom.tobytes(), int(r.reach)))
        reach = F.when(F.col("class") == r["class"], int(r.reach)).otherwise(reach)
        lengths |= set(r.lengths)
    masks = tuple(dict.fromkeys(m for n in sorted(lengths) for m in _masks(n)))
    if not masks:
        return docs.sparkSession.createDataFrame([], STRETCHES)
    found = rows.mapInArrow(partial(_regions, filters=filters, masks=masks), "doc long, reach long, region long, hashes binary, pos array<long>, h array<long>")
    found = materialise(found, "regions")
    hits = found.select("doc", "reach", "region", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("doc", "reach", "region", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"))
    pairs = salted_join(hits, seeds.select("item", "item_pos", "item_words", "h", reach.alias("item_reach")), "h").where("item_reach = reach")
    pairs = pairs.select("doc", "reach", "region", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_words").distinct()
    skipped = F.greatest(F.lit(0), F.col("region") - F.col("diagonal"))
    begin, length = F.greatest(F.lit(0), F.col("diagonal") - F.col("region")), F.col("item_words") - skipped
    window = F.expr("substring(hashes, cast(8 * begin + 1 as int), cast(8 * length as int))")
    full = pairs.join(found.select("doc", "reach", "region", "hashes"), ["doc", "reach", "region"]).withColumns({"skipped": skipped, "begin": begin, "length": length}).where("length > 0")
    full = materialise(full.select("item", "doc", "diagonal", "skipped", window.alias("window")), "windows")
    known = full.groupBy("item").agg(F.count("*").alias("n")).join(items.mapInArrow(_item_words, "item long, item_hashes binary"), "item")
    full = join_counted(full, materialise(known, "items"), "item", "n")
    return full.mapInArrow(partial(_verified, words=words, percent=percent), STRETCHES).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, contaminated, n_items, items)``, the ids of the items that it copies
    in ascending order. A row without an id is not judged and counts as clean."""
    items = overlaps(docs, benchmark, id_col=id_col, **options).groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = left_join_present(docs.select(F.col(id_col).alias("__id"), F.col(id_col).cast("long").alias("doc")), items, "doc")
    return rows.select(F.col("__id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that copy a benchmark item; all columns stay."""
    bad = overlaps(docs, benchmark, id_col=id_col, **options).select(F.col("doc").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).cast("long") == F.col("__bad"), "left_anti")
