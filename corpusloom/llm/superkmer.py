"""Removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least hash among its ``m``-word groups; consecutive windows
with one minimiser travel as one packed string to the minimiser's bucket, where sorting brings equal windows together.

Groups of words that stand in a great part of all windows make bad minimisers, so they are counted first over the whole
table and come last in the order. A window of such groups only goes by two of them, its least and its greatest.

Windows are first compared within the piece of input that a task holds (a few MB of text). An occurrence that has an
earlier document there is settled and does not travel, so a passage in a third of all documents arrives once for each
piece, whatever the number of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import materialise, width
from corpusloom.operators.joins import left_join_present

U = np.uint64
MINIMISER = 3
#: A reducing task holds at most about so many windows, and sorts so many at once; a larger bucket takes several
#: passes over its strings.
HELD, SORTED = 2_000_000, 500_000
#: The least share of all windows from which on a minimiser may count as frequent, whatever the number of buckets: it bounds
#: the list of frequent groups, which goes to all tasks, to 11 times its reciprocal.
LEAST_SHARE = 2.0**-16
MAPPED = "bucket int, slot int, runs binary, packed binary"
SLOTTED = "slot int, runs binary"


def _both(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes and two independent hashes of every window; windows may span rows here."""
    one, two = _text.span_hash(data, starts, ends, 11), _text.span_hash(data, starts, ends, 12)
    return one, _text.rolling(one, k, 13), _text.rolling(two, k, 14)


def _earlier(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a window with the same two hashes has a smaller document id."""
    order = np.lexsort((doc, a))
    new = np.ones(len(a), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    if (~new[1:] & (b[order][1:] != b[order][:-1])).any():  # windows that share the first hash only
        order = np.lexsort((doc, b, a))
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    d = doc[order]
    out = np.empty(len(a), bool)
    out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _runs(doc: np.ndarray, pos: np.ndarray, slots: int) -> Iterator[tuple[int, bytes]]:
    """Window positions as runs (document, first, last), packed by the documents' slots."""
    if not len(doc):
        return
    slot = doc % slots
    order = np.lexsort((pos, doc, slot))
    doc, pos, slot = doc[order], pos[order], slot[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(cut)
    runs = np.stack([doc[first], pos[first], pos[np.append(first[1:], len(doc)) - 1]]).astype(np.int64)
    at = np.flatnonzero(np.append(True, slot[first][1:] != slot[first][:-1]))
    zip_ = zstandard.ZstdCompressor(level=1)
    for i, j in zip(at, np.append(at[1:], len(first))):
        yield int(slot[first[i]]), zip_.compress(runs[:, i:j].tobytes())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs of whole slots as one row for each document."""
    blobs = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(3, -1) for b in batches for x in b.column("runs").to_pylist()]
    if not blobs:
        return
    doc, first, last = np.concatenate(blobs, axis=1)
    del blobs
    order = np.argsort(doc, kind="stable")
    doc, pairs = doc[order], np.stack([first[order], last[order]], axis=1).astype(np.int32)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(edge[1:], len(doc))
    for k in range(0, len(edge), 8192):
        i, j = edge[k : k + 8192], ends[k : k + 8192]
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array([pairs[a:b].tobytes() for a, b in zip(i, j)], pa.binary())], names=["doc", "runs"])


def _groups(h: np.ndarray) -> np.ndarray:
    """The numbers, below 2^63, of the groups of words that may be minimisers."""
    return _text.rolling(h, MINIMISER, 15) >> U(1)


def _counted(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Groups with half of the share of a piece of input or more, and the number of all groups as that of group -1. A group
    with the share of all pieces has at least half of its occurrences in such pieces."""
    for batch in _text.slices(batches, 1):
        data, offs = _text.flat(batch.column(1))
        starts, ends, at = _text.words(data, offs)
        if len(starts) < MINIMISER:
            continue
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        groups = _groups(_text.span_hash(data, starts, ends, 11))[row[: len(row) - MINIMISER + 1] == row[MINIMISER - 1 :]]
        which, n = np.unique(groups, return_counts=True)
        often = n >= max(2.0, share / 2 * len(groups))
        yield pa.record_batch([_text.long_array(np.append(which[often].astype(np.int64), -1)), _text.long_array(np.append(n[often], len(groups)))], names=["g", "n"])


def frequent_groups(rows: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Sorted groups of which each, as a minimiser, could bring a bucket more windows than its part: at most
    ``k`` times the number of buckets, or of the reciprocal of LEAST_SHARE."""
    share = max(1 / buckets, LEAST_SHARE) / (k - MINIMISER + 1)
    counts = materialise(rows.mapInArrow(partial(_counted, share=share), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "groups")
    total = (counts.where("g = -1").first() or (0, 0))[1]
    often = counts.where((F.col("g") >= 0) & (F.col("n") >= share * total / 2)).select("g").toArrow()
    return np.sort(often.column("g").to_numpy().astype(np.uint64))


def _mapped(batches: Iterator[pa.RecordBatch], k: int, buckets: int, slots: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in _text.slices(batches, 1, 4 << 20):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offs = _text.flat(batch.column(1))
        starts, ends, at = _text.words(data, offs)
        if len(starts) < k:
            continue
        h, a, b = _both(data, starts, ends, k)
        row = np.repeat(np.arange(len(ids)), np.diff(at))
        real = np.flatnonzero(row[: len(a)] == row[k - 1 :])  # windows within one document
        if not len(real):
            continue
        row_of, doc = row[real], ids[row[real]]
        pos = real - at[row_of]
        settled = _earlier(a[real], b[real], doc)
        rows = [(slot % buckets, slot, r, None) for slot, r in _runs(doc[settled], pos[settled], slots)]
        least = _groups(h)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)] == least
            least |= often.astype(np.uint64) << U(63)
        key, most = least[: len(a)].copy(), least[: len(a)].copy()
        for i in range(1, k - MINIMISER + 1):
            np.minimum(key, least[i : i + len(a)], out=key)
            if len(frequent):
                np.maximum(most, least[i : i + len(a)], out=most)
        key = np.where(key >> U(63), _text.mix(key ^ _text.mix(most)), key)[real]
        # A super-k-mer: consecutive unsettled windows of a document with one minimiser.
        free = np.flatnonzero(~settled)
        if len(free):
            cut = np.ones(len(free), bool)
            cut[1:] = (key[free][1:] != key[free][:-1]) | (real[free][1:] != real[free][:-1] + 1) | (row_of[free][1:] != row_of[free][:-1])
            first = free[cut]
            count = np.diff(np.append(np.flatnonzero(cut), len(free)))
            bucket = (key[first] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, count, bucket = first[order], count[order], bucket[order]
            w0 = real[first]
            lo, hi = starts[w0], ends[w0 + count + k - 2]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for i, j in zip(edge, np.append(edge[1:], len(first))):
                # Each string with the white space (or the cut) behind it as one line break, and its numbers by byte planes.
                text = _text.gather(data, lo[i:j], hi[i:j] - lo[i:j] + 1, fill=10)
                text[np.cumsum(hi[i:j] - lo[i:j] + 1) - 1] = 10
                numbers = np.stack([np.diff(doc[first[i:j]], prepend=0), pos[first[i:j]], count[i:j]]).astype(np.int64)
                rows.append((int(bucket[i]), None, None, zip_.compress(np.int64(j - i).tobytes() + numbers.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes() + text.tobytes())))
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "slot", "runs", "packed"])


def _unpacked(blob: bytes, k: int) -> tuple[np.ndarray, ...]:
    """Two hashes, document and position of every window in a packed group of super-k-mers."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, pos, count = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 24 * n, 8).reshape(3, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(3, n)
    doc = np.cumsum(doc)
    data = np.frombuffer(raw, np.uint8, -1, 8 + 24 * n)
    starts, ends, _ = _text.words(data, np.array([0, len(data)]))
    at = np.concatenate([[0], np.cumsum(count + k - 1)])
    _, a, b = _both(data, starts, ends, k)
    w = np.arange(count.sum()) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    return a[w], b[w], np.repeat(doc, count), w - np.repeat(at[:-1], count) + np.repeat(pos, count)


def _reduced(batches: Iterator[pa.RecordBatch], k: int, slots: int) -> Iterator[pa.RecordBatch]:
    blobs, total = [], 0
    for batch in batches:
        done = batch.filter(batch.column("runs").is_valid())
        if done.num_rows:
            yield done.select(["slot", "runs"])
        blobs += [x for x in batch.column("packed").to_pylist() if x is not None]
    total = sum(zstandard.frame_content_size(x) for x in blobs) // 24
    passes = max(1, -(-total // HELD))
    for p in range(passes):
        kept: list[list[np.ndarray]] = [[], [], [], []]
        for blob in blobs:
            part = _unpacked(blob, k)
            if passes > 1:
                own = part[1] % U(passes) == U(p)
                part = tuple(x[own] for x in part)
            for store, x in zip(kept, part):
                store.append(x)
        if not kept[0]:
            return
        a, b, doc, pos = map(np.concatenate, kept)
        del kept
        late = np.zeros(len(a), bool)
        sorts = max(1, len(a) // SORTED)
        which = (a % U(sorts)).astype(np.int32)
        for i in range(sorts):
            own = np.flatnonzero(which == i)
            late[own] = _earlier(a[own], b[own], doc[own])
        rows = list(_runs(doc[late], pos[late], slots))
        for i in range(0, len(rows), 1024):
            slot, runs = zip(*rows[i : i + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(runs, pa.binary())], names=["slot", "runs"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """``(doc, runs)``, one row for each document with any: runs of window positions (int32 pairs, both inclusive) whose
    words also start a window of a document with a smaller id. Rows without an id take no part."""
    n = width(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    frequent = frequent_groups(rows, k, 4 * n)
    mapped = rows.mapInArrow(partial(_mapped, k=k, buckets=4 * n, slots=4 * n, frequent=frequent), MAPPED)
    found = mapped.repartition(n, "bucket").mapInArrow(partial(_reduced, k=k, slots=4 * n), SLOTTED)
    return found.repartition(n, "slot").mapInArrow(_merged, "doc long, runs binary")


def _cover(batches: Iterator[pa.RecordBatch], k: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 1, 4 << 20):
        data, offs = _text.flat(batch.column(1))
        starts, ends, at = _text.words(data, offs)
        gone = np.zeros(len(starts) + 1, np.int32)
        n = np.diff(at)
        for i, runs in enumerate(batch.column(2).to_pylist()):
            if runs:
                first, last = np.frombuffer(runs, np.int32).reshape(-1, 2).T
                np.add.at(gone, at[i] + np.minimum(first, n[i]), 1)
                np.add.at(gone, at[i] + np.minimum(last + k, n[i]), -1)
        removed = np.cumsum(gone[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(removed)])
        out, raw = [], data.tobytes()
        for i in range(batch.num_rows):
            a, b = at[i], at[i + 1]
            left = np.flatnonzero(~removed[a:b]) + a
            out.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())]))
        if texts:
            last = pa.array([x.decode() for x in out], pa.string())
        else:
            last = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
        yield pa.record_batch([batch.column(0), _text.long_array(n), _text.long_array(before[at[1:]] - before[at[:-1]]), last], names=["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, n_words, n_removed, kept_text)``, or with ``digest`` the SHA-256
    of the kept text as ``kept_sha256``.

    Words are runs of characters other than ASCII white space. A word is removed if one of the ``k``-word windows over
    it also starts in a document with a smaller id; all windows are judged on the input. Kept words are joined by one
    space. A null or empty text has no words. Repeats within one document stay. A row without an id keeps all its words
    and takes none from others. Rows that repeat an id count as one document and never take words from each other.
    Windows are compared by two independent 64-bit hashes (128 bits decide), in buckets of any size.
    """
    found = repeated_windows(docs, id_col, text_col, k)
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    rows = left_join_present(rows, found, "doc").select("id", "t", "runs")
    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInArrow(partial(_cover, k=k, texts=not digest), f"id {kind}, n_words long, n_removed long, kept string")
    return out.toDF(id_col, "n_words", "n_removed", "kept_sha256" if digest else "kept_text")
