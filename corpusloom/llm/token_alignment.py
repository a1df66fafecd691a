"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both token rows of a text cover the same bytes; an occurrence of A's token and one of B's are linked where their byte ranges overlap.
Documents are numbered within chunks (``slot``, below 65,536). For each pair of ids a chunk has one posting: the compressed bitmap
of the slots that hold the pair linked (sorted 16-bit slots, or plain bits where these are fewer bytes), and multiplicity planes,
bit ``j`` of (links - 1) for each slot of the bitmap. Bitmaps of a chunk's batches are OR-merged; the popcounts of a pair's bitmaps add
up to its document count, for different chunks hold different documents, and those of its planes to its links. Postings then return
to their slots with the pair's count. Texts are never shuffled, postings only where there are too many pairs to broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import materialise, width
from corpusloom.llm.sentencepiece_bpe import Vocabulary, _vocabulary
from corpusloom.operators.joins import join_counted

#: A chunk is closed at so many documents, or so many (pair, document) entries.
SLOTS, ENTRIES = 1 << 16, 1 << 18
#: Pairs that are broadcast with their counts (under 30 bytes each); beyond that they are joined.
MOST = 1 << 19
#: Words whose ids a Python worker remembers.
CACHE = 1 << 19
#: Bytes that begin a character other than white space, so that a space before them begins a token of A.
SOLID = np.zeros(256, bool)
SOLID[[*range(33, 127), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
SCHEMA = "chunk long, slot int, id {kind}, n_a long, n_b long, n_groups long, n_links long, sha string, pair long, n long, links long, docs binary, planes binary"


class ByteLevel:
    """A byte-level BPE model (tokenizers), run over the distinct parts of a batch that it never joins."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        m = json.loads(model)
        step = m.get("pre_tokenizer") or {}
        if m.get("normalizer") or step.get("type") != "ByteLevel" or not step.get("use_regex") or step.get("add_prefix_space") or m.get("truncation") or m.get("padding"):
            raise ValueError("a byte-level model without a normaliser, with its pattern and without an added space is needed")
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        # Bytes that stand for themselves in a byte-level vocabulary; the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.count = max(vocabulary.values()) + 1
        raw = [b""] * self.count
        for t, i in vocabulary.items():
            raw[i] = bytes(byte[c] for c in t)
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.seen: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin. A row is cut before each space that a solid character follows."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & SOLID[data[1:]]
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        codes, first = _text.unique_spans(data, starts, ends)
        parts = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = [p for p in parts if p not in self.seen]
        for i in range(0, len(new), 4096):
            for p, e in zip(new[i : i + 4096], self.tokenizer.encode_batch([p.decode() for p in new[i : i + 4096]], add_special_tokens=False)):
                self.seen[p] = np.array(e.ids, np.uint32).tobytes()
        rows = [self.seen[p] for p in parts]
        size = np.array([len(r) for r in rows], np.int64) // 4
        ids = np.frombuffer(b"".join(rows), np.uint32).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size[codes])])
        return _text.gather(ids, (np.cumsum(size) - size)[codes], size[codes]), total[np.searchsorted(starts, offs)]


class Aligned:
    """What the rows of a batch hold: counts, links as (row, a, b), and the groups as text."""

    def __init__(self, a: ByteLevel, b: Vocabulary, data: np.ndarray, offs: np.ndarray, head: bool = True):
        rows = len(offs) - 1
        full = np.diff(offs) > 0
        # The bytes that both must cover: a space, if the text begins here, and the text.
        want, w_offs = (np.insert(data, offs[:-1][full], 32), offs + np.concatenate([[0], np.cumsum(full)])) if head else (data, offs)
        (x, x_at), (y, y_at) = a.encode(want, w_offs), b.encode(data, offs, prefix=head)
        x_end, y_end = (np.concatenate([[0], np.cumsum(s)]) for s in (a.size[x], b.out_size[y]))
        length = np.diff(w_offs)
        ok = full & (np.diff(x_end[x_at]) == length) & (np.diff(y_end[y_at]) == length)
        x, y, x_at, y_at, want, length = self._only(ok, x, y, x_at, y_at, want, w_offs)
        odd = (_text.gather(a.out, a.at[x], a.size[x]) != want) | (_text.gather(b.out, b.out_at[y], b.out_size[y]) != want)
        if odd.any():
            same = np.diff(np.concatenate([[0], np.cumsum(odd)])[np.concatenate([[0], np.cumsum(length)])]) == 0
            ok = ok & same
            x, y, x_at, y_at, want, length = self._only(same, x, y, x_at, y_at, want, np.concatenate([[0], np.cumsum(length)]))
        self.ok = ok
        x_end, y_end, row_end = np.cumsum(a.size[x]), np.cumsum(b.out_size[y]), np.cumsum(length)
        x_row, y_row = (np.searchsorted(row_end, e) for e in (x_end, y_end))
        common = np.intersect1d(x_end, y_end, assume_unique=True)
        ends = np.union1d(x_end, y_end)
        which = np.flatnonzero(ok)
        self.a, self.b = x[np.searchsorted(x_end, ends)], y[np.searchsorted(y_end, ends)]
        self.row = which[np.searchsorted(row_end, ends)] if len(ends) else np.zeros(0, np.int64)
        per = lambda r: np.bincount(which[r], minlength=rows) if len(r) else np.zeros(rows, np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = per(x_row), per(y_row), per(np.searchsorted(row_end, common)), np.bincount(self.row, minlength=rows)
        # Each group: A's ids, B's ids; a mark after each id says what comes next.
        gx, gy = np.searchsorted(common, x_end), np.searchsorted(common, y_end)
        cx, cy = np.bincount(gx, minlength=len(common)), np.bincount(gy, minlength=len(common))
        base = np.cumsum(cx + cy) - cx - cy
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        code = np.empty(len(x) + len(y), np.int64)
        code[base[gx] + np.arange(len(x)) - (np.cumsum(cx) - cx)[gx]] = x * 4 + last(gx)
        code[(base + cx)[gy] + np.arange(len(y)) - (np.cumsum(cy) - cy)[gy]] = y * 4 + np.where(last(y_row), 3, 2 * last(gy))
        text, at, size = _marked(max(a.count, b.size))
        self.text = _text.gather(text, at[code], size[code]).tobytes()
        to = np.concatenate([[0], np.cumsum(size[code])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        self.text_at = to

    @staticmethod
    def _only(ok: np.ndarray, x: np.ndarray, y: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, want: np.ndarray, w_offs: np.ndarray) -> tuple:
        length = np.diff(w_offs)[ok]
        if ok.all():
            return x, y, x_at, y_at, want, length
        nx, ny = np.diff(x_at), np.diff(y_at)
        pick = lambda v, n: v[np.repeat(ok, n)]
        ends = lambda n: np.concatenate([[0], np.cumsum(n[ok])])
        return pick(x, nx), pick(y, ny), ends(nx), ends(ny), pick(want, np.diff(w_offs)), length


@lru_cache(2)
def _marked(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each id with each mark after it, where it begins and its size."""
    raw = [f"{i}{mark}".encode() for i in range(n) for mark in (",", "|", ";", "")]
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


def bitmap(slots: np.ndarray, n: int) -> bytes:
    """Slots below ``n`` as 16-bit values or, where that is shorter, as bits behind one byte (so that their number is odd)."""
    size = -(-n // 16) * 2 + 1
    if 2 * len(slots) <= size:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(8 * size, bool)
    bits[8 + slots] = True
    return np.packbits(bits).tobytes()


def slots_of(raw: bytes) -> np.ndarray:
    """The slots of a bitmap, in order."""
    if len(raw) % 2 == 0:
        return np.frombuffer(raw, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)[1:]))


def popcount(raw: bytes) -> int:
    """How many slots a bitmap has."""
    return len(raw) // 2 if len(raw) % 2 == 0 else int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())


def planes(more: np.ndarray) -> bytes:
    """Bit planes of the values (links - 1), the lowest first; none if all are zero."""
    return b"".join(np.packbits((more >> j & 1).astype(bool)).tobytes() for j in range(int(more.max(initial=0)).bit_length()))


def links_of(raw: bytes, n: int) -> np.ndarray:
    """How many links each of the ``n`` slots has."""
    out, step = np.ones(n, np.int64), -(-n // 8)
    for j in range(len(raw) // step if raw else 0):
        out += np.unpackbits(np.frombuffer(raw, np.uint8, step, j * step), count=n).astype(np.int64) << j
    return out


class Chunk:
    """The postings of the documents of one task since the last chunk was closed."""

    def __init__(self) -> None:
        self.slots, self.entries, self.keys, self.counts = 0, 0, [], []

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        """Entries ``pair << 16 | slot``, each once, with their links."""
        self.keys.append(key)
        self.counts.append(count)
        self.entries += len(key)

    def postings(self) -> dict[str, list]:
        out: dict[str, list] = {"pair": [], "n": [], "links": [], "docs": [], "planes": []}
        if not self.entries:
            return out
        # OR-merge: an entry of several parts is one bit, and its links add up.
        key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(self.counts)).astype(np.int64)
        slot, pair = key & 0xFFFF, key >> 16
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
        out["links"] = np.add.reduceat(count, edge[:-1])
        out["planes"] = [planes(count[i:j] - 1) if many else b"" for i, j, many in zip(edge.tolist(), edge[1:].tolist(), out["links"] > np.diff(edge))]
        out["docs"] = [bitmap(slot[i:j], self.slots) for i, j in zip(edge.tolist(), edge[1:].tolist())]
        out["n"] = [popcount(d) for d in out["docs"]]
        out["pair"] = pair[edge[:-1]]
        return out


def _counted(x: Aligned, slot: np.ndarray, width_b: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique((x.a * width_b + x.b) << 16 | slot[x.row], return_counts=True)


def _cuts(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of a long text, each but the first beginning with a space between solid characters, where both tokenizers cut."""
    cuts, at = [0], limit
    while at < len(data) - 1:
        part = data[at - 1 : at + limit + 1]
        place = np.flatnonzero((part[1:-1] == 32) & (part[:-2] > 32) & SOLID[part[2:]])
        if len(place):
            cuts.append(at + int(place[0]))
        at = (cuts[-1] if len(place) else at) + limit
    return list(zip(cuts, [*cuts[1:], len(data)]))


def _long(a: ByteLevel, b: Vocabulary, data: np.ndarray, limit: int) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Counts, digest and links (pairs and their number) of one long text, in parts."""
    n, digest, keys, counts = np.zeros(4, np.int64), hashlib.sha256(), [], []
    for i, (p, q) in enumerate(_cuts(data, limit) if b.cuts else [(0, len(data))]):
        x = Aligned(a, b, data[p:q], np.array([0, q - p]), head=not i)
        if not x.ok[0]:
            return [0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        n += [x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0]]
        digest.update((b";" if i else b"") + x.text)
        key, count = _counted(x, np.zeros(1, np.int64), b.size)
        keys.append(key >> 16)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return n.tolist(), digest.hexdigest(), key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


@lru_cache(2)
def _byte_level(model: str) -> ByteLevel:
    return ByteLevel(model)


def _index(batches: Iterator[pa.RecordBatch], a_model: str, b_model: bytes, kind: pa.DataType, limit: int, entries: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (without a pair) and, as each chunk is closed, one for each posting."""
    a, b = _byte_level(a_model), _vocabulary(b_model)
    names = ["chunk", "slot", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "pair", "n", "links", "docs", "planes"]
    types = [pa.int64(), pa.int32(), kind, *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 3, pa.binary(), pa.binary()]
    number, chunk = TaskContext.get().partitionId() << 32, Chunk()

    def batch(rows_: int, /, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(rows_, number)
        return pa.record_batch([pa.nulls(rows_, t) if (c := columns.get(k)) is None else c if isinstance(c, pa.Array) else pa.array(c, t) for k, t in zip(names, types)], names=names)

    def close() -> Iterator[pa.RecordBatch]:
        rows = chunk.postings()
        for i in range(0, len(rows["pair"]), 1 << 15):
            part = {k: v[i : i + (1 << 15)] for k, v in rows.items()}
            yield batch(len(part["pair"]), **part)

    for rows in _text.slices(batches, 1, limit):
        at = 0
        while at < rows.num_rows:
            part = rows.slice(at, SLOTS - chunk.slots)
            m, slot = part.num_rows, chunk.slots + np.arange(min(rows.num_rows - at, SLOTS - chunk.slots))
            data, offs = _text.flat(part.column(1))
            if m == 1 and len(data) > 2 * limit:
                (na, nb, ng, nl), sha, key, count = _long(a, b, data, limit)
                counts, shas = ([na], [nb], [ng], [nl]), [sha]
                chunk.add(key << 16 | slot[0], count)
            else:
                x = Aligned(a, b, data, offs)
                counts = (x.n_a, x.n_b, x.n_groups, x.n_links)
                shas = [hashlib.sha256(x.text[i:j]).hexdigest() if ok else "" for ok, i, j in zip(x.ok, x.text_at, x.text_at[1:])]
                chunk.add(*_counted(x, slot, b.size))
            chunk.slots += m
            yield batch(m, slot=slot, id=part.column(0), sha=shas, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts)))
            at += m
            if chunk.slots == SLOTS or chunk.entries >= entries:
                yield from close()
                number, chunk = number + 1, Chunk()
    yield from close()


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each slot gets from the postings: its links at the best count of their A id, and the counts of all links. The rows of
    a chunk are added up as long as they follow each other."""
    chunk, best, total = None, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        slot = np.flatnonzero(total)
        if len(slot):
            yield pa.record_batch([pa.array(np.full(len(slot), chunk)), pa.array(slot, pa.int32()), pa.array(best[slot]), pa.array(total[slot])], names=["chunk", "slot", "n_best", "count_sum"])
            best[slot] = total[slot] = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        c, n, count, top = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("chunk", "n", "n_docs", "top"))
        docs, bits = batch.column("docs").to_pylist(), batch.column("planes").to_pylist()
        edge = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]]).tolist()
        for i, j in zip(edge, edge[1:]):
            if c[i] != chunk:
                yield from flush()
                chunk = int(c[i])
            size = n[i:j]
            slot = np.concatenate([slots_of(d) for d in docs[i:j]])
            links = np.ones(len(slot), np.int64)
            at = (np.cumsum(size) - size).tolist()
            for k, p in enumerate(bits[i:j]):
                if p:
                    links[at[k] : at[k] + size[k]] = links_of(p, int(size[k]))
            np.add.at(total, slot, links * np.repeat(count[i:j], size))
            np.add.at(best, slot, links * np.repeat(top[i:j], size))
    yield from flush()


def index(docs: DataFrame, a_model: str, b_model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20, entries: int = ENTRIES) -> DataFrame:
    """The table of documents (rows without a pair) and postings (with one, ``a * size of B + b``), in the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.select(id_col).schema[0].dataType
    step = partial(_index, a_model=Path(a_model).read_text(), b_model=Path(b_model).read_bytes(), kind=to_arrow_type(kind), limit=limit, entries=entries)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return materialise(rows.mapInArrow(step, SCHEMA.format(kind=kind.simpleString())), "postings")


def pair_counts(index_: DataFrame, b_model: str) -> DataFrame:
    """``(a, b, n_docs, n_links)`` of all linked id pairs: in how many documents, and how often."""
    size = _vocabulary(Path(b_model).read_bytes()).size
    rows = index_.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n_docs"), F.sum("links").alias("n_links"))
    return rows.select(F.expr(f"pair DIV {size}").alias("a"), (F.col("pair") % size).alias("b"), "n_docs", "n_links")


def align(docs: DataFrame, a_model: str, b_model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20, entries: int = ENTRIES, most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    A is a byte-level BPE model of the tokenizers library, which encodes a space and the text; B is a SentencePiece BPE model, which
    adds the space itself. ``n_groups`` counts the parts between the offsets where both end, ``n_links`` the overlapping pairs of
    tokens, ``n_best`` the links whose pair is the commonest of its A id in the corpus (ties included), ``count_sum`` the document
    counts of all links. A null or empty text, and one that either tokenizer does not give back byte by byte, has zeros and an
    empty digest. Ids may be null or repeat: each row counts as a document. Other columns are not read."""
    size = _vocabulary(Path(b_model).read_bytes()).size
    both = index(docs, a_model, b_model, id_col, text_col, limit, entries)
    postings = both.where("pair IS NOT NULL").select("chunk", "pair", "n", "docs", "planes")
    counts = materialise(postings.groupBy("pair").agg(F.sum("n").alias("n_docs"), F.count("*").alias("chunks")).withColumn("a", F.expr(f"pair DIV {size}")), "counts")
    # One row for each id of A, whose number the vocabulary bounds.
    counts = counts.join(F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("best"))), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("top"), "chunks")
    if counts.count() <= most:
        scored = postings.join(F.broadcast(counts.drop("chunks")), "pair")
    else:
        counts = materialise(counts, "counts")
        scored = join_counted(postings, counts, "pair", "chunks").repartition(width(postings), "chunk").sortWithinPartitions("chunk")
    scored = scored.select("chunk", "n", "n_docs", F.col("top").cast("long").alias("top"), "docs", "planes").mapInArrow(_scores, "chunk long, slot int, n_best long, count_sum long")
    scored = scored.groupBy("chunk", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = both.where("pair IS NULL").select("chunk", "slot", "id", "n_a", "n_b", "n_groups", "n_links", "sha").join(scored, ["chunk", "slot"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("sha").alias("groups_sha256"))
