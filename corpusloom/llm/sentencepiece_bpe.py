"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts of a batch become one flat array of symbols, cut wherever no vocabulary piece holds the two neighbouring
characters, since no merge can cross there. Distinct segments are merged once for the batch: each round finds the least
pair rank of every segment and merges its occurrences from the left at the same time, then compacts the array; segments
leave when no pair remains. A pair whose result could merge again at the same or a better rank is merged one
occurrence a round, which is the order of the library's queue. Very long segments are merged wherever no better pair is in reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text

NONE = np.int64(1) << 40
#: Segments of more symbols (there are hardly any) are merged on their own, at many places in each round.
LONG = 4096
MARK = "▁"


def _least_before(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before each."""
    out = np.concatenate([[NONE], values[:-1]])
    width = 1
    while width < reach:
        step = min(width, reach - width)
        out[step:] = np.minimum(out[step:], out[:-step].copy())
        width += step
    return out


class Vocabulary:
    """Merge tables of a SentencePiece BPE model with an identity normaliser and byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (trainer.byte_fallback and norm.escape_whitespaces) or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, an identity normaliser and kept white space is needed")
        self.prefix = norm.add_dummy_prefix
        kinds = proto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.size = len(pieces)
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        scores = sorted({-proto.pieces[i].score for i in normal.values()})
        order = {s: i for i, s in enumerate(scores)}
        self.rank = np.full(max(symbols.values()) + 2, NONE, np.int64)
        for i in normal.values():
            self.rank[i] = order[-proto.pieces[i].score]
        pairs = {}
        for p, i in normal.items():
            for j in range(1, len(p)):
                if (left := symbols.get(p[:j])) is not None and (right := symbols.get(p[j:])) is not None:
                    pairs[left << 32 | right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        #: Pieces that may merge again at the same or a better rank.
        self.again = np.zeros(len(self.rank), bool)
        for k, i in pairs.items():
            for part in (k >> 32, k & 0xFFFFFFFF):
                if self.rank[part] >= self.rank[i]:
                    self.again[part] = True
        self.reach = max(map(len, normal), default=1)
        inside = sorted({c for p in normal if len(p) > 1 for c in p})
        number = {c: i + 1 for i, c in enumerate(inside)}
        self.joins = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for p in normal:
            for a, b in zip(p, p[1:]):
                self.joins[number[a], number[b]] = True
        self.kind, self.symbol = np.zeros(0x110000, np.int32), -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in number.items():
            self.kind[ord(c)] = i
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        #: White space may be cut off before its mark if no piece holds a mark after another character.
        self.cuts = not self.joins[np.arange(len(inside) + 1) != number.get(MARK, -1)][:, number.get(MARK, 0)].any()
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte = np.array([byte[i] for i in range(256)], np.int64)
        #: Of symbols that are no pieces: their code points, for the bytes that stand for them.
        self.bare = {i: ord(s) for s, i in symbols.items() if i >= len(pieces)}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        self.out_size = np.array([len(r) for r in raw], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.leads = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in proto.pieces])
        self.decimal = [str(i) for i in range(len(pieces))]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of a single long segment after its merges, many of which are made in each round.

        A merge is due as soon as no pair within ``reach`` symbols has a better rank, whatever the rest of the segment holds:
        what comes before it in the library's order and could touch its symbols would be part of one piece with a better pair,
        and no piece is that long. Pairs of one rank go together, those that overlap from the left; where the result could merge
        again at the same or a better rank, only the leftmost within reach goes."""
        symbols = symbols.copy()
        while len(symbols) > 1:
            made = self.pair(symbols[:-1], symbols[1:])
            rank = np.where(made >= 0, self.rank[made], NONE)
            if not (made >= 0).any():
                break
            left, right = _least_before(rank, self.reach), _least_before(rank[::-1], self.reach)[::-1]
            due = (rank < NONE) & (rank <= right) & np.where(self.again[made], rank < left, rank <= left)
            # Of overlapping pairs of one rank every second goes, as long as all from the first on are due.
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rank))))
            waits = np.cumsum(~due)
            hit = np.flatnonzero(due & (waits == (waits - ~due)[first][run]) & ((np.arange(len(rank)) - first[run]) & 1 == 0))
            symbols[hit] = made[hit]
            symbols = np.delete(symbols, hit + 1)
        return symbols

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all segments (``sizes`` of them each, none empty) after their merges, and the new sizes."""
        seg = np.repeat(np.arange(len(sizes)), sizes)
        done_seg, done_sym = [], []
        for i in np.flatnonzero(sizes > LONG):
            at = int(sizes[:i].sum())
            part = self.merge_long(symbols[at : at + sizes[i]])
            done_seg.append(np.full(len(part), i))
            done_sym.append(part)
        if len(done_seg):
            few = (sizes <= LONG)[seg]
            symbols, seg = symbols[few], seg[few]
        made = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            made[:-1] = np.where(seg[1:] == seg[:-1], self.pair(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            rank = np.where(made >= 0, self.rank[made], NONE)
            new = np.ones(len(seg), bool)
            new[1:] = seg[1:] != seg[:-1]
            first = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(seg)))
            live = np.repeat(best < NONE, size)
            if not live.all():
                done_seg.append(seg[~live])
                done_sym.append(symbols[~live])
                symbols, seg, made, rank = symbols[live], seg[live], made[live], rank[live]
                size, best = size[best < NONE], best[best < NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # Of overlapping occurrences every second one goes, from the left.
            start = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.flatnonzero(start)
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) & 1
            lead = np.append(True, seg[hit][1:] != seg[hit][:-1])
            risky = np.repeat(np.logical_or.reduceat(self.again[made[hit]], np.flatnonzero(lead)), np.diff(np.append(np.flatnonzero(lead), len(hit))))
            hit = hit[np.where(risky, lead, odd == 0)]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            to = np.cumsum(keep) - 1
            symbols, seg, made = symbols[keep], seg[keep], made[keep]
            hit = to[hit]
            near = np.zeros(len(seg), bool)
            near[hit] = near[hit[hit > 0] - 1] = True
            near = np.flatnonzero(near)
            after = np.minimum(near + 1, len(seg) - 1)
            ok = (near + 1 < len(seg)) & (seg[after] == seg[near])
            made[near] = np.where(ok, self.pair(symbols[near], symbols[after]), -1)
        seg, symbols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_seg, done_sym))
        order = np.argsort(seg, kind="stable")
        return symbols[order], np.bincount(seg, minlength=len(sizes))

    def ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of merged symbols; a symbol that is no piece becomes the ids of its bytes."""
        odd = (symbols < 0) | (symbols >= self.size)
        if not odd.any():
            return symbols, sizes
        count = np.ones(len(symbols), np.int64)
        which, back = np.unique(symbols[odd], return_inverse=True)
        raw = [chr(self.bare[s] if s >= 0 else -1 - s).encode() for s in which.tolist()]
        size = np.array([len(r) for r in raw])
        count[odd] = size[back]
        to = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        out[to[~odd]] = symbols[~odd]
        at = np.repeat(to[odd], count[odd]) + _text.gather(np.arange(size.max()), np.zeros(len(back), np.int64), count[odd])
        out[at] = self.byte[_text.gather(np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[back], count[odd])]
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[ends] - total[ends - sizes]

    def encode(self, data: np.ndarray, offs: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of UTF-8 text, and where each row's begin."""
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = before[offs]
        full = np.flatnonzero(np.diff(at))
        if self.prefix and prefix:
            chars = np.insert(chars, at[full], ord(MARK))
            at = at + np.searchsorted(full, np.arange(rows + 1))
        chars = np.where(chars == 32, np.uint32(ord(MARK)), chars)
        kind = self.kind[chars]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        cut[at[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(chars))
        codes, first = _text.unique_spans(chars, starts, ends)
        length = (ends - starts)[first]
        symbols, sizes = self.ids(*self.merge(self.symbol[_text.gather(chars, starts[first], length)], length))
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        return _text.gather(symbols, (np.cumsum(sizes) - sizes)[codes], sizes[codes]), total[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids and where each row's begin; the space that encoding puts before a text goes."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
        size, start = self.out_size[ids], self.out_at[ids]
        if self.prefix and prefix:
            head = at[:-1][np.diff(at) > 0]
            head = head[self.leads[ids[head]]]
            size[head] -= 1
            start[head] += 1
        return _text.gather(self.out, start, size), np.concatenate([[0], np.cumsum(size)])[at]


@lru_cache(2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _pieces(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of a long text, each but the first beginning with a space after another character."""
    cuts, at = [0], limit
    while at < len(data):
        space = np.flatnonzero((data[at : at + limit] == 32) & (data[at - 1 : min(at + limit, len(data)) - 1] != 32))
        if len(space):
            cuts.append(at + int(space[0]))
        at = (cuts[-1] if len(space) else at) + limit
    return list(zip(cuts, [*cuts[1:], len(data)]))


def _digests(batches: Iterator[pa.RecordBatch], model: bytes, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(model)
    for batch in _text.slices(batches, 1, limit):
        data, offs = _text.flat(batch.column(1))
        n, one, two = [], [], []
        if batch.num_rows == 1 and len(data) > 2 * limit and v.cuts:
            count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for a, b in _pieces(data, limit):
                ids, _ = v.encode(data[a:b], np.array([0, b - a]), prefix=not a)
                ids_hash.update((("," if a else "") + ",".join(map(v.decimal.__getitem__, ids.tolist()))).encode())
                text_hash.update(v.decode(ids, np.array([0, len(ids)]), prefix=not a)[0])
                count += len(ids)
            n, one, two = [count], [ids_hash.hexdigest()], [text_hash.hexdigest()]
        else:
            ids, at = v.encode(data, offs)
            text, to = v.decode(ids, at)
            n = np.diff(at)
            for i in range(batch.num_rows):
                one.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids[at[i] : at[i + 1]].tolist())).encode()).hexdigest())
                two.append(hashlib.sha256(text[to[i] : to[i + 1]]).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["id", "n", "a", "b"])


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(model)
    for batch in _text.slices(batches, 1):
        ids, at = v.encode(*_text.flat(batch.column(1)))
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(model)
    for batch in batches:
        lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        text, to = v.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
        raw = text.tobytes()
        yield pa.record_batch([batch.column(0), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(to, to[1:])], pa.string())], names=["id", "text"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for each row, exactly the library's encoding without begin and end ids.

    ``model`` is the path of a SentencePiece BPE model on the driver; its bytes travel with the job. A null text is
    empty and has no ids. Other columns are not read; ids may be null or repeat."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(partial(_encoded, model=Path(model).read_bytes()), f"id {kind}, ids array<int>").toDF(id_col, "ids")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` for each row of ids; null ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("x")).mapInArrow(partial(_decoded, model=Path(model).read_bytes()), f"id {kind}, text string").toDF(id_col, "text")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` for each row: digests of the ids (decimals joined by commas)
    and of the text that they decode to, without moving either. Texts of many MB are encoded in pieces cut at spaces."""
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(partial(_digests, model=Path(model).read_bytes()), f"id {kind}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
