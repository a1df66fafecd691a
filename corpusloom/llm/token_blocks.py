"""Token ids in fixed-width bit-packed blocks.

Each id takes the fewest bits that hold every id of the vocabulary. A dataset is a Parquet folder of blocks, one row
each: ``shard`` and ``block`` give the order, ``first`` counts the ids before the block in its shard, ``doc_ids`` and
``doc_sizes`` list its documents, and ``payload`` is the packed ids behind a 16-byte header (magic, bits, number of
ids). Spark's commit protocol writes it on any file system; block rows are small, so a reader takes any of them alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import shared_dir, width

MAGIC = b"TKB1"
#: A block is closed at so many ids.
BLOCK = 1 << 18
SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, doc_sizes array<int>, payload binary"
#: Words that the cache of a Python worker may hold.
CACHE = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit string: groups of 32 ids fill ``bits`` words of 32 bits."""
    groups = -(-len(ids) // 32)
    lanes = np.zeros((groups, 32), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        part = lanes[:, j] << np.uint64(shift)
        out[:, word] |= part & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= part >> np.uint64(32)
    return MAGIC + np.array([bits], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + out[:, :bits].astype("<u4").tobytes()


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a packed block; only the groups that hold them are read."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    bits, n = int(np.frombuffer(payload, "<u4", 1, 4)[0]), int(np.frombuffer(payload, "<u8", 1, 8)[0])
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = start // 32, -(-stop // 32)
    words = np.zeros((b - a, bits + 1), np.uint64)
    words[:, :bits] = np.frombuffer(payload, "<u4", (b - a) * bits, 16 + 4 * a * bits).reshape(b - a, bits)
    out = np.empty((b - a, 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, j] = ((words[:, word] | words[:, word + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    return out.reshape(-1)[start - 32 * a : stop - 32 * a]


#: The steps of a model before its merges on which the cuts of ``Encoder`` rely.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def check_model(model: str) -> None:
    """Raise ``ValueError`` for a model (its JSON) whose text steps are others than those that ``Encoder`` knows."""
    m = json.loads(model)
    steps = [(m.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    if steps != [NORMALIZERS, PRE_TOKENIZERS] or m.get("truncation") or m.get("padding"):
        raise ValueError("a model is needed that lowers NFC text, drops white space and splits letters, digits and signs; this one has other steps")
    for t in m.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or not set(t["content"]) & set("'<|>") or t["content"].split() != [t["content"]]:
            raise ValueError(f"the added token {t['content']!r} could stand in a word that is cut")


class Encoder:
    """A tokenizers model that drops white space, run over the distinct parts of a batch's words.

    A word may be cut where its pre-tokenizer always cuts and normalisation joins nothing: around ASCII digits, and
    between a letter and ASCII punctuation. An apostrophe, which starts contractions, and the characters of special
    tokens are never cut off. ASCII letters are lowered before, but in words with those characters.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        check_model(model)
        self.tokenizer = Tokenizer.from_str(model)
        self.size = self.tokenizer.get_vocab_size()
        self.seen: dict[bytes, bytes] = {}
        self.kind = np.uint16 if self.size <= 65536 else np.uint32
        digit, letter = np.zeros(256, bool), np.zeros(256, bool)
        digit[48:58] = True
        letter[65:91] = letter[97:123] = True
        mark = np.zeros(256, bool)
        mark[33:127] = True
        mark &= ~(digit | letter)
        mark[[ord(c) for c in "'<|>"]] = False
        self.digit, self.letter, self.mark = digit, letter, mark
        self.whole = np.zeros(256, bool)
        self.whole[[ord(c) for c in "'<|>"]] = True

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, the starts of the parts of all words, and the ends."""
        digit, mark, letter = self.digit[data], self.mark[data], self.letter[data]
        # Two-byte letters: lead bytes C3 (but for the signs D7 and F7) to C9 (but for U+0130, which lowers to two characters).
        lead = (data >= 0xC3) & (data <= 0xC9)
        lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        lead[:-1] &= ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
        letter |= lead
        letter[1:] |= lead[:-1]
        cut = np.zeros(len(data) + 1, bool)
        known = digit | mark | letter
        cut[1:-1] = known[1:] & known[:-1] & (digit[1:] | digit[:-1] | (mark[1:] != mark[:-1]))
        odd = np.concatenate([[0], np.cumsum(self.whole[data])])
        odd = odd[ends] > odd[starts]
        low = _text.LOWER[data]
        if odd.any():
            size = (ends - starts)[odd]
            at = _text.gather(np.arange(len(data)), starts[odd], size)
            low[at] = data[at]
            cut[at] = False
            cut[ends[odd]] = False
        cut[starts] = True
        first = np.flatnonzero(cut)
        owner = np.searchsorted(starts, first, "right") - 1
        inside = (owner >= 0) & (first < ends[owner])
        first, owner = first[inside], owner[inside]
        return low, first, np.minimum(np.append(first[1:], len(data)), ends[owner])

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each with ``end_id`` behind, and where each row's begin."""
        starts, ends, _ = _text.words(data, offs)
        rows = len(offs) - 1
        if not len(starts):
            return np.full(rows, end_id, np.int64), np.arange(rows + 1)
        low, a, b = self.parts(data, starts, ends)
        codes, first = _text.unique_spans(low, a, b)
        raw = low.tobytes()
        texts = [raw[i:j] for i, j in zip(a[first].tolist(), b[first].tolist())]
        new = [t for t in texts if t not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            self.seen, new = {}, texts
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in new], add_special_tokens=False)
        self.seen.update(zip(new, (np.array(e.ids, self.kind).tobytes() for e in encoded)))
        found = [self.seen[t] for t in texts]
        size = np.array([len(f) for f in found], np.int64) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(found), self.kind).astype(np.int64)
        at = np.searchsorted(a, offs)
        total = np.concatenate([[0], np.cumsum(size[codes])])
        ids = _text.gather(flat, (np.cumsum(size) - size)[codes], size[codes])
        ofs = total[at]
        return np.insert(ids, ofs[1:], end_id), ofs + np.arange(rows + 1)


@lru_cache(2)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def _blocks(batches: Iterator[pa.RecordBatch], model: str, end_id: int) -> Iterator[pa.RecordBatch]:
    e = _encoder(model)
    bits, shard = bits_for(e.size), TaskContext.get().partitionId()
    first = block = 0
    for batch in _text.slices(batches, 1):
        ids, at = e.encode(*_text.flat(batch.column(1)), end_id)
        docs, i = batch.column(0), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            part = ids[at[i] : at[j]]
            row = [[shard], [block], [first], [len(part)], [docs.slice(i, j - i).to_pylist()], [np.diff(at[i : j + 1]).astype(np.int32)], [pack(part, bits)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))], names=["shard", "block", "first", "n_ids", "doc_ids", "doc_sizes", "payload"])
            first, block, i = first + len(part), block + 1, j


def write_tokens(docs: DataFrame, model: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the tokenizers model at ``model`` (a path on the driver), append ``end_id`` to each, and
    write the ids in ascending order of ``id_col`` as packed blocks to ``path``.

    A null or empty text has the end id only. Rows without an id come first; rows that repeat an id stand together, in
    no fixed order. An empty table gives a dataset without blocks. Models that ``check_model`` does not know are refused.
    """
    check_model(Path(model).read_text())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # The second column splits rows without an id, or with one id, over the partitions.
    rows = rows.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(width(docs), "id", "r").sortWithinPartitions("id", "r")
    blocks = rows.mapInArrow(partial(_blocks, model=Path(model).read_text(), end_id=end_id), SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            sizes = np.array(r["doc_sizes"], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            values = unpack(r["payload"]).astype("<u4")
            if ids:
                last = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
            else:
                last = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["first"] + at[:-1]), pa.array(sizes), last], names=["id", "start", "n", "x"])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True, where: str | None = None) -> DataFrame:
    """``(id_col, start, n_tokens, ids)`` of a packed dataset, or with ``ids=False`` the CRC-32 of each document's ids
    (little-endian, 32 bits each) as ``ids_crc32``. ``start`` counts the ids of all documents before. ``where`` is a
    predicate on the block columns, so that a read of a few blocks touches only those."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # One total for each shard; there are as many as the writer had partitions.
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, starts = 0, []
    for shard, n in totals:
        starts.append((shard, base))
        base += n
    blocks = blocks.where(where) if where else blocks
    blocks = blocks.join(F.broadcast(spark.createDataFrame(starts, "shard int, base long")), "shard").select("base", "first", "doc_ids", "doc_sizes", "payload")
    out = blocks.mapInArrow(partial(_read, ids=ids), f"id long, start long, n long, x {'array<int>' if ids else 'long'}")
    return out.toDF(id_col, "start", "n_tokens", "ids" if ids else "ids_crc32")


def tokenize_to_blocks(docs: DataFrame, model: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write to a new folder of the session's shared folder; its path."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, model, path, end_id, id_col, text_col)
    return path
