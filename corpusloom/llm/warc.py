"""WARC archives as a chunked record table.

Writing: a payload becomes rows of (record, chunk number, bytes) of at most ``chunk`` bytes, the first a response record
and the rest continuation records (WARC segmentation), so no record of an archive is larger than a chunk. Records
end in two line breaks, which is just what Spark's text sink puts between rows, so archives are written by Spark's own
committed writer to any file system, one gzip file for each partition.

Payloads do not move when they are written: digests that repeat are counted, and are broadcast up to a checked number.

Reading: Spark's text source hands on lines; a state machine in ``mapInArrow`` joins them by Content-Length and gives chunk
rows with the payload's running length and SHA-1, never a whole record. Gzip files are not split, so one task reads a file in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._storage import materialise, shared_dir
from corpusloom.operators.joins import join_counted

END = "\r\n\r\n"
#: So many digests that repeat are broadcast, of about 50 bytes each.
BROADCAST = 1_000_000
#: Lines that the reader takes at once.
LINES = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, chunk_no long, warc_type string, target_uri string, refers_to string, http_length long, declared_digest string, data binary, payload_bytes long, running_digest string, is_last boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: four groups of 40 bits as eight digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", chunk: int = 1 << 20) -> DataFrame:
    """``(id, chunk_no, record)``: the text of every WARC record without its closing line breaks; the
    chunks of a record follow one another.

    Of pages with equal payloads of at least ``min_revisit`` bytes that with the largest id is the response and the
    others are revisits of it; smaller payloads are all responses. A null payload is empty and a null URL too. A page
    without an id is a response with an id of its own digest. Rows that repeat an id repeat its record."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"\s", "%20"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload")})
    equal = rows.where(f"size >= {min_revisit} AND id IS NOT NULL").groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n"))
    equal = materialise(equal.where("n > 1"), "equal")
    if equal.count() <= BROADCAST:
        rows = rows.join(F.broadcast(equal.drop("n")), "digest", "left")
    else:
        rows = join_counted(rows, equal, "digest", "n", how="left")
    rows = rows.withColumn("kept", F.when(F.col("size") >= min_revisit, F.col("kept")))
    rows = rows.withColumn("revisit", F.coalesce(F.col("id") != F.col("kept"), F.lit(False)))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    own = F.coalesce(name(F.col("id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))
    n = F.when(F.col("revisit"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int"))
    rows = rows.withColumns({"own": own, "n": n}).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    first = F.col("chunk_no") == 0
    part = F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(part)
    length = F.octet_length(body) + F.when(first, F.octet_length(http)).otherwise(0)
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, F.col("own")).otherwise(F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(""),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", name(F.col("kept"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.when(F.col("n") > 1, line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))).otherwise(""),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("own"))).otherwise(""),
        F.when(~first & (F.col("chunk_no") == F.col("n") - 1), line("WARC-Segment-Total-Length", (F.col("size") + F.octet_length(http)).cast("string"))).otherwise(""),
        F.when(first, F.lit("Content-Type: application/http; msgtype=response\r\n")).otherwise(""),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        F.when(first, http).otherwise(""),
    )
    return rows.select("id", "chunk_no", F.concat(head, body.cast("string")).alias("record"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write ``pages`` as gzip WARC archives below ``path``; the options are those of ``records``."""
    records(pages, **options).select("record").write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Parses the bytes of an archive as they come and gives payloads on in chunks."""

    def __init__(self, chunk: int):
        self.chunk, self.out = chunk, []
        self.record: dict | None = None
        self.reset()

    def reset(self) -> None:
        """Forget an unfinished record, as at the start of a file."""
        self.close()
        self.state, self.left, self.http, self.head = "header", 0, False, b""

    def close(self) -> None:
        """Give out the open payload's last chunk."""
        if self.record is not None:
            self.emit(True)
        self.record = None

    def emit(self, last: bool) -> None:
        r = self.record
        self.out.append((r["id"], r["no"], r["type"], r["uri"], r["refers"], r["http_length"], r["digest"], bytes(r["data"]), r["bytes"], base64.b32encode(r["sha1"].digest()).decode(), last))
        r["no"] += 1
        r["data"] = bytearray()

    def payload(self, data: bytes) -> None:
        r = self.record
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            while part:
                if len(r["data"]) == self.chunk:
                    self.emit(False)
                take = part[: self.chunk - len(r["data"])]
                r["sha1"].update(take)
                r["bytes"] += len(take)
                r["data"] += take
                part = part[len(take) :]

    def header(self, text: bytes) -> None:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("utf-8", "replace").split("\r\n")[1:])}
        size = fields.get("content-length", "0")
        self.left, self.state = int(size) if size.isdigit() else 0, "block"
        if fields.get("warc-type") == "continuation" and self.record is not None and fields.get("warc-segment-origin-id") == self.record["id"]:
            return
        self.close()
        self.http = "application/http" in fields.get("content-type", "")
        self.record = {"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "http_length": None, "sha1": hashlib.sha1(), "bytes": 0, "data": bytearray(), "no": 0}

    def block(self, data: bytes) -> None:
        if not self.http:
            self.payload(data)
            return
        self.head += data
        at = self.head.find(END.encode())
        if at < 0 and self.left:
            return
        head, rest = (self.head[:at], self.head[at + 4 :]) if at >= 0 else (self.head, b"")
        for x in head.decode("latin-1").split("\r\n"):
            if x.lower().startswith("content-length:") and x[15:].strip().isdigit():
                self.record["http_length"] = int(x[15:])
        self.http, self.head = False, b""
        self.payload(rest)

    def feed(self, data: bytes) -> None:
        """The next bytes of a file."""
        while data:
            if self.state == "header":
                data = (self.head + data).lstrip(b"\r\n") if not self.head.strip() else self.head + data
                at = data.find(END.encode())
                if at < 0:
                    self.head = data
                    return
                self.head = b""
                self.header(data[:at])
                data = data[at + 4 :]
            take, data = data[: self.left], data[self.left :]
            self.left -= len(take)
            if take or not self.left:
                self.block(take)
            if not self.left:
                self.state = "header"


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    reader, file = _Reader(chunk), None

    def rows() -> pa.RecordBatch:
        cols = list(zip(*reader.out))
        reader.out = []
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=CHUNKS.replace(",", "").split()[::2])

    for batch in batches:
        names, lines = batch.column(0).to_numpy(), batch.column(1)
        edge = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        for a, b in zip(edge, edge[1:]):
            if a == b:
                continue
            if names[a] != file:
                reader.reset()
                file = names[a]
            # The line breaks that Spark has taken away are put back.
            at = a
            while at < b:
                reader.feed(b"\n".join(lines.slice(at, min(LINES, b - at)).to_pylist()) + b"\n")
                at += LINES
                if len(reader.out) >= 256:
                    yield rows()
    reader.reset()
    if reader.out:
        yield rows()


def read_warc(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """The chunk rows of all records below ``path``: ``record_id, chunk_no``, the record's type and headers, ``data``
    (at most ``chunk`` bytes of payload, without the HTTP head), the payload's length and base32 SHA-1 up to and with
    this chunk, and ``is_last``. Segments that follow their origin record count to it. Cut-off archives give what is
    there. Archives must be gzip files (an uncompressed one larger than a split would be read in parts)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("value").cast("binary").alias("v")).mapInArrow(partial(_chunks, chunk=chunk), CHUNKS)


def inventory(chunks: DataFrame) -> DataFrame:
    """One row for each record: ``record_id, warc_type, payload_bytes, payload_digest, refers_to``. A revisit has the
    length and digest of the full payload, from its headers."""
    revisit = F.col("warc_type") == "revisit"
    return chunks.where("is_last").select("record_id", "warc_type", F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("declared_digest")).otherwise(F.col("running_digest")).alias("payload_digest"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive folder in the shared folder and return the inventory of what is read back, with
    ``page_id`` and ``refers_to`` as numbers: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return inventory(read_warc(pages.sparkSession, path)).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
