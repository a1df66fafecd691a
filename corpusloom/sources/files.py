"""File sources, path filters and sinks (S operators)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import metric_name
from corpusloom.operators.joins import join_counted

# Encodings in the order in which they are tried.
ENCODINGS = "utf-8 utf-8-sig utf-16 utf-16-le utf-16-be cp1252 latin-1 iso-8859-15 cp1250 iso-8859-2 cp1251 koi8-r iso-8859-5 cp1253 cp1254 shift_jis euc-jp gb18030 big5 euc-kr".split()


@lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusloom-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``). A session on one machine may do without
    the setting; on a cluster it is an error to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used several times is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_path`` gave, on whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def describe_path(path: Column) -> dict[str, Column]:
    """Name, lower-case extension, parent directory and id of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"name": name, "ext": F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)), "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "file_id": F.sha2(path, 256)}


def scan_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file below ``paths``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return files.select("path", *(c.alias(k) for k, c in describe_path(F.col("path")).items()), "size", "mtime")


def glob_regex(pattern: str) -> str:
    """A glob as an unanchored-free regex: ``*`` and ``?`` do not cross ``/``, ``**`` does."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            out, i = out + "[" + pattern[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def match_regex(pattern: str) -> str:
    """S3: what a pattern matches, as one regex. An absolute pattern is a path, a directory or a glob; a relative one a
    glob on the end of a path. ``x/**`` and ``x/**/*`` also match ``x``."""
    p = pattern.rstrip("/") or "/"
    variants = [p] + [p[: -len(s)] for s in ("/**", "/**/*") if p.endswith(s) and len(p) > len(s)]
    if p.startswith("/"):
        return "|".join(f"^{glob_regex(v)}(?:/.*)?$" if not set("*?[") & set(v) else f"^{glob_regex(v)}$" for v in variants)
    return "|".join(f"(?:^|/){glob_regex(re.sub('^[./]+', '', v))}$" for v in variants)


def match_globs(path: Column, patterns: Iterable[str]) -> Column:
    """S3: whether any pattern matches."""
    found = [match_regex(p) for p in patterns]
    return path.rlike("|".join(f"(?:{p})" for p in found)) if found else F.lit(False)


def filter_paths(df: DataFrame, exts: Iterable[str] = (), dirs: Iterable[str] = (), globs: Iterable[str] = ()) -> DataFrame:
    """Wanted extensions (none: all), no excluded directory anywhere, no excluded glob on the path or above it."""
    exts, dirs, globs = (list(x) for x in (exts, dirs, globs))
    if exts:
        df = df.where(describe_path(F.col("path"))["ext"].isin(exts))
    if dirs:
        df = df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, dirs))))
    for g in globs:
        inner = "|".join(p.removesuffix("$") + "(?:/.*)?$" for p in match_regex(g).split("$|") if p) if not g.startswith("/") else match_regex(g)
        df = df.where(~F.col("path").rlike(inner))
    return df


def classify_exclusions(entries: DataFrame) -> DataFrame:
    """``(entry)`` to distinct ``(kind, value)``: globs, and plain tokens as both a directory and a glob."""
    value = F.rtrim(F.translate(F.trim("entry"), "\\", "/"), F.lit("/"))
    glob_like = value.rlike(r"[*?\[\]/]")
    kinds = F.when(glob_like, F.array(F.lit("glob"))).otherwise(F.array(F.lit("dir"), F.lit("glob")))
    return entries.select(F.explode(kinds).alias("kind"), value.alias("value")).where("value <> ''").distinct()


def preserve_regex(pattern: str) -> str | None:
    """A rule on a path that may keep duplicates, as one regex; comments and empty rules are none."""
    raw = pattern.strip()
    if not raw or raw.startswith("#"):
        return None
    if raw.startswith("re:"):
        return raw[3:]
    p = raw.replace("\\", "/")
    if p.endswith("/"):
        p = p.rstrip("/")
        return None if not p else f"^{re.escape(p)}" if p.startswith("/") else f"(?:^|/){re.escape(p)}/"
    if not set("*?[]") & set(p) and "/" not in p:
        return f"(?:^|/){re.escape(p)}$"
    loose = glob_regex(p).replace("[^/]*", ".*").replace("[^/]", ".")
    return f"^{loose}$|(?:^|/)(?:{loose})$"


def preserve_duplicates(path: Column, patterns: Iterable[str]) -> Column:
    """S5."""
    found = [f"(?:{r})" for p in patterns if (r := preserve_regex(p))]
    return path.rlike("|".join(found)) if found else F.lit(False)


#: Names of files that the text source unpacks.
PACKED = r"\.(gz|bz2|lz4|snappy|deflate|zst)$"


def read_text_docs(spark: SparkSession, path: str, **options) -> DataFrame:
    """One document for each file, its bytes as they are (Spark leaves out files without any). The text source sets up a decompressor for each file, which takes far longer
    than to read a small one, so only packed files go by it. Spark puts 32 small files in a task at most; tasks are made of
    several such parts."""
    most = 16 * spark.sparkContext.defaultParallelism
    name, file = F.col("_metadata.file_name"), F.col("_metadata.file_path").alias("path")
    files = spark.read.options(**options).format("binaryFile").load(path)
    docs = files.where(~name.rlike(PACKED)).select(file, F.col("content").cast("string").alias("text")).coalesce(most)
    if files.where(name.rlike(PACKED)).select("path").isEmpty():
        return docs
    packed = spark.read.options(**options).text(path, wholetext=True).where(name.rlike(PACKED))
    return docs.unionByName(packed.select(file, F.col("value").alias("text")).coalesce(most))


def write_text_docs(texts: DataFrame, path: str) -> None:
    """One file below ``path``, a new folder, for each row of ``texts(text)``, with a line end. In a folder of a local or mounted disk the
    tasks write the files themselves: there Spark's text sink starts a process for each file, to set its mode, and the driver
    moves all of them. Names are by task and row, so a task that is repeated gives the same files."""
    spark = texts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        texts.select("text").write.options(maxRecordsPerFile="1", **{"mapreduce.fileoutputcommitter.algorithm.version": "2"}).text(path)
        return
    root = system.makeQualified(place).toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        folder = f"{root}/{task.partitionId():05d}"
        part = f"{folder}/.{task.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for text in batch.column(0):
                with open(part, "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                os.replace(part, f"{folder}/{n:09d}.txt")
                n += 1
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    os.makedirs(root)
    texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_csv_docs(spark: SparkSession, path: str, most: int | None = 50_000, **options) -> DataFrame:
    """One document for each row, the first ``most`` of a file (None: all). Rows are numbered by split: a row's place in its split (its place in
    the task, less that of the split's first row) follows the rows of the file's splits before, which are counted first. So no
    file is sorted or numbered as a whole. Files are read once and the rows stored, since how Spark splits files hangs on the cores that a
    cluster has at the time. A field without anything is null, one in quotes an empty text."""
    # No field holds a line end, so this stands for nothing but a field without anything.
    df = spark.read.options(**{"header": "true", "columnPruning": "false", "nullValue": "\n"} | options).csv(path)
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    rows = stored(df.select(*split, F.to_json(F.struct(*df.columns)).alias("text")).withColumn("at", F.monotonically_increasing_id()), "rows")
    splits = stored(rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")), "splits")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")  # over a file's splits
    splits = splits.withColumn("before", before).drop("n")
    splits = splits if most is None else splits.where(F.col("before") < most)
    if splits.count() <= 1_000_000:
        splits = F.broadcast(splits)
    numbered = rows.join(splits, ["path", "block"]).withColumn("row", (F.col("before") + F.col("at") - F.col("first") + 1).cast("long"))
    return (numbered if most is None else numbered.where(F.col("row") <= most)).select("path", "row", "text")


def guard_docs_per_file(docs: DataFrame, most: int, file_col: str = "file") -> DataFrame:
    """All documents of a file with more than ``most`` go (0: off)."""
    if not most:
        return docs
    big = docs.groupBy(file_col).agg(F.count("*").alias("n")).where(F.col("n") > most).select(file_col)
    return docs.join(big, file_col, "left_anti")


def is_binary(raw: bytes, ratio: float = 0.30) -> bool:
    """S9 of one file's head: a NUL byte, or too many control bytes."""
    control = sum(b < 32 and b not in (7, 8, 9, 10, 12, 13, 27) for b in raw)
    return b"\0" in raw or (len(raw) > 0 and control / len(raw) >= ratio)


def sniff_binary(files: DataFrame, ratio: float = 0.30, head: int = 8192) -> DataFrame:
    """``(path, content)`` to ``(path, binary)``; only the heads of files go to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"path": df["path"], "binary": [is_binary(bytes(x), ratio) for x in df["head"]]})

    return files.select("path", F.substring("content", 1, head).alias("head")).mapInPandas(run, "path string, binary boolean")


def decode_with_fallbacks(files: DataFrame, encodings: Iterable[str] = ENCODINGS) -> DataFrame:
    """``(path, content)`` to ``(path, text, encoding)``: text files by the first encoding that decodes them."""
    names = list(encodings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, raw in zip(df["path"], map(bytes, df["content"])):
                if is_binary(raw[:8192]):
                    continue
                for name in names:
                    try:
                        rows.append((path, raw.decode(name), name))
                        break
                    except UnicodeDecodeError:
                        pass
            yield pd.DataFrame(rows, columns=["path", "text", "encoding"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string")


def _matching(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: x["raw"].rlike(pattern))


def code_structure(files: DataFrame) -> DataFrame:
    """``(path, ext, text)`` to ``(path, structure)``: lines that declare something, with their numbers."""
    lines = F.split("text", "\n")
    listed = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), F.trim(x).alias("t"), x.alias("raw")))
    out = F.lit(None)
    for ext, pattern in rules.STRUCTURE.items():
        out = F.when(F.col("ext") == ext, _matching(listed, pattern)).otherwise(out)
    text = F.array_join(F.transform(out, lambda x: F.concat(F.lit("Line "), x["n"].cast("string"), F.lit(": "), x["t"])), "\n")
    return files.select("path", F.when(F.coalesce(F.size(out), F.lit(0)) > 0, text).otherwise("File structure only").alias("structure"))


def flag_scanned_docs(pages: DataFrame, least: int = 100) -> DataFrame:
    """``(doc_id, text)`` by page to ``(doc_id, scanned)``: on average under ``least`` characters a page."""
    return pages.groupBy("doc_id").agg((F.coalesce(F.avg(F.length(F.trim("text"))), F.lit(0.0)) < least).alias("scanned"))


def normalize_web_results(results: DataFrame) -> DataFrame:
    """``(url, title, content[, score])`` as hits."""
    full = lambda c: F.nullif(c, F.lit(""))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), full(F.col("title"))), full(F.col("content")))
    score = F.coalesce("score", F.lit(0.5)) if "score" in results.columns else F.lit(0.5)
    return results.select(F.concat(F.lit("web_"), F.left(F.sha2("url", 256), F.lit(16))).alias("uuid"), text.alias("text"), F.col("url").alias("source"), F.lit(0).alias("chunk_index"), score.alias("score"))


def upsert_chunks(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target after a batch: a key's newest row (``seq``) replaces what was there; rows without a key are skipped.
    ``upsert_into`` does this to a stored table."""
    both = target.withColumn("__batch", F.lit(0)).unionByName(batch.where(F.col(key).isNotNull()).withColumn("__batch", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*target.columns), F.struct("__batch", "seq")).alias("x")).select("x.*")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


Merge = Callable[[DataFrame, DataFrame, str], DataFrame]


def upsert_into(path: str, batch: DataFrame, key: str, merge: Merge = upsert_chunks, buckets: int = 64) -> list[int]:
    """S14 on a table at ``path``, whose rows lie in folders by the hash of their key: only the buckets that the batch's keys fall in
    are read, merged and overwritten; the files of the others stay. The merged rows are written to the shared folder first, so
    a write that fails can be repeated from the batch, and merging a batch twice changes nothing. ``buckets`` is part of the table
    and stays as it was made; choose it so that a bucket is a few hundred MB. Returns the buckets written."""
    spark = batch.sparkSession
    rows = stored(batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return touched
    old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).select(rows.columns) if exists(spark, path) else rows.limit(0)
    merged = stored(merge(old, rows, key), "merged")
    merged.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


#: Keys with their versions that are broadcast; files of a bucket from which on those that stay are dealt anew.
VERSIONS, FILES = 4_000_000, 16


def replace_into(path: str, batch: DataFrame, key: str, value: str, cut: Callable[[DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """S14 where a key has many rows of one version: ``batch(key, value, seq)`` to a table in buckets, as ``upsert_into``. ``cut`` makes the rows
    of the newest versions, with their ``bucket`` and ``seq``; it may group by (bucket, part, key) without a shuffle. A key's rows go
    with its older versions; of equal versions the batch's stays.

    Which versions stay is settled by keys alone, so values are shuffled once, before they are cut, and rows that stay are read and
    written where they lie. The old folders are replaced when all is written. Returns the buckets written."""
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    batch = batch.where(F.col(key).isNotNull()).select(key, value, "seq")
    mine = stored(batch.groupBy(key).agg(F.max("seq").alias("seq")).withColumn("bucket", place), "versions")
    touched = sorted(r["bucket"] for r in mine.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return touched
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)) if exists(spark, path) else None
    if old is not None:
        have = old.groupBy(key).agg(F.max("seq").alias("have"))
        mine = stored(mine.join(have, key, "left").where("have IS NULL OR seq >= have").select(key), "newer")
    keys = F.broadcast(mine.select(key)) if mine.count() <= VERSIONS else mine.select(key)
    dealt = batch.join(keys, key, "left_semi").withColumns({"bucket": place, "part": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))}).repartition("bucket", "part")
    rows = cut(dealt.groupBy("bucket", "part", key).agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("seq"))).drop("part")
    if old is not None:
        stay = old.join(keys, key, "left_anti").select(rows.columns)
        crowded = len(old.select(key).inputFiles()) > FILES * len(touched)
        rows = rows.unionByName(stay.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))) if crowded else stay)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def dead_letter(df: DataFrame, good: Column, reason: Column, now: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with a reason and a time for an append-only table."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok).withColumns({"reason": reason, "failed_at": F.lit(now).cast("timestamp")})


def keyset_page(df: DataFrame, after, n: int, key: str = "id") -> DataFrame:
    """The ``n`` rows behind a cursor."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def export_prometheus(metrics: DataFrame) -> DataFrame:
    """``(name, type, value, ts, tags map)`` to ``(name, lines)``: the latest sample of each metric."""
    last = metrics.groupBy("name").agg(F.max_by(F.struct("type", "value", "tags"), "ts").alias("m"))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("m.tags")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    label = F.when(F.size("m.tags") > 0, F.concat(F.lit("{"), tags, F.lit("}"))).otherwise("")
    name = metric_name(F.col("name"))
    return last.select("name", F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("m.type"), F.lit("\n"), name, label, F.lit(" "), F.col("m.value").cast("string")).alias("lines"))


def files_by_hash(index: DataFrame) -> DataFrame:
    """``(hash, path, paths)``: the paths of each content hash, a row for each, with their number. Files without a hash are one
    group, whose rows stay where they are."""
    rows = stored(index.select("hash", "path").distinct(), "index")
    bare = rows.where("hash IS NULL")
    return with_count(rows, "hash", "paths").unionByName(bare.join(F.broadcast(bare.agg(F.count("*").alias("paths")))))


def with_count(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the number of rows of their key, null keys left out. Nothing is gathered by key, and frequent keys stay put."""
    rows = stored(rows.where(F.col(key).isNotNull()), "rows")
    counts = rows.groupBy(key).agg(F.count("*").alias("__count")).withColumn(name, F.col("__count"))
    return join_counted(rows, stored(counts, "counts"), key, "__count")
