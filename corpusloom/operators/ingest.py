"""De-duplication, incremental ingestion and run state (I operators). Times are timestamps, ``now`` a literal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import join_counted, predicate_join
from corpusloom.operators.retrieval import top
from corpusloom.sources.files import stored, with_count


def canonical_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of equal contents the smallest id is canonical. Texts are read once, for their hashes; only hashes that repeat are
    joined, and the rows of a content that a great part of the documents hold stay where they are. Null texts are left out."""
    keyed = stored(docs.where(F.col(text_col).isNotNull()).select(id_col, F.sha2(text_col, 256).alias("hash")), "hashes")
    first = keyed.groupBy("hash").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = join_counted(keyed, stored(first, "repeated"), "hash", "n", how="left").withColumn("canonical_id", F.coalesce("first", F.col(id_col))).drop("first")
    return out.withColumn("status", F.when(F.col(id_col) == F.col("canonical_id"), "canonical").otherwise("duplicate"))


def dedupe_chunks(new: DataFrame, existing: DataFrame, exempt: Column) -> DataFrame:
    """``new(path, text)`` without stored hashes and repeats in the batch; exempt paths hash with their path."""
    keyed = new.withColumn("hash", F.sha2(F.when(exempt, F.concat(F.lit("FILE_PATH: "), "path", F.lit("\n"), "text")).otherwise(F.col("text")), 256))
    fresh = keyed.join(existing.select("hash").distinct(), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.min_by(F.struct("path", "text"), "path").alias("x")).select("hash", "x.*")


def skip_decision(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """``files(doc, fingerprint, hash)``, ``ledger(doc, fingerprint, hash, done)`` of active versions."""
    mine = ledger.select("doc", F.col("fingerprint").alias("old"), "done")
    owner = ledger.groupBy("hash").agg(F.min("doc").alias("owner"))
    df = files.join(mine, "doc", "left").join(owner, "hash", "left")
    return df.withColumn("decision", F.when((F.col("old") == F.col("fingerprint")) & F.col("done"), "cache_hit").when(F.col("owner") != F.col("doc"), "duplicate").otherwise("process"))


def decide_processing(files: DataFrame, state: DataFrame) -> DataFrame:
    """I4: ``state(doc, old, status, error)``."""
    permanent = F.contains(F.coalesce("error", F.lit("")), F.lit("permanent"))
    d = F.when(F.col("status").isNull() | (F.col("old") != F.col("fingerprint")), "PROCESS").when(F.col("status").isin("UPSERTED", "DELETED"), "SKIP").when(F.col("status") == "FAILED", F.when(permanent, "SKIP").otherwise("RETRY")).otherwise("PROCESS")
    return files.join(state, "doc", "left").withColumn("decision", d)


def publish_version(versions: DataFrame) -> DataFrame:
    """``(doc, fingerprint, run_ts)``: a version is a fingerprint that differs from the one before; the last is active,
    others point to what superseded them."""
    w = Window.partitionBy("doc").orderBy("run_ts", "fingerprint")
    changed = versions.withColumn("last", F.lag("fingerprint").over(w)).withColumn("outcome", F.when(F.col("last") == F.col("fingerprint"), "ALREADY_ACTIVE").otherwise("NEW_ACTIVE"))
    new = changed.where("outcome = 'NEW_ACTIVE'")
    following = F.lead("fingerprint").over(w)
    return new.select("doc", "fingerprint", "run_ts", F.when(following.isNull(), "ACTIVE").otherwise("SUPERSEDED").alias("status"), following.alias("superseded_by"))


def claim_stage(items: DataFrame, stages: DataFrame, now: str, ttl: str = "1 hour", attempts: int = 3) -> DataFrame:
    """``stages(item, status, updated_at, attempt)``."""
    recent = F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl}")
    c = F.when(F.col("status").isNull(), "CLAIMED").when(F.col("status") == "DONE", "DONE").when(F.col("status") == "IN_PROGRESS", F.when(recent, "IN_PROGRESS_RECENT").otherwise("RECLAIMED_STALE")).when((F.col("status") == "FAILED") & (F.col("attempt") < attempts), "CLAIMED").otherwise("DONE")
    return items.join(stages, "item", "left").withColumn("claim", c)


def changed_files(observed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unknown files, and those whose size or time differs."""
    old = catalog.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    return observed.join(old, "path", "left").where("known IS NULL OR NOT (size <=> old_size AND mtime <=> old_mtime)").select(*observed.columns)


def missing_files(catalog: DataFrame, observed: DataFrame, dirs: DataFrame, listed: DataFrame) -> DataFrame:
    """I8: catalogued files of observed directories that are neither observed nor listed."""
    return catalog.join(dirs.select("dir"), "dir", "left_semi").join(observed.select("path"), "path", "left_anti").join(listed.select("path"), "path", "left_anti")


def deleted_between_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """I9."""
    return previous.select("path").subtract(current.select("path"))


def archive_deleted(chunks: DataFrame, missing: DataFrame) -> DataFrame:
    """I10."""
    gone = missing.select("path").distinct().withColumn("__gone", F.lit(True))
    return chunks.join(gone, "path", "left").withColumn("archived", F.coalesce("__gone", "archived")).drop("__gone")


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """The latest runs of each file."""
    return top(runs, n, F.desc("seen_at"), F.desc("run_id"), keys=("path",))


def files_in_run(marks: DataFrame) -> DataFrame:
    """Each file of a run once, with its last mark."""
    return marks.groupBy("run_id", "path").agg(F.max("seen_at").alias("seen_at"))


def resume_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that are not upserted: pending or failed."""
    return chunks.where("status IS NULL OR status <> 'UPSERTED'").withColumn("queue", F.when(F.col("status") == "FAILED", "failed").when(F.col("status") == "NEW", "pending").otherwise("in_progress"))


def file_progress(chunks: DataFrame) -> DataFrame:
    """I14."""
    n = F.count("*")
    done = F.count_if(F.col("status") == "UPSERTED")
    return chunks.groupBy("path").agg(n.alias("total"), F.count_if(F.col("status") == "NEW").alias("pending"), F.count_if(F.col("status") == "EMBEDDED").alias("processing"), done.alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.round(100.0 * done / n, 2).alias("pct"), F.every(F.col("status") == "UPSERTED").alias("complete"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows of each status, and without a status all of them."""
    return rows.rollup("status").agg(F.count("*").alias("n"))


def ready_jobs(jobs: DataFrame, now: str, n: int) -> DataFrame:
    """I16."""
    return jobs.where((F.col("status") == "pending") & (F.col("enqueued_at") <= F.lit(now).cast("timestamp"))).orderBy(F.desc("priority"), "enqueued_at", "job_id").limit(n)


def apply_acks(jobs: DataFrame, acks: DataFrame, now: str, base: int = 2, most: int = 3) -> DataFrame:
    """``acks(job_id, ok)``: completed, to the dead letters after ``most`` tries, or pending again later."""
    df = jobs.join(acks, "job_id", "left")
    tries = F.when(F.col("ok") == F.lit(False), F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(tries >= most, "dlq").otherwise("pending")
    later = F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) + F.pow(F.lit(base), tries).cast("long"))
    at = F.when((F.col("ok") == F.lit(False)) & (tries < most), later).otherwise(F.col("enqueued_at"))
    return df.withColumns({"status": status, "enqueued_at": at, "retry_count": tries}).drop("ok")


def abandoned_jobs(jobs: DataFrame, now: str, idle: str, n: int) -> DataFrame:
    """I18."""
    return jobs.where((F.col("status") == "processing") & (F.col("started_at") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {idle}"))).orderBy("started_at", "job_id").limit(n)


def reconcile_ledger(stages: DataFrame, objects: DataFrame) -> DataFrame:
    """Done stages are reset where stages are done but nothing is stored."""
    stored = objects.limit(1).agg(F.count("*").alias("__stored"))
    return stages.join(F.broadcast(stored)).withColumn("status", F.when((F.col("__stored") == 0) & (F.col("status") == "DONE"), "PENDING").otherwise(F.col("status"))).drop("__stored")


def valid_scores(files: DataFrame, stores: list[DataFrame], config: str) -> DataFrame:
    """``files(path, mtime)`` with the first usable score of the stores ``(path, mtime, config, score)``: same
    configuration, times within a millisecond."""
    df = files
    for i, s in enumerate(stores):
        df = df.join(s.where(F.col("config") == config).select("path", F.col("mtime").alias(f"m{i}"), F.col("score").alias(f"s{i}")), "path", "left")
    usable = [F.when(F.abs(F.col(f"m{i}").cast("double") - F.col("mtime").cast("double")) <= 0.001, F.col(f"s{i}")) for i in range(len(stores))]
    return df.select("path", F.coalesce(*usable).alias("score"))


def directory_scores(files: DataFrame) -> DataFrame:
    """``(path, dir, score)`` to ``(dir, path, n)``: the accepted files of each directory, a row for each, with their number;
    directories without any do not appear."""
    return with_count(files.where("score IS NULL OR score <> 0").select("dir", "path"), "dir", "n")


def order_small_first(files: DataFrame) -> DataFrame:
    """I22."""
    return files.orderBy("size", F.lower("path"))


def _md5_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(dir, entry)`` sorted by both: the digest of each directory's entries, of which none is kept."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at]), pa.array([digest.hexdigest()])], names=["dir", "hash"])

    for batch in batches:
        for name, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or name != at:
                if digest is not None:
                    yield row()
                at, digest = name, hashlib.md5(entry.encode(), usedforsecurity=False)
            else:
                digest.update(b"|" + entry.encode())
    if digest is not None:
        yield row()


def directory_hash(files: DataFrame, most: int = 100_000) -> DataFrame:
    """``(dir, name, mtime, size)`` to a digest of the sorted entries. Directories of over ``most`` files are sorted by Spark and
    digested as a stream, which holds one entry at a time; the others are one row of an aggregate."""
    entry = F.concat_ws(":", "name", F.col("mtime").cast("string"), F.col("size").cast("string")).alias("entry")
    rows = files.select("dir", entry)
    large = stored(rows.groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
    few = rows.join(large, "dir", "left_anti") if large.limit(1).count() else rows
    out = few.groupBy("dir").agg(F.md5(F.array_join(F.array_sort(F.collect_list("entry")), "|")).alias("hash"))
    if few is rows:
        return out
    many = rows.join(large.select("dir"), "dir", "left_semi").repartition("dir").sortWithinPartitions("dir", "entry")
    return out.unionByName(many.mapInArrow(_md5_of_sorted, "dir string, hash string"))


def unchanged_directories(current: DataFrame, cached: DataFrame, options: str) -> DataFrame:
    """Cached rows whose directory has the same hash under the same options."""
    return cached.where(F.col("options_hash") == options).join(current, ["dir", "hash"], "left_semi")


def purge_expired(rows: DataFrame, now: str) -> DataFrame:
    """What stays: rows without an expiry or not past it."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp")))


def cleanup_candidates(files: DataFrame, rules: DataFrame, usage: float, now: str) -> DataFrame:
    """Files that a rule ``(pattern, max_age_days, min_size, priority)`` gives up, oldest then largest first."""
    if usage < 70:
        return files.where("false").withColumn("priority", F.lit(0))
    hard = usage >= 85
    df = predicate_join(files, rules, F.expr("path RLIKE pattern") & (F.col("size") >= F.col("min_size")))
    df = df.where(F.col("priority") <= 3) if hard else df.where(F.col("mtime") <= F.lit(now).cast("timestamp") - F.make_dt_interval(F.col("max_age_days")))
    best = df.groupBy("path", "size", "mtime").agg(F.min("priority").alias("priority"))
    return best.orderBy("mtime", F.desc("size"), "path")


def scan_frontier(pending: DataFrame, visited: DataFrame) -> DataFrame:
    """Pending directories of a run that were not visited, with their place."""
    left = pending.join(visited, ["run_id", "dir"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))


def run_list(events: DataFrame) -> DataFrame:
    """``(run_id, ts, kind, error)``: runs, newest first."""
    by = events.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.count_if(F.col("kind") == "file").alias("files"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ts"))).alias("last_error"))
    return by.orderBy(F.desc("started_at"), "run_id")


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The first writer of a key wins; within the rows the smallest ``seq``. With ``upsert_into`` as its merge, only the
    buckets of the rows' keys are read and written."""
    fresh = rows.join(target.select(key).distinct(), key, "left_anti").select(*target.columns)
    return target.unionByName(fresh.groupBy(key).agg(F.min_by(F.struct(*target.columns), "seq").alias("x")).select("x.*"))
