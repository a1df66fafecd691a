"""Queries of the ingestion operators: documents as files, events as marks, jobs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.plans.registry import query, table

NOW = "2024-01-20"


def docs(spark, d):
    return table(spark, d, "documents")


def events(spark, d):
    return table(spark, d, "events")


def ntz(name="ts"):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("i01_canonical_documents", "SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'canonical' ELSE 'duplicate' END AS status FROM documents")
def i01(spark, d):
    return I.canonical_documents(docs(spark, d))


@query("i02_dedupe_chunks", "WITH k AS (SELECT doc_id, source AS path, CASE WHEN source = 'src1' THEN sha256('FILE_PATH: ' || source || chr(10) || text) ELSE sha256(text) END AS hash FROM documents) SELECT hash, min(path) AS path FROM k WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY hash")
def i02(spark, d):
    old = docs(spark, d).where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("hash"))
    return I.dedupe_chunks(docs(spark, d).select(F.col("source").alias("path"), "text"), old, F.col("path") == "src1").select("hash", "path")


FILES = "f AS (SELECT doc_id AS doc, n_chars || ':' || CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS fingerprint, sha256(text) AS hash FROM documents), l AS (SELECT doc_id AS doc, n_chars || ':0' AS fingerprint, sha256(text) AS hash, doc_id % 6 <> 0 AS done FROM documents WHERE doc_id % 3 <> 1)"


def files(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.concat("n_chars", F.when(F.col("doc_id") % 4 == 0, ":1").otherwise(":0")).alias("fingerprint"), F.sha2("text", 256).alias("hash"))


@query("i03_skip_decision", f"WITH {FILES}, o AS (SELECT hash, min(doc) AS owner FROM l GROUP BY hash) SELECT f.doc, CASE WHEN l.fingerprint = f.fingerprint AND done THEN 'cache_hit' WHEN owner <> f.doc THEN 'duplicate' ELSE 'process' END AS decision FROM f LEFT JOIN l ON l.doc = f.doc LEFT JOIN o ON o.hash = f.hash")
def i03(spark, d):
    ledger = docs(spark, d).where("doc_id % 3 <> 1").select(F.col("doc_id").alias("doc"), F.concat("n_chars", F.lit(":0")).alias("fingerprint"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 6 != 0).alias("done"))
    return I.skip_decision(files(spark, d), ledger).select("doc", "decision")


STATUS = "['UPSERTED', 'FAILED', 'FAILED', 'NEW', 'DELETED'][doc_id % 5 + 1]"


def five(*v, by="doc_id"):
    return F.element_at(F.array(*map(F.lit, v)), (F.col(by) % len(v) + 1).cast("int"))


@query("i04_decide_processing", f"WITH {FILES}, s AS (SELECT doc_id AS doc, n_chars || ':0' AS old, {STATUS} AS status, CASE WHEN doc_id % 5 = 1 THEN 'a permanent fault' END AS error FROM documents WHERE doc_id % 7 <> 0) SELECT f.doc, CASE WHEN status IS NULL OR old <> fingerprint THEN 'PROCESS' WHEN status IN ('UPSERTED', 'DELETED') THEN 'SKIP' WHEN status = 'FAILED' THEN CASE WHEN contains(coalesce(error, ''), 'permanent') THEN 'SKIP' ELSE 'RETRY' END ELSE 'PROCESS' END AS decision FROM f LEFT JOIN s ON s.doc = f.doc")
def i04(spark, d):
    state = docs(spark, d).where("doc_id % 7 <> 0").select(F.col("doc_id").alias("doc"), F.concat("n_chars", F.lit(":0")).alias("old"), five("UPSERTED", "FAILED", "FAILED", "NEW", "DELETED").alias("status"), F.when(F.col("doc_id") % 5 == 1, "a permanent fault").alias("error"))
    return I.decide_processing(files(spark, d), state).select("doc", "decision")


@query("i05_publish_version", "WITH v AS (SELECT user_id AS doc, event_type AS fingerprint, ts AS run_ts FROM events), c AS (SELECT *, lag(fingerprint) OVER (PARTITION BY doc ORDER BY run_ts, fingerprint) AS last FROM v), n AS (SELECT * FROM c WHERE last IS DISTINCT FROM fingerprint) SELECT doc, fingerprint, run_ts, CASE WHEN lead(fingerprint) OVER w IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, lead(fingerprint) OVER w AS superseded_by FROM n WINDOW w AS (PARTITION BY doc ORDER BY run_ts, fingerprint)")
def i05(spark, d):
    v = I.publish_version(events(spark, d).select(F.col("user_id").alias("doc"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("run_ts")))
    return v.withColumn("run_ts", ntz("run_ts"))


@query("i06_claim_stage", f"WITH s AS (SELECT event_id AS item, ['DONE', 'IN_PROGRESS', 'FAILED'][event_id % 3 + 1] AS status, ts, user_id % 5 AS attempt FROM events WHERE event_id % 4 <> 0) SELECT event_id AS item, CASE WHEN status IS NULL THEN 'CLAIMED' WHEN status = 'DONE' THEN 'DONE' WHEN status = 'IN_PROGRESS' THEN CASE WHEN s.ts >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'IN_PROGRESS_RECENT' ELSE 'RECLAIMED_STALE' END WHEN status = 'FAILED' AND attempt < 3 THEN 'CLAIMED' ELSE 'DONE' END AS claim FROM events LEFT JOIN s ON item = event_id")
def i06(spark, d):
    e = events(spark, d)
    s = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("item"), five("DONE", "IN_PROGRESS", "FAILED", by="event_id").alias("status"), F.col("ts").alias("updated_at"), (F.col("user_id") % 5).alias("attempt"))
    return I.claim_stage(e.select(F.col("event_id").alias("item")), s, NOW).select("item", "claim")


def observed(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("lang").alias("mtime"), F.col("source").alias("dir"))


@query("i07_changed_files", "SELECT doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def i07(spark, d):
    o = observed(spark, d)
    old = o.where("path % 3 <> 0").withColumn("size", F.when(F.col("path") % 5 != 0, F.col("size")))
    return I.changed_files(o, old).select("path", "size")


@query("i08_missing_files", "SELECT doc_id AS path FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 2 <> 0 AND doc_id % 5 <> 0")
def i08(spark, d):
    o = observed(spark, d)
    return I.missing_files(o, o.where("path % 2 = 0"), o.where("dir IN ('src1', 'src2', 'src3')").select("dir").distinct(), o.where("path % 5 = 0")).select("path")


@query("i09_deleted_between_runs", "SELECT DISTINCT user_id * 100 + day(ts) AS path FROM events WHERE event_type = 'click' EXCEPT SELECT user_id * 100 + day(ts) FROM events WHERE event_type = 'purchase'")
def i09(spark, d):
    e = events(spark, d).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("path"), "event_type")
    return I.deleted_between_runs(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"))


@query("i10_archive_deleted", "SELECT doc_id AS path, doc_id % 4 = 0 OR doc_id % 9 = 0 AS archived FROM documents")
def i10(spark, d):
    o = observed(spark, d).withColumn("archived", F.col("path") % 9 == 0)
    return I.archive_deleted(o, o.where("path % 4 = 0")).select("path", "archived")


RUNS = "r AS (SELECT event_type AS run_id, user_id AS path, ts AS seen_at, event_id FROM events)"


def runs(spark, d):
    return events(spark, d).select(F.col("event_type").alias("run_id"), F.col("user_id").alias("path"), F.col("ts").alias("seen_at"))


@query("i11_run_history", f"WITH {RUNS} SELECT path, run_id, seen_at, CAST(row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, run_id DESC) AS INT) AS rank FROM r QUALIFY rank <= 10")
def i11(spark, d):
    return I.run_history(runs(spark, d)).withColumn("seen_at", ntz("seen_at"))


@query("i12_files_in_run", f"WITH {RUNS} SELECT run_id, path, max(seen_at) AS seen_at FROM r GROUP BY ALL")
def i12(spark, d):
    return I.files_in_run(runs(spark, d)).withColumn("seen_at", ntz("seen_at"))


STATES = "['NEW', 'EMBEDDED', 'UPSERTED', 'UPSERTED', 'FAILED'][event_id % 5 + 1]"


def states(spark, d):
    return events(spark, d).select(F.col("event_id").alias("chunk"), F.col("user_id").alias("path"), F.when(F.col("user_id") % 3 == 0, "UPSERTED").otherwise(five("NEW", "EMBEDDED", "UPSERTED", "UPSERTED", "FAILED", by="event_id")).alias("status"))


CHUNKS = f"c AS (SELECT event_id AS chunk, user_id AS path, CASE WHEN user_id % 3 = 0 THEN 'UPSERTED' ELSE {STATES} END AS status FROM events)"


@query("i13_resume_chunks", f"WITH {CHUNKS} SELECT chunk, CASE status WHEN 'FAILED' THEN 'failed' WHEN 'NEW' THEN 'pending' ELSE 'in_progress' END AS queue FROM c WHERE status <> 'UPSERTED'")
def i13(spark, d):
    return I.resume_chunks(states(spark, d)).select("chunk", "queue")


@query("i14_file_progress", f"WITH {CHUNKS} SELECT path, count(*) AS total, count(*) FILTER (status = 'NEW') AS pending, count(*) FILTER (status = 'EMBEDDED') AS processing, count(*) FILTER (status = 'UPSERTED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, round(100.0::DOUBLE * count(*) FILTER (status = 'UPSERTED') / count(*), 2) AS pct, bool_and(status = 'UPSERTED') AS complete FROM c GROUP BY path")
def i14(spark, d):
    return I.file_progress(states(spark, d))


@query("i15_status_counts", f"WITH {CHUNKS} SELECT status, count(*) AS n FROM c GROUP BY ROLLUP (status)")
def i15(spark, d):
    return I.status_counts(states(spark, d))


JOBS = "j AS (SELECT event_id AS job_id, ['pending', 'processing', 'completed'][event_id % 3 + 1] AS status, user_id % 5 AS priority, ts AS enqueued_at, ts AS started_at, CAST(user_id % 3 AS INT) AS retry_count FROM events)"


def jobs(spark, d):
    return events(spark, d).select(F.col("event_id").alias("job_id"), five("pending", "processing", "completed", by="event_id").alias("status"), (F.col("user_id") % 5).alias("priority"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("started_at"), (F.col("user_id") % 3).cast("int").alias("retry_count"))


@query("i16_ready_jobs", f"WITH {JOBS} SELECT job_id, priority FROM j WHERE status = 'pending' AND enqueued_at <= TIMESTAMP '{NOW}' ORDER BY priority DESC, enqueued_at, job_id LIMIT 40")
def i16(spark, d):
    return I.ready_jobs(jobs(spark, d), NOW, 40).select("job_id", "priority")


@query("i17_apply_acks", f"WITH {JOBS}, a AS (SELECT job_id, job_id % 4 = 0 AS ok FROM j WHERE job_id % 2 = 0), t AS (SELECT j.*, ok, CASE WHEN NOT ok THEN retry_count + 1 ELSE retry_count END AS t FROM j LEFT JOIN a USING (job_id)) SELECT job_id, CASE WHEN ok IS NULL THEN status WHEN ok THEN 'completed' WHEN t >= 3 THEN 'dlq' ELSE 'pending' END AS status, CASE WHEN NOT ok AND t < 3 THEN TIMESTAMP '{NOW}' + to_seconds(CAST(power(2, t) AS INT)) ELSE enqueued_at END AS enqueued_at, CAST(t AS INT) AS retry_count FROM t")
def i17(spark, d):
    j = jobs(spark, d)
    acks = j.where("job_id % 2 = 0").select("job_id", (F.col("job_id") % 4 == 0).alias("ok"))
    return I.apply_acks(j, acks, NOW).select("job_id", "status", ntz("enqueued_at"), "retry_count")


@query("i18_abandoned_jobs", f"WITH {JOBS} SELECT job_id FROM j WHERE status = 'processing' AND started_at <= TIMESTAMP '{NOW}' - INTERVAL 5 DAY ORDER BY started_at, job_id LIMIT 30")
def i18(spark, d):
    return I.abandoned_jobs(jobs(spark, d), NOW, "5 days", 30).select("job_id")


@query("i19_reconcile_ledger", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'PENDING' ELSE 'FAILED' END AS status FROM events")
def i19(spark, d):
    s = events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "DONE").otherwise("FAILED").alias("status"))
    return I.reconcile_ledger(s, docs(spark, d).where("n_chars < 0"))


@query("i20_valid_scores", "SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE WHEN doc_id % 3 = 0 THEN 2.0::DOUBLE END AS score FROM documents")
def i20(spark, d):
    f = docs(spark, d).select(F.col("doc_id").alias("path"), F.timestamp_seconds("n_chars").alias("mtime"))
    one = f.where("path % 2 = 0").select("path", "mtime", F.lit("c").alias("config"), F.lit(1.0).alias("score"))
    old = f.where("path % 5 = 0").select("path", F.timestamp_seconds(F.col("mtime").cast("long") + 9).alias("mtime"), F.lit("c").alias("config"), F.lit(7.0).alias("score"))
    two = f.where("path % 3 = 0").select("path", "mtime", F.lit("c").alias("config"), F.lit(2.0).alias("score"))
    return I.valid_scores(f, [old, one, two], "c")


@query("i21_directory_scores", "SELECT source AS dir, 'd' || doc_id AS path, count(*) OVER (PARTITION BY source) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality <> 0) AND source IS NOT NULL")
def i21(spark, d):
    f = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("source").alias("dir"), F.col("quality").alias("score"))
    return I.directory_scores(f)


@query("i22_order_small_first", "SELECT doc_id, n_chars AS size, source AS path FROM documents ORDER BY size, lower(path)")
def i22(spark, d):
    return I.order_small_first(docs(spark, d).select("doc_id", F.col("n_chars").alias("size"), F.col("source").alias("path")))


HASHES = "h AS (SELECT source AS dir, md5(string_agg(doc_id || ':' || lang || ':' || n_chars, '|' ORDER BY doc_id || ':' || lang || ':' || n_chars)) AS hash FROM documents GROUP BY source)"


def hashes(spark, d):
    return I.directory_hash(docs(spark, d).select(F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("mtime"), F.col("n_chars").alias("size")))


@query("i23_directory_hash", f"WITH {HASHES} SELECT * FROM h")
def i23(spark, d):
    return hashes(spark, d)


@query("i24_unchanged_directories", f"WITH {HASHES} SELECT dir, hash FROM h WHERE dir NOT IN ('src1', 'src2')")
def i24(spark, d):
    h = hashes(spark, d)
    cached = h.withColumn("hash", F.when(F.col("dir") == "src1", "old").otherwise(F.col("hash"))).withColumn("options_hash", F.when(F.col("dir") == "src2", "b").otherwise("a"))
    return I.unchanged_directories(h, cached, "a").select("dir", "hash")


@query("i25_purge_expired", f"SELECT event_id FROM events WHERE event_type = 'view' OR ts >= TIMESTAMP '{NOW}'")
def i25(spark, d):
    return I.purge_expired(events(spark, d).withColumn("expires_at", F.when(F.col("event_type") != "view", F.col("ts"))), NOW).select("event_id")


RULES = [("^view", 5, 20, 1), ("click|purchase", 2, 50, 4)]


@query("i26_cleanup_candidates", f"WITH r AS (SELECT * FROM (VALUES ('^view', 5, 20, 1), ('click|purchase', 2, 50, 4)) r(pattern, age, low, priority)) SELECT event_type || event_id AS path, CAST(value AS BIGINT) AS size, min(priority) AS priority FROM events JOIN r ON regexp_matches(event_type || event_id, pattern) AND CAST(value AS BIGINT) >= low WHERE ts <= TIMESTAMP '{NOW}' - to_days(age) GROUP BY ALL")
def i26(spark, d):
    f = events(spark, d).select(F.concat("event_type", "event_id").alias("path"), F.rint("value").cast("long").alias("size"), F.col("ts").alias("mtime"))
    r = spark.createDataFrame(RULES, "pattern string, max_age_days int, min_size int, priority int")
    return I.cleanup_candidates(f, r, 75.0, NOW).select("path", "size", "priority")


@query("i27_scan_frontier", "WITH p AS (SELECT event_type AS run_id, user_id AS dir, min(event_id) AS seq FROM events WHERE user_id % 3 <> 0 GROUP BY ALL) SELECT run_id, dir, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INT) AS place FROM p")
def i27(spark, d):
    p = events(spark, d).groupBy(F.col("event_type").alias("run_id"), F.col("user_id").alias("dir")).agg(F.min("event_id").alias("seq"))
    return I.scan_frontier(p, p.where("dir % 3 = 0").select("run_id", "dir")).select("run_id", "dir", "place")


@query("i28_run_list", "SELECT user_id AS run_id, min(ts) AS started_at, count(*) FILTER (event_type = 'view') AS dirs, count(*) FILTER (event_type = 'click') AS files, arg_max(event_type, ts) FILTER (event_id % 7 = 0) AS last_error FROM events GROUP BY user_id")
def i28(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("run_id"), "ts", F.when(F.col("event_type") == "view", "dir").when(F.col("event_type") == "click", "file").alias("kind"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("error"))
    return I.run_list(e).withColumn("started_at", ntz("started_at"))


@query("i29_insert_or_ignore", "WITH r AS (SELECT user_id, event_id AS seq, CASE WHEN event_id < 2000 THEN 0 ELSE 1 END AS b FROM events), t AS (SELECT user_id, min(seq) AS seq FROM r WHERE b = 0 GROUP BY user_id), n AS (SELECT user_id, min(seq) AS seq FROM r WHERE b = 1 AND user_id NOT IN (SELECT user_id FROM t) GROUP BY user_id) SELECT * FROM t UNION ALL SELECT * FROM n")
def i29(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("seq"))
    return I.insert_or_ignore(e.where("seq < 2000").groupBy("user_id").agg(F.min("seq").alias("seq")), e.where("seq >= 2000"), "user_id")
