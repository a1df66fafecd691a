"""Queries of the streams: the given tables as streams, drained by ``availableNow``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.register import register
from corpusloom.plans.registry import query, table
from corpusloom.sources.files import shared_path
from corpusloom.streaming import streams as X


def as_stream(df: DataFrame, order: str, batch: Column | None = None, batches: int = 3) -> DataFrame:
    """A table as a stream of three triggers, in the order of a column (or by numbers 0 to 2): the files of a trigger are
    written after those before, and there are as many as a trigger takes."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "source")
    if batch is None:
        at = F.col(order).cast("double")
        bounds = df.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0] or []
        batch = sum(((at > x).cast("int") for x in bounds), F.lit(0))
    df = df.withColumn("__batch", batch)
    for i in range(batches):
        df.where(F.col("__batch") == i).drop("__batch").repartition(2).sortWithinPartitions(order).write.mode("append").parquet(path)
    return X.read_stream(spark, path, df.drop("__batch").schema, files_per_trigger=2)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("x01_stream_ingest", "WITH n AS (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 900) / 720)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(min(i) AS INT) AS chunk_index, sha256(substr(text, i * 720 + 1, 900)) AS hash FROM n GROUP BY ALL")
def x01(spark, d):
    # Every third document comes as a longer draft first; its chunks are replaced.
    docs = table(spark, d, "documents").select("doc_id", "text")
    draft = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("draft "), "text", F.lit(" "), "text").alias("text"), F.lit(0).alias("seq"), F.lit(0).alias("trigger"))
    last = docs.select("*", F.lit(1).alias("seq"), (F.col("doc_id") % 2 + 1).cast("int").alias("trigger"))
    target = shared_path(spark, "chunks")
    X.run_once(as_stream(draft.unionByName(last), "doc_id", F.col("trigger")), each=X.stream_ingest(target, shared_path(spark, "batches"), buckets=8))
    return X.ingested(spark, target).select("doc_id", "chunk_index", "hash")


@query("x02_stream_dedupe", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def x02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"))
    return X.run_once(X.stream_dedupe(as_stream(docs, "ts"), "3650 days")).select("hash")


#: Windows are given out when the watermark has passed them.
MARK = "m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)"


@query("x03_stream_metrics", f'WITH {MARK}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS name, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL) SELECT start, start + INTERVAL 1 HOUR AS "end", name, n, total, low, high FROM w, m WHERE start + INTERVAL 1 HOUR <= mark')
def x03(spark, d):
    s = as_stream(events(spark, d).select(F.col("event_type").alias("name"), "value", "ts"), "ts")
    return ntz(X.run_once(X.stream_metrics(s, late="1 day")).withColumn("total", F.round("total", 6)), "start", "end")


@query("x04_stream_snapshots", f'WITH {MARK}, e AS (SELECT user_id AS conv_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, false) AS fresh FROM events), k AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY conv_id ORDER BY ts) AS k FROM e), s AS (SELECT conv_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM k GROUP BY conv_id, k) SELECT s.* FROM s, m WHERE "end" <= mark')
def x04(spark, d):
    s = as_stream(events(spark, d).select(F.col("user_id").alias("conv_id"), "ts"), "ts")
    return ntz(X.run_once(X.stream_snapshots(s, late="1 day")), "start", "end")


@query("x05_stream_usage", "WITH e AS (SELECT user_id AS thread_id, event_type AS file_id, event_id % 20 AS chunk_id, ts, row_number() OVER w AS n, sum(value) OVER w AS score FROM events WINDOW w AS (PARTITION BY user_id, event_type, event_id % 20 ORDER BY ts, value ROWS UNBOUNDED PRECEDING)) SELECT thread_id, file_id, chunk_id, n AS uses, round(score, 6) AS score, ts AS promoted_at FROM e WHERE n = 3")
def x05(spark, d):
    uses = events(spark, d).select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("file_id"), (F.col("event_id") % 20).alias("chunk_id"), F.col("value").alias("score"), "ts")
    out = X.run_once(X.stream_usage(as_stream(uses, "ts"), 3, ttl_hours=24 * 3650, late="40 days"))
    return ntz(out.withColumn("score", F.round("score", 6)), "promoted_at")


#: The circuit's steps one by one.
CIRCUIT = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS source, ts, event_type NOT IN ('error', 'signup') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type NOT IN ('error', 'signup')) AS n FROM events),
r AS (SELECT DISTINCT source, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 'closed' AS circuit, 0 AS failures, 0::DOUBLE AS last FROM e UNION ALL
SELECT source, n, ts, CASE WHEN ok THEN CASE h WHEN 'half-open' THEN 'closed' ELSE h END WHEN h = 'half-open' OR h = 'closed' AND failures + 1 >= 5 THEN 'open' ELSE h END, CASE WHEN NOT ok THEN failures + 1 ELSE CASE h WHEN 'half-open' THEN 0 WHEN 'closed' THEN greatest(0, failures - 1) ELSE failures END END, CASE WHEN ok THEN last ELSE epoch(ts) END
FROM (SELECT e.*, r.failures, r.last, CASE WHEN circuit = 'open' AND epoch(e.ts) - r.last >= 60 THEN 'half-open' ELSE circuit END AS h FROM r JOIN e ON e.source = r.source AND e.n = r.n + 1))
SELECT source, ts, circuit, failures FROM r WHERE n > 0"""


@query("x06_stream_circuit", CIRCUIT)
def x06(spark, d):
    s = as_stream(events(spark, d).select(F.col("user_id").cast("string").alias("source"), "ts", (~F.col("event_type").isin("error", "signup")).alias("ok")), "ts")
    return ntz(X.run_once(X.stream_circuit(s, late="40 days")), "ts")


@query("x07_stream_ttl")
def x07(spark, d):
    s = as_stream(events(spark, d).select(F.col("user_id").cast("string").alias("tenant"), "ts"), "ts")
    return X.run_once(X.stream_ttl(s))


PROBES = "SELECT user_id::VARCHAR AS volume, ts, event_type <> 'error' AS \"primary\" FROM events"


def probes(spark, d):
    return events(spark, d).select(F.col("user_id").cast("string").alias("volume"), "ts", (F.col("event_type") != "error").alias("primary"))


@query("x08_stream_availability", f"SELECT volume, ts AS reconnected_at FROM (SELECT *, lag(\"primary\") OVER (PARTITION BY volume ORDER BY ts, \"primary\") AS b FROM ({PROBES})) WHERE \"primary\" AND NOT b")
def x08(spark, d):
    return X.run_once(X.stream_availability(as_stream(probes(spark, d), "ts"), late="40 days")).withColumn("reconnected_at", F.col("reconnected_at").cast("timestamp_ntz"))


@query("x08_batch_availability", f"SELECT volume, ts AS reconnected_at FROM (SELECT *, lag(\"primary\") OVER (PARTITION BY volume ORDER BY ts, \"primary\") AS b FROM ({PROBES})) WHERE \"primary\" AND NOT b")
def x08b(spark, d):
    return X.batch_availability(probes(spark, d)).withColumn("reconnected_at", F.col("reconnected_at").cast("timestamp_ntz"))


@query("x09_stream_log_alerts", f"WITH {MARK}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS tool, count(*) FILTER (value > 100 AND value <= 300) AS errors, count(*) FILTER (value > 300) AS critical FROM events GROUP BY ALL) SELECT w.* FROM w, m WHERE errors + critical > 0 AND start + INTERVAL 1 HOUR <= mark")
def x09(spark, d):
    s = as_stream(events(spark, d).select(F.col("event_type").alias("tool"), F.when(F.col("value") > 300, "out of memory").when(F.col("value") > 100, "failed").otherwise("fine").alias("line"), "ts"), "ts")
    return ntz(X.run_once(X.stream_log_alerts(s, late="1 day", most=0)), "start")


@query("x10_late_data_report", "WITH b AS (SELECT event_id % 3 AS batch, ts FROM events), g AS (SELECT batch, max(ts) AS m FROM b GROUP BY batch), s AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g) SELECT batch, count(*) AS rows, count(*) FILTER (ts < seen - INTERVAL 1 DAY) AS late FROM b JOIN s USING (batch) GROUP BY batch")
def x10(spark, d):
    target = shared_path(spark, "late")
    s = as_stream(events(spark, d).select("event_id", "ts"), "ts", F.col("event_id") % 3)
    X.run_once(s, each=X.late_data_report(target, "1 day"))
    return spark.read.parquet(target).select(F.col("batch").cast("long").alias("batch"), "rows", "late")


@query("registered_functions", r"SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(regexp_replace(text, '\s', '', 'g')) / 3) AS INT)) END AS INT) AS tokens, sha256(text) AS hash FROM documents")
def functions(spark, d):
    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("corpusloom_documents")
    return spark.sql("SELECT doc_id, estimate_tokens(text) AS tokens, content_hash(text) AS hash FROM corpusloom_documents")
