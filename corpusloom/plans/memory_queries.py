"""Queries of conversation memory and usage tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import memory as M
from corpusloom.operators import usage as U
from corpusloom.plans.ingest_queries import five, ntz
from corpusloom.plans.registry import query, table
from corpusloom.plans.retrieval_queries import hits, vectors
from corpusloom.plans.retrieval_queries import sql as hits_sql
from corpusloom.plans.text_queries import any_sql, q

NOW = "2024-01-20"


def msgs(spark, d):
    return table(spark, d, "conversations")


@query("m01_recent_window", "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS recent_sha256 FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) WHERE role <> 'system' GROUP BY conv_id")
def m01(spark, d):
    return M.format_recent(M.recent_window(msgs(spark, d), 4)).select("conv_id", F.sha2("recent", 256).alias("recent_sha256"))


@query("m02_should_compress", "SELECT conv_id, count(*) AS n, CAST(sum(strlen(text) + strlen(role)) AS BIGINT) AS bytes, count(*) > 8 OR sum(strlen(text) + strlen(role)) / 1024 >= 3.2 AS compress FROM conversations GROUP BY conv_id")
def m02(spark, d):
    return M.should_compress(msgs(spark, d), window=4, limit_kb=4)


TURNING = f"tp AS (SELECT *, turn = min(turn) OVER w OR turn = max(turn) OVER w OR contains(text, '?') OR {any_sql('lower(text)', rules.TURNING)} AS turning, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id))"
PARETO = f"""{TURNING}, pk AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, greatest(3, CAST(floor(n * 0.2 + 1e-9) AS INT)) AS target FROM tp WHERE n <= 3 OR turning),
ps AS (SELECT *, greatest(1, (k - 2) // (target - 2)) AS step FROM pk), kept AS (SELECT conv_id, turn, role, text FROM ps WHERE n <= 3 OR k <= target OR i = 1 OR i = k OR ((i - 2) % step = 0 AND (i - 2) / step < target - 2))"""


@query("m03_turning_points", f"WITH {TURNING} SELECT conv_id, turn, turning FROM tp")
def m03(spark, d):
    return M.turning_points(msgs(spark, d)).select("conv_id", "turn", "turning")


@query("m04_pareto_compress", f"WITH {PARETO} SELECT conv_id, turn FROM kept")
def m04(spark, d):
    return M.pareto_compress(msgs(spark, d)).select("conv_id", "turn")


SUMMARY = "string_agg(role || ': ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END, chr(10) ORDER BY turn)"


@query("m05_format_summary", f"WITH {PARETO} SELECT conv_id, {SUMMARY} AS summary FROM kept GROUP BY conv_id")
def m05(spark, d):
    return M.format_summary(M.pareto_compress(msgs(spark, d)))


# The generated talk has few question marks, so full stops of every third message are read as such.
QUOTES = rf"""mq AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '\.', '?') WHEN turn % 3 = 1 THEN 'This means ' || text || ' In 2024.' ELSE text END AS text FROM conversations),
cq AS (SELECT conv_id, turn, role, [CASE WHEN role = 'user' AND contains(text, '?') THEN trim(regexp_extract(text, '[^.!?]*\?')) END, CASE WHEN role = 'assistant' AND {any_sql('lower(text)', rules.DEFINITIVE)} THEN trim(list_filter(string_split_regex(text, '[.!?]'), lambda x: length(trim(x)) > 30)[1]) END, CASE WHEN regexp_matches(text, '/[^\s]+|[0-9]{{2,}}') THEN trim(list_filter(string_split_regex(text, '[.!?]'), lambda x: regexp_matches(x, '/[^\s]+|[0-9]{{2,}}'))[1]) END] AS c FROM mq WHERE length(text) >= 20),
uq AS (SELECT conv_id, turn, role, unnest(c) AS q, generate_subscripts(c, 1) AS pos FROM cq), quotes AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS INT) AS place, role || ': ' || q AS quote FROM uq WHERE q IS NOT NULL QUALIFY place <= 5)"""


def quotable(spark, d):
    m = F.col("turn") % 3
    return msgs(spark, d).withColumn("text", F.when(m == 0, F.expr(r"concat(split(text, '\\.', 2)[0], if(contains(text, '.'), '?', ''), coalesce(try_element_at(split(text, '\\.', 2), 2), ''))")).when(m == 1, F.concat(F.lit("This means "), "text", F.lit(" In 2024."))).otherwise(F.col("text")))


@query("m06_key_quotes", f"WITH {QUOTES} SELECT * FROM quotes")
def m06(spark, d):
    return M.key_quotes(quotable(spark, d))


KEYWORDS = rf"""wk AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1) AS pos FROM conversations),
ck AS (SELECT *, lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_\-./]', '', 'g')) AS k FROM wk), sk AS (SELECT *, CASE WHEN regexp_matches(w, '^[a-z]+[A-Z]') THEN 3 WHEN contains(k, '_') THEN 3 WHEN regexp_matches(k, '^[\p{{L}}\p{{N}}_]+\.(pdf|xlsx|docx|txt|py|js|json)') THEN 4 WHEN starts_with(k, '/') THEN 3 WHEN regexp_matches(w, '^\p{{Lu}}') AND length(w) > 3 THEN 2 WHEN length(k) > 6 THEN 1 END AS s FROM ck WHERE length(k) >= 3 AND k NOT IN ({', '.join(map(q, rules.SNAPSHOT_STOPWORDS))})),
tk AS (SELECT conv_id, k AS keyword, CAST(sum(s) AS BIGINT) AS weight, min(turn * 1000000 + pos) AS first FROM sk WHERE s IS NOT NULL GROUP BY ALL), keywords AS (SELECT conv_id, keyword, weight, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, first) AS INT) AS place FROM tk QUALIFY place <= 20)"""


@query("m07_weighted_keywords", f"WITH {KEYWORDS} SELECT * FROM keywords")
def m07(spark, d):
    return M.weighted_keywords(msgs(spark, d))


@query("m08_build_snapshots", f"WITH {PARETO}, {KEYWORDS}, s AS (SELECT conv_id, {SUMMARY} AS summary, count(*) AS n_kept FROM kept GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, string_agg(keyword, ',' ORDER BY place) AS keywords FROM keywords GROUP BY conv_id) SELECT conv_id, n_messages, n_kept, sha256(summary) AS summary_sha256, coalesce(keywords, '') AS keywords, round(n_kept / n_messages, 6) AS ratio, TIMESTAMP '{NOW}' + INTERVAL 30 DAY AS ttl_at FROM s JOIN n USING (conv_id) LEFT JOIN w USING (conv_id)")
def m08(spark, d):
    s = M.build_snapshots(msgs(spark, d), NOW)
    return s.select("conv_id", "n_messages", "n_kept", F.sha2("summary", 256).alias("summary_sha256"), F.array_join("keywords", ",").alias("keywords"), "ratio", ntz("ttl_at"))


LAST = "[NULL, TIMESTAMP '2024-01-19 23:50:00', TIMESTAMP '2024-01-19 20:00:00'][conv_id % 3 + 1]"


@query("m09_snapshot_due", f"SELECT conv_id, count(*) >= 10 AND (any_value({LAST}) IS NULL OR any_value({LAST}) <= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE) AS due FROM conversations GROUP BY conv_id")
def m09(spark, d):
    last = msgs(spark, d).where("conv_id % 3 <> 0").groupBy("conv_id").agg(F.first(F.when(F.col("conv_id") % 3 == 1, "2024-01-19 23:50:00").otherwise("2024-01-19 20:00:00").cast("timestamp")).alias("taken_at"))
    return M.snapshot_due(msgs(spark, d), last, NOW).select("conv_id", "due")


def snaps(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("snapshot_id"), F.col("user_id"), F.col("ts").alias("taken_at"), F.col("ts").alias("ttl_at"), (F.col("event_type") == "error").alias("pinned"))


@query("m10_live_snapshots", f"SELECT event_id AS snapshot_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INT) AS place FROM events WHERE event_type = 'error' OR ts > TIMESTAMP '{NOW}' QUALIFY place <= 50")
def m10(spark, d):
    return M.live_snapshots(snaps(spark, d), NOW).select("snapshot_id", "place")


@query("m11_expired_snapshots", f"SELECT event_id AS snapshot_id FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '{NOW}'")
def m11(spark, d):
    return M.expired_snapshots(snaps(spark, d), NOW).select("snapshot_id")


@query("m12_search_snapshots", hits_sql("SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) FROM hits WHERE label % 2 = 0) t(query_id, id, score, rank) WHERE rank <= 5"))
def m12(spark, d):
    live = vectors(spark, d).select(F.col("id").alias("snapshot_id"), "label").where("label % 2 = 0").join(hits(spark, d).select(F.col("query_id").alias("user_id"), F.col("id").alias("snapshot_id")), "snapshot_id")
    return M.search_snapshots(hits(spark, d), live, 5)


@query("m13_memory_context", f"WITH {PARETO}, s AS (SELECT conv_id, {SUMMARY} AS summary FROM kept GROUP BY conv_id), x AS (SELECT conv_id % 10 AS query_id, conv_id AS rank, '## c' || conv_id || chr(10) || substr(summary, 1, 300) || chr(10) || '- q1' || chr(10) || '- q2' || chr(10) || '- q3' AS section FROM s), u AS (SELECT *, sum(length(section)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM x) SELECT query_id, string_agg(section, chr(10) || chr(10) ORDER BY rank) AS context FROM u WHERE used <= 1500 GROUP BY query_id")
def m13(spark, d):
    s = M.format_summary(M.pareto_compress(msgs(spark, d)))
    s = s.select((F.col("conv_id") % 10).alias("query_id"), F.col("conv_id").alias("rank"), F.concat(F.lit("c"), "conv_id").alias("title"), "summary", F.array(*map(F.lit, ("q1", "q2", "q3", "q4"))).alias("quotes"))
    return M.memory_context(s, 1500)


@query("m14_retrieve_with_memory")
def m14(spark, d):
    h = hits(spark, d)
    return M.retrieve_with_memory(h, h.where("query_id % 100 = 0 AND rank % 2 = 0").withColumn("rank", (F.col("rank") / 2).cast("int")), vectors(spark, d), 8)


@query("m15_context_with_budget", """WITH r AS (SELECT doc_id, text AS recent, repeat('d', CAST(n_chars AS INT)) AS documents, 'Tools ' || source AS tools, repeat('s', 500) AS summary FROM documents),
a AS (SELECT *, 4000 - length('# System' || chr(10) || 'sys') - length('# Current question' || chr(10) || 'why') AS l0 FROM r), b AS (SELECT *, CASE WHEN length(tools) < l0 * 0.2 THEN tools END AS t FROM a), c AS (SELECT *, l0 - length(coalesce(t, '')) AS l1 FROM b),
e AS (SELECT *, CASE WHEN length(recent) > CAST(floor(l1 * 0.4) AS INT) THEN right(recent, CAST(floor(l1 * 0.4) AS INT)) ELSE recent END AS rr FROM c), f AS (SELECT *, l1 - length(rr) AS l2 FROM e),
g AS (SELECT *, CASE WHEN length(documents) > CAST(floor(l2 * 0.4) AS INT) THEN left(documents, CAST(floor(l2 * 0.4) AS INT)) || '...' ELSE documents END AS dd FROM f), h AS (SELECT *, l2 - length(dd) AS l3 FROM g)
SELECT doc_id, sha256('# System' || chr(10) || 'sys' || chr(10) || chr(10) || CASE WHEN l3 > 100 THEN '# Previous summary' || chr(10) || CASE WHEN 500 > l3 THEN left(summary, l3) || '...' ELSE summary END || chr(10) || chr(10) ELSE '' END || '# Recent messages' || chr(10) || rr || chr(10) || chr(10) || '# ' || t || chr(10) || chr(10) || '# Relevant documents' || chr(10) || dd || chr(10) || chr(10) || '# Current question' || chr(10) || 'why') AS context_sha256 FROM h""")
def m15(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.lit("sys").alias("system"), F.lit("why").alias("question"), F.concat(F.lit("Tools "), "source").alias("tools"), F.col("text").alias("recent"), F.expr("repeat('d', cast(n_chars AS int))").alias("documents"), F.expr("repeat('s', 500)").alias("summary"))
    return M.context_with_budget(r, 1000).select("doc_id", F.sha2("context", 256).alias("context_sha256"))


FILE = "event_id || ['.pdf', '.xlsx', '.zip', '.docx'][event_id % 4 + 1]"
LOG = f"tl AS (SELECT user_id AS thread_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, CASE WHEN event_id % 4 = 2 THEN 'archive' ELSE 'office' END AS tool, {FILE} AS file_path FROM events)"


def log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), "event_id", "ts", F.when(F.col("event_id") % 4 == 2, "archive").otherwise("office").alias("tool"), F.concat("event_id", five(".pdf", ".xlsx", ".zip", ".docx", by="event_id")).alias("file_path"))
    return M.tool_log(e)


@query("m16_tool_log", f"WITH {LOG} SELECT thread_id, event_id, 'doc#' || place AS doc_id FROM tl QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY place DESC) <= 5")
def m16(spark, d):
    return log(spark, d).where("back <= 5").select("thread_id", "event_id", "doc_id")


@query("m17_resolve_tool_reference", f"""WITH {LOG}, qs AS (SELECT DISTINCT user_id AS thread_id, ['doc#3', 'the last file', 'open the pdf', 'that archive', 'the first one', 'hm'][user_id % 6 + 1] AS t FROM events),
c AS (SELECT thread_id, place, file_path, CASE WHEN t = 'doc#3' THEN CASE WHEN place = 3 THEN 0 END WHEN t = 'open the pdf' THEN CASE WHEN ends_with(file_path, '.pdf') THEN 1 ELSE 2 END WHEN t = 'that archive' THEN CASE WHEN tool = 'archive' THEN 1 ELSE 2 END WHEN t = 'the first one' THEN CASE WHEN place = 1 THEN 1 ELSE 2 END ELSE 1 END AS p FROM qs JOIN tl USING (thread_id))
SELECT thread_id, 'doc#' || place AS doc_id, file_path FROM c WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY p, place DESC) = 1""")
def m17(spark, d):
    asks = table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("query_id"), F.col("user_id").alias("thread_id"), five("doc#3", "the last file", "open the pdf", "that archive", "the first one", "hm", by="user_id").alias("text"))
    return M.resolve_tool_reference(asks, log(spark, d)).select("thread_id", "doc_id", "file_path")


@query("m18_checkpoints", f"SELECT user_id AS thread_id, event_type AS namespace, arg_max(event_id, ts) FILTER (event_id % 3 <> 0) AS payload FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ALL HAVING max(ts) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND count(*) FILTER (event_id % 3 <> 0) > 0")
def m18(spark, d):
    w = table(spark, d, "events").where(F.col("ts") <= F.lit(NOW).cast("timestamp")).select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("namespace"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("payload"), "ts")
    return M.checkpoints(w, NOW).select("thread_id", "namespace", "payload")


USES = "u AS (SELECT user_id AS thread_id, event_type AS file_id, event_id % 20 AS chunk_id, round(sum(value), 6) AS score, count(*) AS uses FROM events GROUP BY ALL), cu AS (SELECT *, CAST(sum(uses) OVER (PARTITION BY thread_id, file_id) AS BIGINT) AS query_count FROM u)"


def uses(spark, d):
    return U.chunk_usage(table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("file_id"), (F.col("event_id") % 20).alias("chunk_id"), F.col("value").alias("score")))


def uploads(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % 997).alias("hash"), F.col("event_type").alias("name"), F.col("user_id").alias("thread_id"), "ts")


@query("u01_upload_stats", "SELECT event_id % 997 AS hash, count(*) AS uploads, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_type, ts) AS name, count(DISTINCT user_id) AS threads FROM events GROUP BY 1")
def u01(spark, d):
    return U.upload_stats(uploads(spark, d)).withColumns({"first_at": ntz("first_at"), "last_at": ntz("last_at")})


@query("u02_auto_promote", "SELECT event_id % 997 AS hash, count(*) AS uploads FROM events WHERE event_id % 997 % 5 <> 0 GROUP BY 1 HAVING count(*) >= 11")
def u02(spark, d):
    done = uploads(spark, d).where("hash % 5 = 0").select("hash")
    return U.auto_promote(U.upload_stats(uploads(spark, d)), done, 11).select("hash", "uploads")


@query("u03_chunk_usage", f"WITH {USES} SELECT * FROM cu")
def u03(spark, d):
    return uses(spark, d)


PARETO_U = f"{USES}, pf AS (SELECT *, count(*) OVER f AS n, sum(score) OVER f AS total, CAST(row_number() OVER (PARTITION BY thread_id, file_id ORDER BY score DESC, chunk_id) AS INT) AS place FROM cu WHERE query_count >= 5 WINDOW f AS (PARTITION BY thread_id, file_id)), pc AS (SELECT * EXCLUDE (total), round(score / total, 6) AS share FROM pf WHERE place <= greatest(1, floor(n * 0.2 + 1e-9)))"


@query("u04_pareto_chunks", f"WITH {PARETO_U} SELECT * FROM pc")
def u04(spark, d):
    return U.pareto_chunks(uses(spark, d))


@query("u05_promote", f"WITH {PARETO_U} SELECT DISTINCT chunk_id, 'temp_' || thread_id AS promoted_from, 'default' AS tenant FROM pc")
def u05(spark, d):
    c = table(spark, d, "events").select(F.concat(F.lit("temp_"), "user_id").alias("tenant"), (F.col("event_id") % 20).alias("chunk_id")).distinct()
    return U.promote(c, U.pareto_chunks(uses(spark, d)))


# Sums of six places are exact, so that no rounding hangs on the order of the rows.
PARETO_EXACT = PARETO_U.replace("sum(score) OVER f", "sum(score::DECIMAL(18,6)) OVER f")


@query("u06_promotable_files", f"WITH {PARETO_EXACT}, b AS (SELECT thread_id, file_id, count(*) AS t, max(n) AS n, max(query_count) AS qc, round(sum(share::DECIMAL(18,6)) * 100, 1)::DOUBLE AS pct FROM pc GROUP BY ALL) SELECT thread_id, file_id, printf('%d of %d chunks carry %.1f%% of the score in %d uses', t, n, pct, qc) AS reason FROM b")
def u06(spark, d):
    return U.promotable_files(U.pareto_chunks(uses(spark, d)))


@query("u07_tracking_stats", f"SELECT count(DISTINCT event_id % 997) AS unique_files, count(*) FILTER (ts > TIMESTAMP '{NOW}') AS active, count(*) FILTER (event_type = 'purchase') AS promoted FROM events")
def u07(spark, d):
    t = table(spark, d, "events").select(F.col("ts").alias("expires_at"), (F.col("event_type") == "purchase").alias("promoted"))
    return U.tracking_stats(uploads(spark, d), t, NOW)


@query("u08_artifact_stats", f"SELECT user_id AS thread_id, count(*) AS files, round(sum(event_id) / 1048576, 6) AS mb, count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY) AS expired, count(*) = count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY) AS left_empty FROM events GROUP BY user_id")
def u08(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("path"), F.col("event_id").alias("size"), F.col("ts").alias("mtime"))
    return U.artifact_stats(f, NOW, "10 days")
