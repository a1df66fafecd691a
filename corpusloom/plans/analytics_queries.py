"""Queries of metrics, logs, coverage and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import code_question_profile, percent_of
from corpusloom.operators import evidence as E
from corpusloom.operators import metrics as A
from corpusloom.plans.ingest_queries import five
from corpusloom.plans.registry import query, table
from corpusloom.plans.streaming_queries import CIRCUIT
from corpusloom.plans.retrieval_queries import HITS, asked, full_hits, vectors
from corpusloom.plans.text_queries import q

NOW = "2024-01-20"
QUANTILES = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def samples(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("id"), five("counter", "gauge", "timer", by="event_id").alias("type"))


for _n, _kind, _cols in (
    ("a01_summary_counter", "counter", "round(sum(value), 6) AS total, count(value) AS n, round(avg(value), 6) AS mean"),
    ("a02_summary_gauge", "gauge", "arg_max(value, ts) AS current, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean"),
    ("a03_summary_timer", "timer", "count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high"),
    ("a04_summary_histogram", "histogram", f"count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, {QUANTILES}"),
):

    @query(_n, f"SELECT event_type AS name, {_cols} FROM events GROUP BY event_type")
    def _summary(spark, d, kind=_kind):
        return A.summary(samples(spark, d), kind)


@query("a04_approx_histogram")
def a04b(spark, d):
    return A.approx_histogram(samples(spark, d))


@query("a05_metrics_summary", f"SELECT ['counter', 'gauge', 'timer'][event_id % 3 + 1] AS type, event_type AS name, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS last_hour FROM events GROUP BY ALL")
def a05(spark, d):
    return A.metrics_summary(samples(spark, d), NOW)


@query("a06_metrics_since", f"SELECT event_type AS name, event_id AS id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS INT) AS back FROM events WHERE ts >= TIMESTAMP '{NOW}' QUALIFY back <= 50")
def a06(spark, d):
    return A.metrics_since(samples(spark, d), NOW, 50).select("name", "id", "back")


LINES = """ll AS (SELECT event_type AS tool, ts, event_id, ['GET /x HTTP/1.1" 200 OK', 'GET /y HTTP/1.1" 404 gone', 'POST HTTP/1.1" 503 failed', 'Traceback: error Timeout', 'WARN slow', 'fine', 'kernel: Out of Memory', 'permission denied'][CASE WHEN event_type = 'view' THEN event_id % 6 ELSE event_id % 8 END + 1] AS line FROM events)"""


def lines(spark, d):
    pick = F.when(F.col("event_type") == "view", F.col("event_id") % 6).otherwise(F.col("event_id") % 8) + 1
    v = F.array(*map(F.lit, ('GET /x HTTP/1.1" 200 OK', 'GET /y HTTP/1.1" 404 gone', 'POST HTTP/1.1" 503 failed', "Traceback: error Timeout", "WARN slow", "fine", "kernel: Out of Memory", "permission denied")))
    return table(spark, d, "events").select(F.col("event_type").alias("tool"), "ts", "event_id", F.element_at(v, pick.cast("int")).alias("line"))


CATS = f"cat AS (SELECT tool, category, count(*) AS n FROM ll JOIN (VALUES {', '.join(f'({q(n)}, {q(p)})' for n, p in rules.LOG_CATEGORIES)}) r(category, pattern) ON regexp_matches(line, pattern) GROUP BY ALL), st AS (SELECT tool, regexp_extract(line, 'HTTP/1\\.1\"\\s+(\\d{{3}})', 1) AS status, count(*) AS n FROM ll WHERE regexp_matches(line, 'HTTP/1\\.1\"\\s+\\d{{3}}') GROUP BY ALL)"


@query("a07_log_categories", f"WITH {LINES}, {CATS} SELECT * FROM cat")
def a07(spark, d):
    return A.log_categories(lines(spark, d))


@query("a08_http_status_counts", f"WITH {LINES}, {CATS} SELECT * FROM st")
def a08(spark, d):
    return A.http_status_counts(lines(spark, d))


@query("a09_log_anomalies", f"""WITH {LINES}, {CATS}, e AS (SELECT tool, sum(n) AS n, bool_or(category = 'Out of Memory') AS oom, bool_or(category = 'Permission Denied') AS denied FROM cat GROUP BY tool), h AS (SELECT tool, sum(n) FILTER (regexp_matches(status, '^[45]')) AS bad, sum(n) AS al FROM st GROUP BY tool)
SELECT tool, 'High error count: ' || n || ' errors found' AS anomaly FROM e WHERE n > 100 UNION ALL SELECT tool, printf('High HTTP error rate: %.1f%% (%d/%d)', bad / al * 100, CAST(bad AS BIGINT), CAST(al AS BIGINT)) FROM h WHERE bad / al > 0.1 UNION ALL SELECT tool, 'Critical: Out of Memory errors detected' FROM e WHERE oom UNION ALL SELECT tool, 'Critical: Permission Denied errors detected' FROM e WHERE denied""")
def a09(spark, d):
    return A.log_anomalies(lines(spark, d))


@query("a10_filter_log_lines", f"WITH {LINES}, k AS (SELECT tool, event_id, ts, CASE WHEN regexp_matches(line, '(?i)error|exception|traceback|critical|fatal') THEN 'error' WHEN regexp_matches(line, '(?i)warn') THEN 'warning' END AS level FROM ll) SELECT tool, event_id, level, CAST(ts AS DATE) AS date FROM k WHERE level IS NOT NULL AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def a10(spark, d):
    return A.filter_log_lines(lines(spark, d), NOW).select("tool", "event_id", "level", "date")


EXEC = "ex AS (SELECT DISTINCT event_type AS file, event_id // 8 AS line FROM events)"


def executed(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("file"), F.floor(F.col("event_id") / 8).alias("line"))


@query("a11_consecutive_blocks", f"WITH {EXEC}, i AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM ex) SELECT file, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY file, i")
def a11(spark, d):
    return A.consecutive_blocks(executed(spark, d))


SYMBOLS = "sy AS (SELECT event_type AS file, 's' || event_id AS symbol, event_id // 8 AS start_line, event_id // 8 + user_id % 6 AS end_line FROM events)"


@query("a12_symbol_coverage", f"WITH {EXEC}, {SYMBOLS}, n AS (SELECT sy.*, count(line) AS executed FROM sy LEFT JOIN ex ON sy.file = ex.file AND line BETWEEN start_line AND end_line GROUP BY ALL) SELECT file, symbol, executed, round(executed / (end_line - start_line + 1), 6) AS ratio, CASE WHEN executed > 0 THEN 'touched' ELSE 'unused' END AS status FROM n")
def a12(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("file"), F.concat(F.lit("s"), "event_id").alias("symbol"), F.floor(F.col("event_id") / 8).alias("start_line"), (F.floor(F.col("event_id") / 8) + F.col("user_id") % 6).alias("end_line"))
    return A.symbol_coverage(s, executed(spark, d))


@query("a13_correlate_findings", f"WITH {EXEC}, f AS (SELECT event_type AS file, (event_id + 4) // 8 AS line, max(user_id % 100) AS confidence FROM events GROUP BY ALL), o AS (SELECT f.* FROM f SEMI JOIN ex USING (file, line)), l AS (SELECT o.file, o.line, count(*) / 11 * 100 AS local FROM o JOIN ex e ON o.file = e.file AND abs(o.line - e.line) <= 5 GROUP BY ALL), t AS (SELECT file, line, confidence, round((confidence + local) / 2, 6) AS total FROM o JOIN l USING (file, line)) SELECT *, CASE WHEN total >= 80 THEN 'high' WHEN total >= 60 THEN 'medium' ELSE 'low' END AS level FROM t")
def a13(spark, d):
    f = table(spark, d, "events").groupBy(F.col("event_type").alias("file"), F.floor((F.col("event_id") + 4) / 8).alias("line")).agg(F.max(F.col("user_id") % 100).alias("confidence"))
    return A.correlate_findings(f, executed(spark, d))


@query("a14_audit_events", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS back FROM events QUALIFY back <= 100")
def a14(spark, d):
    return A.audit_events(table(spark, d, "events"), "event_type").select("event_id", "back")


@query("a15_pressure_actions", CIRCUIT)
def a15(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (~F.col("event_type").isin("error", "signup")).alias("ok"))
    return A.pressure_actions(e).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SPANS = "iv AS (SELECT event_id AS id, event_type AS op, epoch(ts)::DOUBLE AS start, epoch(ts)::DOUBLE + value AS \"end\", user_id % 4 <> 0 AS ok FROM events), ops AS (SELECT op, count(*) AS n, count(*) FILTER (ok) AS ok FROM iv GROUP BY op)"


def spans(spark, d):
    t = F.col("ts").cast("timestamp").cast("double")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("op"), t.alias("start"), (t + F.col("value")).alias("end"), (F.col("user_id") % 4 != 0).alias("ok"))


@query("a16_interval_overlaps", f"WITH {SPANS} SELECT a.id AS a_id, b.id AS b_id, a.ok AS a_ok, b.ok AS b_ok FROM iv a JOIN iv b ON a.op = 'click' AND b.op = 'view' AND greatest(a.start, b.start) < least(a.\"end\", b.\"end\")")
def a16(spark, d):
    s = spans(spark, d)
    return A.interval_overlaps(s.where("op = 'click'"), s.where("op = 'view'")).drop("overlap")


@query("a16_overlap_summary", f"WITH {SPANS}, o AS (SELECT x.op AS a, y.op AS b, count(*) AS n FROM iv x JOIN iv y ON x.start < y.\"end\" AND y.start < x.\"end\" WHERE x.op < y.op AND x.start < x.\"end\" AND y.start < y.\"end\" GROUP BY ALL) SELECT p.op AS a, q.op AS b, p.n AS a_count, q.n AS b_count, coalesce(o.n, 0) AS overlap_pairs, p.ok AS a_ok, q.ok AS b_ok FROM ops p JOIN ops q ON p.op < q.op LEFT JOIN o ON o.a = p.op AND o.b = q.op")
def a16b(spark, d):
    every = spans(spark, d)
    kinds = sorted(r[0] for r in every.select("op").distinct().collect())  # a few kinds of events
    return A.overlap_summary(every, [(a, b) for a in kinds for b in kinds if a < b])


@query("a17_ingestion_summary", "SELECT round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS \"view\" FROM events")
def a17(spark, d):
    return A.ingestion_summary(samples(spark, d), ["click", "view"])


#: The lines that a run has covered, of those that are executable: else none is orphaned.
COVERED = EXEC.replace("FROM events", "FROM events WHERE event_id % 8 < 5")


@query("a18_orphaned_lines", f"WITH {COVERED}, al AS (SELECT DISTINCT event_type AS file, event_id // 8 AS line FROM events), o AS (SELECT file, count(*) AS n FROM al ANTI JOIN ex USING (file, line) GROUP BY file) SELECT al.file, count(*) AS executable, coalesce(any_value(n), 0) AS orphaned, coalesce(any_value(n), 0) = count(*) AS uncovered FROM al LEFT JOIN o ON o.file = al.file GROUP BY al.file")
def a18(spark, d):
    every = table(spark, d, "events").select(F.col("event_type").alias("file"), F.floor(F.col("event_id") / 8).alias("line"))
    covered = table(spark, d, "events").where("event_id % 8 < 5").select(F.col("event_type").alias("file"), F.floor(F.col("event_id") / 8).alias("line"))
    return A.orphaned_lines(every, covered)


# Hits whose texts carry years and status marks by their ids.
EH = f"{HITS}, eh AS (SELECT query_id, rank, source, score, id, CASE id % 5 WHEN 0 THEN 'Rule of ' || (2020 + id % 4) || '. ' || text WHEN 1 THEN 'VIGENTE ' || text WHEN 2 THEN 'Deprecated: ' || text ELSE text END AS text FROM full_hits)"
YC = "yy AS (SELECT query_id, CAST(regexp_extract(text, '\\b(20\\d{2})\\b', 1) AS INT) AS year, string_agg(source, ',' ORDER BY rank, source) AS sources FROM eh WHERE regexp_matches(text, '\\b20\\d{2}\\b') GROUP BY 1, 2), yc AS (SELECT y.query_id, y.year AS stale_year, m.year AS current_year, y.sources AS stale_sources, m.sources AS current_sources FROM yy y JOIN yy m ON m.query_id = y.query_id AND m.year = (SELECT max(year) FROM yy z WHERE z.query_id = y.query_id) AND y.year < m.year)"
SC = "sc AS (SELECT query_id, string_agg(source, ',' ORDER BY rank, source) FILTER (contains(lower(text), 'vigente')) AS current_sources, string_agg(source, ',' ORDER BY rank, source) FILTER (contains(lower(text), 'obsoleto') OR contains(lower(text), 'deprecated')) AS stale_sources FROM eh GROUP BY query_id HAVING current_sources IS NOT NULL AND stale_sources IS NOT NULL)"
CF = "cf AS (SELECT query_id, 'year_discrepancy' AS type, 'Year ' || stale_year || ' against ' || current_year AS note FROM yc UNION ALL SELECT query_id, 'vigente_conflict', 'Current and obsolete sources' FROM sc)"
CONF = "ce AS (SELECT query_id, avg(score) FILTER (rank <= 10) AS mean, count(*) AS n FROM eh GROUP BY query_id), ck AS (SELECT query_id, count(*) AS k FROM cf GROUP BY query_id), co AS (SELECT query_id, round_even(greatest(0, CASE WHEN n IS NULL THEN 0 ELSE least(mean + least(n * 0.02, 0.15), 0.85) END - least(coalesce(k, 0) * 0.1, 0.3)), 3) AS confidence FROM q LEFT JOIN ce USING (query_id) LEFT JOIN ck USING (query_id))"


def marked(spark, d):
    i = F.col("id") % 5
    text = F.when(i == 0, F.concat(F.lit("Rule of "), 2020 + F.col("id") % 4, F.lit(". "), "text")).when(i == 1, F.concat(F.lit("VIGENTE "), "text")).when(i == 2, F.concat(F.lit("Deprecated: "), "text")).otherwise(F.col("text"))
    return full_hits(spark, d).withColumn("text", text)


def conflicts(spark, d):
    return E.find_conflicts(marked(spark, d)).select("query_id", "type")


@query("e01_year_conflicts", f"WITH {EH}, {YC} SELECT * FROM yc")
def e01(spark, d):
    c = E.year_conflicts(marked(spark, d))
    return c.withColumns({k: F.array_join(k, ",") for k in ("stale_sources", "current_sources")})


@query("e02_status_conflicts", f"WITH {EH}, {SC} SELECT * FROM sc")
def e02(spark, d):
    c = E.status_conflicts(marked(spark, d))
    return c.withColumns({k: F.array_join(k, ",") for k in ("stale_sources", "current_sources")})


@query("e03_resolve_conflicts", f"WITH {EH}, {YC}, {SC}, {CF}, al AS (SELECT query_id, type FROM cf UNION ALL SELECT query_id, 'other' FROM q UNION ALL SELECT -1, 'other'), b AS (SELECT query_id, source FROM eh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source DESC) = 1) SELECT query_id, type, CASE type WHEN 'year_discrepancy' THEN 'rule_recency' WHEN 'vigente_conflict' THEN 'rule_vigente' ELSE CASE WHEN source IS NULL THEN 'unresolved' ELSE 'rule_score' END END AS resolution, CASE WHEN type = 'other' THEN source END AS chosen FROM al LEFT JOIN b USING (query_id)")
def e03(spark, d):
    h = marked(spark, d)
    other = asked(spark, d).select("query_id").unionByName(table(spark, d, "region").where("r_regionkey = 0").select(F.lit(-1).cast("long").alias("query_id"))).withColumn("type", F.lit("other"))
    return E.resolve_conflicts(conflicts(spark, d).unionByName(other), h)


@query("e04_confidence_heuristic", f"WITH {EH}, {YC}, {SC}, {CF}, {CONF} SELECT * FROM co")
def e04(spark, d):
    return E.confidence_heuristic(asked(spark, d), marked(spark, d), conflicts(spark, d))


@query("e05_confidence_semantic", f"WITH {EH} SELECT query_id, round(sum(score / rank) / sum(1.0::DOUBLE / rank), 6) AS confidence FROM full_hits WHERE rank <= 5 GROUP BY query_id")
def e05(spark, d):
    return E.confidence_semantic(full_hits(spark, d))


@query("e06_pair_consistency", f"WITH {EH}, pc AS (SELECT query_id, 'h' || query_id AS hypothesis, rank, source, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN -1 ELSE 0 END AS l FROM hits JOIN documents ON doc_id = id WHERE rank <= 8), b AS (SELECT query_id, hypothesis, count(*) FILTER (l = 1) AS s, count(*) FILTER (l = -1) AS c, list(source ORDER BY rank) FILTER (l = -1) AS a FROM pc GROUP BY ALL) SELECT query_id, hypothesis, round((s - c) / greatest(1, s + c), 6) AS consistency, CASE WHEN s < c THEN array_to_string(a[1:3], ',') END AS contradicting FROM b")
def e06(spark, d):
    m = F.col("id") % 3
    s = full_hits(spark, d).select("query_id", F.concat(F.lit("h"), "query_id").alias("hypothesis"), F.col("rank").alias("fact_rank"), F.col("source").alias("fact"), F.when(m == 0, 0.8).otherwise(0.1).alias("support"), F.when(m == 2, 0.8).otherwise(0.1).alias("neutral"), F.when(m == 1, 0.8).otherwise(0.05).alias("contradict"))
    return E.pair_consistency(s).withColumn("contradicting", F.array_join("contradicting", ","))


@query("e07_low_similarity", f"WITH {EH} SELECT query_id, 'q' AS hypothesis, round(avg(list_cosine_similarity(e, embedding::DOUBLE[])), 6) AS similarity, round(avg(list_cosine_similarity(e, embedding::DOUBLE[])), 6) < 0.3 AS low FROM full_hits JOIN q USING (query_id) JOIN embeddings ON vec_id = id GROUP BY query_id")
def e07(spark, d):
    h = asked(spark, d).select("query_id", F.lit("q").alias("hypothesis"), F.col("v").alias("h"))
    f = full_hits(spark, d).join(vectors(spark, d).select("id", "v"), "id").select("query_id", F.col("v").alias("f"))
    return E.low_similarity(h, f)


@query("e08_escalate", f"WITH {EH}, {YC}, {SC}, {CF}, {CONF} SELECT query_id, confidence, confidence < 0.6 OR coalesce(k, 0) > 2 AS escalate, printf('confidence=%.3f conflicts=%d unresolved=0', confidence, coalesce(k, 0)) AS summary FROM co LEFT JOIN ck USING (query_id)")
def e08(spark, d):
    h, c = marked(spark, d), conflicts(spark, d)
    return E.escalate(E.confidence_heuristic(asked(spark, d), h, c), E.resolve_conflicts(c, h))


ANSWER = "'CONFIRMED FACTS:' || chr(10) || string_agg('- [' || source || '] ' || substr(text, 1, 250), chr(10) ORDER BY rank)"


@query("e09_structured_answer", f"WITH {EH}, a AS (SELECT query_id, {ANSWER} AS a, array_to_string((list(substr(text, 1, 120) ORDER BY rank))[1:3], '|') AS key_points FROM eh WHERE rank <= 8 GROUP BY query_id) SELECT query_id, sha256(a || chr(10) || chr(10) || 'HYPOTHESES:' || chr(10) || '1. one' || chr(10) || '2. two') AS answer_sha256, key_points FROM a")
def e09(spark, d):
    h = asked(spark, d).select("query_id", F.posexplode(F.array(F.lit("one"), F.lit("two"))).alias("place", "hypothesis")).withColumn("place", F.col("place") + 1)
    return E.structured_answer(marked(spark, d), hypotheses=h).select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("key_points", "|").alias("key_points"))


@query("e10_fallback_facts", f"WITH {EH} SELECT query_id, rank, substr(text, 1, 200) AS fact FROM eh WHERE rank <= 5")
def e10(spark, d):
    return E.fallback_facts(marked(spark, d))


@query("e10_fallback_hypothesis", f"WITH {EH} SELECT query_id, substr(arg_min(text, rank), 1, 300) AS hypothesis FROM eh GROUP BY query_id")
def e10b(spark, d):
    return E.fallback_hypothesis(marked(spark, d))


@query("evidence_report", f"WITH {EH}, {YC}, {SC}, {CF}, {CONF}, a AS (SELECT query_id, {ANSWER} AS a FROM eh WHERE rank <= 8 GROUP BY query_id), n AS (SELECT query_id, string_agg('- ' || note, chr(10) ORDER BY note) AS n FROM (SELECT * FROM cf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY note) <= 3) GROUP BY query_id) SELECT query_id, confidence, confidence < 0.6 OR coalesce(k, 0) > 2 AS escalate, sha256(a || coalesce(chr(10) || chr(10) || 'CONFLICTS:' || chr(10) || n, '')) AS answer_sha256 FROM co LEFT JOIN ck USING (query_id) LEFT JOIN a USING (query_id) LEFT JOIN n USING (query_id)")
def report(spark, d):
    r = E.evidence_report(asked(spark, d), marked(spark, d))
    return r.select("query_id", "confidence", "escalate", F.sha2("answer", 256).alias("answer_sha256"))


_found = "string_agg('[' || n || '] ' || source || ' (score=' || printf('%.2f', score) || ')' || chr(10) || trim(text, ' '), chr(10) ORDER BY n)"
_merged = f"""WITH {EH}, {YC}, {SC}, {CF}, f AS (SELECT query_id, '### HECHOS RECUPERADOS' || chr(10) || {_found} AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM eh) GROUP BY query_id),
mm AS (SELECT query_id, '### MEMORIA DE SESIÓN' || chr(10) || {_found} AS t FROM (SELECT conv_id * 50 AS query_id, role AS source, 0.5 AS score, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY query_id),
x AS (SELECT q.query_id, '### RESULTADO MATEMÁTICO' || chr(10) || 'Resultado: ' || (2.0 * query_id / 100)::DOUBLE AS t FROM q WHERE query_id % 100 = 0),
k AS (SELECT query_id, '### ANÁLISIS DE CÓDIGO' || chr(10) || 'Lenguaje: Python' || chr(10) || 'Problemas: bug; error' AS t FROM q WHERE query_id % 100 = 50),
c AS (SELECT query_id, '### CONFLICTOS DE VERSIÓN' || chr(10) || string_agg('- ' || note, chr(10) ORDER BY note) AS t FROM cf GROUP BY query_id), h AS (SELECT query_id, '### HIPÓTESIS' || chr(10) || '1. one' || chr(10) || '2. two' AS t FROM q)
SELECT query_id, sha256(concat_ws(chr(10) || repeat('─', 60) || chr(10), f.t, mm.t, x.t, k.t, c.t, h.t)) AS summary_sha256 FROM q LEFT JOIN f USING (query_id) LEFT JOIN mm USING (query_id) LEFT JOIN x USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN h USING (query_id)"""


@query("e11_merge_evidence", _merged)
def e11(spark, d):
    """All evidence of each query: hits, the conversation of its number, a calculation, a code question, conflicts, hypotheses."""
    a, hits = asked(spark, d).select("query_id"), marked(spark, d)
    memory = table(spark, d, "conversations").select((F.col("conv_id") * 50).alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("source"), F.lit(0.5).alias("score"), "text")
    sums = a.where("query_id % 100 = 0").select("query_id", percent_of(F.concat(F.lit("2 % of "), F.col("query_id").cast("string")))["value"].alias("result"))
    code = a.where("query_id % 100 = 50").select("query_id", F.inline(F.array(code_question_profile(F.lit("bug and error in python"))))).select("query_id", "language", F.lit(None).cast("string").alias("result"), "issues")
    notes = E.find_conflicts(hits).select("query_id", "note")
    guesses = a.select("query_id", F.posexplode(F.array(F.lit("one"), F.lit("two"))).alias("place", "hypothesis")).withColumn("place", F.col("place") + 1)
    return E.merge_evidence(a, hits, memory, sums, code, notes, guesses).select("query_id", F.sha2("summary", 256).alias("summary_sha256"))
