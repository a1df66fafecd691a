"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as X
from corpusloom.functions.columns import let
from corpusloom.operators.joins import predicate_join
from corpusloom.plans.registry import query, table


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def case(rules_, col: str, default: str, value: int = 0) -> str:
    return "CASE " + " ".join(f"WHEN {has(col, r[1])} THEN {q(r[value])}" for r in rules_) + f" ELSE {q(default)} END"


def _project(name, source, keys, cols, sql):
    """Register a query that adds columns to a table's keys."""

    @query(name, sql)
    def run(spark, d):
        return table(spark, d, source).select(*keys, *(c.alias(k) for k, c in cols().items()))


MSG = ("conv_id", "turn")
DOC = ("doc_id",)


@query("p01_sanitize_text", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '[^\PC\n\t]', ' ', 'g'), '[^\PZ ]', ' ', 'g')) AS clean_sha256 FROM documents WHERE text IS NOT NULL")
def p01(spark, d):
    return X.sanitize(table(spark, d, "documents").where("text IS NOT NULL")).select("doc_id", F.sha2("text", 256).alias("clean_sha256"))


TOKENS = r"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(regexp_replace(text, '\s', '', 'g')) / 3) AS INT)) END"
_project("p02_estimate_tokens", "documents", DOC, lambda: {"tokens": X.estimate_tokens(F.col("text"))}, f"SELECT doc_id, CAST({TOKENS} AS INT) AS tokens FROM documents")
_project("p03_effective_limit", "part", ("p_partkey",), lambda: {"effective": X.effective_limit(F.col("p_size"))}, "SELECT p_partkey, CAST(CASE WHEN p_size <= 0 THEN 0 ELSE greatest(1, p_size - least(greatest(8, CAST(floor(p_size * 0.1) AS INT)), greatest(1, p_size // 3))) END AS INT) AS effective FROM part")
_project("p04_truncate_to_tokens", "documents", DOC, lambda: {"cut_sha256": F.sha2(X.truncate_to_tokens(F.col("text"), 100), 256)}, rf"""
WITH h AS (SELECT doc_id, text, {TOKENS} AS n, regexp_extract(text, '^(?:\s*\S){{0,285}}') AS head FROM documents),
b AS (SELECT *, strpos(reverse(head), ' ') AS back FROM h)
SELECT doc_id, sha256(CASE WHEN n <= 100 THEN text WHEN back > 0 AND back <= 100 THEN rtrim(substr(head, 1, length(head) - back), ' ') ELSE head END) AS cut_sha256 FROM b""")
_project("p05_content_hash", "documents", DOC, lambda: {"hash": X.content_hash(F.col("text"))}, "SELECT doc_id, sha256(text) AS hash FROM documents")
_project("p06_chunk_id", "documents", DOC, lambda: {"chunk_id": X.chunk_id(F.col("source"), F.col("doc_id"), F.sha2("text", 256)), "control_id": X.chunk_id(F.col("source"), F.col("doc_id"), F.sha2("text", 256), short=False)}, "SELECT doc_id, substr(sha256(source || ':' || doc_id || ':' || sha256(text)), 1, 32) AS chunk_id, sha256(source || ':' || doc_id || ':' || sha256(text)) AS control_id FROM documents")
_project("p07_normalize_key", "pages", ("page_id",), lambda: {"key": X.normalize_key(F.col("url"))}, "WITH s AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS s FROM pages) SELECT page_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS key FROM s")
_project("p08_coerce_datetime", "events", ("event_id",), lambda: {"iso": X.coerce_datetime(F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "dd/MM/yyyy")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+00'00'"))).otherwise(F.col("event_type")))}, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM events")


@query("p09_prune_metadata", "SELECT event_id, event_type AS source, user_id AS chunk_index, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'a,b' END AS users, event_id % 3 = 0 AS archived FROM events")
def p09(spark, d):
    acl = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"u'), F.col("user_id"), F.lit('"'))).otherwise('["a","b"]')
    raw = F.concat(F.lit('{"source":"'), "event_type", F.lit('","chunk_index":'), F.col("user_id").cast("string"), F.lit(',"file_size_bytes":-4,"owner_id":7,"secret":"x","allowed_user_ids":'), acl, F.lit(',"archived":'), (F.col("event_id") % 3 == 0).cast("string"), F.lit("}"))
    p = table(spark, d, "events").select("event_id", F.inline(F.array(X.prune_metadata(raw))))
    return p.where("owner_id IS NULL AND file_size_bytes IS NULL").select("event_id", "source", "chunk_index", F.array_join("allowed_user_ids", ",").alias("users"), "archived")


SCRIPT = case(rules.SCRIPTS, "text", "other")
_project("p10_detect_script", "conversations", MSG, lambda: {"script": X.detect_script(F.col("text"))}, f"SELECT conv_id, turn, {SCRIPT} AS script FROM conversations")
_hint = "CASE " + " ".join(f"WHEN {any_sql('lower(text)', w)} THEN {q(k)}" for k, w in rules.LANGUAGE_MARKERS) + rf" WHEN {SCRIPT} = 'cyrillic' THEN 'ru' WHEN {SCRIPT} = 'cjk' THEN CASE WHEN regexp_matches(text, '[\x{{3040}}-\x{{309f}}]') THEN 'ja' WHEN regexp_matches(text, '[\x{{ac00}}-\x{{d7af}}]') THEN 'ko' ELSE 'zh' END ELSE 'en' END"
_project("p11_language_hint", "documents", DOC, lambda: {"hint": X.language_hint(F.col("text"))}, f"SELECT doc_id, {_hint} AS hint FROM documents")


def _profile_sql(select: str) -> str:
    counts = ", ".join(f"n - length(regexp_replace(s, '[{v}]', '', 'g')) AS {k}" for k, v in rules.FAMILIES.items())
    names = list(rules.FAMILIES)
    top = "greatest(" + ", ".join([*names, "other"]) + ")"
    dominant = "CASE WHEN n = 0 THEN 'unknown' " + " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in names) + " ELSE 'other' END"
    return rf"""WITH s AS (SELECT doc_id, regexp_replace(substr(text, 1, 50000), '\s', '', 'g') AS s FROM documents), n AS (SELECT *, length(s) AS n FROM s),
c AS (SELECT doc_id, n, {counts} FROM n), o AS (SELECT *, n - {" - ".join(names)} AS other FROM c), p AS (SELECT *, {dominant} AS dominant, n > 0 AND (cjk + hangul) / n >= 0.05 AS has_cjk FROM o) SELECT {select} FROM p"""


@query("p12_script_profile", _profile_sql("doc_id, dominant, has_cjk, round(CASE WHEN n > 0 THEN latin / n ELSE 0 END, 6) AS latin"))
def p12(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.inline(F.array(X.script_profile(F.col("text")))))
    return p.select("doc_id", "dominant", "has_cjk", F.round("latin", 6).alias("latin"))


@query("p13_split_policy", _profile_sql("doc_id, CASE WHEN has_cjk OR dominant IN ('cjk', 'hangul') THEN 700 ELSE 1200 END AS size, CASE WHEN has_cjk OR dominant IN ('cjk', 'hangul') THEN 120 ELSE 150 END AS overlap"))
def p13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(F.array(let(X.script_profile(F.col("text")), X.split_policy)))).select("doc_id", "size", "overlap")


_stop = [w for w in dict.fromkeys(rules.KEYWORD_STOPWORDS) if not set(w) & set(rules.ACCENTS[0])]
_project("p14_query_keywords", "benchmark", ("item_id",), lambda: {"keywords": F.array_join(X.query_keywords(F.col("text")), " ")}, rf"""
WITH t AS (SELECT item_id, unnest(string_split_regex(regexp_replace(text, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+')) AS w, generate_subscripts(string_split_regex(regexp_replace(text, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+'), 1) AS i FROM benchmark),
f AS (SELECT *, translate(lower(w), '{rules.ACCENTS[0]}', '{rules.ACCENTS[1]}') AS k FROM t WHERE length(w) >= 3),
u AS (SELECT item_id, k, min(i) AS i, arg_min(w, i) AS w FROM f WHERE k NOT IN ({", ".join(map(q, _stop))}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u)
SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY n) FILTER (n <= 8), '') AS keywords FROM benchmark LEFT JOIN r USING (item_id) GROUP BY item_id""")
_project("p15_perception_keywords", "benchmark", ("item_id",), lambda: {"keywords": F.array_join(X.perception_keywords(F.col("text")), " ")}, rf"""
WITH a AS (SELECT item_id, regexp_extract_all(text, '[a-záéíóúüñA-Z]{{4,}}') AS x FROM benchmark),
t AS (SELECT item_id, lower(unnest(x)) AS w, generate_subscripts(x, 1) AS i FROM a),
u AS (SELECT item_id, w, min(i) AS i FROM t WHERE w NOT IN ({", ".join(map(q, sorted(set(rules.PERCEPTION_STOPWORDS))))}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u)
SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY n) FILTER (n <= 10), '') AS keywords FROM benchmark LEFT JOIN r USING (item_id) GROUP BY item_id""")
INTENT5 = "CASE " + " ".join(f"WHEN {any_sql('trim(lower(text))', w)}" + (f" AND length(text) <= {n}" if n else "") + f" THEN '{k}'" for k, n, w in rules.INTENTS5) + " ELSE 'GENERAL_KNOWLEDGE' END"
_project("p16_classify_intent5", "conversations", MSG, lambda: {"intent": X.classify_intent5(F.col("text"))}, f"SELECT conv_id, turn, {INTENT5} AS intent FROM conversations")
_project("p17_use_rag", "conversations", MSG, lambda: {"use_rag": X.use_rag(X.classify_intent5(F.col("text")))}, f"SELECT conv_id, turn, {INTENT5} IN ('PERSONAL_KB', 'GENERAL_KNOWLEDGE') AS use_rag FROM conversations")
INTENT7 = case(rules.INTENTS7, "text", "general")
# RE2 takes ASCII word ends only ("nodo" would end before an accented letter), so its patterns name what may stand around a word.
_letter = r"[^\p{L}\p{Nd}\p{Mn}_]"
_intents7 = [(name, pattern.replace(r"(?i)\b", rf"(?i)(?:^|{_letter})", 1).removesuffix(r"\b") + rf"(?:$|{_letter})") for name, pattern in rules.INTENTS7]
_project("p18_classify_intent7", "documents", DOC, lambda: {"intent": X.first_match(F.col("text"), rules.INTENTS7, "general")}, f"SELECT doc_id, {case(_intents7, 'text', 'general')} AS intent FROM documents")
_project("p19_classify_domain", "documents", DOC, lambda: {"domain": X.first_match(F.col("text"), rules.DOMAINS, "general")}, f"SELECT doc_id, {case(rules.DOMAINS, 'text', 'general')} AS domain FROM documents")
WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
COMPLEXITY = rf"CASE WHEN {WORDS} > 30 OR ({has('text', rules.COMPLEX)} AND {WORDS} > 15) OR length(text) - length(replace(text, '?', '')) > 1 THEN 'high' WHEN {WORDS} > 12 OR {has('text', rules.COMPLEX)} THEN 'medium' ELSE 'low' END"
_project("p20_estimate_complexity", "conversations", MSG, lambda: {"complexity": X.estimate_complexity(F.col("text"))}, f"SELECT conv_id, turn, {COMPLEXITY} AS complexity FROM conversations")
_project("p21_classify_tone", "documents", DOC, lambda: {"tone": X.first_match(F.col("text"), rules.TONES, "neutral")}, f"SELECT doc_id, {case(rules.TONES, 'text', 'neutral')} AS tone FROM documents")
NEEDS_MATH, NEEDS_CODE = (f"({has('text', a)} OR {has('text', b)})" for a, b in ((rules.MATH, rules.MATH_SYMBOLS), (rules.CODE, rules.CODE_BLOCK)))
_project("p22_needs_flags", "documents", DOC, lambda: {"math": X.needs_math(F.col("text")), "code": X.needs_code(F.col("text"))}, f"SELECT doc_id, {NEEDS_MATH} AS math, {NEEDS_CODE} AS code FROM documents")
# RE2 takes ASCII word ends only, so the last pattern names what may follow.
ENTITIES_SQL = "list_concat(list_concat(regexp_extract_all(text, {0}), regexp_extract_all(text, {1})), list_concat(regexp_extract_all(text, {2}), regexp_extract_all(text, {3}, 1)))".format(*map(q, (*rules.ENTITIES[:3], r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])")))
_project("p23_regex_entities", "documents", DOC, lambda: {"entities": F.array_join(X.regex_entities(F.col("text")), "|")}, f"WITH e AS (SELECT doc_id, {ENTITIES_SQL} AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM e), m AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, coalesce(string_agg(w, '|' ORDER BY i), '') AS entities FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id")


@query("p24_route_branches", f"""WITH p AS (SELECT conv_id, turn, lower(text) AS low, {COMPLEXITY} AS c, {NEEDS_MATH} AS m, {NEEDS_CODE} AS k, {INTENT7} AS i FROM conversations)
SELECT conv_id, turn, 'retrieval_vector,retrieval_graph' || CASE WHEN c <> 'low' THEN ',query_rewriter' ELSE '' END || CASE WHEN c = 'high' THEN ',subquestion_generator,retrieval_planner' ELSE '' END || CASE WHEN m THEN ',math_specialist' ELSE '' END || CASE WHEN k THEN ',code_specialist' ELSE '' END || CASE WHEN c <> 'low' THEN ',fact_extractor,hypothesis_generator' ELSE '' END || CASE WHEN turn % 5 = 0 THEN ',conflict_resolver' ELSE '' END || CASE WHEN i = 'memory' OR {any_sql("low", rules.MEMORY_WORDS)} THEN ',memory_retrieval' ELSE '' END || CASE WHEN {any_sql("low", rules.PRIVACY_WORDS)} THEN ',privacy_scrubber' ELSE '' END || ',evidence_ranker,integration_layer' AS branches FROM p""")
def p24(spark, d):
    t = F.col("text")
    b = X.route_branches(t, X.estimate_complexity(t), X.needs_math(t), X.needs_code(t), F.col("turn") % 5 == 0, X.first_match(t, rules.INTENTS7, "general"), F.lit(True))
    return table(spark, d, "conversations").select(*MSG, F.array_join(b, ",").alias("branches"))


_mode = "CASE " + " ".join(f"WHEN {any_sql('lower(text)', w)} THEN '{k}'" for k, w in rules.MODES) + " END"
@query("p25_resolve_answer_mode", f"SELECT conv_id, turn, coalesce({_mode}, CASE WHEN conv_id % 3 = 0 THEN 'concise' END, 'detailed') AS mode, {_mode} IS NOT NULL AND {any_sql('lower(text)', rules.MODE_PERSISTS)} AS persist FROM conversations")
def p25(spark, d):
    c = table(spark, d, "conversations")
    preferred = F.when(F.col("conv_id") % 3 == 0, "concise").when(F.col("conv_id") % 3 == 1, "unheard-of")
    return c.select(*MSG, X.resolve_answer_mode(F.col("text"), preferred).alias("m")).select(*MSG, "m.mode", "m.persist")


_project("p26_split_subquestions", "conversations", MSG, lambda: {"parts": F.array_join(X.split_subquestions(F.regexp_replace("text", r"\.\s", " versus ")), "|")}, rf"""
WITH s AS (SELECT conv_id, turn, regexp_replace(text, '\.\s', ' versus ', 'g') AS t FROM conversations), p AS (SELECT *, list_filter(list_transform(string_split_regex(t, {q(rules.CONNECTORS)}), lambda x: trim(x)), lambda x: length(x) > 10) AS p FROM s)
SELECT conv_id, turn, CASE WHEN len(p) <= 1 THEN t ELSE array_to_string(p[1:4], '|') END AS parts FROM p""")
_project("p27_code_question_profile", "documents", DOC, lambda: {"language": X.code_question_profile(F.col("text"))["language"], "task": X.code_question_profile(F.col("text"))["task"], "tool_hint": X.code_question_profile(F.col("text"))["tool_hint"], "n_issues": F.size(X.code_question_profile(F.col("text"))["issues"])}, f"SELECT doc_id, {case(rules.CODE_LANGUAGES, 'text', 'unknown')} AS language, {case(rules.CODE_TASKS, 'text', 'explain')} AS task, {case(rules.CODE_TASKS, 'text', 'search_file', 2)} AS tool_hint, CAST(least(5, len(list_distinct(regexp_extract_all(text, {q(rules.CODE_ISSUES)})))) AS INT) AS n_issues FROM documents")


@query("p28_percent_of", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round_even(p_size / 100 * p_retailprice, 4) END AS value, CAST(CASE WHEN p_partkey % 2 = 1 THEN 2 END AS INT) AS n_numbers FROM part")
def p28(spark, d):
    ask = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("What is "), F.col("p_size").cast("string"), F.lit("% of "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))).otherwise(F.concat(F.lit("between "), F.col("p_size").cast("string"), F.lit(" and "), F.col("p_retailprice").cast("string")))
    return table(spark, d, "part").select("p_partkey", X.percent_of(ask).alias("x")).select("p_partkey", "x.value", F.when(F.col("x.numbers").isNotNull(), F.size("x.numbers")).alias("n_numbers"))


def _chain(rules_, make) -> str:
    out = "text"
    for name, pattern in rules_:
        out = f"regexp_replace({out}, {q(pattern)}, {q(make(name))}, 'g')"
    return out


_project("p29_strip_secrets", "documents", DOC, lambda: {"clean_sha256": F.sha2(X.strip_secrets(F.col("text")), 256)}, f"SELECT doc_id, sha256({_chain(rules.SECRETS, lambda n: f'[REDACTED_{n}]')}) AS clean_sha256 FROM documents")
_project("p30_mask_pii_plain", "documents", DOC, lambda: {"masked_sha256": F.sha2(X.mask_pii_plain(F.col("text")), 256)}, f"SELECT doc_id, sha256({_chain(rules.PII, lambda n: f'<{n}>')}) AS masked_sha256 FROM documents")


@query("p30_mask_pii")
def p30(spark, d):
    return X.mask_pii(table(spark, d, "documents"), "doc_id").select("doc_id", F.size("privacy").alias("n_masked"), F.sha2("masked", 256).alias("masked_sha256"))


def _report_sql() -> str:
    """Counts by the growth of a text whose matches are replaced by single marks."""
    steps, t = [], "text"
    counts = []
    for i, (name, p) in enumerate([*rules.SECRETS, *rules.PII]):
        counts.append((name, f"len(regexp_extract_all(t{i}, {q(p)}))"))
        make = f"[REDACTED_{name}]" if i < len(rules.SECRETS) else f"<{name}>"
        steps.append(f"s{i + 1} AS (SELECT *, regexp_replace(t{i}, {q(p)}, {q(make)}, 'g') AS t{i + 1} FROM s{i})")
    k = len(rules.SECRETS)
    total = " + ".join(c for _, c in counts)
    cols = ", ".join(f"{c} AS {n.lower()}" for n, c in counts[k:])
    return f"WITH s0 AS (SELECT doc_id, text AS t0 FROM documents), {', '.join(steps)} SELECT doc_id, {' + '.join(c for _, c in counts[:k])} AS secrets, {cols} FROM s{len(steps)} WHERE {total} > 0"


@query("p31_redaction_report", _report_sql())
def p31(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.inline(F.array(X.redaction_report(F.col("text")))))
    names = r.columns[1:]
    return r.where(" + ".join(names) + " > 0").select("doc_id", *(F.col(n).cast("long").alias(n) for n in names))


@query("p32_privacy_map")
def p32(spark, d):
    return X.privacy_map(X.mask_pii(table(spark, d, "documents"), "doc_id"), "doc_id")


@query("p33_scrub_alt")
def p33(spark, d):
    return X.mask_pii(table(spark, d, "documents"), "doc_id", table=rules.SCRUB, running=True).select("doc_id", F.size("privacy").alias("n_masked"), F.sha2("masked", 256).alias("masked_sha256"))


_kinds = "['.pdf', 'note', ' Chat ', 'video', '']"
@query("p34_contribution", f"WITH k AS (SELECT doc_id, {_kinds}[doc_id % 5 + 1] AS k FROM documents), n AS (SELECT doc_id, lower(trim(regexp_replace(k, '^\\s*\\.', ''))) AS k FROM k) SELECT doc_id, CASE k WHEN 'pdf' THEN 'citation' WHEN 'note' THEN 'original' WHEN 'chat' THEN 'ai_assisted' ELSE 'unknown' END AS type, k IN ('note', 'chat') AS shareable FROM n")
def p34(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (".pdf", "note", " Chat ", "video", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", X.contribution(kind).alias("c")).select("doc_id", "c.type", "c.shareable")


@query("p35_provenance", "SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END, 'page:' || page_id) AS source, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END, 'page:' || page_id) AS title FROM pages")
def p35(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url"))
    p = X.provenance(F.lit(None).cast("string"), url, F.lit(""), F.concat(F.lit("page:"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", "p.source", "p.title")


_project("p36_valid_names", "part", ("p_partkey",), lambda: {"label": X.valid_label(F.col("p_brand")), "relation": X.valid_relation(F.upper("p_type"))}, "SELECT p_partkey, regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]*$') AS label, regexp_matches(upper(p_type), '^[A-Z_][A-Z0-9_]*$') AS relation FROM part")


def dimension_check(vectors, col="embedding"):
    """The vectors whose length is not the collection's (its most frequent one, the smaller on ties)."""
    sized = vectors.withColumn("dim", F.size(col))
    usual = sized.groupBy("dim").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "dim")).alias("m")).select(F.col("m.dim").alias("expected"))
    return sized.join(F.broadcast(usual), F.col("dim") != F.col("expected"))


@query("p37_dimension_check", "SELECT vec_id, 32 AS dim, 64 AS expected FROM embeddings WHERE vec_id % 10 = 3")
def p37(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return dimension_check(e).select("vec_id", "dim", "expected")


_metric = "concat(['ingestion.', 'query.latency.', 'cache_size.', 'custom '][event_id % 4 + 1], event_type, CASE WHEN event_id % 5 = 0 THEN '.total' ELSE '' END)"
@query("p38_infer_metric_type", f"WITH n AS (SELECT event_id, {_metric} AS name FROM events) SELECT event_id, CASE " + " ".join(f"WHEN {any_sql('lower(name)', p)} THEN '{k}'" for k, p in rules.METRIC_PARTS) + " ELSE 'gauge' END AS type FROM n")
def p38(spark, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("ingestion.", "query.latency.", "cache_size.", "custom "))), (F.col("event_id") % 4 + 1).cast("int")), "event_type", F.when(F.col("event_id") % 5 == 0, ".total").otherwise(""))
    return table(spark, d, "events").select("event_id", X.infer_metric_type(name).alias("type"))


@query("p39_classify_failure", """WITH s AS (SELECT event_id, [200, 429, 504, 503, NULL, NULL, NULL][event_id % 7 + 1] AS s, ['x', 'x', 'x', 'x', 'timeout', 'permission', 'disk_full'][event_id % 7 + 1] AS k FROM events)
SELECT event_id, CASE WHEN s = 429 THEN 'rate_limit' WHEN s = 504 THEN 'timeout' WHEN s = 503 THEN 'upstream_unavailable' WHEN k = 'timeout' THEN 'timeout' WHEN k = 'permission' THEN 'permission' WHEN k = 'disk_full' THEN 'disk_pressure' ELSE 'network' END AS kind, k NOT IN ('permission', 'disk_full') AS retryable, CASE WHEN s = 503 THEN 'high' WHEN k = 'disk_full' THEN 'critical' ELSE 'medium' END AS severity FROM s""")
def p39(spark, d):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 7 + 1).cast("int"))
    f = X.classify_failure(pick(200, 429, 504, 503, None, None, None), pick("x", "x", "x", "x", "timeout", "permission", "disk_full"))
    return table(spark, d, "events").select("event_id", f.alias("f")).select("event_id", "f.*")


def pipeline_tags(paths, rules_df):
    """``(path, tags)`` by a rule table of (tag, pattern)."""
    return predicate_join(paths, rules_df, F.expr("path RLIKE pattern")).groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query("p40_pipeline_tags", "WITH r AS (SELECT * FROM (VALUES ('example', 'example'), ('secure', '^https:'), ('blog', '//blog\\.')) r(tag, pattern)), m AS (SELECT DISTINCT url AS path, tag FROM pages JOIN r ON regexp_matches(url, pattern)) SELECT path, string_agg(tag, ',' ORDER BY tag) AS tags FROM m GROUP BY path")
def p40(spark, d):
    r = spark.createDataFrame([("example", "example"), ("secure", "^https:"), ("blog", r"//blog\.")], "tag string, pattern string")
    return pipeline_tags(table(spark, d, "pages").select(F.col("url").alias("path")), r).select("path", F.array_join("tags", ",").alias("tags"))


_project("p41_composite_cache_key", "documents", DOC, lambda: {"plain": X.composite_cache_key(F.col("text")), "composite": X.composite_cache_key(F.col("text"), F.col("source"), F.col("doc_id"))}, "SELECT doc_id, sha256(text) AS plain, sha256(source || '::' || doc_id || '::' || text) AS composite FROM documents")
_project("p42_valid_id", "documents", DOC, lambda: {"good": X.valid_id(F.sha2("text", 256)), "bad": X.valid_id(F.md5("text"))}, "SELECT doc_id, true AS good, false AS bad FROM documents")
