"""Queries of the retrieval operators: every vector whose id is divisible by 50 asks all vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.plans.registry import query, table

HITS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id),
hits AS (SELECT query_id, id, score, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM p QUALIFY rank <= 20),
full_hits AS (SELECT h.*, source, text FROM hits h JOIN documents ON doc_id = id)"""


def sql(select: str) -> str:
    return f"WITH {HITS}{select}" if select.startswith(",") else f"WITH {HITS} {select}"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(spark, d):
    return vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


def hits(spark, d, k=20):
    return R.knn(asked(spark, d), vectors(spark, d), k)


def full_hits(spark, d):
    """Hits with source, text and label."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return hits(spark, d).join(docs, "id").join(vectors(spark, d).select("id", "label"), "id")


BM25 = r"""asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark),
w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS w FROM tf JOIN df USING (term), tot),
s AS (SELECT query_id, id, round(sum(w), 6) AS score FROM asked JOIN wt USING (term) GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10)"""


def keyword_hits(spark, d, k=10):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(q, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), k)


@query("r01_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM embeddings")
def r01(spark, d):
    v = vectors(spark, d)
    one = v.where("id = 0").select(F.col("v").alias("w"))
    return v.join(F.broadcast(one)).select(F.col("id").alias("vec_id"), F.round(R.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("r02_knn", sql("SELECT query_id, id, score, rank FROM hits WHERE rank <= 10"))
def r02(spark, d):
    return hits(spark, d, 10)


@query("r03_knn_lsh")
def r03(spark, d):
    return R.knn_lsh(asked(spark, d), vectors(spark, d), 10)


@query("r04_bm25", f"WITH {BM25} SELECT * FROM kw")
def r04(spark, d):
    return keyword_hits(spark, d)


@query("r05_hybrid", f"""WITH {HITS}, {BM25}, a AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS v FROM hits WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id * 50 AS query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS k FROM kw WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(0.7 * coalesce(v, 0) + (1 - 0.7) * coalesce(k, 0), 6) AS score FROM a FULL JOIN b USING (query_id, id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def r05(spark, d):
    return R.hybrid(hits(spark, d), keyword_hits(spark, d).withColumn("query_id", F.col("query_id") * 50), 10)


@query("r06_score_of", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN quality::DOUBLE END, CASE WHEN doc_id % 3 = 1 THEN 1 - toxic END, 0) AS score FROM labels")
def r06(spark, d):
    m = F.col("doc_id") % 3
    return table(spark, d, "labels").select("doc_id", R.score_of(F.when(m == 0, F.col("quality").cast("double")), F.when(m == 1, F.col("toxic").cast("double"))).alias("score"))


@query("r07_filter_meta", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def r07(spark, d):
    return R.filter_meta(table(spark, d, "documents"), {"lang": "en", "source": ["src1", "src2"], "text": None}).select("doc_id")


@query("r08_retrieve_by_source", sql("SELECT query_id, id, rank, score FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM p JOIN documents ON doc_id = id WHERE source = 'src3') WHERE rank <= 5"))
def r08(spark, d):
    mine = R.filter_meta(table(spark, d, "documents"), {"source": "src3"}).select(F.col("doc_id").alias("id"))
    return R.knn(asked(spark, d), vectors(spark, d).join(mine, "id", "left_semi"), 5)


ACL = "c AS (SELECT doc_id AS id, doc_id % 7 = 0 AS archived, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'private' END AS visibility, source AS owner_id, ['src' || doc_id % 5, 'src' || doc_id % 11] AS allowed FROM documents)"


def chunks(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), (i % 7 == 0).alias("archived"), F.when(i % 3 == 0, "public").otherwise("private").alias("visibility"), F.col("source").alias("owner_id"), F.array(F.concat(F.lit("src"), i % 5), F.concat(F.lit("src"), i % 11)).alias("allowed_user_ids"))


@query("r09_acl_filter", f"WITH {ACL} SELECT NULL AS user_id, id FROM c WHERE NOT archived AND visibility = 'public' UNION ALL SELECT DISTINCT u, id FROM (SELECT id, unnest(list_append(allowed, owner_id)) AS u FROM c WHERE NOT archived AND visibility <> 'public') WHERE u IN (SELECT source FROM documents)")
def r09(spark, d):
    users = table(spark, d, "documents").select(F.col("source").alias("user_id")).distinct()
    return R.acl_filter(chunks(spark, d), users).select("user_id", "id")


@query("r10_archive_fallback", sql(", a AS (SELECT query_id, id, score, label % 3 <> 0 OR query_id % 100 = 0 AS archived FROM hits), l AS (SELECT * FROM a WHERE NOT archived UNION ALL SELECT * FROM a WHERE archived AND query_id NOT IN (SELECT query_id FROM a WHERE NOT archived)) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM l QUALIFY rank <= 10"))
def r10(spark, d):
    h = hits(spark, d).join(vectors(spark, d).select("id", "label"), "id").withColumn("archived", (F.col("label") % 3 != 0) | (F.col("query_id") % 100 == 0))
    return R.with_archive_fallback(h.drop("rank")).select("query_id", "id", "score", "rank")


TENANT = "CASE WHEN label % 2 = 0 THEN 'temp_' || label ELSE 'kb' || label END"


def tenanted(spark, d):
    tenant = F.when(F.col("label") % 2 == 0, F.concat(F.lit("temp_"), "label")).otherwise(F.concat(F.lit("kb"), "label"))
    return full_hits(spark, d).withColumn("tenant", tenant).select("query_id", "id", "score", "tenant")


@query("r11_topk_per_tenant", sql(f", t AS (SELECT query_id, id, score, {TENANT} AS tenant FROM full_hits) SELECT *, CAST(row_number() OVER (PARTITION BY query_id, tenant ORDER BY score DESC, id) AS INT) AS rank, starts_with(tenant, 'temp_') AS is_temporal FROM t QUALIFY rank <= 2"))
def r11(spark, d):
    return R.topk_per_tenant(tenanted(spark, d), 2)


@query("r12_merge_by_score", sql(f", t AS (SELECT query_id, id, score, CASE WHEN starts_with({TENANT}, 'temp_') THEN 'temporal' ELSE 'kb' END AS side FROM full_hits), m AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, id) AS INT) AS rank FROM t QUALIFY rank <= 8) SELECT *, count(*) FILTER (side = 'kb') OVER (PARTITION BY query_id) AS n_kb, count(*) FILTER (side = 'temporal') OVER (PARTITION BY query_id) AS n_temporal FROM m"))
def r12(spark, d):
    t = tenanted(spark, d)
    temporal = F.col("tenant").startswith("temp_")
    return R.merge_by_score(t.where(~temporal).drop("tenant"), t.where(temporal).drop("tenant"), 8)


RRF = f"""WITH {HITS}, {BM25}, l AS (SELECT query_id, id, rank, 0 AS list FROM hits UNION ALL SELECT query_id * 50, id, rank, 1 FROM kw),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(list * 1000 + rank) AS at_ FROM l GROUP BY ALL)"""


def fused(spark, d):
    return R.rrf([hits(spark, d), keyword_hits(spark, d).withColumn("query_id", F.col("query_id") * 50)])


@query("r13_rrf", RRF + " SELECT query_id, id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, at_) AS INT) AS rank FROM f")
def r13(spark, d):
    return fused(spark, d)


@query("r14_combine_kb_memory", sql(""", l AS (SELECT query_id, CASE WHEN rank % 4 = 0 THEN 'kb_' || (rank - 1) ELSE id::VARCHAR END AS id, rank, 0 AS list, 'kb' AS source_type FROM hits UNION ALL SELECT query_id, CASE WHEN rank % 5 = 0 THEN 'mem_' || (rank - 1) ELSE id::VARCHAR END, rank, 1, 'mem' FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS rank FROM hits)),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(list * 1000 + rank) AS at_, arg_min(source_type, list * 1000 + rank) AS source_type FROM l GROUP BY ALL)
SELECT query_id, id, rrf, source_type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, at_) AS INT) AS rank FROM f QUALIFY rank <= 10"""))
def r14(spark, d):
    h = hits(spark, d)
    memory = R.top(h.drop("rank"), 20, F.col("id"))
    gap = lambda df, n: df.withColumn("id", F.when(F.col("rank") % n != 0, F.col("id")))
    return R.combine_kb_memory(gap(h, 4), gap(memory, 5), 10)


def with_vectors(spark, d):
    return full_hits(spark, d).join(vectors(spark, d).select("id", "v"), "id").withColumn("pair_score", F.round(R.token_jaccard(F.col("text"), F.lit("the of and to in")), 6))


WORDS5 = "['the', 'of', 'and', 'to', 'in']"
#: Hits with vectors in the order of their ranks.
WITH_V = f"""{HITS}, d AS (SELECT h.query_id, h.id, h.rank, h.score, embedding::DOUBLE[] AS v, text, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS n FROM full_hits h JOIN embeddings ON vec_id = id)"""


def dedupe_sql(source: str) -> str:
    """The hits of ``source`` one by one, each kept if no kept one is too like it, as ``kd``."""
    return f"""rd AS (SELECT query_id, n, id, score, rank, true AS keep, [v] AS kept FROM {source} WHERE n = 1 UNION ALL SELECT query_id, n, id, score, rank, k, CASE WHEN k THEN list_append(kept, v) ELSE kept END
FROM (SELECT x.*, kept, list_max(list_transform(kept, lambda y: list_cosine_similarity(y, x.v))) < 0.85 AS k FROM rd JOIN {source} x ON x.query_id = rd.query_id AND x.n = rd.n + 1)), kd AS (SELECT query_id, id, rank, score FROM rd WHERE keep)"""


def mmr_sql(source: str, k: int) -> str:
    """``k`` steps, each taking the hit of ``source`` with the greatest gain, as ``mm``."""
    gain = "CASE WHEN step = 0 THEN score ELSE 0.5 * score - 0.5 * greatest(0, list_max(list_transform(vs, lambda y: list_cosine_similarity(y, v)))) END"
    return f"""rm AS (SELECT DISTINCT query_id, 0 AS step, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs FROM {source} UNION ALL SELECT g.query_id, step + 1, list_append(ids, m.id), list_append(vs, x.v)
FROM (SELECT query_id, step, ids, vs, max({{'g': g, 'n': -n, 'id': id}}) AS m FROM (SELECT rm.*, x.id, x.n, {gain} AS g FROM rm JOIN {source} x ON x.query_id = rm.query_id WHERE step < {k} AND NOT list_contains(ids, x.id)) GROUP BY ALL) g JOIN {source} x ON x.query_id = g.query_id AND x.id = m.id),
mm AS (SELECT a.query_id, ids[step] AS id, CAST(step AS INT) AS rank FROM rm a WHERE step > 0)"""


@query("r15_dedupe_near", f"WITH RECURSIVE {WITH_V}, {dedupe_sql('d')} SELECT * FROM kd")
def r15(spark, d):
    return R.dedupe_near(with_vectors(spark, d))


@query("r15b_near_dup_pairs", "WITH c AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS e FROM embeddings GROUP BY embedding) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM c a JOIN c b ON a.id < b.id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.95")
def r15b(spark, d):
    return R.near_dup_pairs(vectors(spark, d), 0.95)


@query("r15b_vector_classes", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings")
def r15c(spark, d):
    return R.vector_classes(vectors(spark, d))


@query("r16_mmr", f"WITH RECURSIVE {WITH_V}, {mmr_sql('d', 8)} SELECT mm.query_id, mm.id, mm.rank, score FROM mm JOIN d USING (query_id, id)")
def r16(spark, d):
    return R.mmr(with_vectors(spark, d))


@query("r17_bound_candidates", sql("SELECT query_id, id, score, rank FROM hits WHERE rank <= 7"))
def r17(spark, d):
    return R.bound_candidates(hits(spark, d), 7)


INTENT = "CASE query_id % 200 WHEN 0 THEN 'SMALL_TALK' WHEN 50 THEN 'GENERAL_KNOWLEDGE' END"


def intent():
    return F.when(F.col("query_id") % 200 == 0, "SMALL_TALK").when(F.col("query_id") % 200 == 50, "GENERAL_KNOWLEDGE")


@query("r18_rerank_gate", sql(f"SELECT query_id, id, coalesce({INTENT} = 'SMALL_TALK', false) OR count(*) OVER (PARTITION BY query_id) < 2 AS gated FROM hits"))
def r18(spark, d):
    return R.rerank_gate(hits(spark, d).withColumn("intent", intent())).select("query_id", "id", "gated")


@query("r19_combine_pair_scores", sql(r""", w AS (SELECT query_id, id, score, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM full_hits), j AS (SELECT *, round(len(list_intersect(w, ['the', 'of', 'and', 'to', 'in'])) / len(list_distinct(list_concat(w, ['the', 'of', 'and', 'to', 'in']))), 6) AS pair FROM w), c AS (SELECT query_id, id, round(0.7 * pair::DECIMAL(20,12) + 0.3 * score::DECIMAL(20,12), 6)::DOUBLE AS combined FROM j)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS INT) AS rank FROM c"""))
def r19(spark, d):
    return R.combine_pair_scores(with_vectors(spark, d)).select("query_id", "id", "combined", "rank")


_pair = rf"""pp AS (SELECT query_id, id, score, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM d), pc AS (SELECT query_id, id, round(0.7 * round(len(list_intersect(w, {WORDS5})) / len(list_distinct(list_concat(w, {WORDS5}))), 6)::DECIMAL(20,12) + 0.3 * score::DECIMAL(20,12), 6)::DOUBLE AS combined FROM pp)"""
_single = "s AS (SELECT d.query_id, d.id, d.score, d.v, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.id) AS n FROM d JOIN kd USING (query_id, id))"
@query("r20_rerank", f"WITH RECURSIVE {WITH_V}, {dedupe_sql('d')}, {_single}, {mmr_sql('s', 16)}, {_pair} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS INT) AS rank, combined AS score FROM pc SEMI JOIN mm USING (query_id, id) QUALIFY rank <= 8")
def r20(spark, d):
    return R.rerank(with_vectors(spark, d), "mmr_then_pair")


@query("r21_retrieval_stats", sql("SELECT query_id, count(score) AS n, round_even(avg(score), 3) AS avg_score, coalesce(round_even(avg(score), 3) < 0.5, false) AS low_relevance FROM q LEFT JOIN (SELECT * FROM hits WHERE label % 4 = 0) h USING (query_id) GROUP BY query_id"))
def r21(spark, d):
    some = hits(spark, d).join(vectors(spark, d).where("label % 4 = 0").select("id"), "id")
    return R.retrieval_stats(asked(spark, d), some).select("query_id", "n", "avg_score", "low_relevance")


@query("r22_fallback_decision", sql(f""", s AS (SELECT query_id, count(score) AS n, max(score) AS m, coalesce(round_even(avg(score), 3) < 0.5, false) AS low FROM q LEFT JOIN (SELECT * FROM hits WHERE label % 4 = 0) h USING (query_id) GROUP BY query_id),
t AS (SELECT *, {INTENT} AS intent, query_id % 150 = 0 AS error, query_id % 3 AS n_web FROM s), w AS (SELECT *, coalesce(intent = 'GENERAL_KNOWLEDGE', false) AS g, n = 0 OR error OR (low AND coalesce(intent = 'GENERAL_KNOWLEDGE', false)) AS web_search FROM t)
SELECT query_id, web_search, CASE WHEN n = 0 AND NOT (web_search AND n_web > 0) THEN CASE WHEN g THEN 'llm_only' ELSE 'no_docs_found' END WHEN m < 0.05 THEN CASE WHEN g THEN 'llm_only_low_relevance' ELSE 'no_relevant_docs' END ELSE 'answer' END AS outcome FROM w"""))
def r22(spark, d):
    some = hits(spark, d).join(vectors(spark, d).where("label % 4 = 0").select("id"), "id")
    s = R.retrieval_stats(asked(spark, d), some).withColumns({"intent": F.coalesce(intent(), F.lit("")), "error": F.col("query_id") % 150 == 0, "n_web": F.col("query_id") % 3})
    return R.fallback_decision(s).select("query_id", "web_search", "outcome")


@query("r23_fuse_local_web", sql(", w AS (SELECT page_id % 10 * 50 AS query_id, page_id AS id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS rank FROM pages), u AS (SELECT query_id, id, 0 AS side, rank FROM hits UNION ALL SELECT query_id, id, 1, rank FROM w) SELECT query_id, id, side = 1 AS is_web, CAST(row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS INT) AS rank FROM u"))
def r23(spark, d):
    """All pages as results of web searches, dealt to ten of the queries."""
    web = table(spark, d, "pages").select((F.col("page_id") % 10 * 50).alias("query_id"), F.col("page_id").alias("id"))
    web = web.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return R.fuse_local_web(hits(spark, d).select("query_id", "id", "rank"), web).select("query_id", "id", "is_web", "rank")


@query("r24_unique_sources", sql("SELECT query_id, source, arg_min(score, rank) AS score, min(rank) AS rank FROM full_hits GROUP BY ALL"))
def r24(spark, d):
    return R.unique_sources(full_hits(spark, d))


CONTEXT = "string_agg('[Document ' || rank || '] (Source: ' || source || ', Score: ' || printf('%.3f', score) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)"


@query("r25_build_context", sql(f"SELECT query_id, sha256({CONTEXT}) AS context_sha256 FROM full_hits WHERE rank <= 5 GROUP BY query_id"))
def r25(spark, d):
    return R.build_context(full_hits(spark, d).where("rank <= 5")).select("query_id", F.sha2("context", 256).alias("context_sha256"))


@query("r26_compress_hits", sql(", k AS (SELECT query_id, source, score, CASE WHEN label % 2 = 0 THEN source ELSE substr(text, 1, 80) END AS key FROM full_hits WHERE score >= 0.3), b AS (SELECT query_id, key, max(score) AS score FROM k GROUP BY ALL) SELECT query_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM b QUALIFY rank <= 5"))
def r26(spark, d):
    h = full_hits(spark, d).withColumn("chunk_id", F.when(F.col("label") % 2 == 0, F.col("source"))).select("query_id", "chunk_id", "text", "source", "score")
    return R.compress_hits(h, most=5).select("query_id", "score", "rank")


@query("r27_rank_evidence", sql("SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p DESC, id) AS INT) AS rank FROM (SELECT query_id, id, round(score / 2 + (label % 3) / 10.0::DOUBLE, 6) AS p FROM full_hits) WHERE p >= 0.3 QUALIFY rank <= 10"))
def r27(spark, d):
    f = full_hits(spark, d).drop("rank").withColumn("pair_score", F.round(F.col("score") / 2 + F.col("label") % 3 / 10.0, 6))
    return R.rank_evidence(f).select("query_id", "id", "rank")


@query("r28_multi_query_union", f"""WITH {BM25}, plan AS (SELECT i AS query_id, i + j AS item_id, j AS pos FROM (SELECT item_id AS i FROM benchmark), range(3) r(j)),
u AS (SELECT p.query_id, id, min(pos * 1000 + rank) AS at_, arg_min(score, pos * 1000 + rank) AS score FROM plan p JOIN kw ON kw.query_id = item_id GROUP BY ALL) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY at_, id) AS INT) AS rank FROM u""")
def r28(spark, d):
    b = table(spark, d, "benchmark")
    plan = b.select(F.col("item_id").alias("query_id"), F.array(*((F.col("item_id") + j).cast("string") for j in range(4))).alias("queries"))
    h = keyword_hits(spark, d).withColumn("text", F.col("query_id").cast("string")).drop("query_id")
    return R.multi_query_union(plan, h)


@query("r29_fallback_plan", "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'r' || item_id || '|s1|s2|s3' ELSE text END AS vector_queries, 'a|b|c|d|e' AS graph_focus, regexp_matches(lower(text), 'recuerdas|anteriormente|antes|previo') AS memory_query FROM benchmark")
def r29(spark, d):
    even = F.col("item_id") % 2 == 0
    letters = lambda *x: F.array(*map(F.lit, x))
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(even, F.concat(F.lit("r"), "item_id")).alias("rewritten"), F.when(even, letters("s1", "s2", "s3", "s4")).alias("subquestions"), letters(*"abcdefg").alias("entities"))
    p = R.fallback_plan(qs)
    return p.select("query_id", F.array_join("vector_queries", "|").alias("vector_queries"), F.array_join("graph_focus", "|").alias("graph_focus"), "memory_query")


CACHE = "SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0"


def _cache(spark, d):
    t = table(spark, d, "documents").where("doc_id % 3 = 0")
    return t.select(F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 5 == 0, "2024-01-31").otherwise("2024-02-01").cast("timestamp").alias("expires_at"))


@query("r30_to_embed", f"SELECT doc_id FROM documents WHERE sha256(text) NOT IN ({CACHE})")
def r30(spark, d):
    return R.to_embed(table(spark, d, "documents"), _cache(spark, d), "2024-01-31")[0].select("doc_id")


@query("r30_cache_stats", f"SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses, round(100.0 * count(*) FILTER (h) / count(*), 2) AS hit_rate FROM (SELECT sha256(text) IN ({CACHE}) AS h FROM documents)")
def r30b(spark, d):
    return R.to_embed(table(spark, d, "documents"), _cache(spark, d), "2024-01-31")[1]


@query("r31_tenant_stats", "SELECT source AS tenant, count(*) AS n, count(DISTINCT source) AS n_tenants FROM documents GROUP BY ROLLUP (source)")
def r31(spark, d):
    return R.tenant_stats(table(spark, d, "documents").withColumnRenamed("source", "tenant"))


@query("r32_batch_exists", "SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS found FROM documents")
def r32(spark, d):
    return R.batch_exists(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("r33_file_location", "SELECT source AS file_id, CASE WHEN min(doc_id) % 2 = 0 THEN source ELSE 'path/' || min(doc_id) END AS location FROM documents GROUP BY source")
def r33(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("file_id"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("path/"), "doc_id")).alias("file_path"), "source", F.col("doc_id").alias("chunk_index"))
    return R.file_location(c)


@query("r34_apply_grants", f"WITH {ACL} SELECT id, id % 10 = 4 AS changed, CASE WHEN id % 10 = 4 THEN 'shared' ELSE visibility END AS visibility, array_to_string(list_sort(list_distinct(CASE WHEN id % 10 = 4 THEN list_concat(allowed, ['zoe', 'amy']) ELSE allowed END)), ',') AS acl FROM c")
def r34(spark, d):
    c = chunks(spark, d).withColumns({"external_id": F.col("id").cast("string"), "hash": F.concat(F.lit("h"), "id")})
    key = F.when(F.col("doc_id") % 20 == 4, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("h"), "doc_id"))
    ch = table(spark, d, "documents").where("doc_id % 10 = 4").select(key.alias("key"), F.lit("shared").alias("new_visibility"), F.array(F.lit("zoe"), F.lit("amy")).alias("user_ids"))
    return R.apply_grants(c, ch).select("id", "changed", "visibility", F.array_join("allowed_user_ids", ",").alias("acl"))


@query("flagship_answer_context", RRF + f""", r AS (SELECT query_id, id, rrf AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, at_) AS INT) AS rank FROM f QUALIFY rank <= 5), c AS (SELECT r.*, source, i, substr(text, i * 720 + 1, 900) AS text FROM r JOIN (SELECT doc_id AS id, source, text, unnest(range(CAST(greatest(0, ceil((length(text) - 900) / 720)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) USING (id)),
a AS (SELECT query_id * 50 AS query_id, list(term) AS words FROM asked GROUP BY query_id), x AS (SELECT c.query_id, rank, score, source, text, coalesce(len(list_intersect(words, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''))), 0) AS n, i FROM c LEFT JOIN a USING (query_id) QUALIFY row_number() OVER (PARTITION BY c.query_id, c.id ORDER BY n DESC, i) = 1) SELECT query_id, {CONTEXT} AS context FROM x GROUP BY query_id""")
def flagship(spark, d):
    """Vector and keyword retrieval for all queries, fused, with the best chunk of each of the five best as context."""
    best = fused(spark, d).where("rank <= 5").withColumnRenamed("rrf", "score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    asked = table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text")
    return R.build_context(R.best_chunks(best, docs, asked))
