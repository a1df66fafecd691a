"""Queries of the graph operators: documents' capitalised words as a gazetteer-free entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import graph as G
from corpusloom.plans.registry import query, table
from corpusloom.plans.text_queries import q
from corpusloom.sources.files import stored

# Entities by a gazetteer of nation names would be empty here, so a document's distinct capitalised words of five letters
# or more that end a line are its entities.
ENT = r"""w AS (SELECT doc_id AS chunk_id, source AS topic, unnest(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{3,})\.', 1))) AS name FROM documents),
e AS (SELECT chunk_id, topic, name, row_number() OVER (PARTITION BY chunk_id ORDER BY name) AS pos FROM w QUALIFY pos <= 8), k AS (SELECT *, lower(name) || '|CONCEPT' AS key FROM e),
m AS (SELECT DISTINCT chunk_id, key AS entity FROM k), r AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity GROUP BY ALL),
edges AS (SELECT src, 'RELATED_TO' AS rel, dst FROM r UNION ALL SELECT DISTINCT key, 'PART_OF', topic FROM k)"""


def sql(select: str) -> str:
    return f"WITH {ENT}{select}" if select.startswith(",") else f"WITH {ENT} {select}"


def entities(spark, d):
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,})\."), F.lit(1))))
    e = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("topic"), F.posexplode(F.slice(words, 1, 8)).alias("pos", "name"))
    return e.withColumns({"type": F.when(F.col("pos") % 2 == 0, "concept"), "seq": F.col("chunk_id") * 10 + F.col("pos")})


def edges(spark, d, found=None):
    e = entities(spark, d) if found is None else found
    return G.cooccurrence(G.mentions(e)).select("src", "rel", "dst").unionByName(G.entity_topic(e))


GAZETTEER = (("GNU General Public License", "LICENSE"), ("General Public License", "LICENSE"), ("Public License", "TERM"), ("Apache License", "LICENSE"), ("token", "SECRET"))


def _spans_sql() -> str:
    """Entities with their places, by rule: what a pattern leaves of a text says where its matches stand. The gazetteer is one
    pattern with the longest names first."""
    word = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])"
    names = "|".join(n.replace(" ", r"[^A-Za-z0-9_]+") for n, _ in sorted(GAZETTEER, key=lambda x: -len(x[0].split())))
    patterns = [*rules.ENTITIES[:3], word, rf"\b(?:{names})\b"]
    parts = [f"SELECT chunk_id, {k} AS rule, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s FROM (SELECT chunk_id, regexp_extract_all(text, {q(p)}) AS m, regexp_extract_all(text, {q(p)}, {1 if k == 3 else 0}) AS g, string_split_regex(text, {q(p)}) AS s FROM c)" for k, p in enumerate(patterns)]
    kinds = " ".join(f"WHEN {q(n)} THEN {q(t)}" for n, t in GAZETTEER)
    return f"""WITH c AS (SELECT doc_id AS chunk_id, source AS topic, text FROM documents), u AS ({" UNION ALL ".join(parts)}),
p AS (SELECT chunk_id, rule, i, g, CAST(sum(length(s)) OVER w + sum(length(m)) OVER w - length(m) + position(g IN m) - 1 AS BIGINT) AS start FROM u WINDOW w AS (PARTITION BY chunk_id, rule ORDER BY i)),
e AS (SELECT chunk_id, start, start + length(g) AS stop, CASE WHEN rule = 4 THEN regexp_replace(g, '[^A-Za-z0-9_]+', ' ', 'g') ELSE g END AS name, rule = 4 AS known FROM p),
k AS (SELECT chunk_id, start, stop, name, CASE name {kinds} END AS type FROM e WHERE known),
a AS (SELECT * FROM k UNION ALL SELECT chunk_id, start, stop, name, 'CONCEPT' FROM e WHERE NOT known AND NOT EXISTS (SELECT 1 FROM k WHERE k.chunk_id = e.chunk_id AND k.start < e.stop AND e.start < k.stop)),
f AS (SELECT chunk_id, name, min(start) AS start, arg_min(stop, start) AS stop, arg_min(type, start) AS type FROM a GROUP BY ALL)
SELECT chunk_id, topic, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY start, stop, name) - 1 AS INT) AS pos, name, type FROM f JOIN c USING (chunk_id) QUALIFY pos < 8"""


@query("g01_extract_entities", _spans_sql().replace("GROUP BY ALL", "GROUP BY chunk_id, name"))
def g01(spark, d):
    return G.extract_entities(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("topic"), "text"), gazetteer=spark.createDataFrame(list(GAZETTEER), "name string, type string"))


@query("g02_upsert_entities", sql("SELECT key, arg_max(name, chunk_id * 10 + pos) AS name, 'CONCEPT' AS type FROM k GROUP BY key"))
def g02(spark, d):
    return G.upsert_entities(entities(spark, d))


@query("g03_mentions", sql("SELECT * FROM m"))
def g03(spark, d):
    return G.mentions(entities(spark, d))


@query("g04_cooccurrence", sql("SELECT *, 'RELATED_TO' AS rel FROM r"))
def g04(spark, d):
    return G.cooccurrence(G.mentions(entities(spark, d)))


@query("g05_entity_topic", sql("SELECT DISTINCT key AS src, 'PART_OF' AS rel, topic AS dst FROM k"))
def g05(spark, d):
    return G.entity_topic(entities(spark, d))


KIND = "['pdf', 'note', 'chat'][doc_id % 3 + 1]"


def origin(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(i.alias("chunk_id"), F.when(i % 4 == 0, "").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("file_path"), F.element_at(F.array(*map(F.lit, ("pdf", "note", "chat"))), (i % 3 + 1).cast("int")).alias("doc_type"), F.col("lang").alias("author"), i.alias("seq"))
    return G.chunk_source(c.withColumn("chunk_id", F.col("chunk_id").cast("string")))


SOURCES = f"o AS (SELECT doc_id, doc_id::VARCHAR AS src, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE source END AS dst, {KIND} AS k, lang FROM documents), s AS (SELECT dst AS title, arg_max(k, doc_id) AS k, arg_max(lang, doc_id) AS author FROM o GROUP BY dst)"


@query("g06_chunk_source", f"WITH {SOURCES} SELECT title, CASE k WHEN 'pdf' THEN 'citation' WHEN 'note' THEN 'original' ELSE 'ai_assisted' END AS type, k <> 'pdf' AS shareable, author FROM s")
def g06(spark, d):
    return origin(spark, d)[1]


@query("g07_related_context", sql(", q AS (SELECT item_id AS query_id, unnest(string_split(lower(text), ' ')[1:3]) AS keyword FROM benchmark), h AS (SELECT DISTINCT query_id, key AS src FROM k JOIN q ON contains(lower(name), keyword)), x AS (SELECT DISTINCT h.query_id, e2.src, rel, dst, topic FROM h JOIN edges e2 USING (src) LEFT JOIN (SELECT src, dst AS topic FROM edges WHERE rel = 'PART_OF') t USING (src)) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY src, rel, dst, topic) AS INT) AS rank FROM x QUALIFY rank <= 40"))
def g07(spark, d):
    kw = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(F.split(F.lower("text"), " "), 1, 3)).alias("keyword"))
    e = stored(entities(spark, d), "entities")
    return G.related_context(kw, G.upsert_entities(e), edges(spark, d, e))


@query("g08_edge_search", sql(", h AS (SELECT * FROM edges WHERE contains(src, 'ther') OR contains(dst, 'ther')), b AS (SELECT src, rel, dst FROM h UNION ALL SELECT dst, rel, src FROM h) SELECT *, src || ' -[' || rel || ']-> ' || dst AS line FROM b"))
def g08(spark, d):
    return G.edge_search(edges(spark, d), "ther", include_reverse=True)


@query("g09_shareable_chunks", f"WITH {SOURCES} SELECT DISTINCT src AS chunk_id FROM o JOIN s ON title = dst WHERE s.k = 'note'")
def g09(spark, d):
    e, n = origin(spark, d)
    return G.shareable_chunks(e, n, ["original"])


@query("g10_graph_stats", sql("SELECT 'node' AS kind, CASE WHEN GROUPING(topic) = 0 THEN topic END AS label, count(*) AS n FROM k GROUP BY ROLLUP (topic) UNION ALL SELECT 'edge', CASE WHEN GROUPING(rel) = 0 THEN rel END, count(*) FROM edges GROUP BY ROLLUP (rel)"))
def g10(spark, d):
    return G.graph_stats(entities(spark, d).select(F.col("topic").alias("label")), edges(spark, d))


@query("g11_graph_context_lines", sql("SELECT dst AS query_id, string_agg(src || ' (Entity) --[PART_OF]--> ' || dst || ' (Topic)', chr(10) ORDER BY src || ' (Entity) --[PART_OF]--> ' || dst || ' (Topic)') AS context FROM edges WHERE rel = 'PART_OF' GROUP BY dst"))
def g11(spark, d):
    e = edges(spark, d).where("rel = 'PART_OF'").select(F.col("dst").alias("query_id"), "src", F.lit(None).cast("string").alias("src_type"), "rel", "dst", F.lit("Topic").alias("dst_type"), F.lit(None).cast("string").alias("topic"))
    return G.graph_context_lines(e)


@query("g12_graph_hits", sql("SELECT 'graph:' || src || ':' || rel || ':' || dst AS chunk_id, src || ' -[' || rel || ']-> ' || dst AS text, 'graph' AS source, 1.0::DOUBLE AS score FROM edges"))
def g12(spark, d):
    return G.graph_hits(edges(spark, d))


@query("g13_merge_triples", sql(", n AS (SELECT DISTINCT name FROM k WHERE chunk_id % 2 = 0) SELECT a.name AS src, 'NEXT' AS rel, b.name AS dst, max(a.chunk_id) AS last FROM k a JOIN k b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.name IN (FROM n) AND b.name IN (FROM n) GROUP BY ALL"))
def g13(spark, d):
    e = entities(spark, d)
    nxt = e.select("chunk_id", (F.col("pos") - 1).alias("pos"), F.col("name").alias("dst"))
    rel = e.select("chunk_id", "pos", F.col("name").alias("src")).join(nxt, ["chunk_id", "pos"]).select("src", F.lit("NEXT").alias("rel"), "dst", F.create_map(F.lit("chunk"), F.col("chunk_id")).alias("properties"), F.col("chunk_id").alias("seq"))
    _, r = G.merge_triples(e.where("chunk_id % 2 = 0").select(F.lit("Word").alias("label"), "name"), rel)
    return r.select("src", "rel", "dst", F.col("properties")["chunk"].alias("last"))


@query("g14_uniqueness_audit", sql("SELECT topic AS label, key, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1"))
def g14(spark, d):
    return G.uniqueness_audit(entities(spark, d).select(F.col("topic").alias("label"), G.entity_key(F.col("name"), F.col("type")).alias("key")))


@query("g15_backfill_stats", sql("SELECT count(*) AS processed, CAST(sum(coalesce(n, 0)) AS BIGINT) AS entities, count(*) FILTER (n IS NULL AND length(trim(text)) > 0) AS errors FROM documents LEFT JOIN (SELECT chunk_id, count(*) AS n FROM m GROUP BY chunk_id) ON chunk_id = doc_id"))
def g15(spark, d):
    return G.backfill_stats(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), G.mentions(entities(spark, d)))
