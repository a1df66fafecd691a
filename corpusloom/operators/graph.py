"""Graph operators on node and edge tables (G operators). Edges are ``(src, rel, dst)``; nodes have a ``key`` and a ``name``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.columns import let
from corpusloom.functions.text import contribution, provenance, regex_entities
from corpusloom.operators.joins import salted_join
from corpusloom.operators.retrieval import top
from corpusloom.sources.files import stored


#: Names of a gazetteer that go to all tasks as one trie; larger ones are joined.
NAMES = 200_000
WORD = re.compile(r"[A-Za-z0-9_]+")
SPANS = "array<struct<start:int,stop:int,name:string,type:string>>"


def name_trie(rows: Iterable[tuple[str, str]]) -> dict:
    """Words to the tries of what may follow them; under None the name and type that end there (the smallest of several)."""
    trie: dict = {}
    for name, kind in rows:
        at = trie
        for word in WORD.findall(name or ""):
            at = at.setdefault(word, {})
        if at is not trie:
            at[None] = min(at.get(None, (name, kind)), (name, kind), key=lambda x: (x[0], x[1] or ""))
    return trie


def known_spans(text: str | None, trie: dict) -> list[dict]:
    """The names of a text from the left, of several that begin at one word the longest; names do not overlap."""
    words, out, i = list(WORD.finditer(text or "")), [], 0
    while i < len(words):
        at, j, hit = trie.get(words[i][0]), i, None
        while at is not None:
            j += 1
            if None in at:
                hit = (j, at[None])
            at = at.get(words[j][0]) if j < len(words) else None
        if hit is None:
            i += 1
            continue
        j, (name, kind) = hit
        out.append({"start": words[i].start(), "stop": words[j - 1].end(), "name": name, "type": kind})
        i = j
    return out


def _pattern_spans(text: Column) -> Column:
    """P23's entities with where they stand, which follows from what the pattern leaves of the text."""

    def spans(pattern: str) -> Column:
        def placed(x: Column) -> Column:
            def at(m: Column, i: Column) -> Column:
                size = lambda part, n: F.aggregate(F.slice(part, F.lit(1), n), F.lit(0), lambda s, y: s + F.length(y))
                start = size(x["left"], i + 1) + size(x["found"], i)
                return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("name"), F.lit("CONCEPT").alias("type"))

            return F.transform(x["found"], at)

        return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("left")), placed)

    return F.concat(*(spans(p) for p in rules.ENTITIES))


def _chosen(known: Column, text: Column, most: int) -> Column:
    """The first ``most`` names: those of the gazetteer, and pattern entities that do not overlap them, by where they first stand."""

    def both(k: Column) -> Column:
        free = lambda p: ~F.exists(k, lambda x: (x["start"] < p["stop"]) & (p["start"] < x["stop"]))
        ordered = F.array_sort(F.transform(F.concat(k, F.filter(_pattern_spans(text), free)), lambda x: F.struct(x["start"], x["stop"], x["name"], x["type"])))
        names = lambda o: F.array_distinct(F.transform(o, lambda x: x["name"]))
        return let(ordered, lambda o: F.transform(F.slice(names(o), 1, most), lambda n: F.filter(o, lambda x: x["name"] == n)[0]))

    return let(F.coalesce(known, F.array().cast(SPANS)), both)


def extract_entities(chunks: DataFrame, most: int = 8, gazetteer: DataFrame | None = None, names: int = NAMES) -> DataFrame:
    """G1: ``(chunk_id, topic, pos, name, type)``: the first entities of each chunk, by pattern as CONCEPT, and by a gazetteer
    ``(name, type)`` of names of one or several words with their types.

    Names match whole words (letters, digits and ``_``), whatever stands between them, from the left, the longest first; they
    take the place of pattern entities that they overlap. Entities count by where they first stand. Up to ``names`` names go to the
    tasks as a trie; of more, those that occur in a chunk are found by joining its runs of as many words as names have."""
    if gazetteer is None:
        found = F.slice(regex_entities(F.col("text")), 1, most)
        return chunks.select("chunk_id", "topic", F.posexplode(found).alias("pos", "name")).withColumn("type", F.lit("CONCEPT"))
    if gazetteer.count() <= names:
        trie = name_trie(map(tuple, gazetteer.select("name", "type").collect()))
        match = F.pandas_udf(lambda texts: texts.map(lambda t: known_spans(t, trie)), SPANS)
        placed = chunks.select("chunk_id", "topic", "text", match("text").alias("known"))
    else:
        placed = _joined_spans(chunks, gazetteer)
    rows = placed.select("chunk_id", "topic", F.posexplode(_chosen(F.col("known"), F.col("text"), most)).alias("pos", "e"))
    return rows.select("chunk_id", "topic", "pos", "e.name", "e.type")


def _joined_spans(chunks: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``chunks`` with the spans of a gazetteer of any size: a chunk's distinct word runs meet the names, then a chunk with the names
    that occur in it (no more than it has word runs) is matched as usual."""
    words = lambda c: F.array_remove(F.split(c, "[^A-Za-z0-9_]+"), "")
    listed = gazetteer.select("name", "type", words(F.col("name")).alias("w")).where(F.size("w") > 0)
    lengths = [r[0] for r in listed.select(F.size("w")).distinct().collect()]  # a few lengths
    listed = listed.groupBy(F.array_join("w", " ").alias("run")).agg(F.min(F.struct("name", "type")).alias("entry"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*(runs(n) for n in lengths)))))
    met = chunks.select("chunk_id", words(F.col("text")).alias("w")).select("chunk_id", F.explode(every).alias("run")).join(listed, "run").groupBy("chunk_id").agg(F.collect_set("entry").alias("entries"))
    match = F.pandas_udf(lambda texts, rows: texts.combine(rows, lambda t, r: [] if r is None else known_spans(t, name_trie((x["name"], x["type"]) for x in r))), SPANS)
    both = chunks.join(met, "chunk_id", "left")
    return both.select("chunk_id", "topic", "text", match("text", "entries").alias("known"))


def entity_key(name: Column, kind: Column) -> Column:
    return F.concat_ws("|", F.lower(name), F.upper(F.coalesce(kind, F.lit("CONCEPT"))))


def upsert_entities(entities: DataFrame) -> DataFrame:
    """One row for each key; the last name (``seq``) wins."""
    return entities.groupBy(entity_key(F.col("name"), F.col("type")).alias("key")).agg(F.max_by("name", "seq").alias("name"), F.first(F.upper(F.coalesce("type", F.lit("CONCEPT")))).alias("type"))


def mentions(entities: DataFrame) -> DataFrame:
    """G3."""
    return entities.select("chunk_id", entity_key(F.col("name"), F.col("type")).alias("entity")).distinct()


def cooccurrence(mentioned: DataFrame) -> DataFrame:
    """Pairs of entities of one chunk in both directions, with the number of chunks. A chunk has a bounded number of
    entities (G1), so pairs are made within its row."""
    lists = mentioned.groupBy("chunk_id").agg(F.collect_set("entity").alias("e"))
    pairs = lists.select(F.explode("e").alias("src"), "e").select("src", F.explode("e").alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("rel", F.lit("RELATED_TO"))


def entity_topic(entities: DataFrame) -> DataFrame:
    """G5."""
    return entities.select(entity_key(F.col("name"), F.col("type")).alias("src"), F.lit("PART_OF").alias("rel"), F.col("topic").alias("dst")).distinct()


def chunk_source(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunk_id, source, file_path, doc_type, author, seq)`` to edges and source nodes, last values winning."""
    p = chunks.select("chunk_id", "author", "seq", provenance(F.lit(None).cast("string"), F.col("source"), F.col("file_path"), F.col("chunk_id")).alias("p"), contribution(F.col("doc_type")).alias("c"))
    edges = p.select(F.col("chunk_id").alias("src"), F.lit("ORIGINATED_FROM").alias("rel"), F.col("p.title").alias("dst")).distinct()
    nodes = p.groupBy(F.col("p.title").alias("title")).agg(F.max_by(F.struct("c.type", "c.shareable", "author"), "seq").alias("x")).select("title", "x.*")
    return edges, nodes


def related_context(keywords: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """``(query_id, keyword)``: edges from entities whose name holds a keyword, any case, with the entity's topic. A
    keyword and a name meet on a piece of up to three characters that both hold. An empty keyword finds nothing.

    Rows are ordered by entity first, and each entity with an edge gives one at least. So a keyword needs its first ``limit`` entities
    only, a query as many, and an entity its first ``limit`` edges with topics; no query meets all edges of all its entities."""
    low = keywords.select("query_id", F.lower("keyword").alias("k")).where("k <> ''").distinct()
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)))
    # A keyword asks with one of its pieces of three, the least by hash; one shorter than that with all of itself.
    piece = F.when(F.length("k") < 3, F.col("k")).otherwise(F.array_min(F.transform(pieces("k", 3), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))["x"])
    ask = stored(low.select("k").distinct().withColumn("piece", piece), "keywords")
    wanted = ask.select("piece").distinct()
    live = stored(edges.where("src IS NOT NULL AND rel IN ('RELATED_TO', 'PART_OF')").select("src", "rel", "dst").distinct(), "edges")
    names = entities.select(F.col("key").alias("src"), F.lower("name").alias("n")).where("n <> ''").join(live.select("src").distinct(), "src", "left_semi")
    held = names.withColumn("piece", F.explode(F.array_distinct(F.concat(*(pieces("n", n) for n in (1, 2, 3))))))
    held = stored(held.join(F.broadcast(wanted) if wanted.count() <= NAMES else wanted, "piece", "left_semi"), "names")
    met = salted_join(held, ask, "piece").where(F.contains("n", "k")).select("k", "src")
    met = met.withColumn("at", F.dense_rank().over(Window.partitionBy("k").orderBy("src"))).where(F.col("at") <= limit).select("k", "src").distinct()
    hit = stored(top(low.join(met, "k").select("query_id", "src").distinct(), limit, F.col("src")).drop("rank"), "hits")
    near = live.join(hit.select("src").distinct(), "src", "left_semi")
    first = lambda df, *by: top(df, limit, *map(F.col, by), keys=("src",)).drop("rank")
    topics = first(near.where("rel = 'PART_OF'").select("src", F.col("dst").alias("topic")), "topic")
    about = first(first(near, "rel", "dst").join(topics, "src", "left"), "rel", "dst", "topic")
    out = hit.join(about, "src").select("query_id", "src", "rel", "dst", "topic")
    return top(out, limit, F.col("src"), F.col("rel"), F.col("dst"), F.col("topic"))


def edge_search(edges: DataFrame, keyword: str, include_reverse: bool = False) -> DataFrame:
    """Edges of which an end holds the keyword, case by case; both orientations where asked for."""
    hit = edges.where(F.contains("src", F.lit(keyword)) | F.contains("dst", F.lit(keyword))).select("src", "rel", "dst")
    both = hit.unionByName(hit.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))) if include_reverse else hit
    return both.withColumn("line", F.format_string("%s -[%s]-> %s", "src", "rel", "dst"))


def shareable_chunks(origin: DataFrame, sources: DataFrame, types: list[str] | None = None) -> DataFrame:
    """G9."""
    ok = sources.where("shareable")
    ok = ok.where(F.col("type").isin(types)) if types else ok
    return origin.join(ok, origin["dst"] == ok["title"], "left_semi").select(F.col("src").alias("chunk_id")).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each label and type, and of all (``label`` null)."""
    n = nodes.rollup("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return n.unionByName(edges.rollup("rel").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("rel").alias("label"), "n"))


def graph_context_lines(edges: DataFrame) -> DataFrame:
    """``(query_id, src, src_type, rel, dst, dst_type, topic)`` to one text for each query."""
    topic = F.when(F.col("topic").isNotNull(), F.concat(F.lit("  [topic: "), "topic", F.lit("]"))).otherwise("")
    line = F.concat(F.format_string("%s (%s) --[%s]--> %s (%s)", "src", F.coalesce("src_type", F.lit("Entity")), "rel", "dst", F.coalesce("dst_type", F.lit("Entity"))), topic)
    return edges.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("context"))


def graph_hits(edges: DataFrame) -> DataFrame:
    """G12."""
    return edges.select(F.concat_ws(":", F.lit("graph"), "src", "rel", "dst").alias("chunk_id"), F.format_string("%s -[%s]-> %s", "src", "rel", "dst").alias("text"), F.lit("graph").alias("source"), F.lit(1.0).alias("score"))


def merge_triples(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by (label, name), and relations between nodes that exist, the last properties (``seq``) winning."""
    nodes = entities.select("label", "name").distinct()
    names = nodes.select("name").distinct()
    known = relations.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return nodes, known.groupBy("src", "rel", "dst").agg(F.max_by("properties", "seq").alias("properties"))


def uniqueness_audit(nodes: DataFrame) -> DataFrame:
    """Keys that a label has more than once."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def backfill_stats(chunks: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Chunks seen, entities written, and chunks with text but without an entity."""
    per = mentioned.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return chunks.join(per, "chunk_id", "left").agg(F.count("*").alias("processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.count_if(F.col("n").isNull() & (F.length(F.trim("text")) > 0)).alias("errors"))
