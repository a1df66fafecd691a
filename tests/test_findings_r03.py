"""Cases that the reviewer's odd inputs and larger tables brought up, each too rare for the small tables."""

import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as X
from corpusloom.functions.columns import fixed
from corpusloom.operators import cells
from corpusloom.operators import evidence as E
from corpusloom.operators import graph as G
from corpusloom.operators import memory as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import splitting as T
from corpusloom.operators import usage as U
from corpusloom.plans.queries import QUERIES, SQL
from corpusloom.sources import files as S
from corpusloom.streaming import streams


def test_a_message_without_a_quotable_sentence_gives_none(spark):
    rows = [
        (1, 0, "assistant", "This means it. It is. So. Yes. And no."),  # no sentence of over 30 characters
        (1, 1, "user", "See what lies in the folder a/. There is more of it"),  # a path that ends with its sentence
        (1, 2, "user", "The file is /tmp/x and there are 42 of them. Good"),
    ]
    got = M.key_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.place, r.quote) for r in got] == [(1, "user: The file is /tmp/x and there are 42 of them")]


@pytest.mark.parametrize("places", [1, 2, 3])
def test_numbers_are_printed_by_their_exact_value(spark, places):
    rng = random.Random(places)
    xs = [0.0, 0.5, 0.125, 0.375, 0.1235, 0.0625, 0.9995, 0.99951, -0.0004, -0.1235, 2.5, 1e9 + 0.5, 12.345, 1e15, 0.545, 0.285] + [rng.randrange(-(10**6), 10**6) / 10**rng.randrange(2, 7) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fixed(F.col("x"), places).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != f"{r.x:.{places}f}"] == []


def test_contexts_and_summaries_print_scores_by_their_exact_value(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.1235, "t")], "query_id long, rank int, source string, score double, text string")
    assert R.build_context(hits).first().context == "[Document 1] (Source: a, Score: 0.123)\nt"
    hits, q = hits.withColumn("score", F.lit(0.125)), spark.createDataFrame([(1,)], "query_id long")
    none = lambda columns: spark.createDataFrame([], f"query_id long, {columns}")
    got = E.merge_evidence(q, hits, hits.limit(0), none("result double"), none("language string, result string, issues array<string>"), none("note string"), none("place int, hypothesis string"))
    assert "[1] a (score=0.12)\nt" in got.first().summary


def test_intents_end_at_letters_of_any_script(spark):
    sql = SQL["p18_classify_intent7"]
    texts = ["el nodoñdo", "ñnodo", "un nodo, sí", "QUÉ DICE", "nodo", "(nodo)", "neo4j_x", "énodo", "ſuma", "version\nx", "", None]
    want = ["general", "general", "graph", "research", "graph", "graph", "general", "general", "math", "version", "general", "general"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", X.first_match(F.col("text"), rules.INTENTS7, "general").alias("x"))
    assert [r.x for r in got.orderBy("doc_id").collect()] == want
    duck = duckdb.connect()
    duck.register("documents", docs)
    assert sorted(duck.execute(sql).fetchall()) == list(enumerate(want))


def test_plans_ask_memory_where_the_text_does(spark, tmp_path):
    texts = ["Recuerdas el nodo?", "Lo que vimos ANTES", "nada"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, r.memory_query) for r in QUERIES["r29_fallback_plan"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert got == [(0, True), (1, True), (2, False)] == sorted((r[0], r[3]) for r in duck.execute(SQL["r29_fallback_plan"]).fetchall())


def test_csv_rows_past_fifty_thousand_of_a_file(spark, tmp_path):
    spark.range(50_020).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("t"), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["s07_read_csv_docs"](spark, str(tmp_path))
    assert (got.count(), got.where("doc_id = '50019'").count()) == (50_020, 1)


def test_shares_are_summed_exactly(spark):
    # In doubles these are 0.12344999999999999 or more, by their order.
    rng = random.Random(5)
    for _ in range(20):
        whole = rng.randrange(100, 900) * 1000 + 500
        parts = sorted(rng.sample(range(1, whole), 3))
        shares = [y - x for x, y in zip([0, *parts], [*parts, whole])]
        rows = [(1, str(i), x / 1e6, 20, 9) for i, at in enumerate([[0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]]) for x in (shares[k] for k in at)]
        got = U.promotable_files(spark.createDataFrame(rows, "thread_id long, file_id string, share double, n int, query_count int").coalesce(1)).collect()
        assert {r.reason for r in got} == {f"4 of 20 chunks carry {(whole // 100 + 5) // 10 / 10:.1f}% of the score in 9 uses"}


def test_files_without_a_hash_are_listed(spark):
    index = spark.createDataFrame([(None, "a"), (None, "b"), ("h", "c"), ("h", "c")], "hash string, path string")
    assert sorted(map(tuple, S.files_by_hash(index).collect()), key=str) == sorted([("h", "c", 1), (None, "a", 2), (None, "b", 2)], key=str)


def test_every_overlapping_pair_is_listed(spark, sf):
    """The pairs are as many as the summary counts."""
    pairs = QUERIES["a16_interval_overlaps"](spark, sf)
    assert {"a_id", "b_id"} <= set(pairs.columns)
    counted = QUERIES["a16_overlap_summary"](spark, sf).where("a = 'click' AND b = 'view'").first().overlap_pairs
    assert pairs.count() == pairs.select("a_id", "b_id").distinct().count() == counted > 0


def test_some_lines_are_orphaned(spark, sf):
    got = QUERIES["a18_orphaned_lines"](spark, sf).collect()
    assert got and all(0 < r.orphaned < r.executable for r in got)


def test_queries_of_many_cells_are_given_out_in_parts():
    rng = np.random.default_rng(1)
    centres, v = (cells.unit(rng.normal(size=(n, 8))) for n in (300, 500))
    batch = pa.record_batch([pa.array(range(500)), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(np.zeros(500), pa.int32()), pa.nulls(500, pa.float64())], names=["id", "v", "cell", "x"])
    got = list(cells._visits(iter([batch]), centres, np.full(300, 2.0), False))
    assert max(b.num_rows for b in got) <= cells.ROWS < sum(b.num_rows for b in got) == 500 * 299


def test_the_nearest_of_a_tile_are_in_order_with_ties_by_id():
    rng = np.random.default_rng(2)
    ids, m = np.arange(40) * 3, rng.integers(-1, 2, size=(40, 3)).astype(float)
    asks = pa.record_batch([pa.array([0, 3, 7]), pa.array(m[:3].tolist(), pa.list_(pa.float64())), pa.nulls(3, pa.float64())], names=["id", "v", "x"])
    for k in (1, 5, 39, 60):
        got = cells._nearest(ids, m, asks, k, False).to_pylist()
        names, s = cells.cosines(ids, m, asks)
        want = [(int(q), int(i), x) for q, row in zip(names, s) for x, i in sorted(((x, i) for x, i in zip(row, ids) if i != q), key=lambda y: (-y[0], y[1]))[:k]]
        assert [(r["query_id"], r["id"], r["score"]) for r in got] == want


def test_chunks_are_given_out_in_parts():
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a" * 3_000_000, None, "b c"])], names=["doc_id", "text"])
    got = list(T._with(lambda t: [t[i : i + 1000] for i in range(0, len(t), 1000)])(iter([batch])))
    rows = [r for b in got for r in b.to_pylist()]
    assert max(b.num_rows for b in got) <= 1049 and len(rows) == 3001 and rows[-1] == {"doc_id": 3, "chunk_index": 0, "chunk_text": "b c"}


def test_stream_state_is_kept_by_groups_of_keys(spark, tmp_path):
    path = str(tmp_path / "uses")
    spark.range(4000).select((F.col("id") % 2000).alias("thread_id"), F.when(F.col("id") % 3 > 0, "f").alias("file_id"), F.lit(1).alias("chunk_id"), F.lit(0.5).alias("score"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(path)
    uses = streams.stream_usage(streams.read_stream(spark, path, spark.read.parquet(path).schema), 2)
    q = uses.writeStream.format("memory").queryName("uses_by_group").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= streams.GROUPS
    # Rows 2000 apart share a thread, but not a file: 2000 leaves 2 over 3.
    rows = [(i % 2000, "f" if i % 3 else None) for i in range(4000)]
    assert spark.table("uses_by_group").count() == sum(rows.count(r) == 2 for r in set(rows))


def test_text_files_are_read_in_few_tasks(spark, tmp_path):
    """Plain and packed files, whatever their bytes, and many small ones in no more tasks than 16 for each core."""
    import gzip

    (tmp_path / "a b.txt").write_bytes(b"x\xff\r\n")
    (tmp_path / "p.txt.gz").write_bytes(gzip.compress("pä\n".encode()))
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = S.read_text_docs(spark, path).select("path", F.hex(F.col("text").cast("binary")).alias("x")).collect()
        assert {(r.path.rsplit("/", 1)[1], r.x) for r in got} == {("a%20b.txt", "78FF0D0A"), ("p.txt.gz", "70C3A40A")}
    texts = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("é\n"), "id")).alias("text"))
    S.write_text_docs(texts, f"file://{tmp_path}/many")
    docs = S.read_text_docs(spark, f"file://{tmp_path}/many", recursiveFileLookup="true")
    assert docs.count() == docs.select("path").distinct().count() == 20_000
    assert docs.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
    assert docs.select("text").exceptAll(texts.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))).isEmpty()


def test_related_context_is_the_first_rows_of_all(spark):
    """Many entities, edges and topics of a keyword, repeated and null ones, against all of them sorted."""
    rng = random.Random(3)
    names = [f"Ab{rng.randrange(10**6):06}" for _ in range(60)]
    entities = [(f"{n.lower()}|X", n) for n in names] + [("bare|X", "Abbare"), ("null|X", None), ("ab1|X", "Ab1")] * 2
    edges = [(f"{rng.choice(names).lower()}|X", rng.choice(["RELATED_TO", "PART_OF", "OTHER"]), rng.choice([None, *"abcdefgh"])) for _ in range(900)]
    edges += [("ab1|X", "RELATED_TO", f"d{i}") for i in range(50)] + [("ab1|X", "PART_OF", f"t{i}") for i in range(9)] + [(None, "PART_OF", "t")]
    words = [(1, "ab"), (1, "AB"), (1, "b1"), (2, ""), (2, None), (3, "ab1"), (4, "zz")] + [(5, n[2:6]) for n in names]
    got = G.related_context(
        spark.createDataFrame(words, "query_id long, keyword string"), spark.createDataFrame(entities, "key string, name string"), spark.createDataFrame(edges, "src string, rel string, dst string"), limit=12
    ).collect()
    order = lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = []
    for query in range(6):
        hit = {k for k, n in entities for i, w in words if i == query and w and n and w.lower() in n.lower()}
        rows = {(s, r, d, t) for s, r, d in edges if s in hit and r != "OTHER" for t in ({y for x, p, y in edges if x == s and p == "PART_OF"} or {None})}
        want += [(query, *r, i + 1) for i, r in enumerate(sorted(rows, key=order)[:12])]
    assert sorted((r.query_id, r.rank, r.src, r.rel, r.dst or "", r.topic or "") for r in got) == sorted((q, n, s, r, d or "", t or "") for q, s, r, d, t, n in want)


def test_ingestion_moves_texts_once(spark, tmp_path):
    """Versions by keys alone: random batches against a plain table, however many files a bucket has; texts meet one exchange."""
    rng, want = random.Random(1), {}
    target, log = str(tmp_path / "chunks"), str(tmp_path / "log")
    write = streams.stream_ingest(target, log, size=4, overlap=1, buckets=2)
    plans, plain = [], streams.replace_into
    for number in range(12):
        rows = [(rng.choice([None, *range(9)]), rng.choice([None, "", "aaaaaaaaaa", "abcdefgh"[: rng.randrange(9)] * rng.randrange(3)]), rng.randrange(-3, 4 * number + 4) * 50 + i) for i in range(5)]
        for d, t, s in rows:
            if d is not None and t is not None and s >= want.get(d, (-(10**9),))[0]:
                want[d] = (s, t)
        write(spark.createDataFrame(rows, "doc_id long, text string, seq long"), number)
        cut = {d: [t[i : i + 4] for i in range(0, max(1, len(t) - 1), 3)] if t else [] for d, (_, t) in want.items()}
        assert sorted((r.doc_id, r.chunk_index, r.chunk_text, r.seq) for r in streams.ingested(spark, target).collect()) == sorted((d, c.index(x), x, want[d][0]) for d, c in cut.items() for x in set(c))
    plain(str(tmp_path / "other"), spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, seq long"), "doc_id", "text", lambda docs: plans.append(docs) or docs.withColumn("n", F.lit(1)), 2)
    cut = plans[0].groupBy("bucket", "part", "doc_id", F.sha2("text", 256)).count()
    assert cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(bucket") == 1


def test_metadata_is_parsed_once_and_keeps_right_types_only(spark, sf):
    cases = [
        ('{"source":5,"meta":{"source":"x"},"chunk_total":1.0}', {}),
        ('{"source":"a\\"b\\u00e9\\n","chunk_index":-1,"allowed_user_ids":"u","archived":true}', {"source": 'a"bé\n', "allowed_user_ids": ["u"], "archived": True}),
        ('{"allowed_user_ids":"[x","chunk_index":9223372036854775807,"chunk_total":1e3}', {"allowed_user_ids": ["[x"], "chunk_index": 2**63 - 1}),
        ('{"allowed_user_ids":["a",1.0,null,{"x":1}],"archived":"true"}', {"allowed_user_ids": ["a", "1.0", None, '{"x":1}']}),
        ('{"allowed_user_ids":["a","é"],"content":"x \\"archived\\": true"}', {"allowed_user_ids": ["a", "é"], "content": 'x "archived": true'}),
        ('{"allowed_user_ids":5,"chunk_index":99999999999999999999,"hash":null}', {}),
        ('{"content":{"a":1,"a":2},"source":"s","file_size_bytes":0}', {"source": "s", "file_size_bytes": 0}),
        *((x, {}) for x in ("no object", '{"source":"x","chunk', "{}", "", None)),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, raw string")
    got = rows.select("i", F.inline(F.array(X.prune_metadata(F.col("raw"))))).orderBy("i").collect()
    assert [{k: v for k, v in r.asDict().items() if v is not None and k != "i"} for r in got] == [want for _, want in cases]
    plan = QUERIES["p09_prune_metadata"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json(StructField(content,"), plan.count("regexp_extract(")) == (1, 0), plan


def _batch(ids, v, cell, x):
    n = len(ids)
    return pa.record_batch([pa.array(ids), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(np.full(n, cell), pa.int32()), pa.array(np.broadcast_to(x, n), pa.float64())], names=["id", "v", "cell", "x"])


def test_memory_of_visits_and_borders_is_bounded_for_all_cells():
    rng = np.random.default_rng(3)
    centres, v = (cells.unit(rng.normal(size=(n, 16))) for n in (cells.CELLS, 300))
    batch, radius = _batch(range(300), v, 0, 0.9), np.full(cells.CELLS, 0.5)
    for step in (lambda: cells._visits(iter([batch]), centres, radius, True), lambda: cells._borders(iter([batch]), centres, radius, 0.5)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in step())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 60e6


def test_cells_of_almost_equal_pivots_are_visited():
    rng = np.random.default_rng(4)
    one = rng.normal(size=16)
    centres = cells.unit(np.array([one, one + 1e-9 * rng.normal(size=16)]))
    v = cells.unit(one + rng.normal(size=(400, 16)))
    of = cells.distances(v, centres).argmin(axis=1)
    asks, members = v[of == 0], v[of == 1]
    assert len(asks) and len(members)
    best = (asks @ members.T).max(axis=1)
    got = [x for b in cells._visits(iter([_batch(range(len(asks)), asks, 0, best)]), centres, np.full(2, 2.0), False) for x in b.column("id").to_pylist()]
    assert got == list(range(len(asks)))


def test_the_nearest_of_a_tile_above_what_was_found():
    rng = np.random.default_rng(5)
    ids, m = np.arange(60) * 3, rng.integers(-1, 2, size=(60, 3)) * rng.choice([1e-3, 1.0, 50.0], size=(60, 1))
    for x in (-1.0, 0.0, 0.5, 0.816497, 1.0):
        asks = _batch([0, 3, 6, 7], m[:4], 0, x)
        for k, same in ((1, False), (5, True), (60, False)):
            got = cells._nearest(ids, m, asks, k, same).to_pylist()
            names, s = cells.cosines(ids, m, asks)
            want = [(int(q), int(i), y) for q, row in zip(names, s) for y, i in sorted(((y, i) for y, i in zip(row, ids) if y >= x and (same or i != q)), key=lambda z: (-z[0], z[1]))[:k]]
            assert [(r["query_id"], r["id"], r["score"]) for r in got] == want


def test_keywords_are_scored_where_the_chunks_are(spark):
    rng = random.Random(26)
    texts = [" ".join(["the", "of"] + [f"W{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(2, 40))]) for _ in range(300)]
    # Copies, more than are asked for; no words; an id in rows of one length, of two lengths, and no id.
    rows = list(enumerate(texts + [texts[0]] * 30 + ["", " \n", None, "the"])) + [(5, texts[5]), (5, texts[5]), (6, "the of w1"), (None, texts[7]), (None, "the w2 zz")]
    asks = [(q, f"The of {' '.join(rng.sample(texts[q].split(), 2))} nowhere") for q in range(40)] + [(40, "the"), (41, "zzz"), (42, None), (0, "of w1 w1"), (None, "the w3")]
    chunks = spark.createDataFrame(rows, "id long, text string").repartition(5)
    asked = spark.createDataFrame(asks, "query_id long, text string")
    documents, benchmark = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]}), pd.DataFrame({"item_id": pd.array([q for q, _ in asks], "Int64"), "text": [t for _, t in asks]})
    # Ids that are null come first in Spark, and last in DuckDB.
    want = duckdb.sql(SQL["r04_bm25"].replace("score DESC, id)", "score DESC, id NULLS FIRST)")).fetchall()
    scored = R.bm25(asked, chunks, 10)
    assert sorted(map(str, scored.select("query_id", "id", "score", "rank").collect())) == sorted(f"Row(query_id={q}, id={i}, score={s}, rank={r})" for q, i, s, r in want)
    # Neither words nor scores of all chunks meet the queries in a join, and a task gives out its first ten of a query.
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    unlike = chunks.where("id <> 5 AND id <> 6")
    assert R.bm25(asked, unlike, 10).count() == R.bm25(asked, unlike, 10, held=0).count() == R.bm25(asked, unlike, 10, held=0, plain=0).count()
    in_place = R._scored_in_place(R.query_terms(asked), unlike, 10, 1.2, 0.75)
    assert in_place.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] == 10
    assert R.bm25(asked.limit(0), chunks, 10).count() == R.bm25(asked, chunks.limit(0), 10).count() == 0
    names = chunks.withColumn("id", F.concat(F.lit("d"), "id"))
    assert {(r.query_id, r.score, r["rank"]) for r in R.bm25(asked, names, 10).collect()} == {(q, s, r) for q, _, s, r in want}


@pytest.mark.parametrize("block, words", [(1, 1), (700, 90), (1 << 21, 1 << 19)])
def test_blocks_of_chunks_give_the_same_keywords(monkeypatch, block, words):
    rng = np.random.default_rng(26)
    texts = [None if i == 3 else [f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 30)) if x < 50] for i in range(400)]
    terms, k = pa.array([f"w{i}" for i in range(1, 30)]), 4
    asks = [sorted(rng.choice(29, 5, replace=False)) for _ in range(7)]
    start = np.cumsum([0] + [sum(t in a for a in asks) for t in range(29)])
    asking = np.array([q for t in range(29) for q, a in enumerate(asks) if t in a])
    idf = rng.random(29) + 0.1
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "WORDS", words)
    batch = pa.record_batch([pa.array(range(400)), pa.array(texts, pa.list_(pa.string()))], names=["id", "w"])
    counted = list(R._counted(iter([batch.slice(0, 150), batch.slice(150, 0), batch.slice(150)]), terms))
    assert sum(c.num_rows for c in counted) == 400
    got = [r for b in R._best(iter(counted), pa.array(range(7)), start, asking, idf, 12.0, k, 1.2, 0.75) for r in b.to_pylist()]
    want = []
    for q, a in enumerate(asks):
        scores = {}
        for i, w in enumerate(texts):
            for t in a:
                if n := (w or []).count(f"w{t + 1}"):
                    scores[i] = scores.get(i, 0.0) + idf[t] * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / 12.0)))
        want += [(q, i, round(s, 6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    assert [(r["query_id"], r["id"], round(r["score"], 6)) for r in got] == want
