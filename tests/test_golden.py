"""Small literal cases of single operators, and what must hold between operators."""

import time
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as X
from corpusloom.operators import evidence as E
from corpusloom.operators import graph as G
from corpusloom.operators import ingest as I
from corpusloom.operators import joins as J
from corpusloom.operators import metrics as A
from corpusloom.operators import retrieval as R
from corpusloom.operators import splitting as T
from corpusloom.plans import analytics_queries, retrieval_queries, streaming_queries
from corpusloom.sources import files as S


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'long'}" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, expected", [(0, 0), (-4, 0), (1, 1), (3, 2), (100, 90), (1000, 900)])
def test_effective_limit(spark, n, expected):
    assert one(spark, X.effective_limit(F.col("n")), n=n) == expected


def test_ten_tokens_with_limit_three_make_five_segments(spark):
    docs = spark.createDataFrame([(1, " ".join(f"tok{i}" for i in range(10)))], "doc_id long, text string")
    got = T.segment_by_tokens(docs, 3).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == ["tok0 tok1", "tok2 tok3", "tok4 tok5", "tok6 tok7", "tok8 tok9"]


def test_small_files_come_first(spark):
    rows = [("medium", 20), ("c_same", 10), ("large", 50), ("B_same", 10), ("small", 5)]
    got = I.order_small_first(spark.createDataFrame(rows, "path string, size long")).collect()
    assert [r.path for r in got] == ["small", "B_same", "c_same", "medium", "large"]


@pytest.mark.parametrize("path, pattern, expected", [("/a/b", "/a/b/", True), ("/a/b/c/d.txt", "/a/b/", True), ("/a/bc", "/a/b/", False), ("/x/data", "data/**", True), ("/x/data/f", "data/**", True), ("/x/y.txt", "*.txt", True), ("/x/y.txt.bak", "*.txt", False)])
def test_path_rules(spark, path, pattern, expected):
    assert one(spark, S.match_globs(F.col("p"), [pattern]), p=path) is expected


def test_uuid_of_a_key(spark):
    u = str(uuid.uuid4())
    assert one(spark, X.normalize_key(F.col("k")), k=u) == u
    for k in ("http://x/y", "", "é", "abc"):
        assert one(spark, X.normalize_key(F.col("k")), k=k) == str(uuid.uuid5(uuid.NAMESPACE_URL, k))


def test_personal_data(spark):
    text = "Write a@b.org or c@d.org, call 555-123-4567, server 10.0.0.1, Mr. Smith"
    df = X.mask_pii(spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "id long, text string"), "id")
    got = {r.id: r for r in df.collect()}
    assert got[1].masked == "Write <EMAIL_1> or <EMAIL_2>, call <PHONE_1>, server <IP_ADDRESS_1>, <PERSON_1>"
    assert [p.original for p in got[1].privacy] == ["a@b.org", "c@d.org", "555-123-4567", "10.0.0.1", "Mr. Smith"]
    assert got[2].masked == "nothing here" and not got[2].privacy
    alt = X.mask_pii(spark.createDataFrame([(1, "Ana Lopez, x@y.es")], "id long, text string"), "id", table=rules.SCRUB, running=True).first()
    assert alt.masked == "<PERSONA>_1, <EMAIL>_0"


def test_perception(spark):
    assert one(spark, X.needs_math(F.col("t")), t="calcula el 20%") and one(spark, X.needs_code(F.col("t")), t="why does def f(x): fail")
    assert one(spark, X.classify_intent5(F.col("t")), t="hola") == "SMALL_TALK"
    assert one(spark, X.classify_intent5(F.col("t")), t="what do my notes say about spark") == "PERSONAL_KB"
    assert one(spark, X.language_hint(F.col("t")), t="the die") == "de"
    assert one(spark, X.percent_of(F.col("t")), t="12,5% de 80")["value"] == 10.0


def test_splitters():
    text = "\n\n".join("para %d " % i + "word " * 60 for i in range(9))
    pieces = T.recursive_pieces(text, 200, 40)
    assert max(map(len, pieces)) <= 200 and all(f"para {i}" in " ".join(pieces) for i in range(9))
    assert T.recursive_pieces("abc", 10, 2) == ["abc"]
    cjk = T.cjk_pieces("一二三。四五六！七八九？", 8, 2)
    assert cjk == ["一二三。四五六！", "六！七八九？"]


def test_binary_and_encodings(spark):
    rows = [("a", b"plain"), ("b", b"\x00\x01"), ("c", "é".encode("latin-1") + b" x"), ("d", b"\x01\x02\x03abc"), ("e", b"")]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert {r.path: r.binary for r in S.sniff_binary(files).collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}
    assert {r.path for r in S.decode_with_fallbacks(files, ["utf-8", "latin-1"]).where("encoding = 'latin-1'").collect()} == {"c"}


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 2, "w"), (None, 3, "n")], "k string, seq int, v string")
    first = S.upsert_chunks(old, new, "k")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, S.upsert_chunks(first, new, "k").collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]


def test_fusion_is_symmetric_and_skips_missing_ids(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, None, 2), (1, "y", 3)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 3)], "query_id long, id string, rank int")
    score = lambda *l: {r.id: r.rrf for r in R.rrf(list(l)).collect()}
    assert score(a, b) == score(b, a) and abs(score(a)["y"] - 1 / 63) < 1e-9
    assert [r.id for r in R.rrf([a, b]).orderBy("rank").collect()] == ["x", "y"]


def test_compressed_hits(spark):
    cols = "query_id long, chunk_id string, text string, source string, score double"
    hits = spark.createDataFrame([(1, "a", "t", "s", 0.8), (1, "b", "t", "s", 0.2), (1, "c", "t", "s", 0.6), (1, "c", "t", "s", 0.9)], cols)
    assert [(r.chunk_id, r.score) for r in R.compress_hits(hits, 0.5).orderBy("rank").collect()] == [("c", 0.9), ("a", 0.8)]
    assert R.compress_hits(spark.createDataFrame([], cols)).count() == 0


def test_diversity(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0]}
    rows = [(7, i, n + 1, s, v.get(i)) for n, (i, s) in enumerate([(1, 0.9), (2, 0.89), (3, 0.5), (4, 0.4)])]
    hits = spark.createDataFrame(rows, "query_id long, id long, rank int, score double, v array<double>")
    assert [r.id for r in R.dedupe_near(hits).orderBy("rank").collect()] == [1, 3, 4]
    assert [r.id for r in R.mmr(hits.where("id < 4"), k=2).orderBy("rank").collect()] == [1, 3]


def test_lsh_recall(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.id) for r in R.knn(retrieval_queries.asked(spark, sf), retrieval_queries.vectors(spark, sf), 10).collect()}
    near = {(r.query_id, r.id) for r in retrieval_queries.r03(spark, sf).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_knn_blocks_agree(spark, sf):
    v = retrieval_queries.vectors(spark, sf)
    q = retrieval_queries.asked(spark, sf)
    assert sorted(map(tuple, R.knn(q, v, 5).collect())) == sorted(map(tuple, R.knn(q, v, 5).collect()))


def test_near_pairs_and_classes(spark):
    """A cluster of a third of all vectors, copies among them, and vectors at random: no link between different ones is lost."""
    g = np.random.default_rng(3)
    v = np.vstack([g.normal(size=(200, 16)), np.repeat(np.ones((1, 16)), 100, 0) + g.normal(scale=0.08, size=(100, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([v, v[-10:]]))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    classes = {r.id: r.class_id for r in R.vector_classes(df).collect()}
    assert classes == {i: i if i < 300 else i - 10 for i in range(310)}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if round(float(unit[i] @ unit[j]), 6) >= 0.9}
    got = {(r.a, r.b) for r in R.near_dup_pairs(df, 0.9).collect()}
    assert got <= want and len(got) >= 0.999 * len(want) > 1000


def test_frequent_keys_are_dealt_to_several_tasks(spark):
    left = spark.range(3000).selectExpr("IF(id % 2 = 0, 'often', concat('k', id % 50)) AS k", "id AS a")
    right = spark.createDataFrame([("often", 1), ("often", 2), ("k1", 3), (None, 4)], "k string, b long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    joined = J.salted_join(left, right, "k", share=20, least=10)
    assert sorted(map(tuple, joined.select("k", "a", "b").collect())) == want
    table = left.groupBy("k").count()
    assert J.join_counted(left, table.withColumn("n", F.col("count")), "k", "n", share=4).count() == 3000


def test_joins_on_two_keys_and_on_null_keys(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 1, "c"), (2, 1, "d")], "x long, y long, v string")
    table = spark.createDataFrame([(1, 1, 2, "p"), (1, 2, 1, "q")], "x long, y long, n long, w string")
    for share in (2, 1000):
        got = J.join_counted(rows, table, ["x", "y"], "n", share=share, how="left").select("v", "w")
        assert sorted(map(tuple, got.collect())) == [("a", "p"), ("b", "q"), ("c", "p"), ("d", None)]
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (3, "d")], "x long, v string")
    table = spark.createDataFrame([(1, "p", [1]), (None, "never", [2])], "x long, w string, z array<int>")
    got = J.left_join_present(rows, table, "x").select("x", "v", "w", "z")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "x", "left").select("x", "v", "w", "z").collect()))


def test_best_chunks(spark):
    docs = spark.createDataFrame([(1, "s", "x" * 1000 + " the red fox " + "y" * 800 + " red fox"), (2, "t", "short text"), (3, "u", None), (4, "v", "fox red " * 300)], "id long, source string, text string")
    hits = spark.createDataFrame([(q, i, i, 0.5) for q in (7, 8) for i in (1, 2, 3, 4)], "query_id long, id long, rank int, score double")
    asked = spark.createDataFrame([(7, "The RED red fox  fox")], "query_id long, text string")
    got = {(r.query_id, r.id): r.text for r in R.best_chunks(hits, docs, asked).collect()}
    text = docs.where("id = 1").first().text
    assert got == {(7, 1): text[720:1620], (7, 2): "short text", (7, 4): ("fox red " * 300)[:900], (8, 1): text[:900], (8, 2): "short text", (8, 4): ("fox red " * 300)[:900]}


def test_edges_of_names_that_hold_keywords(spark):
    names = ["Alpha Beta", "beta", "ALPHABET", "x", "", "Ünï cöde", "be"]
    entities = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "key string, name string")
    edges = spark.createDataFrame([(f"e{i}", "PART_OF", "t") for i in range(len(names))], "src string, rel string, dst string")
    words = ["alpha", "BE", "b", "x", "", "nï c", "zzz", "alphabet soup"]
    keywords = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "query_id long, keyword string")
    got = {(r.query_id, r.src) for r in G.related_context(keywords, entities, edges).collect()}
    assert got == {(i, f"e{k}") for i, w in enumerate(words) for k, n in enumerate(names) if w and w.lower() in n.lower()}


def test_waves_and_their_cap(spark):
    items = spark.range(20).repartition(3)
    waves = {r.id: r.wave for r in T.group_waves(items, 6, "id").collect()}
    assert waves == {i: f"wave_{i // 6 + 1:03d}" for i in range(20)}
    assert sorted(r.id for r in T.group_waves(items, 6, "id", most=2).collect()) == list(range(12))


def test_window_splitter_and_keywords_by_brute_force(spark):
    texts = ["", "é" * 7, "abc", "".join(chr(97 + i % 26) for i in range(1000)), "日本" * 333, "a\nb\r\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((9, 3), (10, 0), (10, 8), (900, 180), (7, 6)):
        want = {(i, k, t[a : a + size]) for i, t in enumerate(texts) if t for k, a in enumerate(range(0, max(1, len(t) - size + (size - overlap)), size - overlap)) if k == 0 or a - (size - overlap) + size < len(t)}
        assert {tuple(r) for r in T.split_fixed(df, size, overlap).collect()} == want
    assert one(spark, X.query_keywords(F.col("t")), t="Árbol arbol ARBOL the Casa, casa! x1 ab") == ["Árbol", "the", "Casa"] or one(spark, X.query_keywords(F.col("t")), t="Árbol arbol ARBOL Casa, casa! x1 ab") == ["Árbol", "Casa"]


def test_long_texts_take_linear_time(spark):
    """Four times the text takes about four times as long, not sixteen."""
    def seconds(n, f):
        df = spark.createDataFrame([(1, "word wörd other text " * n)], "doc_id long, text string").cache()
        df.count()
        best = 1e9
        for _ in range(2):
            began = time.time()
            f(df).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    for f in (lambda d: T.segment_by_tokens(d, 100), lambda d: T.split_fixed(d, 900, 180), lambda d: d.select(X.query_keywords(F.col("text")))):
        assert seconds(80_000, f) < 10 * seconds(20_000, f) + 1


def test_percentiles_and_blocks(spark):
    m = spark.createDataFrame([("m", float(i), datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(1, 101)], "name string, value double, ts timestamp")
    r = A.summary(m, "histogram").first()
    assert (r.p50, r.p95, r.p99) == (50.5, 95.05, 99.01)
    lines = spark.createDataFrame([("f", x) for x in (1, 2, 3, 7, 8)], "file string, line long")
    assert sorted(map(tuple, A.consecutive_blocks(lines).select("start_line", "end_line").collect())) == [(1, 3), (7, 8)]


def test_circuit(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(seconds=i), False) for i in range(5)] + [("s", t + timedelta(seconds=70), True)]
    got = A.pressure_actions(spark.createDataFrame(rows, "source string, ts timestamp, ok boolean")).orderBy("ts").collect()
    assert [r.circuit for r in got] == ["closed"] * 4 + ["open", "closed"]


def test_streams_agree_with_batches(spark, sf):
    batch = sorted(map(tuple, analytics_queries.a15(spark, sf).collect()))
    assert sorted(map(tuple, streaming_queries.x06(spark, sf).collect())) == batch
    usage = streaming_queries.events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    closed = {(r.start, r.name): r.n for r in streaming_queries.x03(spark, sf).collect()}
    truth = {(r.w.start, r.event_type): r["count"] for r in usage.collect()}
    assert closed and all(truth[k] == n for k, n in closed.items())


def test_conflict_rules(spark):
    c = spark.createDataFrame([(1, "year_discrepancy"), (1, "vigente_conflict"), (1, "odd"), (2, "odd")], "query_id long, type string")
    hits = spark.createDataFrame([(1, 1, "s", "t", 0.4)], "query_id long, rank int, source string, text string, score double")
    got = {(r.query_id, r.type): r.resolution for r in E.resolve_conflicts(c, hits).collect()}
    assert got == {(1, "year_discrepancy"): "rule_recency", (1, "vigente_conflict"): "rule_vigente", (1, "odd"): "rule_score", (2, "odd"): "unresolved"}


def test_confidence(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, i, 0.9) for i in range(1, 13)], "query_id long, rank int, score double")
    none = spark.createDataFrame([], "query_id long")
    assert {r.query_id: r.confidence for r in E.confidence_heuristic(q, hits, none).collect()} == {1: 0.85, 2: 0.0}
    assert E.confidence_heuristic(q, hits, spark.createDataFrame([(1,)], "query_id long")).where("query_id = 1").first().confidence == 0.75


def test_semantic_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert np.isclose(R.token_jaccard(F.lit("a b"), F.lit("b c"))._jc is not None, True)
