"""Operators in the forms that hold for large tables, against plain versions on small ones: ranks instead of pairs, selection instead
of buffers, buckets instead of whole tables, bounds instead of all postings."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, ingest, memory, metrics
from corpusloom.operators import retrieval as R
from corpusloom.sources import files
from corpusloom.streaming import streams as X


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_percentiles_by_selection(spark):
    rng = random.Random(1)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(4000)] + [("ties", float(rng.randrange(5))) for _ in range(3000)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame([(n, v, i) for i, (n, v) in enumerate(rows)], "name string, value double, ts long").repartition(4)
    assert collected(metrics.summary(df, "histogram", buffered=50)) == collected(metrics.summary(df, "histogram"))
    got = {r.name: r for r in metrics.percentiles(df, metrics.QUANTILES, 50).collect()}
    values = [v for n, v in rows if n == "hot"]
    assert np.allclose([got["hot"][q] for q, _ in metrics.QUANTILES], np.quantile(values, [p for _, p in metrics.QUANTILES]))


def intervals(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = float(rng.randrange(400)) + rng.choice([0.0, 0.25, 0.5])
        out.append((i, rng.choice("abc"), start, start + rng.choice([0.0, 0.25, 1.0, 7.5, 60.0]), rng.random() < 0.7))
    return [*out, (n, "a", 0.0, 31_536_000.0, True), (n + 1, "b", 5.0, 2.0, True), (n + 2, "b", None, 3.0, None), (n + 3, None, 1.0, 2.0, True)]


def overlap(x, y):
    return None not in (x[2], x[3], y[2], y[3]) and max(x[2], y[2]) < min(x[3], y[3])


def test_overlap_counts_without_pairs(spark):
    rows = intervals(4)
    df = spark.createDataFrame(rows, "id long, op string, start double, end double, ok boolean").repartition(3)
    pairs = [("a", "b"), ("b", "c"), ("c", "missing")]
    of = lambda op: [r for r in rows if r[1] == op]
    want = [(a, b, len(of(a)), len(of(b)), sum(overlap(x, y) for x in of(a) for y in of(b)), sum(bool(r[4]) for r in of(a)), sum(bool(r[4]) for r in of(b))) for a, b in pairs]
    assert collected(metrics.overlap_summary(df, pairs)) == sorted(want, key=str)


@pytest.mark.parametrize("tick", [1.0, 0.1, 1000.0])
def test_overlapping_pairs_by_dyadic_covers(spark, tick):
    rows = intervals(5, 120)
    df = spark.createDataFrame(rows, "id long, op string, start double, end double, ok boolean")
    got = collected(metrics.interval_overlaps(df.where("op = 'a'"), df.where("op = 'b'"), tick).select("a_id", "b_id"))
    assert got == sorted(((x[0], y[0]) for x in rows for y in rows if x[1] == "a" and y[1] == "b" and overlap(x, y)), key=str)


def test_csv_rows_are_numbered_by_split(spark, tmp_path):
    for name, n in (("one.csv", 900), ("two.csv", 3), ("empty.csv", 0)):
        (tmp_path / name).write_text("a,b\n" + "".join(f"{name}{i},{'x' * (i % 50)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.read_csv_docs(spark, str(tmp_path), most=500).withColumn("a", F.get_json_object("text", "$.a"))
        assert df.rdd.getNumPartitions() > 4
        got = sorted((r.path.split("/")[-1], r.row, r.a) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((name, i + 1, f"{name}{i}") for name, n in (("one.csv", 500), ("two.csv", 3)) for i in range(n))


def stamps(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_rewrites_its_buckets_only(spark, tmp_path):
    path = tmp_path / "table"
    df = lambda rows: spark.createDataFrame(rows, "k string, seq long, v string")
    files.upsert_into(str(path), df([(f"k{i}", 0, "old") for i in range(40)] + [(None, 0, "skipped")]), "k", buckets=8)
    before = stamps(path)
    batch = df([("k3", 1, "a"), ("k3", 2, "b"), ("new", 0, "c")])
    touched = files.upsert_into(str(path), batch, "k", buckets=8)
    after = stamps(path)
    assert 1 <= len(touched) <= 2
    kept = {p for p in before if not any(f"bucket={b}/" in p for b in touched)}
    assert kept and all(after.get(p) == before[p] for p in kept)
    want = sorted([(f"k{i}", 0, "old") for i in range(40) if i != 3] + [("k3", 2, "b"), ("new", 0, "c")])
    assert sorted(map(tuple, spark.read.parquet(str(path)).select("k", "seq", "v").collect())) == want
    files.upsert_into(str(path), batch, "k", buckets=8)
    assert sorted(map(tuple, spark.read.parquet(str(path)).select("k", "seq", "v").collect())) == want
    assert files.upsert_into(str(path), batch.limit(0), "k", buckets=8) == []
    files.upsert_into(str(path), df([("k3", 0, "late"), ("k99", 5, "x"), ("k99", 4, "first")]), "k", ingest.insert_or_ignore, buckets=8)
    rows = {r.k: r.v for r in spark.read.parquet(str(path)).collect()}
    assert rows["k3"] == "b" and rows["k99"] == "first"


def test_ingestion_replaces_and_ignores_replays(spark, tmp_path):
    target, log = str(tmp_path / "chunks"), str(tmp_path / "log")
    write = X.stream_ingest(target, log, size=10, overlap=2, buckets=4)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, seq long")
    chunks = lambda: sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in X.ingested(spark, target).collect())
    write(docs([(1, "abcdefghijklmnopqrstuvwxyz", 0), (2, "short", 0), (3, "x" * 30, 0), (None, "lost", 0), (4, None, 0)]), 0)
    assert chunks() == [(1, 0, "abcdefghij"), (1, 1, "ijklmnopqr"), (1, 2, "qrstuvwxyz"), (2, 0, "short"), (3, 0, "x" * 10), (3, 3, "x" * 6)]
    write(docs([(1, "changed", 1), (1, "older", 0), (2, "late", -1)]), 1)
    now = chunks()
    assert [c for c in now if c[0] < 3] == [(1, 0, "changed"), (2, 0, "short")]
    before = stamps(tmp_path / "chunks")
    write(docs([(1, "never seen", 9)]), 1)  # a replay of a batch that is logged
    assert chunks() == now and stamps(tmp_path / "chunks") == before
    write(docs([(1, "", 2)]), 2)
    write(docs([(1, "changed", 1)]), 3)
    assert [c for c in chunks() if c[0] < 3] == [(2, 0, "short")]


def test_usage_events_come_once(spark, tmp_path):
    def stream(parts):
        path = str(tmp_path / f"uses{len(parts)}")
        for rows in parts:
            spark.createDataFrame(rows, "thread_id long, file_id string, chunk_id long, score double, second long").coalesce(1).withColumn("ts", F.timestamp_seconds("second")).drop("second").write.mode("append").parquet(path)
        return X.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)

    use = lambda c, s: (1, "f", c, 1.0, s)
    parts = [[use(0, 1), use(1, 1)], [use(0, 2), use(1, 2)], [use(0, 4), use(0, 3)], [use(0, 5), use(1, 6)], [use(0, 7)]]
    got = X.run_once(X.stream_usage(stream(parts), 3, ttl_hours=1))
    assert sorted((r.chunk_id, r.uses, r.score, r.promoted_at.timestamp()) for r in got.collect()) == [(0, 3, 3.0, 3.0), (1, 3, 3.0, 6.0)]
    # Past its time to live a chunk is forgotten: its two uses do not count any more.
    far = 10 * 86_400
    parts = [[use(0, 1), use(0, 2)], [use(5, far)], [use(5, far + 1)], [use(0, far + 2)], [use(0, far + 3)], [use(5, far + 4)]]
    got = X.run_once(X.stream_usage(stream(parts), 3, ttl_hours=1))
    assert [(r.chunk_id, r.uses) for r in got.collect()] == [(5, 3)]


def test_gazetteer_of_several_words(spark):
    names = [("Apache Spark", "TECHNOLOGY"), ("Spark", "PRODUCT"), ("Spark Summit North", "EVENT"), ("New York", "PLACE"), ("york city", "PLACE"), ("Apache", "TRIBE"), ("--", "NONE"), ("Apache Spark", "ZZZ")]
    text = "Nine met: Old Mill, Apache-Spark, then Apache Spark Summit; New  York City in 2024. spark Spark Summit North. " + ". ".join(f"Big Name{chr(97 + i)}" for i in range(9))
    chunks = spark.createDataFrame([(1, "t", text), (2, "t", None), (3, "t", "nothing"), (4, "t", "Spark")], "chunk_id long, topic string, text string")
    gazetteer = spark.createDataFrame(names, "name string, type string")
    got = collected(graph.extract_entities(chunks, gazetteer=gazetteer))
    assert got == collected(graph.extract_entities(chunks, gazetteer=gazetteer, names=2))
    assert [g[2:] for g in got if g[0] == 1] == [(0, "Old Mill", "CONCEPT"), (1, "Apache Spark", "TECHNOLOGY"), (2, "New York", "PLACE"), (3, "2024", "CONCEPT"), (4, "Spark Summit North", "EVENT"), (5, "Big Namea", "CONCEPT"), (6, "Big Nameb", "CONCEPT"), (7, "Big Namec", "CONCEPT")]
    assert [g for g in got if g[0] != 1] == [(4, "t", 0, "Spark", "PRODUCT")]


def test_known_spans_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        names = {" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(4)}
        words = [rng.choice("abcd") for _ in range(12)]
        want, i = [], 0
        while i < len(words):
            fit = [n for n in names if words[i : i + len(n.split())] == n.split()]
            best = max(fit, key=len, default=None)
            if best:
                want.append((2 * i, 2 * i + len(best), best))
            i += len(best.split()) if best else 1
        got = graph.known_spans(" ".join(words), graph.name_trie((n, "T") for n in names))
        assert [(g["start"], g["stop"], g["name"]) for g in got] == want


def test_bm25_bounds(spark):
    rng = random.Random(8)
    texts = [" ".join(["the"] * rng.randrange(1, 4) + ["of"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(3, 30))]) for _ in range(400)]
    texts += ["the", "", None, "the of", texts[0], texts[0]]
    queries = [(q, f"the of {' '.join(rng.sample(texts[q].split(), 3))} nowhere") for q in range(60)] + [(60, "the"), (61, "zzz"), (62, None)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    words = {i: (t or "").lower().split() for i, t in enumerate(texts)}
    n, mean = len(texts), np.mean([len(words[i]) for i, t in enumerate(texts) if t is not None])
    df, tf = Counter(w for x in words.values() for w in set(x)), {i: Counter(x) for i, x in words.items()}
    want = []
    for q, text in queries:
        scores = {}
        for w in set((text or "").lower().split()):
            for i in words:
                if f := tf[i][w]:
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        want += [(q, r, i) for r, (i, _) in enumerate(sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:5], 1)]
    for plain in (0, R.PLAIN):
        assert sorted((r.query_id, r["rank"], r.id) for r in R.bm25(asked, chunks, 5, plain=plain).collect()) == sorted(want)
    # What is joined for all queries does not hold the words that every chunk has, unless a query has no others.
    listed, terms = R.postings(asked, chunks)
    rows = R.essential_terms(listed, terms, 5).collect()
    essential = sum(r.df for r in rows if r.essential)
    assert 60 in (asking := {r.query_id for r in rows if r.essential and r.term == "the"}) and len(asking) < 6
    assert essential < 0.25 * sum(r.df for r in rows)


def test_hot_contents_and_large_directories(spark):
    texts = [(i, "same" if i % 3 else f"t{i % 50}") for i in range(600)] + [(900, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    got = {r.doc_id: (r.canonical_id, r.status) for r in ingest.canonical_documents(docs).collect()}
    assert got == {i: (first[t], "canonical" if first[t] == i else "duplicate") for i, t in texts if t is not None}
    listed = spark.createDataFrame([("d1" if i % 4 else "d2", f"f{i}", i, i % 7) for i in range(300)] + [(None, "x", 1, 1)], "dir string, name string, mtime long, size long").repartition(6)
    assert collected(ingest.directory_hash(listed, most=100)) == collected(ingest.directory_hash(listed))
    paths = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h1", "a"), ("h2", "c"), (None, "d")], "hash string, path string")
    assert collected(files.files_by_hash(paths)) == [("h1", "a", 2), ("h1", "b", 2), ("h2", "c", 1)]


def test_tool_references(spark):
    log = spark.createDataFrame([(1, f"doc#{i}", i, tool, path) for i, (tool, path) in enumerate([("ocr", "a.PDF"), ("archive", "b.zip"), ("load", "c.xlsx"), ("load", "d.pdf"), ("load", "e.txt")], 1)], "thread_id long, doc_id string, place int, tool string, file_path string")
    asks = {"doc#2": 2, "doc#9": None, "the document": 5, "the last file": 5, "the pdf": 4, "excel sheet": 3, "that zip": 2, "the scan": 1, "the first one": 1, "word file": 5, "hm": 5, "first spreadsheet": 3}
    queries = spark.createDataFrame([(i, 1, t) for i, t in enumerate(asks)] + [(99, 2, "hm")], "query_id long, thread_id long, text string")
    got = {r.query_id: r.doc_id for r in memory.resolve_tool_reference(queries, log).collect()}
    assert got == {i: f"doc#{n}" for i, n in enumerate(asks.values()) if n}
