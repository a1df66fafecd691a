"""Keys that hold a great part of the rows, long stretches and concurrent pipelines, against plain versions."""

import os
import random
import re
import threading
from itertools import combinations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from corpusloom.llm import _components, decontaminate, minhash, superkmer  # noqa: E402
from corpusloom.llm._storage import materialise, scratch  # noqa: E402
from corpusloom.operators import joins  # noqa: E402


def components(edges):
    """The smallest node that each node of ``edges`` reaches."""
    low = {n: n for e in edges for n in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def near_groups(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
    edges = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = components(edges)
    return {i: (len(s), low.get(i, i)) for i, s in sets.items()}


def hot_documents(seed):
    """A third near copies of one text, a third copies of another, many rows without words, and others."""
    g = random.Random(seed)
    word = lambda: f"w{g.randrange(5000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for j in g.sample(range(120), 1 + i % 4):
            text[j] = word()
        rows.append((i, " ".join(text)))
    rows += [(100 + i, "the same words in every one of these rows") for i in range(60)]
    rows += [(200 + i, g.choice(["", None, " \n "])) for i in range(30)]
    rows += [(300 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_with_hot_pivots_copies_and_empty_rows(spark, monkeypatch, k):
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 400)
    monkeypatch.setattr(minhash, "salted_join", lambda *a, **o: joins.salted_join(*a, **o | {"share": 20}))
    for module in (minhash, _components):
        monkeypatch.setattr(module, "join_counted", lambda *a, **o: joins.join_counted(*a, **o | {"share": 5}))
    rows = hot_documents(k)
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (None, ""), (None, None)], "doc_id long, text string").repartition(7)
    got = minhash.near_duplicates(df, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == near_groups(rows, k)
    assert len(got) == len(rows) + 3 and all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("share", [3, 1000])
def test_components_of_stars_and_chains(spark, monkeypatch, share):
    monkeypatch.setattr(_components, "join_counted", lambda *a, **o: joins.join_counted(*a, **o | {"share": share}))
    g = random.Random(share)
    edges = [(500, i) for i in range(501, 600)] + [(i, i + 1) for i in range(40)] + [(39, 550), (1000, 1001), (1001, 1000), (7, 7)]
    edges += [(g.randrange(2000, 2100), g.randrange(2000, 2100)) for _ in range(60)]
    got = _components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == components([e for e in edges if e[0] != e[1]])


def test_pairs_of_a_hot_pivot_are_dealt_to_several_keys(spark):
    pairs = spark.range(1, 101).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    counts = pairs.groupBy("b").agg(F.count("*").alias("__n"))
    joined = joins.salted_join(pairs, spark.createDataFrame([(0, "t"), (5, "u")], "b long, t string"), "b", share=20, least=10, counts=counts)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and sorted(r.a for r in joined.collect()) == list(range(1, 101))


def test_a_long_document_of_benchmark_text_is_several_regions(spark):
    item = [f"i{j}" for j in range(40)]
    n = 4000
    text = " ".join(w for i in range(n) for w in (*item, f"x{i}", f"y{i}", f"z{i}"))
    docs = spark.createDataFrame([(1, text), (2, "nothing of it"), (None, text[:5000]), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert n * 43 > 2 * decontaminate.SPAN
    got = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == [(1, 9, 43 * i, 40, 40) for i in range(n)]
    rows = sorted(((r.doc_id, r.contaminated, r.items) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert rows == [(1, True, [9]), (2, False, []), (None, False, []), (None, False, [])]


def test_rows_without_an_id_do_not_meet_in_one_task(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f")] + [(None, "a b c d e")] * 50, "doc_id long, text string").repartition(5)
    out = superkmer.remove_repeats(docs, k=3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted([(1, 5, 0, "a b c d e"), (2, 6, 5, "f")] + [(None, 5, 0, "a b c d e")] * 50, key=str)
    # The rows with an id are joined, the others pass in their own branch of a union.
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_pipelines_of_two_threads_keep_their_tables_apart(spark):
    seen, both = {}, threading.Barrier(2, timeout=120)

    def pipeline(name):
        with scratch(spark):
            df = materialise(spark.range(3), name)
            path = df.inputFiles()[0].removeprefix("file://")
            both.wait()
            if name == "late":
                both.wait()
                seen[name] = df.count()
        seen[name + " gone"] = not os.path.exists(path)
        if name == "early":
            both.wait()

    threads = [threading.Thread(target=pipeline, args=(x,)) for x in ("early", "late")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"early gone": True, "late": 3, "late gone": True}
