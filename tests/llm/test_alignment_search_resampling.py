"""Alignment of tokenizers, collision-counting search and importance resampling against brute force, with nulls, empty and long
texts, ties, repeated rows, empty tables and columns whose names clash."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("corpusloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from corpusloom.llm import collision_search, importance, token_alignment  # noqa: E402
from corpusloom.llm.queries import QUERIES  # noqa: E402

EXTRA = "id string, t string, n long, pair long, chunk string, slot string, weight string, score string, rank string, bucket string, vec string, asks string, cell string, bound string"
MORE = ("i", "t", 1, 2, "c", "s", "w", "x", "r", "b", "v", "a", "l", "d")


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- op11

PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


@pytest.fixture(scope="module")
def models():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(rows, models):
    """The contract, token by token with both libraries, and the pair counts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(models[0]), sentencepiece.SentencePieceProcessor(model_file=models[1])
    a.encode_special_tokens = True

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    docs, count, links_of = [], Counter(), Counter()
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False), b.encode(text, num_threads=1)) if text else (None, None)
        p, q = ([bytes(BYTE[c] for c in t) for t in x.tokens], [piece(j) for j in y]) if text else ([], [])
        if not text or b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            docs.append((i, 0, 0, 0, [], ""))
            continue
        p, q, links, j = spans(p), spans(q), [], 0
        for k, (start, stop) in enumerate(p):
            while q[j][1] <= start:
                j += 1
            m = j
            while m < len(q) and q[m][0] < stop:
                links.append((x.ids[k], y[m]))
                m += 1
        common, groups, u, v = sorted({e for _, e in p} & {e for _, e in q}), [], 0, 0
        for c in common:
            ga, gb = [], []
            while u < len(p) and p[u][1] <= c:
                ga.append(x.ids[u])
                u += 1
            while v < len(q) and q[v][1] <= c:
                gb.append(y[v])
                v += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        docs.append((i, len(p), len(q), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
        links_of.update(links)
    best = Counter()
    for (s, _), n in count.items():
        best[s] = max(best[s], n)
    out = [(i, na, nb, ng, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), h) for i, na, nb, ng, ls, h in docs]
    return sorted(out, key=str), sorted((a, b, n, links_of[a, b]) for (a, b), n in count.items())


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    rows += [(900, None), (901, ""), (902, " "), (903, "a▁b"), (904, "<|endoftext|> <s> hi  there\n\n x　 y z   q  "), (905, "don't I'll \U0001f600‍ x" * 50), (906, "w" * 3000), (907, "one two. " * 4000), (908, "\t a b  c <0x41>"), (3, rows[3][1]), (None, "no id"), (None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 2000, "entries": 1500, "most": 50}])
def test_alignment(spark, texts, models, options):
    docs = spark.createDataFrame([(*r, *MORE) for r in texts], f"doc_id long, text string, {EXTRA}").repartition(3)
    want, pairs = aligned(texts, models)
    assert collected(token_alignment.align(docs, *models, **options)) == want
    index = token_alignment.index(docs, *models, **{k: v for k, v in options.items() if k != "most"})
    assert sorted(map(tuple, token_alignment.pair_counts(index, models[1]).collect())) == pairs
    assert collected(token_alignment.align(docs.limit(0), *models)) == []


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (70, 3), (70, 70), (65_536, 5), (65_536, 40_000)):
        slots = np.sort(rng.choice(n, k, replace=False))
        raw = token_alignment.bitmap(slots, n)
        assert (token_alignment.slots_of(raw) == slots).all() and token_alignment.popcount(raw) == k
        links = rng.integers(1, 2 + k % 7, k)
        assert (token_alignment.links_of(token_alignment.planes(links - 1), k) == links).all()


def test_op11_query(spark, sf, models):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collected(got) == aligned(rows, models)[0]


# -- op12


def nearest(rows, asks, k):
    """By brute force; an id with several vectors counts at its nearest."""
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.asarray(v, float)).all() and np.asarray(v, float).any()]
    out = {}
    for q in sorted({i for i, _ in good if i in asks}):
        mine = min((v.tolist() for i, v in good if i == q))
        far = {}
        for i, v in good:
            if i != q and len(v) == len(mine):
                d = float(np.sqrt(np.cumsum((v - mine) ** 2)[-1]))
                far[i] = min(d, far.get(i, d))
        out[q] = sorted(((d, i) for i, d in far.items()))[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for _, i in want[q]})
    assert set(found) == {q for q in want if want[q]}
    return hits / sum(map(len, want.values()))


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "spread":
        m = rng.standard_normal((1500, 16))
    else:
        m = rng.standard_normal((40, 16))[rng.integers(0, 40, 1500)] + 0.05 * rng.standard_normal((1500, 16))
        m[::3] = m[0]  # a third of all rows are equal
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_collision_search(spark, monkeypatch, kind):
    monkeypatch.setattr(collision_search, "SAMPLE", 200)
    monkeypatch.setattr(collision_search, "SHARD", 300)
    monkeypatch.setattr(collision_search, "GROUP", 20)
    rows = vectors(kind)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (None, rows[1][1]), (50, rows[7][1]), rows[50], (2006, [1.0, 2.0]), (2050, [1.0, 2.5])]
    df = spark.createDataFrame([(i, v, *MORE) for i, v in rows + odd], f"vec_id long, embedding array<float>, {EXTRA}").repartition(5)
    asks = {i for i, _ in rows + odd if i is not None and i % 50 == 0}
    got = collision_search.search(df.where("vec_id % 50 = 0"), df).collect()
    want = nearest(rows + odd, asks, 10)
    assert recall(got, want) >= 0.97
    exact = {(q, i): d for q, x in nearest(rows + odd, asks, 5000).items() for d, i in x}
    assert all(exact[r.query_id, r.vec_id] == r.score for r in got)


def test_search_of_few_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(0, [9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(collision_search.search(df, df).collect(), nearest(rows, set(range(6)), 10)) == 1
    assert collision_search.search(df, df.limit(0)).count() == 0 and collision_search.search(df.limit(0), df).count() == 0


def test_op12_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_collision_search"](spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert recall(got.collect(), nearest(rows, {i for i, _ in rows if i % 100 == 0}, 10)) >= 0.9


# -- op13

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def drawn(docs, target, percent=5, least=20):
    def features(text):
        w = WORD.findall((text or "").encode().translate(UPPER))
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in each:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= least and o[0] is not None), key=lambda o: (-o[3], o[0]))
    for r, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = r
    return sorted((tuple(o[:5]) for o in out), key=str)


@pytest.mark.parametrize("options", [{}, {"limit": 700, "share": 8}, {"percent": 60, "min_words": 1}])
def test_importance_resampling(spark, sf, options):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:80]
    rows += [(900, None), (901, ""), (902, "..."), (903, "w" * 5000 + " a " + "é" * 200), (904, "Long Ωmega x9 " * 3000), (905, "y" * 9000), (3, rows[3][1]), (None, rows[4][1]), (None, None)]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, "long Ωmega"]
    docs = spark.createDataFrame([(*r, *MORE) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, wanted, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert collected(got) == drawn(rows, target, options.get("percent", 5), options.get("min_words", 20))


def test_resampling_of_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    none = docs.limit(0).select("text")
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(importance.resample(kept, none)) == drawn(rows, [])
    assert importance.resample(docs.limit(0), none).count() == 0
    taken = importance.draw(kept, none, percent=50)
    assert taken.columns == kept.columns and taken.count() == sum(x[4] is not None for x in drawn(rows, [], 50))


def test_crc_of_joined_parts():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 64)]
    for p in parts:
        for q in parts:
            got = importance.joined(np.array([zlib.crc32(p)], np.uint32), np.array([zlib.crc32(q)], np.uint32), np.array([len(q)]))
            assert got[0] == zlib.crc32(p + q)
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    assert importance.walked(np.full(4, 7, np.uint32), data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(p, 7) for p in parts]


def test_op13_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert collected(QUERIES["op13_importance_resampling"](spark, sf)) == drawn(rows, target)


def test_the_head_decides_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    full, none = importance.head_table(docs), importance.Head([], [])
    assert len(full.words) > 50 and len(full.keys) > 20
    assert collected(importance.bucket_totals(docs, full)) == collected(importance.bucket_totals(docs, none).where(F.col("n") != 0))
