"""Queries that SQL cannot express, against plain versions over the whole given tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from corpusloom.functions import rules
from corpusloom.plans.queries import QUERIES
from corpusloom.plans.retrieval_queries import asked, vectors
from corpusloom.sources.files import ENCODINGS


def rows(sf, table):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def masked(text, table, running):
    """Rule by rule, every match from the left becomes the next placeholder."""
    found, seen = [], Counter()
    for name, pattern in table:
        out, at = "", 0
        for m in re.finditer(pattern, text):
            seen[name] += 1
            token = f"<{name}>_{len(found)}" if running else f"<{name}_{seen[name]}>"
            found.append((token, m[0]))
            out, at = out + text[at : m.start()] + token, m.end()
        text = out + text[at:]
    return text, found


def test_numbered_masks(spark, sf):
    for name, table, running in (("p30_mask_pii", rules.PII, False), ("p33_scrub_alt", rules.SCRUB, True)):
        want = {r["doc_id"]: masked(r["text"] or "", table, running) for r in rows(sf, "documents")}
        got = {r.doc_id: (r.n_masked, r.masked_sha256) for r in QUERIES[name](spark, sf).collect()}
        assert got == {i: (len(f), sha(t)) for i, (t, f) in want.items()} and any(f for _, f in want.values())
    want = Counter((i, a, b) for i, r in ((r["doc_id"], masked(r["text"] or "", rules.PII, False)) for r in rows(sf, "documents")) for a, b in r[1])
    assert Counter(map(tuple, QUERIES["p32_privacy_map"](spark, sf).collect())) == want


def test_decoding(spark, sf):
    want = {}
    for r in rows(sf, "documents"):
        raw = r["text"].encode("latin-1", "replace") if r["doc_id"] % 10 == 1 else r["text"].encode() + b"\0\1" * (r["doc_id"] % 10 == 0)
        if b"\0" in raw[:8192]:
            continue  # binary by its head
        name = next(n for n in ENCODINGS if decodes(raw, n))
        want[str(r["doc_id"])] = (name, sha(raw.decode(name)))
    assert {r.path: (r.encoding, r.text_sha256) for r in QUERIES["s10_decode_with_fallbacks"](spark, sf).collect()} == want


def decodes(raw, name):
    try:
        return raw.decode(name) is not None
    except UnicodeDecodeError:
        return False


def test_sentences_are_packed(spark, sf):
    """T3, sentence by sentence: a piece takes the next sentence as long as both fit."""
    got = defaultdict(dict)
    for r in QUERIES["t03_split_cjk"](spark, sf).collect():
        got[r.doc_id][r.chunk_index] = r.chunk_sha256
    for r in rows(sf, "documents"):
        sentences = [s for s in re.findall(r"[^。！？!?]*[。！？!?]|[^。！？!?]+", r["text"] or "") if s.strip()]
        pieces = []
        for s in sentences:
            for part in [s[i : i + 700] for i in range(0, len(s), 700)] if len(s) > 700 else [s]:
                if pieces and len(s) <= 700 and len(pieces[-1]) + len(part) <= 700:
                    pieces[-1] += part
                else:
                    pieces.append(part)
        chunks, before = [], ""
        for p in pieces:
            chunks.append(before[-120:] + p)
            before = chunks[-1]
        assert got[r["doc_id"]] == {i: sha(c) for i, c in enumerate(chunks)}


def test_recursive_pieces_cover_the_text(spark, sf):
    """No piece is longer than asked for, pieces stand in the text in order, and leave out white space only."""
    from corpusloom.operators import splitting as T

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows(sf, "documents")}
    for df, size in ((T.split_recursive(docs), 900), (T.split_by_policy(docs), 1200)):
        chunks = defaultdict(list)
        for r in df.orderBy("doc_id", "chunk_index").collect():
            chunks[r.doc_id].append(r.chunk_text)
        for i, text in texts.items():
            start = end = 0
            for c in chunks[i]:
                assert len(c) <= size and c == c.strip() != ""
                # The last place that leaves no gap: a text may repeat itself.
                gap = len(text[end:]) - len(text[end:].lstrip())
                start = text.rfind(c, start, end + gap + len(c))
                assert start >= 0
                end = max(end, start + len(c))
            assert not text[end:].strip()


def test_approximate_percentiles_are_near_in_rank(spark, sf):
    values = defaultdict(list)
    for r in rows(sf, "events"):
        values[r["event_type"]].append(r["value"])
    for r in QUERIES["a04_approx_histogram"](spark, sf).collect():
        v = np.sort([x for x in values[r.name] if x is not None])
        assert r.n == len(v)
        for got, p in ((r.p50, 0.5), (r.p95, 0.95), (r.p99, 0.99)):
            assert abs(np.searchsorted(v, got, "right") / len(v) - p) <= 0.001 + 1 / len(v)


def test_silent_tenants_expire(spark, sf):
    """Who has been silent for a day when the stream ends has expired a day after the last touch, and nobody expires
    at another time than a day after a touch."""
    touches = defaultdict(list)
    for r in rows(sf, "events"):
        touches[str(r["user_id"])].append(np.datetime64(r["ts"], "ms"))
    day, mark = np.timedelta64(24, "h"), max(max(t) for t in touches.values()) - np.timedelta64(10, "m")
    got = defaultdict(set)
    for r in QUERIES["x07_stream_ttl"](spark, sf).collect():
        got[r.tenant].add(np.datetime64(r.expired_at, "ms"))
    for tenant, t in touches.items():
        assert got[tenant] <= {x + day for x in t}
        assert (max(t) + day in got[tenant]) == (max(t) + day <= mark)


def test_memory_changes_only_queries_that_have_some(spark, sf):
    """The others keep their first hits in order; those with memory get as many, each once."""
    exact = {(r.query_id, r.rank): r.id for r in QUERIES["r02_knn"](spark, sf).collect()}
    got = defaultdict(list)
    for r in QUERIES["m14_retrieve_with_memory"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    assert set(got) == {r.query_id for r in asked(spark, sf).collect()} and vectors(spark, sf).count() > 8
    for q, ids in got.items():
        assert len(ids) == len(set(ids)) == 8
        if q % 100:
            assert ids == [exact[q, k] for k in range(1, 9)]
