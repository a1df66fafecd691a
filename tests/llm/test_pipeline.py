"""The pipeline's stages on planted cases."""

import hashlib
import random

import pytest

pytest.importorskip("corpusloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_planted_cases(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "river", "stone"]) + "".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 3)))) for _ in range(n))
    clean = {i: text(80) for i in range(10)}
    item = text(25)
    docs = [(i, t, "en", f"s{i}") for i, t in clean.items()]
    docs += [(20, clean[3], "en", "s1"), (21, clean[4] + " end", "en", "s1"), (22, text(20) + " " + item + " " + text(20), "en", "s2"), (23, "too short", "en", "s2"), (24, text(60) + ' token = "abcdef123456" ' + text(9), "en", "s3")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(range(10)) | {24}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(got[i].n_tokens == len(lib.encode(t)) for i, t in clean.items())
    hidden = docs[-1][1].replace('token = "abcdef123456', "[SECRET]")
    assert got[24].decoded_sha256 == hashlib.sha256(hidden.encode()).hexdigest()


def test_stage_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def odd_documents(spark):
    words = "The river and the stone of the old town is in a field that they have seen with his lamp at this hour for as long as it was on"
    rows = [(1, words, "en", "s1"), (1, words, "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (None, words + " token=abcdefgh", "en", "s2"), (None, None, None, None), (5, "long " + "tokens " * 40_000, "en", "s3"), (6, words + " password: hunter2hunter2", None, "s1"), (7, " \t\n", "xx", "s1")]
    return spark.createDataFrame([(*r, "c", 1, "d", "e", 2) for r in rows], "doc_id long, text string, lang string, source string, key string, n long, row string, spans string, rep long")


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and columns whose names clash: no stage fails or loses a
    column, and each does to every row what its docstring says."""
    import corpus_pipeline

    docs = odd_documents(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {n: f(spark, docs, f"file://{tmp_path}") for n, f in stages.items() if n != "sentencepiece"}
    assert all(d.columns == docs.columns for d in out.values())
    ids = {n: sorted(((r.doc_id, (r.text or "")[:12]) for r in d.collect()), key=str) for n, d in out.items()}
    every = sorted(((r.doc_id, (r.text or "")[:12]) for r in docs.collect()), key=str)
    assert ids["quality_rules"] == [(1, "The river an"), (1, "The river an"), (6, "The river an"), (None, "The river an")]
    assert ids["near_dedup"] == [x for x in every if x[0] != 6] and ids["decontamination"] == every and ids["secret_scan"] == [x for x in every]
    hidden = {r.doc_id: r.text for r in out["secret_scan"].where("text LIKE '%SECRET%'").collect()}
    assert hidden == {6: docs.where("doc_id = 6").first().text.replace("password: hunter2hunter2", "[SECRET]"), None: docs.where("doc_id IS NULL AND text IS NOT NULL").first().text.replace("token=abcdefgh", "[SECRET]")}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def encoded(doc_id, text):
        ids = model.encode(text or "", num_threads=1)
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["sentencepiece"](spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted((encoded(r.doc_id, r.text) for r in docs.collect()), key=str)


def test_empty_table(spark, tmp_path):
    import corpus_pipeline

    odd_documents(spark).limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of a few words")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_intermediate_tables_are_deleted(spark, tmp_path):
    from corpusloom.llm._storage import materialise, scratch

    with scratch(spark):
        df = materialise(spark.range(3), "gone")
        kept = materialise(df, "kept", f"file://{tmp_path}/kept")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 3 and __import__("os").path.isdir(path)
    assert kept.count() == 3 and not __import__("os").path.exists(path)
