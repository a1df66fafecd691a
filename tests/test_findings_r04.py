"""One test for each finding of round 4, which failed before its change."""

import duckdb
import pytest

from corpusloom.operators import splitting as T
from corpusloom.plans.queries import QUERIES, SQL


@pytest.fixture
def conf(spark):
    """Sets the session's settings, and takes them back in the end."""
    old = {}

    def put(k, v):
        old.setdefault(k, spark.conf.get(k, None))
        spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def csv_rows(spark, folder, rows):
    """The rows of s07, and those of its SQL, for ``rows`` of ids, codes and texts."""
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES["s07_read_csv_docs"](spark, str(folder))
    return got, sorted(duck.execute(SQL["s07_read_csv_docs"]).fetchall(), key=str)


def test_csv_tells_empty_texts_from_none(spark, tmp_path):
    texts = [None, "", " ", '"', '""', "\n", ",", ",,", "\\", 'a\\"', "a", "null", "\0", "a\r\nb", "%41 +é"]
    got, want = csv_rows(spark, tmp_path, [(i, c, t) for i, (c, t) in enumerate((c, t) for c in texts for t in texts)])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_csv_of_texts_beyond_twenty_million_characters(spark, tmp_path):
    got, want = csv_rows(spark, tmp_path, [(1, "en", "a b " * 5_100_000), (2, "en", "x")])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_csv_rows_hang_on_no_number_of_cores(spark, tmp_path, conf):
    """Files are split by the cores there are, which may change between the numbering of rows and their use."""
    conf("spark.sql.files.openCostInBytes", "1")
    conf("spark.sql.leafNodeDefaultParallelism", "12")
    got, want = csv_rows(spark, tmp_path, [(i, "en", f"{i} " * (i % 50)) for i in range(2_000)])
    conf("spark.sql.leafNodeDefaultParallelism", "3")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_the_whole_text_decides_how_it_is_split(spark, tmp_path):
    head, cjk = "some words " * 5_000, "東京の朝。" * 4_000
    texts = {1: head + cjk, 2: head + cjk[:100], 3: cjk, 4: "한글 " * 20 + head, 5: cjk[:4_000] + head * 10, 6: "", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, n, c) for i in (1, 3) for n, c in enumerate(T.cjk_pieces(texts[i], 700, 120))]
    want += [(i, n, c) for i in (2, 4, 5) for n, c in enumerate(T.recursive_pieces(texts[i], 1200, 150))]
    assert sorted(map(tuple, T.split_by_policy(docs).collect())) == sorted(want)
    assert QUERIES["t06_split_by_policy"](spark, str(tmp_path)).count() == len(want)
