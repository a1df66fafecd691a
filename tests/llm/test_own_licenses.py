"""A license table of one's own: whole texts and single lines, whether or not they speak of a license."""

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpusloom.llm")

from corpusloom.llm import licenses  # noqa: E402


def test_lines_of_an_own_table(spark):
    own = spark.createDataFrame([("PD", "Public domain dedication text.")], "license_id string, text string")
    texts = ["public domain  DEDICATION text", "before\nPublic domain dedication text\nafter\n***\n", "public domain", "", None, "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in licenses.scan(docs, own).collect()}
    assert got == {0: ("PD", 1, ["PD"]), 1: (None, 1, ["PD"]), 2: (None, 0, []), 3: (None, 0, []), 4: (None, 0, []), 5: (None, 0, [])}
