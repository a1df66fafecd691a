"""Marks that mislead: what the pages of a host show comes before what a page says of itself."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpusloom.llm")

from corpusloom.llm import html_wrapper  # noqa: E402


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def pages(shape, n=6, host="marks.example"):
    """Pages of one host and the texts of their articles."""
    rng, out, want = random.Random(len(shape)), [], []
    for i in range(n):
        body = [prose(rng, 40) for _ in range(3)]
        out.append((i, f"https://{host}/{i}", shape.replace("BODY", "".join(f"<p>{b}</p>" for b in body))))
        want.append("\n".join(body))
    return out, want


TEASER = "<p>Subscribe to our letter today and never miss what the others are reading this week.</p>"
MENU = "".join(f"<a href='/{w}'>{w} stories</a> " for w in "world home sport money travel science health opinion".split())
SHAPES = {
    "article is a constant teaser": f"<html><body><article>{TEASER}</article><div class='c1'>BODY</div></body></html>",
    "main holds a menu and a teaser": f"<html><body><main><div class='x'>{MENU}</div><div class='c2'>BODY</div><div class='y'>{TEASER}</div></main></body></html>",
    "main holds the article only": "<html><body><div class='x'>Home page of the paper of the town</div><main>BODY</main></body></html>",
}


@pytest.mark.parametrize("name", SHAPES)
def test_misleading_marks(spark, name):
    rows, want = pages(SHAPES[name])
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == want


def test_a_single_page_trusts_its_mark(spark):
    rows, _ = pages(SHAPES["article is a constant teaser"], n=1)
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0].text == "Subscribe to our letter today and never miss what the others are reading this week."
