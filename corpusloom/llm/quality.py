"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared with references by
Jensen-Shannon distance (base 2, so 0 to 1). Short documents, whose histograms say little, are not judged by them.
Everything is computed within a document's row: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import let


SYMBOLS = "#*$%&|<>"
SPACE = r" \t\n\x0B\f\r"
PUNCTUATION = ".,;:!?'\"()-"
#: The twenty most frequent words of each language, most frequent first.
COMMON = {
    "en": "the of and to in a is that it was for on are as with his they be at this",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
#: Shares of white space, digits, symbols, punctuation, upper-case letters and the rest in prose of these languages.
CLASSES = (0.16, 0.005, 0.001, 0.03, 0.03, 0.774)
#: Rank r of a language's words is taken to have the share 0.06 / r^0.8 of all words (a Zipf-Mandelbrot curve).
SHARES = tuple(0.06 * r**-0.8 for r in range(1, 21))
#: By language: classes and shares of the common words. ``fit_references`` measures them on labelled documents.
REFERENCES = {lang: (CLASSES, SHARES) for lang in COMMON}


def _js(p: list[float], q: list[float]) -> float:
    """The Jensen-Shannon distance of two lists of shares."""
    return math.sqrt(sum(x * math.log2(2 * x / (x + y)) for a in (zip(p, q), zip(q, p)) for x, y in a if x > 0) / 2)


def lack_limit(shares: tuple[float, ...]) -> float:
    """Too few common words: three quarters of the distance of a text that has none of them."""
    return 0.75 * _js([0.0] * len(shares) + [1.0], [*shares, 1 - sum(shares)])


def symbol_limit(classes: tuple[float, ...]) -> float:
    """Too many symbols: the distance of prose with one more symbol and space for every second word."""
    return _js([(x + classes[0] / 2 * (i in (0, 2))) / (1 + classes[0]) for i, x in enumerate(classes)], list(classes))


def _distance(p: Column, q: list[float]) -> Column:
    """The Jensen-Shannon distance of an array of shares to a reference."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _size(a: Column) -> Column:
    return F.size(a).cast("long")


def repeated_words(words: Column, k: int = 5) -> Column:
    """How many words stand in a ``k``-word window that the array holds twice or more, each word counted once.

    Windows are sorted by (hash, position) packed in one long; neighbours with one hash are candidates, and those are
    compared word by word, so equal hashes of different windows count for nothing."""

    def window(w: Column, i: Column) -> Column:
        return F.array(*(w[i + j] for j in range(k)))

    def covered(w: Column) -> Column:
        plain = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.hash(*(w[i + j] for j in range(k))))

        def repeats(h: Column) -> Column:
            high = lambda x: F.shiftright(x, 32)
            near = F.filter(h, lambda x, i: ((i > 0) & (high(x) == high(h[F.greatest(i - 1, F.lit(0))]))) | ((i < F.size(h) - 1) & (high(x) == high(h[F.least(i + 1, F.size(h) - 1)]))))
            texts = F.array_sort(F.transform(near, lambda x: F.struct(window(w, x.bitwiseAND(0xFFFFFFFF).cast("int")).alias("t"), x.bitwiseAND(0xFFFFFFFF).cast("int").alias("p"))))

            def positions(t: Column) -> Column:
                same = F.filter(t, lambda x, i: ((i > 0) & (x["t"] == t[F.greatest(i - 1, F.lit(0))]["t"])) | ((i < F.size(t) - 1) & (x["t"] == t[F.least(i + 1, F.size(t) - 1)]["t"])))
                at = F.array_sort(F.transform(same, lambda x: x["p"].cast("long")))
                step = F.aggregate(at, F.struct(F.lit(-k).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(k).cast("long"), p - s["last"])).alias("n")))
                return step["n"]

            return F.when(F.size(near) == 0, F.lit(0).cast("long")).otherwise(let(texts, positions))

        packed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x.cast("long"), 32).bitwiseOR(i.cast("long"))))
        return let(plain, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(packed(h), repeats)))

    return F.when(F.size(words) < k + 1, F.lit(0).cast("long")).otherwise(let(words, covered))


def _compared(c: Column, classes: Column, numbers: Column, total: Column, of_classes: tuple[float, ...], of_words: tuple[float, ...]) -> Column:
    """The distances of a document's classes and numbers of common words to one language's reference."""

    def words(n: Column) -> Column:
        return let(F.transform(n, lambda x: x / total), lambda s: distances(n, s, F.aggregate(s, F.lit(0.0), lambda a, b: a + b)))

    def distances(n: Column, shares: Column, whole: Column) -> Column:
        filled = F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - whole)))
        both = F.struct(_distance(classes, list(of_classes)).alias("c"), _distance(filled, [*of_words, 1 - sum(of_words)]).alias("w"))
        return let(both, lambda d: F.struct(
            d["c"].alias("class_js"), d["w"].alias("word_js"),
            ((whole < sum(of_words)) & (d["w"] > lack_limit(of_words))).alias("lacks"),
            ((c["n_symbols"] > of_classes[2] * c["chars"]) & (d["c"] > symbol_limit(of_classes))).alias("symbolic"),
            n.alias("common"),
        ))

    return let(numbers, words)


def _features(text: Column, lang: Column, references: dict) -> Column:
    """A struct of counts, of the two distances (``class_js``, ``word_js``), of the numbers of the language's common words
    (``common``), and of what limits by sign are exceeded (``lacks``, ``symbolic``). Texts and counts are bound once, so it costs
    the same in a filter as in a projection."""
    every = sorted({x for v in COMMON.values() for x in v.split()})
    strip = f"[{re.escape(PUNCTUATION + SYMBOLS)}]*+"

    def split(t: Column) -> Column:
        words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
        return let(F.struct(t.alias("t"), words.alias("w"), lines.alias("l"), F.length(t).cast("long").alias("chars")), counted)

    def counted(x: Column) -> Column:
        t, w = x["t"], x["w"]
        counts = {
            "n_words": _size(w),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": x["chars"] - F.length(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": _size(x["l"]) - _size(F.array_distinct(x["l"])),
            "n_repeat_words": repeated_words(w),
            "chars": x["chars"],
            "digits": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
            "punctuation": F.regexp_count(t, F.lit("[.,;:!?'\"()-]")).cast("long"),
            "upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        }
        common = F.regexp_extract_all(F.lower(t), F.lit(rf"(?<![^{SPACE}]){strip}({'|'.join(every)}){strip}(?![^{SPACE}])"), F.lit(1))
        return let(F.struct(*(v.alias(k) for k, v in counts.items()), common.alias("common")), lambda c: measured(c, list(counts)))

    def measured(c: Column, names: list[str]) -> Column:
        n, total = F.greatest(c["chars"], F.lit(1)), F.greatest(c["n_words"], F.lit(1))
        space = c["chars"] - c["word_chars"]
        rest = c["chars"] - space - c["digits"] - c["n_symbols"] - c["punctuation"] - c["upper"]
        classes = F.array(*(x / n for x in (space, c["digits"], c["n_symbols"], c["punctuation"], c["upper"], F.greatest(rest, F.lit(0)))))
        found = F.lit(None).cast("struct<class_js:double,word_js:double,lacks:boolean,symbolic:boolean,common:array<int>>")
        for name, (of_classes, of_words) in references.items():
            numbers = F.transform(F.array(*map(F.lit, COMMON[name].split())), lambda r: F.size(c["common"]) - F.size(F.array_remove(c["common"], r)))
            found = F.when(lang == name, _compared(c, classes, numbers, total, of_classes, of_words)).otherwise(found)
        return let(found, lambda f: F.struct(*(c[k].alias(k) for k in names), *(f[k].alias(k) for k in ("class_js", "word_js", "lacks", "symbolic", "common"))))

    return let(F.coalesce(text.cast("string"), F.lit("")), split)


def verdict(text: Column, lang: Column, class_limit: float = 0.3, class_words: int = 30, word_limit: float = 0.4, word_words: int = 100, by_sign: bool = True, references: dict = REFERENCES) -> Column:
    """A struct of ``q`` (see ``_features``), ``base_failed`` and ``kept``, computed once for a text."""

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
        far = ((q["n_words"] >= class_words) & (q["class_js"] > class_limit)) | ((q["n_words"] >= word_words) & (q["word_js"] > word_limit))
        if by_sign:
            far |= ((q["n_words"] >= word_words) & q["lacks"]) | ((q["n_words"] >= class_words) & q["symbolic"])
        return F.struct(q.alias("q"), failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))

    return let(_features(text, lang, references), judged)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """``docs`` with ``q`` (see ``_features``), ``base_failed`` and ``kept``; ``limits`` are those of ``verdict``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in 5-word windows found twice or more. Others are
    kept unless, in a language with references, the character classes of a document of at least ``class_words`` words
    are farther than ``class_limit`` from prose, or the common words of one of at least ``word_words`` words farther than
    ``word_limit`` from the language's. With ``by_sign`` there are closer limits where common words are fewer than the
    language's (``lack_limit``) and where symbols are more than in prose (``symbol_limit``): the distance of a text without any
    common word is 0.398, so a ``word_limit`` of 0.4 alone never finds one. A null or empty text has no words and fails; a
    null or unknown language is judged by the base rules alone. Repeated rows are judged alike; an empty table gives an empty
    table.
    """
    df = docs.withColumn("__v", verdict(F.col(text_col), F.col(lang_col), **limits))
    return df.withColumns({k: F.col(f"__v.{k}") for k in ("q", "base_failed", "kept")}).drop("__v")


def fit_references(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", good: str = "quality = 1", most: int = 2000, least: int = 30) -> dict[str, tuple[tuple[float, ...], tuple[float, ...]]]:
    """References for ``verdict``, measured: the classes and shares of common words over all characters and words of the labelled
    documents for which ``good`` holds, of each language the ``most`` with the smallest ids. Languages with fewer than ``least``
    of them, and words that none of them has, keep what is built in."""
    chosen = docs.where(F.col(lang_col).isin(list(COMMON))).join(labels.where(good).select(id_col).distinct(), id_col, "left_semi").select(id_col, lang_col)
    first = chosen.withColumn("__n", F.row_number().over(Window.partitionBy(lang_col).orderBy(id_col))).where(F.col("__n") <= most).select(id_col)
    q = judge(docs.join(F.broadcast(first), id_col, "left_semi"), text_col, lang_col).select(F.col(lang_col).alias("lang"), "q.*")
    space = F.col("chars") - F.col("word_chars")
    rest = F.col("chars") - space - F.col("digits") - F.col("n_symbols") - F.col("punctuation") - F.col("upper")
    sums = [F.sum(c) for c in (space, F.col("digits"), F.col("n_symbols"), F.col("punctuation"), F.col("upper"), F.greatest(rest, F.lit(0)))]
    out = dict(REFERENCES)
    for lang, n, chars, words, classes, common in q.groupBy("lang").agg(F.count("*"), F.sum("chars"), F.sum("n_words"), F.array(*sums), F.array(*(F.sum(F.col("common")[i]) for i in range(len(SHARES))))).collect():
        if n >= least and chars and words:
            out[lang] = (tuple(x / sum(classes) for x in classes), tuple(x / words or y for x, y in zip(common, SHARES)))
    return out


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return docs.where(verdict(F.col(text_col), F.col(lang_col), **options)["kept"])
