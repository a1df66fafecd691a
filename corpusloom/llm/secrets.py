"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates of every text are found by patterns, with their positions; hashes of the candidate values are counted
over the whole corpus by distinct owners and repositories. A value that many owners hold is a copied example; one that
stays with an owner looks live. Counts are combined before the shuffle and candidate values never leave as plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.columns import let
from corpusloom.llm._columns import row_key, running
from corpusloom.llm._storage import materialise
from corpusloom.operators.joins import join_counted

#: The base kinds in order, each with its pattern, the group that must be long enough, and how long.
#: For access and hex, a match of the least length is found where the unbounded pattern's match is long enough.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Key formats of public services, and private-key headers: reported where their owners show them to be live.
MORE = ("live", r"\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\bsk_live_[A-Za-z0-9]{16,}|\bAIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1)
KINDS = (*BASE, MORE)
PLACEHOLDER = r"(?i)example|change.?me|dummy|placeholder|your.?(key|token|secret)|^(.)\2*$|x{6,}|1234567"
SPAN = "array<struct<start:int,kind:int,end:int,hash:string,placeholder:boolean>>"
FOUND = "array<struct<start:int,kind:int,end:int,live:boolean>>"
#: Code points in a piece of a text that is redacted: spans are cut from pieces, not from the beginning of the text.
PIECE = 4096


def _spans(text: Column, kind: int) -> Column:
    """The spans of one kind: running sums of the gaps between matches and of the matches give positions in code points."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"), F.split(text, pattern).alias("g"))

    def placed(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.length(m) + F.length(x["g"][i]))
        long_enough = F.filter(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: F.length(x["v"][i]) >= least)

        def span(ends: Column, i: Column) -> Column:
            v = x["v"][i]
            return F.struct((ends[i] - F.length(x["m"][i])).alias("start"), F.lit(kind).alias("kind"), ends[i].alias("end"), F.sha2(v, 256).alias("hash"), v.rlike(PLACEHOLDER).alias("placeholder"))

        return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(long_enough, lambda i: span(ends, i)))

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(SPAN))


def _marked(spans: Column) -> Column:
    """Sorted spans with one more field ``hidden``: whether a base span overlaps a span of the further kind."""
    more = len(BASE)

    def marks(s: Column) -> Column:
        ends = F.transform(s, lambda x: F.when(x["kind"] < more, x["end"]).otherwise(-1))
        starts = F.transform(F.reverse(s), lambda x: F.when(x["kind"] < more, x["start"]).otherwise(2**31 - 1))
        # The farthest end of the base spans up to a place, and the least start of those from it on.
        reach = F.struct(running(ends, lambda a, b: F.greatest(a, b)).alias("end"), F.reverse(running(starts, lambda a, b: F.least(a, b))).alias("start"))
        return let(reach, lambda r: F.transform(s, lambda x, i: x.withField("hidden", (x["kind"] == more) & ((r["end"][i] > x["start"]) | (r["start"][i] < x["end"])))))

    return let(spans, lambda s: F.when(F.exists(s, lambda x: x["kind"] == more) & F.exists(s, lambda x: x["kind"] < more), marks(s)).otherwise(F.transform(s, lambda x: x.withField("hidden", F.lit(False)))))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], whole: bool = False) -> DataFrame:
    """``(id, key, owner, repo, spans)`` for each row, with ``whole`` also the row itself as ``row``; rows of one key have the
    same id and text."""
    row = [F.struct("*").alias("row")] if whole else []
    rows = docs.select(*row, F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(owner_col).cast("string").alias("owner"), F.to_json(F.struct(*repo_cols)).alias("repo"))
    spans = F.array_sort(F.concat(*(_spans(F.col("t"), k) for k in range(len(KINDS)))))
    return rows.select(*(["row"] if whole else []), "id", row_key(F.col("id"), F.col("t")).alias("key"), "owner", "repo", _marked(spans).alias("spans"))


def _judged(rows: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """``(key, found)`` of all keys of candidates that have base or live spans."""
    each = rows.where("size(spans) > 0").select("key", F.coalesce("owner", F.lit("")).alias("owner"), "repo", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash"))
    by_owner = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    stats = materialise(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n")), "owners")
    live = ~F.col("s.placeholder") & (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = join_counted(each.select("key", "s", "hash"), stats, "hash", "n").select("key", F.struct("s.start", "s.kind", "s.end", live.alias("live")).alias("f"), "s.hidden")
    return judged.where((F.col("f.kind") < len(BASE)) | (F.col("f.live") & ~F.col("hidden"))).groupBy("key").agg(F.array_sort(F.collect_set("f")).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``(id, key, found)``, with ``found`` an array of ``(start, kind, end, live)``.

    All base spans are in it. Spans of the further kind are in it if live: the value has at most ``max_owners``
    owners and ``max_repos`` repositories in the corpus and is no placeholder; such a span is left out where a base
    span overlaps it. ``live`` says the same of base spans. Positions are code points, the end exclusive; kinds are numbers
    of ``KINDS``. A null text is empty. Null owners or repositories count as one each. Rows that repeat an id are scanned
    alone; equal rows have equal results. An empty table gives an empty table.
    """
    rows = materialise(candidates(docs, id_col, text_col, owner_col, repo_cols), "candidates")
    judged = _judged(rows, max_owners, max_repos)
    none = F.expr(f"CAST(array() AS {FOUND})")
    out = rows.where("size(spans) > 0").select("id", "key").join(judged, "key", "left").select("id", "key", F.coalesce("found", none).alias("found"))
    return out.unionByName(rows.where("size(spans) = 0").select("id", "key", none.alias("found")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live)`` for each row: base counts, a digest of the base
    spans as ``kind:start:end`` joined by commas, all spans in that form, and how many look live."""
    found = scan(docs, id_col, **options)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col("id").alias(id_col), *(number(k).alias(f"n_{BASE[k][0]}") for k in range(len(BASE))), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"))


def _without(text: Column, spans: Column) -> Column:
    """The text with ``[SECRET]`` for each group of overlapping spans, which are sorted."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.greatest(a - k * PIECE, F.lit(0))
            return F.substring(pieces[k], start + 1, F.least(b - k * PIECE, F.lit(PIECE)) - start)

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), part), "")).otherwise("")

    def joined(s: Column) -> Column:
        x, ends = s["spans"], s["ends"]
        heads = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (x[i]["start"] >= ends[F.greatest(i - 1, F.lit(0))]))
        # A gap begins where the last group ends and ends where the next one begins.
        places = F.struct(F.concat(F.array(F.lit(0)), F.transform(F.slice(heads, 2, F.size(heads)), lambda i: ends[i - 1]), F.slice(ends, -1, 1)).alias("a"), F.concat(F.transform(heads, lambda i: x[i]["start"]), F.array(s["n"])).alias("b"))
        return let(places, lambda g: F.array_join(F.zip_with(g["a"], g["b"], lambda a, b: cut(s["pieces"], a, b)), "[SECRET]"))

    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return let(F.struct(spans.alias("spans"), ends.alias("ends"), F.length(text).alias("n"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")), joined)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; overlapping spans become one. Other columns stay, and
    counts of characters in them are not changed. Patterns are looked for once; only rows with a span are shuffled."""
    rows = materialise(candidates(docs, id_col, text_col, owner_col, repo_cols, whole=True), "candidates")
    text = F.col(f"row.`{text_col}`").cast("string")
    marked = rows.where("size(spans) > 0").select("row", "key").join(_judged(rows, max_owners, max_repos), "key", "left")
    fields = [F.when(F.col("found").isNotNull(), _without(text, F.col("found"))).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.where("size(spans) = 0").select("row.*").unionByName(marked.select(*fields))
