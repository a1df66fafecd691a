"""Scalar text functions: columns in, one column out (P operators of the inventory)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.columns import let

UNPRINTABLE = r"[^\P{C}\n\t]|[^\P{Z} ]"


def first_match(text: Column, table: Iterable[tuple], default: str, value: int = 0) -> Column:
    """The first rule of ``(value, pattern, ...)`` whose pattern occurs in the text; a pattern that takes either case does so for
    all letters."""
    out = F.lit(default)
    for rule in reversed(list(table)):
        out = F.when(text.rlike(re.sub(r"^\(\?i\)", "(?iu)", rule[1])), rule[value]).otherwise(out)
    return out


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the substrings occurs."""
    return text.rlike("|".join(map(re.escape, words)))


def sanitize(df: DataFrame, col: str = "text") -> DataFrame:
    """NFC, then every unprintable character but newline and tab as a space. Only rows with combining marks or
    characters outside the Latin blocks go through Python."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    plain = F.coalesce(~F.col(col).rlike(r"[\p{M}\x{1100}-\x{11ff}\x{2126}\x{212a}\x{212b}\x{f900}-\x{faff}]"), F.lit(True))
    both = df.where(plain).unionByName(df.where(~plain).withColumn(col, nfc(col)))
    return both.withColumn(col, F.regexp_replace(col, UNPRINTABLE, " "))


def estimate_tokens(text: Column) -> Column:
    """A third of the characters that are no white space, one at least; an empty text has none."""
    n = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 3).cast("int")))


def effective_limit(n: Column) -> Column:
    """A token limit less a safety margin."""
    margin = F.least(F.greatest(F.lit(8), F.floor(n * F.lit(0.1)).cast("int")), F.greatest(F.lit(1), F.floor(n / 3).cast("int")))
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), n - margin)).cast("int")


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """The text up to its token limit, cut back to the last space if that is within 100 characters of the cut."""
    if limit <= 0:
        return text
    n = max(1, int(limit * 2.85))
    # Counted repetition of a large n overflows regex engines, so it is nested.
    head = F.regexp_extract(text, rf"^(?:\s*\S){{0,{n}}}" if n <= 1000 else rf"^(?:(?:\s*\S){{0,1000}}){{0,{n // 1000}}}(?:\s*\S){{0,{n % 1000}}}", 0)
    back = F.locate(" ", F.reverse(head))
    cut = F.when((back > 0) & (back <= 100), F.rtrim(F.left(head, F.length(head) - back))).otherwise(head)
    return F.when(estimate_tokens(text) <= limit, text).otherwise(cut)


def content_hash(text: Column) -> Column:
    """P5."""
    return F.sha2(text, 256)


def chunk_id(file: Column, index: Column, digest: Column, short: bool = True) -> Column:
    """An id of a file's chunk; the control plane keeps all 64 digits."""
    full = F.sha2(F.concat_ws(":", file, index.cast("string"), digest), 256)
    return F.left(full, F.lit(32)) if short else full


def normalize_key(key: Column) -> Column:
    """A UUID as it is, anything else as the UUIDv5 of the key in the URL namespace, from SHA-1 in SQL functions."""
    raw = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), key.cast("binary")))
    variant = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate("0123456789abcdef") for x in (d, "89ab"[i % 4])]), F.substring(raw, 17, 1))
    made = F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"), variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12))
    return F.when(key.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(key)).otherwise(made)


def coerce_datetime(text: Column) -> Column:
    """An ISO timestamp in UTC from common formats and document stamps (``D:YYYYMMDDhhmmss``), else null."""
    t = F.trim(text)
    stamp = F.regexp_extract(t, r"^D:(\d{14})", 1)
    day = F.regexp_extract(t, r"^D:(\d{8})", 1)
    found = F.coalesce(
        *(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd")),
    )
    return F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def prune_metadata(raw: Column) -> Column:
    """The allowed keys of a JSON object with the right types, as a struct; a lone user becomes a list. The object is parsed once
    (and once more for users that are not all strings, which are taken as they are written); of a key that repeats the last counts."""
    users, flag = "allowed_user_ids", "archived"

    def pruned(m: Column) -> Column:
        def of(k: str, kind: str, type_: str) -> Column:
            return F.when(F.schema_of_variant(m[k]) == kind, F.try_variant_get(m[k], "$", type_))

        def listed(kind: Column) -> Column:
            lone = F.when(kind == "STRING", F.array(F.try_variant_get(m[users], "$", "string")))
            plain = lone.when(kind == "ARRAY<STRING>", F.try_variant_get(m[users], "$", "array<string>"))
            return plain.when(kind.startswith("ARRAY<"), F.from_json(F.get_json_object(raw, f"$.{users}"), "array<string>"))

        numbers = (let(of(k, "BIGINT", "long"), lambda n: F.when(n >= 0, n)).alias(k) for k in rules.METADATA_INTS)
        acl = let(F.schema_of_variant(m[users]), listed).alias(users)
        return F.struct(*(of(k, "STRING", "string").alias(k) for k in rules.METADATA_STRINGS), *numbers, acl, of(flag, "BOOLEAN", "boolean").alias(flag))

    keys = [*rules.METADATA_STRINGS, *rules.METADATA_INTS, users, flag]
    return let(F.from_json(raw, ", ".join(f"{k} variant" for k in keys)), pruned)


def detect_script(text: Column) -> Column:
    """P10."""
    return first_match(text, rules.SCRIPTS, "other")


def language_hint(text: Column) -> Column:
    """By marker substrings, then by script; English by default."""
    script = detect_script(text)
    out = F.when(script == "cyrillic", "ru").when(script == "cjk", F.when(text.rlike(r"[\x{3040}-\x{309f}]"), "ja").when(text.rlike(r"[\x{ac00}-\x{d7af}]"), "ko").otherwise("zh")).otherwise("en")
    for lang, markers in reversed(rules.LANGUAGE_MARKERS):
        out = F.when(any_of(F.lower(text), markers), lang).otherwise(out)
    return out


def script_profile(text: Column, sample: int | None = 50_000) -> Column:
    """A struct of the dominant script family, the share of each, and whether CJK text is present, over the first ``sample``
    characters (None: all)."""
    names = [*rules.FAMILIES, "other"]

    def counts(s: Column) -> Column:
        return F.array(F.length(s), *(F.length(s) - F.length(F.regexp_replace(s, f"[{v}]", "")) for v in rules.FAMILIES.values()))

    def profile(c: Column) -> Column:
        n = c[0]
        shares = [F.when(n > 0, x / n).otherwise(0.0) for x in (*(c[i + 1] for i in range(len(rules.FAMILIES))), n - sum((c[i + 1] for i in range(len(rules.FAMILIES))), F.lit(0)))]
        top = F.element_at(F.array(*map(F.lit, names)), F.array_position(F.array(*shares), F.greatest(*shares)).cast("int"))
        share = dict(zip(names, shares))
        return F.struct(F.when(n > 0, top).otherwise("unknown").alias("dominant"), *(v.alias(k) for k, v in share.items()), (share["cjk"] + share["hangul"] >= 0.05).alias("has_cjk"))

    head = text if sample is None else F.left(text, F.lit(sample))
    return let(F.regexp_replace(head, r"\s", ""), lambda s: let(counts(s), profile))


def split_policy(profile: Column) -> Column:
    """Chunk size, overlap and mode for a script profile."""
    cjk = profile["has_cjk"] | profile["dominant"].isin("cjk", "hangul")
    return F.struct(F.when(cjk, 700).otherwise(1200).alias("size"), F.when(cjk, 120).otherwise(150).alias("overlap"), cjk.alias("cjk"))


def query_keywords(text: Column, most: int = 8) -> Column:
    """Distinct tokens of three characters or more that are no stop words, in order and as written. Tokens are
    compared in lower case without accents, stop words with accents therefore never match."""
    fold = lambda x: F.translate(F.lower(x), *rules.ACCENTS)
    stop = [w for w in dict.fromkeys(rules.KEYWORD_STOPWORDS) if not set(w) & set(rules.ACCENTS[0])]
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}_\s]", " "), r"\s+")
    # Sorted by key and place, so that the first of each key is found without looking through the others.
    keyed = F.array_sort(F.filter(F.transform(words, lambda x, i: F.struct(fold(x).alias("k"), i.alias("i"), x.alias("w"))), lambda x: (F.length(x["w"]) >= 3) & ~x["k"].isin(stop)))
    first = let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | (x["k"] != s[F.greatest(i - 1, F.lit(0))]["k"])))
    return F.transform(F.slice(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), 1, most), lambda x: x["w"])


def perception_keywords(text: Column, most: int = 10) -> Column:
    """Distinct lower-case letter runs of four or more that are no stop words, in order."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[a-záéíóúüñA-Z]{4,}"), F.lit(0)), F.lower)
    return F.slice(F.array_distinct(F.filter(runs, lambda x: ~x.isin(sorted(set(rules.PERCEPTION_STOPWORDS))))), 1, most)


def classify_intent5(text: Column) -> Column:
    """What a message wants, by substrings in any language, in the order of the rules."""
    low, out = F.trim(F.lower(text)), F.lit("GENERAL_KNOWLEDGE")
    for name, longest, words in reversed(rules.INTENTS5):
        hit = any_of(low, words)
        out = F.when(hit & (F.length(text) <= longest) if longest else hit, name).otherwise(out)
    return out


def use_rag(intent: Column) -> Column:
    """P17."""
    return intent.isin("PERSONAL_KB", "GENERAL_KNOWLEDGE")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def estimate_complexity(text: Column) -> Column:
    """P20."""
    words, hard = word_count(text), text.rlike(rules.COMPLEX)
    return F.when((words > 30) | (hard & (words > 15)) | (F.regexp_count(text, F.lit(r"\?")) > 1), "high").when((words > 12) | hard, "medium").otherwise("low")


def needs_math(text: Column) -> Column:
    """P22."""
    return text.rlike(rules.MATH) | text.rlike(rules.MATH_SYMBOLS)


def needs_code(text: Column) -> Column:
    """P22."""
    return text.rlike(rules.CODE) | text.rlike(rules.CODE_BLOCK)


def regex_entities(text: Column) -> Column:
    """Distinct entities, rule by rule."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in rules.ENTITIES)))


def route_branches(text: Column, complexity: Column, math: Column, code: Column, conflicts: Column, intent: Column, needs_retrieval: Column) -> Column:
    """The distinct branches of the evidence pipeline that a query takes, in order."""
    low, mid = F.lower(text), complexity.isin("medium", "high")
    when = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            F.array(F.lit("retrieval_vector")),
            when(needs_retrieval | (complexity != "low"), "retrieval_graph"),
            when(mid, "query_rewriter"),
            when(complexity == "high", "subquestion_generator", "retrieval_planner"),
            when(math, "math_specialist"),
            when(code, "code_specialist"),
            when(mid, "fact_extractor", "hypothesis_generator"),
            when(conflicts, "conflict_resolver"),
            when((intent == "memory") | any_of(low, rules.MEMORY_WORDS), "memory_retrieval"),
            when(any_of(low, rules.PRIVACY_WORDS), "privacy_scrubber"),
            F.array(F.lit("evidence_ranker"), F.lit("integration_layer")),
        )
    )


def resolve_answer_mode(text: Column, preferred: Column, default: str = "detailed") -> Column:
    """P25: a struct of the mode and whether the choice is to be kept for the session."""
    low, explicit = F.lower(text), F.lit(None).cast("string")
    for name, triggers in reversed(rules.MODES):
        explicit = F.when(any_of(low, triggers), name).otherwise(explicit)
    known = F.when(preferred.isin([m[0] for m in rules.MODES]), preferred)
    return F.struct(F.coalesce(explicit, known, F.lit(default)).alias("mode"), (explicit.isNotNull() & any_of(low, rules.MODE_PERSISTS)).alias("persist"))


def split_subquestions(text: Column, most: int = 4) -> Column:
    """The parts of a question between connectors, or the question where there are not two of over ten characters."""
    parts = F.filter(F.transform(F.split(text, rules.CONNECTORS), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return F.when(F.size(parts) <= 1, F.array(text)).otherwise(F.slice(parts, 1, most))


def code_question_profile(text: Column) -> Column:
    """Language, task, symbols, issues and tool hint of a question about code."""
    return F.struct(
        first_match(text, rules.CODE_LANGUAGES, "unknown").alias("language"),
        first_match(text, rules.CODE_TASKS, "explain").alias("task"),
        F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.CODE_SYMBOLS), F.lit(1))), 1, 8).alias("symbols"),
        F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.CODE_ISSUES), F.lit(1))), 1, 5).alias("issues"),
        first_match(text, rules.CODE_TASKS, "search_file", value=2).alias("tool_hint"),
    )


def percent_of(text: Column) -> Column:
    """The result of "p % of n" to four places, and else the numbers found."""
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    hit = text.rlike(rules.PERCENT_OF)
    value = F.bround(number(F.regexp_extract(text, rules.PERCENT_OF, 1)) / 100 * number(F.regexp_extract(text, rules.PERCENT_OF, 2)), 4)
    found = F.transform(F.regexp_extract_all(text, F.lit(rules.NUMBER), F.lit(0)), number)
    return F.struct(F.when(hit, value).alias("value"), F.when(~hit, found).alias("numbers"))


def strip_secrets(text: Column) -> Column:
    """Secrets as ``[REDACTED_<NAME>]``."""
    for name, pattern in rules.SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{name}]")
    return text


def mask_pii_plain(text: Column) -> Column:
    """P30 without numbers: personal data as ``<CATEGORY>``."""
    for name, pattern in rules.PII:
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text


def redaction_report(text: Column) -> Column:
    """How many secrets and how much personal data of each category the masking replaces. A pattern is looked for once in a
    text, and replaced only where it occurs; each is a literal of a branch of its own, which compiles it once."""
    steps = [(p, f"[REDACTED_{n}]") for n, p in rules.SECRETS] + [(p, f"<{n}>") for n, p in rules.PII]
    k = len(rules.SECRETS)

    def branch(i: Column, f: Callable[[str, str], Column]) -> Column:
        out = F.when(i == 0, f(*steps[0]))
        for j, s in enumerate(steps[1:], 1):
            out = out.when(i == j, f(*s))
        return out

    def step(done: Column, i: Column) -> Column:
        def counted(n: Column) -> Column:
            left = F.when(n == 0, done["t"]).otherwise(branch(i, lambda p, mark: F.regexp_replace(done["t"], p, mark)))
            return F.struct(left.alias("t"), F.concat(done["n"], F.array(n)).alias("n"))

        return let(branch(i, lambda p, _: F.regexp_count(done["t"], F.lit(p))), counted)

    def named(done: Column) -> Column:
        n = done["n"]
        return F.struct(sum((n[i] for i in range(1, k)), n[0]).alias("secrets"), *(n[k + i].alias(name.lower()) for i, (name, _) in enumerate(rules.PII)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.struct(text.alias("t"), F.array().cast("array<int>").alias("n")), step, named)


def _numbered(batches: Iterator[pd.DataFrame], table: tuple, running: bool) -> Iterator[pd.DataFrame]:
    compiled = [(name, re.compile(p)) for name, p in table]
    for df in batches:
        texts, maps = [], []
        for text in df["text"].fillna(""):
            found: list[tuple[str, str]] = []
            seen: dict[str, int] = {}

            def put(m, name):
                seen[name] = seen.get(name, 0) + 1
                token = f"<{name}>_{len(found)}" if running else f"<{name}_{seen[name]}>"
                found.append((token, m[0]))
                return token

            for name, pattern in compiled:
                text = pattern.sub(lambda m, name=name: put(m, name), text)
            texts.append(text)
            maps.append([{"placeholder": a, "original": b} for a, b in found])
        yield pd.DataFrame({"id": df["id"], "masked": texts, "privacy": maps})


def mask_pii(df: DataFrame, id_col: str, text_col: str = "text", table: tuple = rules.PII, running: bool = False) -> DataFrame:
    """P30, and P33 with the second scrubber's table and one running counter: ``(id, masked, privacy)``, placeholders
    numbered within a text, ``privacy`` holding what each stands for (P32). Rows without any pattern skip Python."""
    hit = F.lit(False)
    for _, p in table:
        hit = hit | F.col(text_col).rlike(p)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(hit, F.lit(False)).alias("hit"))
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, masked string, privacy array<struct<placeholder:string,original:string>>"
    done = rows.where("hit").select("id", "text").mapInPandas(lambda b: _numbered(b, table, running), schema)
    rest = rows.where("NOT hit").select("id", F.col("text").alias("masked"), F.expr("CAST(array() AS array<struct<placeholder:string,original:string>>)").alias("privacy"))
    return done.unionByName(rest).withColumnRenamed("id", id_col)


def privacy_map(masked: DataFrame, id_col: str) -> DataFrame:
    """One row for each placeholder; to be written to a restricted sink."""
    return masked.select(id_col, F.explode("privacy").alias("p")).select(id_col, "p.placeholder", "p.original")


def contribution(kind: Column) -> Column:
    """A struct of contribution type and whether the document may be shared; a leading dot is ignored."""
    key = F.lower(F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), r"^\s*\.", "")))
    what, share = F.lit("unknown"), F.lit(False)
    for k, c, s in rules.CONTRIBUTIONS:
        what, share = F.when(key == k, c).otherwise(what), F.when(key == k, s).otherwise(share)
    return F.struct(what.alias("type"), share.alias("shareable"))


def provenance(arg: Column, source: Column, file_path: Column, chunk: Column) -> Column:
    """Source and title from the first values that are not empty."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(F.coalesce(full(arg), full(source), full(file_path), full(chunk)).alias("source"), F.coalesce(full(file_path), full(source), full(arg), full(chunk)).alias("title"))


def valid_label(name: Column) -> Column:
    """P36."""
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def valid_relation(name: Column) -> Column:
    """P36."""
    return F.coalesce(name.rlike(r"^[A-Z_][A-Z0-9_]*$"), F.lit(False))


def infer_metric_type(name: Column) -> Column:
    """P38."""
    out = F.lit("gauge")
    for kind, parts in reversed(rules.METRIC_PARTS):
        out = F.when(any_of(F.lower(name), parts), kind).otherwise(out)
    for kind, names in rules.METRIC_NAMES.items():
        out = F.when(name.isin(names), kind).otherwise(out)
    return out


def classify_failure(status: Column, kind: Column) -> Column:
    """Kind, retryable and severity of a failure, from an HTTP status or an exception kind."""
    out = (
        F.when(status == 429, F.struct(F.lit("rate_limit"), F.lit(True), F.lit("medium")))
        .when(status.isin(408, 504), F.struct(F.lit("timeout"), F.lit(True), F.lit("medium")))
        .when(status.between(500, 599), F.struct(F.lit("upstream_unavailable"), F.lit(True), F.lit("high")))
        .when(kind == "timeout", F.struct(F.lit("timeout"), F.lit(True), F.lit("medium")))
        .when(kind == "connection", F.struct(F.lit("network"), F.lit(True), F.lit("high")))
        .when(kind == "missing_file", F.struct(F.lit("not_found"), F.lit(False), F.lit("low")))
        .when(kind == "permission", F.struct(F.lit("permission"), F.lit(False), F.lit("medium")))
        .when(kind == "disk_full", F.struct(F.lit("disk_pressure"), F.lit(False), F.lit("critical")))
        .otherwise(F.struct(F.lit("network"), F.lit(True), F.lit("medium")))
    )
    return out.cast("struct<kind:string,retryable:boolean,severity:string>")


def valid_id(value: Column) -> Column:
    """64 hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def composite_cache_key(text: Column, source: Column | None = None, index: Column | None = None) -> Column:
    """P41."""
    return F.sha2(text if source is None else F.concat_ws("::", source, index.cast("string"), text), 256)


def metric_name(name: Column) -> Column:
    """A metric's name as the exposition format wants it."""
    clean = F.translate(name, ".- ", "___")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("metric_"), clean))
