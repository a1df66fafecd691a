"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import licenses, quality, secrets


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
l AS (SELECT doc_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM w),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM l),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT node, b FROM r JOIN two ON a = reach)
SELECT doc_id, any_value(n) AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM n JOIN r ON node = doc_id GROUP BY doc_id"""

ARCHIVE = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS kept, list_transform(range(4), lambda g: CAST('0x' || substr(s, 1 + 10 * g, 10) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1 AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM k"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {q(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return rf"trim(regexp_replace({out}, '[\p{{P}}\p{{S}}\s\p{{Z}}\x00-\x1f]+', ' ', 'g'))"


def license_sql() -> str:
    known = [(i, p.format(n)) for i, names in licenses.NAMES.items() for n in names for p in licenses.PHRASES[:-1]]
    known += [(i, licenses.PHRASES[-1].format(i)) for i in {*licenses.NAMES, *licenses.TEXTS}] + list(licenses.TEXTS.items())
    known += [(i, f"{t}\n\n{licenses.TEXTS[i]}") for i, titles in licenses.TITLES.items() for t in titles]
    values = ", ".join(f"({q(i)}, {q(t)})" for i, t in known)
    digests = ", ".join(f"({q(i)}, {q(d)})" for i, d in licenses.DIGESTS.items())
    return f"""WITH k AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, sha256({_canonical("t")}) AS digest FROM (VALUES {values}) v(license_id, t) UNION ALL SELECT license_id, digest FROM (VALUES {digests}) w(license_id, digest)) GROUP BY digest),
d AS (SELECT doc_id, text, sha256({_canonical("text")}) AS digest FROM documents), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE regexp_matches(text, '(?i)licen')),
f AS (SELECT doc_id, k.license_id AS notice FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM l WHERE regexp_matches(line, '(?i)licen')) JOIN k USING (digest)),
g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices FROM f GROUP BY doc_id)
SELECT d.doc_id, k.license_id, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN g ON g.doc_id = d.doc_id"""


REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) AS p FROM w),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM i), f AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS j FROM g JOIN f USING (g) WHERE doc_id > f),
x AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda a, j: NOT coalesce(list_contains(gone, j), false)), ' ')) AS kept_sha256 FROM w LEFT JOIN x USING (doc_id)"""


def secret_sql(max_owners: int = 1, max_repos: int = 2) -> str:
    parts = []
    for k, (name, pattern, group, least) in enumerate(secrets.KINDS):
        pattern = q(pattern.replace(r"\x20", " "))
        parts.append(f"SELECT doc_id, source, lang, {k} AS kind, {q(name)} AS name, {least} AS least, string_split_regex(text, {pattern}) AS g, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {group}) AS v FROM documents WHERE regexp_matches(text, {pattern})")
    simple = secrets.PLACEHOLDER.replace(r"|^(.)\2*$", "")
    return f"""WITH a AS ({" UNION ALL ".join(parts)}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
s AS (SELECT doc_id, source, lang, kind, name, v[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS b, length(m[i]) AS n FROM i WHERE length(v[i]) >= least),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(source, '') || '|' || coalesce(lang, '')) AS repos FROM s GROUP BY v),
j AS (SELECT s.*, b + n AS e, NOT (regexp_matches(v, {q(simple)}) OR length(replace(v, v[1], '')) = 0) AND owners <= {max_owners} AND repos <= {max_repos} AS live FROM s JOIN o USING (v)),
k AS (SELECT * FROM j WHERE kind < 3 UNION ALL SELECT x.* FROM j x WHERE kind = 3 AND live AND NOT EXISTS (SELECT 1 FROM j y WHERE y.doc_id = x.doc_id AND y.kind < 3 AND y.b < x.e AND x.b < y.e)),
r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{secrets.BASE[k][0]}" for k in range(3))}, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans, count(*) FILTER (live) AS n_live FROM k GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{b[0]}, 0) AS n_{b[0]}" for b in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM documents LEFT JOIN r USING (doc_id)"""


def _distance(p: str, reference: list[float]) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    ref = "[" + ", ".join(f"{x!r}::DOUBLE" for x in reference) + "]"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {len(reference) + 1}), lambda i: {half.format(f'{p}[i]', f'{ref}[i]')} + {half.format(f'{ref}[i]', f'{p}[i]')})) / 2))"


def quality_sql(class_limit: float = 0.3, class_words: int = 30, word_limit: float = 0.4, word_words: int = 100) -> str:
    strip = q(quality.PUNCTUATION + quality.SYMBOLS)
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(q, v.split()))}]" for k, v in quality.COMMON.items()) + " END"
    every = ", ".join(sorted({q(x) for v in quality.COMMON.values() for x in v.split()}))
    langs = ", ".join(map(q, quality.COMMON))
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
i AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 3))) AS p, w FROM w), g AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM i),
d AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS j FROM d WHERE c > 1) GROUP BY doc_id),
c AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) AS chars,
len(regexp_extract_all(t, '[0-9]')) AS digits, len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS punct, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper, list_filter(list_transform(w, lambda x: lower(trim(x, {strip}))), lambda x: x IN ({every})) AS h, {lists} AS common FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, list_transform([chars - word_chars, digits, n_symbols, punct, upper, greatest(0, word_chars - digits - n_symbols - punct - upper)], lambda x: x / greatest(chars, 1)) AS cls, list_transform(common, lambda x: len(list_filter(h, lambda y: y = x)) / greatest(n_words, 1)) AS wd FROM c),
v AS (SELECT *, list_append(wd, greatest(0, 1 - list_sum(wd))) AS wd1, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
j AS (SELECT *, CASE WHEN lang IN ({langs}) THEN {_distance("cls", list(quality.CLASSES))} END AS class_js, CASE WHEN lang IN ({langs}) THEN {_distance("wd1", [*quality.SHARES, 1 - sum(quality.SHARES)])} END AS word_js FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce((n_words >= {class_words} AND class_js > {class_limit}) OR (n_words >= {word_words} AND word_js > {word_limit}) OR (n_words >= {word_words} AND list_sum(wd) < {sum(quality.SHARES)!r} AND word_js > {quality.lack_limit(quality.SHARES)!r}) OR (n_words >= {class_words} AND n_symbols > {quality.CLASSES[2]!r} * chars AND class_js > {quality.symbol_limit(quality.CLASSES)!r}), false) AS kept FROM j"""


SQL = {
    "op1_minhash_neardup": NEAR,
    "op4_warc": ARCHIVE,
    "op6_license_scan": license_sql(),
    "op8_substring_dedup": REPEATS,
    "op9_secret_scan": secret_sql(),
    "op10_quality_rules": quality_sql(),
}
