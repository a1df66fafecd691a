"""Queries of the file sources and the splitters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import splitting as T
from corpusloom.plans.registry import query, table
from corpusloom.plans.text_queries import q
from corpusloom.sources import files as S

PATH = "regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '')"


def paths(spark, d):
    """The pages' URLs as absolute paths."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "").alias("path"))


def docs(spark, d):
    return table(spark, d, "documents")


@query("s01_scan_corpus")
def s01(spark, d):
    return S.scan_corpus(spark, d).select("name", "ext", "size")


@query("s02_filter_paths", f"WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, path FROM p WHERE regexp_matches(path, '[^./]\\.html$') AND NOT regexp_matches(path, '/(fr|de)/') AND NOT regexp_matches(path, '(^|/)1[^/]*\\.html(/.*)?$')")
def s02(spark, d):
    return S.filter_paths(paths(spark, d), [".html"], ["fr", "de"], ["1*.html"])


GLOBS = ["/blog.therti.example.com/", "en/*.html", "/m.**/*", "es/**"]


@query("s03_match_globs", f"WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, regexp_matches(path, '^/blog\\.therti\\.example\\.com(/.*)?$|(^|/)en/[^/]*\\.html$|^/m\\..*$|(^|/)es/.*$|(^|/)es$') AS matched FROM p")
def s03(spark, d):
    return paths(spark, d).select("page_id", S.match_globs(F.col("path"), GLOBS).alias("matched"))


@query("s04_classify_exclusions", f"WITH p AS (SELECT CASE WHEN page_id % 2 = 0 THEN {PATH} ELSE 'x' || page_id % 9 || '/' END AS v FROM pages), n AS (SELECT DISTINCT rtrim(v, '/') AS value FROM p) SELECT 'glob' AS kind, value FROM n WHERE value <> '' UNION ALL SELECT 'dir', value FROM n WHERE NOT regexp_matches(value, '[*?\\[\\]/]')")
def s04(spark, d):
    return S.classify_exclusions(paths(spark, d).select(F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("x"), F.col("page_id") % 9, F.lit("/"))).alias("entry")))


@query("s05_preserve_duplicates", f"WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, regexp_matches(path, '/es/\\d+$|(^|/)fr/|/[^/]*7\\.html$') AS preserved FROM p")
def s05(spark, d):
    return paths(spark, d).select("page_id", S.preserve_duplicates(F.col("path"), ["# none", "re:/es/\\d+$", "fr/", "*7.html"]).alias("preserved"))


@query("s06_read_text_docs", "SELECT sha256(text || chr(10)) AS text_sha256 FROM documents")
def s06(spark, d):
    path = S.shared_path(spark, "texts")
    S.write_text_docs(docs(spark, d), path)
    return S.read_text_docs(spark, path, recursiveFileLookup="true").select(F.sha2("text", 256).alias("text_sha256"))


@query("s07_read_csv_docs", r"""SELECT doc_id::VARCHAR AS doc_id, lang, sha256(regexp_replace(text, '[\n\r"\\]', ' ', 'g')) AS text_sha256 FROM documents""")
def s07(spark, d):
    path = S.shared_path(spark, "csv")
    # Codes may hold what would end a row of a file, too.
    rows = docs(spark, d).select("doc_id", F.url_encode("lang").alias("lang"), F.regexp_replace("text", r'[\n\r"\\]', " ").alias("text"))
    rows.write.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    longest = str(2**31 - 1)  # else a text of over 20 million characters would make its document null
    read = S.read_csv_docs(spark, path, most=None).select(F.from_json("text", "doc_id string, lang string, text string", {"maxStringLen": longest}).alias("r"))
    return read.select("r.doc_id", F.url_decode("r.lang").alias("lang"), F.sha2("r.text", 256).alias("text_sha256"))


@query("s08_guard_docs_per_file", "SELECT doc_id FROM documents WHERE lang || source IN (SELECT lang || source FROM documents GROUP BY ALL HAVING count(*) <= 10)")
def s08(spark, d):
    return S.guard_docs_per_file(docs(spark, d).withColumn("file", F.concat("lang", "source")), 10).select("doc_id")


def _raw(spark, d):
    bad = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00\x01"))).when(F.col("doc_id") % 10 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), bad.alias("content"))


@query("s09_sniff_binary", "SELECT doc_id::VARCHAR AS path, doc_id % 10 = 0 AS binary FROM documents")
def s09(spark, d):
    return S.sniff_binary(_raw(spark, d), head=1 << 20)


@query("s10_decode_with_fallbacks")
def s10(spark, d):
    return S.decode_with_fallbacks(_raw(spark, d)).select("path", "encoding", F.sha2("text", 256).alias("text_sha256"))


# The documents' lines as code: every third one declares a function or, in other files, a type.
_code = "CASE n % 3 WHEN 1 THEN '  def ' || line WHEN 2 THEN 'type ' || line ELSE line END"
@query("s11_code_structure", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), c AS (SELECT doc_id, n, {_code} AS line FROM l),
m AS (SELECT doc_id, string_agg('Line ' || (n + 1) || ': ' || trim(line), chr(10) ORDER BY n) AS t FROM c WHERE (doc_id % 3 = 0 AND regexp_matches(line, {q(rules.STRUCTURE["py"])})) OR (doc_id % 3 = 1 AND regexp_matches(line, {q(rules.STRUCTURE["go"])})) GROUP BY doc_id)
SELECT doc_id::VARCHAR AS path, sha256(coalesce(t, 'File structure only')) AS structure_sha256 FROM documents LEFT JOIN m USING (doc_id)""")
def s11(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, "py").when(F.col("doc_id") % 3 == 1, "go").otherwise("zz")
    code = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("  def "), x)).when(i % 3 == 2, F.concat(F.lit("type "), x)).otherwise(x))
    files = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), ext.alias("ext"), F.array_join(code, "\n").alias("text"))
    return S.code_structure(files).select("path", F.sha2("structure", 256).alias("structure_sha256"))


@query("s12_flag_scanned_docs", "SELECT conv_id AS doc_id, avg(length(trim(text))) < 100 AS scanned FROM conversations GROUP BY conv_id")
def s12(spark, d):
    return S.flag_scanned_docs(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))


@query("s13_normalize_web_results", "SELECT 'web_' || substr(sha256(url), 1, 16) AS uuid, sha256(CASE WHEN page_id % 3 = 0 THEN html ELSE '# Page ' || page_id || chr(10) || chr(10) || html END) AS text_sha256, url AS source, CAST(0 AS INT) AS chunk_index, 0.5::DOUBLE AS score FROM pages")
def s13(spark, d):
    r = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("Page "), "page_id")).alias("title"), F.col("html").alias("content"))
    return S.normalize_web_results(r).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("s14_upsert_chunks", "WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS b FROM events), r AS (SELECT user_id, event_type, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY b DESC, event_id DESC) AS n FROM e) SELECT user_id, event_type, seq FROM r WHERE n = 1")
def s14(spark, d):
    e, path = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq")), S.shared_path(spark, "target")
    for i in (0, 1):
        S.upsert_into(path, e.where(F.col("seq") % 2 == i), "user_id", buckets=8)
    return spark.read.parquet(path).drop("bucket")


@query("s15_dead_letter", "SELECT o_orderkey, 'negative or null' AS reason, TIMESTAMP '2024-01-31 00:00:00' AS failed_at FROM orders WHERE NOT coalesce(o_totalprice > 150000, false)")
def s15(spark, d):
    bad = S.dead_letter(table(spark, d, "orders"), F.col("o_totalprice") > 150000, F.lit("negative or null"), "2024-01-31")[1]
    return bad.select("o_orderkey", "reason", F.col("failed_at").cast("timestamp_ntz").alias("failed_at"))


@query("s16_keyset_page", "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def s16(spark, d):
    return S.keyset_page(docs(spark, d).select("doc_id", "lang"), 100, 25, "doc_id")


METRICS = "m AS (SELECT event_id, 'svc.' || event_type AS name, value, ts, user_id FROM events)"


@query("s17_export_prometheus", f"WITH {METRICS} SELECT name, '# TYPE ' || replace(name, '.', '_') || ' gauge' || chr(10) || replace(name, '.', '_') || '{{user=\"' || arg_max(user_id, ts) || '\"}} ' || arg_max(CAST(value AS INT), ts) AS lines FROM m GROUP BY name".replace("{{", "{").replace("}}", "}"))
def s17(spark, d):
    m = table(spark, d, "events").select(F.concat(F.lit("svc."), "event_type").alias("name"), F.lit("gauge").alias("type"), F.rint("value").cast("int").alias("value"), "ts", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"))
    return S.export_prometheus(m)


@query("s18_files_by_hash", "SELECT sha256(text) AS hash, 'd' || doc_id AS path, count(*) OVER (PARTITION BY sha256(text)) AS paths FROM documents")
def s18(spark, d):
    return S.files_by_hash(docs(spark, d).select(F.sha2("text", 256).alias("hash"), F.concat(F.lit("d"), "doc_id").alias("path")))


def digest(df):
    return df.select("doc_id", "chunk_index", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query("t01_split_recursive")
def t01(spark, d):
    return digest(T.split_recursive(docs(spark, d)))


@query("t01b_split_fixed", "WITH n AS (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 900) / 720)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(i AS INT) AS chunk_index, sha256(substr(text, i * 720 + 1, 900)) AS chunk_sha256 FROM n")
def t01b(spark, d):
    return digest(T.split_fixed(docs(spark, d), 900, 180))


_md = "CASE n % 4 WHEN 1 THEN '# ' || line WHEN 2 THEN '## ' || line ELSE line END"
@query("t02_split_markdown", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
m AS (SELECT doc_id, n, CASE n % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level, {_md} AS line FROM l), s AS (SELECT *, count(*) FILTER (level > 0) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM m),
h AS (SELECT doc_id, section, level, trim(regexp_replace(line, '^#+ ', '')) AS title FROM s WHERE level > 0),
g AS (SELECT doc_id, section, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1, CASE WHEN level = 2 THEN title END AS h2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
b AS (SELECT doc_id, section, trim(string_agg(line, chr(10) ORDER BY n), ' ') AS t FROM s WHERE level = 0 GROUP BY ALL)
SELECT b.doc_id, b.section, h1, h2, sha256(t) AS chunk_sha256 FROM b LEFT JOIN g USING (doc_id, section) WHERE t <> ''""")
def t02(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("# "), x)).when(i % 4 == 2, F.concat(F.lit("## "), x)).otherwise(x))
    return T.split_markdown(docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("text"))).select("doc_id", "section", "h1", "h2", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query("t03_split_cjk")
def t03(spark, d):
    return digest(T.split_cjk(docs(spark, d)))


@query("t04_segment_by_tokens", r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, w, text, unnest(range(greatest(1, CAST(ceil(len(w) / 90) AS BIGINT)))) AS i FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk_index, sha256(CASE WHEN len(w) <= 90 THEN text ELSE array_to_string(w[i * 90 + 1 : i * 90 + 90], ' ') END) AS chunk_sha256 FROM g""")
def t04(spark, d):
    return digest(T.segment_by_tokens(docs(spark, d), 100))


@query("t05_split_semantic", "WITH s AS (SELECT conv_id AS doc_id, turn AS n, text, length(text) % 97 / 97.0::DOUBLE AS distance FROM conversations), l AS (SELECT doc_id, quantile_cont(distance, 0.6) AS lim FROM s GROUP BY doc_id), c AS (SELECT s.*, CAST(count(*) FILTER (distance > lim) OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS chunk_index FROM s JOIN l USING (doc_id)) SELECT doc_id, chunk_index, sha256(string_agg(text, ' ' ORDER BY n)) AS chunk_sha256 FROM c GROUP BY ALL")
def t05(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), "text", (F.length("text") % 97 / 97.0).alias("distance"))
    return digest(T.split_semantic(s, 0.6))


@query("t06_split_by_policy")
def t06(spark, d):
    return digest(T.split_by_policy(docs(spark, d)))


@query("t07_prepend_context", "WITH n AS (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 900) / 720)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(i AS INT) AS chunk_index, sha256(substr(text, 1, 200) || chr(10) || chr(10) || substr(text, i * 720 + 1, 900)) AS chunk_sha256 FROM n")
def t07(spark, d):
    return digest(T.prepend_context(T.split_fixed(docs(spark, d), 900, 180), docs(spark, d)))


@query("t08_group_waves", "SELECT doc_id, printf('wave_%03d', CAST(ceil(row_number() OVER (ORDER BY doc_id) / 30.0) AS INT)) AS wave FROM documents")
def t08(spark, d):
    return T.group_waves(docs(spark, d).select("doc_id"), 30, "doc_id")
