"""Evidence and conflict analytics (E operators) over hits ``(query_id, rank, source, text, score)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.columns import fixed
from corpusloom.operators.retrieval import cosine
from corpusloom.sources.files import stored


def _sources(by: str = "rank"):
    return F.transform(F.array_sort(F.collect_list(F.struct(by, "source"))), lambda x: x["source"])


def year_conflicts(hits: DataFrame) -> DataFrame:
    """A conflict of every older year against a query's latest, with the sources of both."""
    year = F.regexp_extract("text", r"\b(20\d{2})\b", 1)
    by = hits.withColumn("year", year).where("year <> ''").groupBy("query_id", F.col("year").cast("int").alias("year")).agg(_sources().alias("sources"))
    last = by.groupBy("query_id").agg(F.max(F.struct("year", "sources")).alias("m"))
    return by.join(last, "query_id").where("year < m.year").select("query_id", F.col("year").alias("stale_year"), F.col("m.year").alias("current_year"), F.col("sources").alias("stale_sources"), F.col("m.sources").alias("current_sources"))


def status_conflicts(hits: DataFrame) -> DataFrame:
    """Queries with hits marked as current and hits marked as obsolete."""
    low = F.lower("text")
    marked = hits.withColumns({"current": F.contains(low, F.lit("vigente")), "obsolete": F.contains(low, F.lit("obsoleto")) | F.contains(low, F.lit("deprecated"))}).where("current OR obsolete")
    lists = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("current"), F.struct("rank", "source")))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("obsolete"), F.struct("rank", "source")))).alias("o"))
    names = lambda c: F.transform(c, lambda x: x["source"])
    return lists.where("size(c) > 0 AND size(o) > 0").select("query_id", names("c").alias("current_sources"), names("o").alias("stale_sources"))


def resolve_conflicts(conflicts: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, type)``: by recency, by status, else by the best-scored source, else unresolved."""
    best = hits.groupBy("query_id").agg(F.max(F.struct("score", F.col("source"))).alias("b"))
    df = conflicts.join(best.select("query_id", F.col("b.source").alias("best")), "query_id", "left")
    rule = F.when(F.col("type") == "year_discrepancy", "rule_recency").when(F.col("type") == "vigente_conflict", "rule_vigente").when(F.col("best").isNotNull(), "rule_score").otherwise("unresolved")
    return df.withColumns({"resolution": rule, "chosen": F.when(rule == "rule_score", F.col("best"))}).drop("best")


def confidence_heuristic(queries: DataFrame, hits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """From the mean of the first ten scores, the amount of evidence, and the number of conflicts."""
    e = hits.groupBy("query_id").agg(F.avg(F.when(F.col("rank") <= 10, F.col("score"))).alias("mean"), F.count("*").alias("n"))
    c = conflicts.groupBy("query_id").agg(F.count("*").alias("k"))
    df = queries.select("query_id").join(e, "query_id", "left").join(c, "query_id", "left")
    base = F.when(F.col("n").isNull(), 0.0).when(F.col("mean").isNull(), 0.2).otherwise(F.least(F.col("mean") + F.least(F.col("n") * 0.02, F.lit(0.15)), F.lit(0.85)))
    return df.select("query_id", F.bround(F.greatest(F.lit(0.0), base - F.least(F.coalesce("k", F.lit(0)) * 0.1, F.lit(0.3))), 3).alias("confidence"))


def confidence_semantic(hits: DataFrame) -> DataFrame:
    """E5: the mean cosine (``score``) of the first five, weighted by 1 / rank."""
    return hits.where("rank <= 5").groupBy("query_id").agg(F.round(F.sum(F.col("score") / F.col("rank")) / F.sum(1.0 / F.col("rank")), 6).alias("confidence"))


def pair_consistency(scores: DataFrame, most: int = 8) -> DataFrame:
    """``(query_id, hypothesis, fact_rank, fact, support, neutral, contradict)``, the three scores of a model: support
    less contradiction over the first facts, and the first three contradicting facts where negative."""
    label = F.when((F.col("support") >= F.col("neutral")) & (F.col("support") >= F.col("contradict")), 1).when(F.col("contradict") > F.col("neutral"), -1).otherwise(0)
    df = scores.where(F.col("fact_rank") <= most).withColumn("l", label)
    by = df.groupBy("query_id", "hypothesis").agg(F.count_if(F.col("l") == 1).alias("s"), F.count_if(F.col("l") == -1).alias("c"), F.array_sort(F.collect_list(F.when(F.col("l") == -1, F.struct("fact_rank", "fact")))).alias("against"))
    value = (F.col("s") - F.col("c")) / F.greatest(F.lit(1), F.col("s") + F.col("c"))
    return by.select("query_id", "hypothesis", F.round(value, 6).alias("consistency"), F.when(value < 0, F.transform(F.slice("against", 1, 3), lambda x: x["fact"])).alias("contradicting"))


def low_similarity(hypotheses: DataFrame, facts: DataFrame, limit: float = 0.3) -> DataFrame:
    """``(query_id, hypothesis, h)`` and ``(query_id, f)``, unit vectors: hypotheses unlike their facts on average."""
    pairs = hypotheses.join(facts, "query_id").groupBy("query_id", "hypothesis").agg(F.round(F.avg(cosine(F.col("h"), F.col("f"))), 6).alias("similarity"))
    return pairs.withColumn("low", F.col("similarity") < limit)


def escalate(confidence: DataFrame, conflicts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """E8."""
    c = conflicts.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("resolution") == "unresolved").alias("u"))
    df = confidence.join(c, "query_id", "left").na.fill(0, ["n", "u"])
    yes = (F.col("confidence") < threshold) | (F.col("n") > 2) | (F.col("u") > 0)
    return df.select("query_id", "confidence", yes.alias("escalate"), F.format_string("confidence=%.3f conflicts=%d unresolved=%d", "confidence", "n", "u").alias("summary"))


def structured_answer(evidence: DataFrame, conflicts: DataFrame | None = None, hypotheses: DataFrame | None = None) -> DataFrame:
    """``(query_id, answer, key_points)``: the first eight facts, then conflicts ``(query_id, note)`` and hypotheses
    ``(query_id, place, hypothesis)``, the first three of each."""
    line = F.concat(F.lit("- ["), "source", F.lit("] "), F.left("text", F.lit(250)))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.left("text", F.lit(120)).alias("point"))))
    df = evidence.where("rank <= 8").groupBy("query_id").agg(ordered.alias("e"))
    df = df.select("query_id", F.concat(F.lit("CONFIRMED FACTS:\n"), F.array_join(F.transform("e", lambda x: x["line"]), "\n")).alias("a"), F.transform(F.slice("e", 1, 3), lambda x: x["point"]).alias("key_points"))
    sections = ["a"]
    if conflicts is not None:
        notes = conflicts.groupBy("query_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("note")), 1, 3), lambda x: F.concat(F.lit("- "), x)), "\n").alias("n"))
        df = df.join(notes.select("query_id", F.concat(F.lit("CONFLICTS:\n"), "n").alias("c")), "query_id", "left")
        sections.append("c")
    if hypotheses is not None:
        top3 = hypotheses.where("place <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hypothesis"))), lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["hypothesis"])), "\n").alias("t"))
        df = df.join(top3.select("query_id", F.concat(F.lit("HYPOTHESES:\n"), "t").alias("h")), "query_id", "left")
        sections.append("h")
    return df.select("query_id", F.concat_ws("\n\n", *sections).alias("answer"), "key_points")


#: The titles of a summary's sections in order, and the line between sections.
SECTIONS = {"facts": "HECHOS RECUPERADOS", "memory": "MEMORIA DE SESIÓN", "math": "RESULTADO MATEMÁTICO", "code": "ANÁLISIS DE CÓDIGO", "conflicts": "CONFLICTOS DE VERSIÓN", "hypotheses": "HIPÓTESIS"}
RULE = "\n" + "─" * 60 + "\n"


def merge_evidence(queries: DataFrame, hits: DataFrame, memory: DataFrame, math: DataFrame, code: DataFrame, conflicts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``(query_id, summary)``: one text of all evidence of each query, in sections that are left out where empty.

    ``hits`` and ``memory`` are ``(query_id, rank, source, score, text)``, ``math`` is ``(query_id, result)`` (P28), ``code`` is
    ``(query_id, language, result, issues)`` (P27), ``conflicts`` ``(query_id, note)``, ``hypotheses`` ``(query_id, place,
    hypothesis)``. A query without evidence has an empty summary."""

    def section(name: str, body):
        return F.concat(F.lit(f"### {SECTIONS[name]}\n"), body).alias(name)

    def found(df: DataFrame, name: str) -> DataFrame:
        source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" "), "source")).otherwise("")
        number = lambda x, i: F.concat(F.format_string("[%d]", i + 1), x["head"], F.lit("\n"), x["text"])
        head = F.concat(source, F.format_string(" (score=%s)", fixed(F.coalesce("score", F.lit(0.0)).cast("double"), 2)))
        rows = F.array_sort(F.collect_list(F.struct("rank", head.alias("head"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))))
        return df.groupBy("query_id").agg(section(name, F.array_join(F.transform(rows, number), "\n")))

    lines = [
        F.concat(F.lit("Lenguaje: "), F.nullif("language", F.lit(""))),
        F.concat(F.lit("Resultado:\n"), F.nullif("result", F.lit(""))),
        F.when(F.size("issues") > 0, F.concat(F.lit("Problemas: "), F.array_join("issues", "; "))),
    ]
    notes = F.array_join(F.transform(F.array_sort(F.collect_list("note")), lambda x: F.concat(F.lit("- "), x)), "\n")
    guesses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hypothesis"))), lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["hypothesis"])), "\n")
    parts = [
        found(hits, "facts"),
        found(memory, "memory"),
        math.where("result IS NOT NULL").select("query_id", section("math", F.concat(F.lit("Resultado: "), F.col("result").cast("string")))),
        code.select("query_id", section("code", F.concat_ws("\n", *lines))),
        conflicts.groupBy("query_id").agg(section("conflicts", notes)),
        hypotheses.groupBy("query_id").agg(section("hypotheses", guesses)),
    ]
    out = queries.select("query_id").distinct()
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out.select("query_id", F.concat_ws(RULE, *SECTIONS).alias("summary"))


def fallback_facts(hits: DataFrame) -> DataFrame:
    """The first five hits, cut to 200 characters."""
    return hits.where("rank <= 5").select("query_id", "rank", F.left("text", F.lit(200)).alias("fact"))


def fallback_hypothesis(hits: DataFrame) -> DataFrame:
    """The best hit, cut to 300 characters."""
    return hits.groupBy("query_id").agg(F.left(F.min_by("text", "rank"), F.lit(300)).alias("hypothesis"))


def find_conflicts(hits: DataFrame) -> DataFrame:
    """E1 and E2 as rows ``(query_id, type, note)``. They are stored, as all that follows reads them several times."""
    years, status = year_conflicts(hits), status_conflicts(hits)
    rows = years.select("query_id", F.lit("year_discrepancy").alias("type"), F.format_string("Year %d against %d", "stale_year", "current_year").alias("note"))
    return stored(rows.unionByName(status.select("query_id", F.lit("vigente_conflict").alias("type"), F.lit("Current and obsolete sources").alias("note"))), "conflicts")


def evidence_report(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The whole pipeline: conflicts, their resolution, confidence, escalation and answer of every query. A query's hits are
    bounded (R17) before, and stored here, since every step reads them."""
    hits = stored(hits, "hits")
    conflicts = find_conflicts(hits)
    resolved = resolve_conflicts(conflicts, hits)
    verdict = escalate(confidence_heuristic(queries, hits, conflicts), resolved)
    return verdict.join(structured_answer(hits, conflicts), "query_id", "left")
