"""Metrics, logs, coverage and interval analytics (A operators)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators.joins import join_counted
from corpusloom.operators.retrieval import top
from corpusloom.sources.files import stored


QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
#: Samples of a metric up to which its percentiles come from one aggregate.
BUFFERED = 1 << 20


def summary(samples: DataFrame, kind: str, buffered: int = BUFFERED) -> DataFrame:
    """A1-A4: ``(name, value, ts)`` to one row for each metric: ``counter``, ``gauge``, ``timer`` or ``histogram``. Percentiles are
    exact, between neighbours in proportion. A metric's values are buffered up to ``buffered`` samples; beyond that they are
    selected (``percentiles``), which holds no more of them the more there are."""
    v = F.col("value")
    r = lambda c: F.round(c, 6)
    cols = {
        "counter": [r(F.sum(v)).alias("total"), F.count(v).alias("n"), r(F.avg(v)).alias("mean")],
        "gauge": [F.max_by(v, "ts").alias("current"), F.min(v).alias("low"), F.max(v).alias("high"), r(F.avg(v)).alias("mean")],
        "timer": [F.count(v).alias("n"), r(F.sum(v)).alias("total"), r(F.avg(v)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high")],
    }
    if kind != "histogram":
        return samples.groupBy("name").agg(*cols[kind])
    most = samples.groupBy("name").agg(F.count(v).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= buffered:
        return samples.groupBy("name").agg(*cols["timer"], *(r(F.percentile(v, p)).alias(n) for n, p in QUANTILES))
    timer = samples.groupBy("name").agg(*cols["timer"])
    found = percentiles(samples, QUANTILES, buffered)
    found = found.select(F.col("name").alias("__name"), *(r(F.col(n)).alias(n) for n, _ in QUANTILES))
    return timer.join(found, F.col("name").eqNullSafe(F.col("__name")), "left").drop("__name")


def percentiles(samples: DataFrame, wanted: tuple[tuple[str, float], ...], buffered: int = BUFFERED, parts: int = 16) -> DataFrame:
    """``(name, value)`` to a column for each percentile, by distributed selection: ``parts`` buckets between values that a mergeable
    sketch gives are counted exactly, only the buckets that hold the ranks are kept, and so on until a metric has at most
    ``buffered`` distinct values left. A null name is a metric of its own; null values do not count."""
    spark = samples.sparkSession
    keys = F.broadcast(spark.createDataFrame(list(wanted), "quantile string, p double"))
    rows = samples.where("value IS NOT NULL").groupBy("name", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    rows = stored(rows.withColumn("key", F.to_json(F.struct("name"))), "samples")
    total = rows.groupBy("key", "name").agg(F.sum("n").alias("all")).join(keys)
    rank = F.col("p") * (F.col("all") - 1)
    ranks = stored(total.select(F.concat("key", "quantile").alias("k"), "name", "quantile", F.floor(rank).alias("lower"), F.ceil(rank).alias("upper"), (rank - F.floor(rank)).alias("part"), F.lit(0).cast("long").alias("below")), "ranks")
    rows = rows.join(keys.select("quantile")).select(F.concat("key", "quantile").alias("k"), "value", "n")
    while True:
        cuts = stored(rows.groupBy("k").agg(F.count("*").alias("c"), F.percentile_approx("value", [i / parts for i in range(parts + 1)], 100 * parts).alias("cuts")), "cuts")
        if (cuts.agg(F.max("c")).first()[0] or 0) <= max(buffered, 4 * parts):
            break
        placed = stored(join_counted(rows, cuts, "k", "c").select("k", "value", "n", F.size(F.filter("cuts", lambda x: x <= F.col("value"))).alias("b")), "placed")
        w = Window.partitionBy("k").orderBy("b")  # a row for each bucket
        sums = placed.groupBy("k", "b").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(w) - F.col("m")).join(ranks, "k")
        sums = sums.withColumn("before", F.col("before") + F.col("below"))
        needed = stored(sums.where("before <= upper AND before + m > lower").select("k", "b", "before"), "needed")
        rows = stored(placed.join(F.broadcast(needed.select("k", "b")) if needed.count() < 100_000 else needed.select("k", "b"), ["k", "b"]).select("k", "value", "n"), "rest")
        ranks = stored(ranks.drop("below").join(needed.groupBy("k").agg(F.min("before").alias("below")), "k"), "ranks")
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("value")) + F.col("below")
    found = rows.join(ranks, "k").withColumn("upto", upto).groupBy("name", "quantile").agg(F.min(F.when(F.col("upto") > F.col("lower"), F.col("value"))).alias("lo"), F.min(F.when(F.col("upto") > F.col("upper"), F.col("value"))).alias("hi"), F.first("part").alias("part"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi"))
    return found.groupBy("name").pivot("quantile", [n for n, _ in wanted]).agg(F.first(value))


def approx_histogram(samples: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """A4 for many samples: percentiles from mergeable sketches."""
    return samples.groupBy("name").agg(F.count("value").alias("n"), *(F.percentile_approx("value", p, accuracy).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def metrics_summary(samples: DataFrame, now: str) -> DataFrame:
    """A5: ``(name, type, ts)``: samples of each metric, in all and in the last hour."""
    recent = F.col("ts") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    return samples.groupBy("type", "name").agg(F.count("*").alias("n"), F.count_if(recent).alias("last_hour"))


def metrics_since(samples: DataFrame, since: str, limit: int) -> DataFrame:
    """A6."""
    return top(samples.where(F.col("ts") >= F.lit(since).cast("timestamp")), limit, F.desc("ts"), F.col("id"), keys=("name",), name="back")


def log_categories(lines: DataFrame) -> DataFrame:
    """``(tool, line)``: lines of each tool in each category; a line may be in several."""
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), name) for name, p in rules.LOG_CATEGORIES)))
    return lines.select("tool", F.explode(hits).alias("category")).groupBy("tool", "category").agg(F.count("*").alias("n"))


def http_status_counts(lines: DataFrame) -> DataFrame:
    """A8."""
    s = lines.select("tool", F.regexp_extract("line", r'HTTP/1\.1"\s+(\d{3})', 1).alias("status")).where("status <> ''")
    return s.groupBy("tool", "status").agg(F.count("*").alias("n"))


def log_anomalies(lines: DataFrame) -> DataFrame:
    """``(tool, anomaly)``."""
    errors = log_categories(lines).groupBy("tool").agg(F.sum("n").alias("errors"), F.max(F.col("category") == "Out of Memory").alias("oom"), F.max(F.col("category") == "Permission Denied").alias("denied"))
    http = http_status_counts(lines).groupBy("tool").agg(F.sum(F.when(F.col("status").rlike("^[45]"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all"))
    df = errors.join(http, "tool", "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("errors") > 100, F.format_string("High error count: %d errors found", "errors")),
        F.when(F.col("bad") / F.col("all") > 0.1, F.format_string("High HTTP error rate: %.1f%% (%d/%d)", F.col("bad") / F.col("all") * 100, "bad", "all")),
        F.when(F.col("oom"), "Critical: Out of Memory errors detected"),
        F.when(F.col("denied"), "Critical: Permission Denied errors detected"),
    ))
    return df.select("tool", F.explode(found).alias("anomaly"))


def filter_log_lines(lines: DataFrame, now: str, days: int = 7) -> DataFrame:
    """A10: ``(tool, line, ts)``: error and warning lines within retention, with their date as a partition column."""
    level = F.when(F.col("line").rlike("(?i)error|exception|traceback|critical|fatal"), "error").when(F.col("line").rlike("(?i)warn"), "warning")
    return lines.withColumns({"level": level, "date": F.to_date("ts")}).where(F.col("level").isNotNull() & (F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))


def consecutive_blocks(lines: DataFrame) -> DataFrame:
    """``(file, line)`` to ``(file, start_line, end_line)`` of runs of consecutive numbers."""
    w = Window.partitionBy("file").orderBy("line")
    island = lines.distinct().withColumn("i", F.col("line") - F.row_number().over(w))
    return island.groupBy("file", "i").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("i")


def symbol_coverage(symbols: DataFrame, executed: DataFrame, block: int = 64) -> DataFrame:
    """Executed lines within each symbol's span. A span stands in every block of ``block`` lines that it touches, so
    a line meets only the symbols around it."""
    runs = executed.select("file", "line", F.floor(F.col("line") / block).alias("b")).distinct()
    spans = symbols.select("file", "symbol", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("b"))
    n = spans.join(runs, ["file", "b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("file", "symbol").agg(F.count("line").alias("executed"))
    size = F.col("end_line") - F.col("start_line") + 1
    out = symbols.join(n, ["file", "symbol"], "left").withColumn("executed", F.coalesce("executed", F.lit(0)))
    return out.select("file", "symbol", "executed", F.round(F.col("executed") / size, 6).alias("ratio"), F.when(F.col("executed") > 0, "touched").otherwise("unused").alias("status"))


def correlate_findings(findings: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Findings ``(file, line, confidence)`` on uncovered lines, weighed with how uncovered the lines around are."""
    u = uncovered.select("file", "line").distinct()
    on = findings.join(u, ["file", "line"], "left_semi")
    # A line within five of another is in the same or a neighbouring bucket of ten.
    near = u.select("file", F.col("line").alias("other"), F.explode(F.sequence(F.floor(F.col("line") / 10) - 1, F.floor(F.col("line") / 10) + 1)).alias("b"))
    local = on.select("file", "line").distinct().withColumn("b", F.floor(F.col("line") / 10)).join(near, ["file", "b"]).where(F.abs(F.col("line") - F.col("other")) <= 5).groupBy("file", "line").agg((F.count("*") / 11 * 100).alias("local"))
    df = on.join(local, ["file", "line"]).withColumn("total", F.round((F.col("confidence") + F.col("local")) / 2, 6))
    return df.select("file", "line", "confidence", "total", F.when(F.col("total") >= 80, "high").when(F.col("total") >= 60, "medium").otherwise("low").alias("level"))


def audit_events(events: DataFrame, by: str, n: int = 100) -> DataFrame:
    """The latest events of each session or type."""
    return top(events, n, F.desc("ts"), F.desc("event_id"), keys=(by,), name="back")


def circuit_steps(rows: pd.DataFrame, state: dict, threshold: int, reset: float) -> list[tuple]:
    """The circuit after each event in time order; ``state`` is carried on."""
    out = []
    for at, ok in zip(rows["ts"], rows["ok"]):
        t = at.timestamp()
        if state["circuit"] == "open" and t - state["last"] >= reset:
            state["circuit"] = "half-open"
        if ok:
            if state["circuit"] == "half-open":
                state["circuit"], state["failures"] = "closed", 0
            elif state["circuit"] == "closed":
                state["failures"] = max(0, state["failures"] - 1)
        else:
            state["failures"] += 1
            state["last"] = t
            if state["circuit"] == "half-open" or state["circuit"] == "closed" and state["failures"] >= threshold:
                state["circuit"] = "open"
        out.append((at, state["circuit"], state["failures"]))
    return out


def pressure_actions(events: DataFrame, threshold: int = 5, reset: float = 60.0) -> DataFrame:
    """``(source, ts, ok)`` to the circuit of each source after each event. A source's events reach Python sorted, in
    batches, so its length is not bounded by memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state = None, {}
        for df in batches:
            for key, part in df.groupby("source", sort=False):
                if key != source:
                    source, state = key, {"circuit": "closed", "failures": 0, "last": 0.0}
                yield pd.DataFrame([(key, *x) for x in circuit_steps(part, state, threshold, reset)], columns=["source", "ts", "circuit", "failures"])

    ordered = events.select("source", "ts", "ok").repartition("source").sortWithinPartitions("source", "ts", "ok")
    return ordered.mapInPandas(run, "source string, ts timestamp, circuit string, failures int")


def overlap_summary(intervals: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(op, start, end, ok)``, seconds, to one row for each pair of operations: how many of either, how many of these were
    ok, and how many pairs overlap, ``max(start) < min(end)``.

    No pair is made. The b-intervals that overlap an a-interval are those that start before its end, less those that end before or at
    its start: two ranks. Starts and ends are sorted over ranges, each range is counted, and ranks run within a range from
    the counts of those before, so the rows are linear in the intervals. Intervals without a positive length overlap nothing."""
    spark = intervals.sparkSession
    names = sorted({x for p in pairs for x in p})
    rows = intervals.where(F.col("op").isin(names))
    sizes = rows.groupBy("op").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    ends = F.explode(F.array(F.struct(F.col("end").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("start").alias("t"), F.lit(1).alias("kind")))).alias("e")
    points = rows.where(F.col("start") < F.col("end")).select("op", ends).groupBy("e.t", "e.kind", "op").agg(F.count("*").alias("n"))
    # At one time ends come before starts.
    points = stored(points.repartitionByRange("t", "kind").withColumn("range", F.spark_partition_id()), "points")
    second = sorted({b for _, b in pairs})
    of = lambda kind, b: F.sum(F.when((F.col("kind") == kind) & (F.col("op") == b), F.col("n")).otherwise(0))
    columns = {f"{p}{i}": of(kind, b) for i, b in enumerate(second) for p, kind in (("s", 1), ("e", 0))}
    whole = points.groupBy("range").agg(*(c.alias(k) for k, c in columns.items()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = whole.select("range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_") for k in columns))
    upto = Window.partitionBy("range").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.select("*", *(F.coalesce(c.over(upto), F.lit(0)).alias(k) for k, c in columns.items())).join(F.broadcast(base), "range")
    rank = lambda k: F.col("n") * (F.col(k) + F.col(f"{k}_"))
    sums = ranked.groupBy("op").agg(*(F.sum(F.when(F.col("kind") == 0, rank(f"s{i}")).otherwise(-rank(f"e{i}"))).alias(f"o{i}") for i in range(len(second))))
    sums = sums.unpivot("op", [f"o{i}" for i in range(len(second))], "b", "overlap_pairs")
    wanted = spark.createDataFrame([(a, b, f"o{second.index(b)}") for a, b in pairs], "a string, b string, o string")
    out = wanted.join(sums.select(F.col("op").alias("a"), F.col("b").alias("o"), "overlap_pairs"), ["a", "o"], "left")
    for p in "ab":
        out = out.join(sizes.select(F.col("op").alias(p), F.col("n").alias(f"{p}_count"), F.col("ok").alias(f"{p}_ok")), p, "left")
    return out.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a_count", "b_count", "overlap_pairs", "a_ok", "b_ok")))


def interval_overlaps(a: DataFrame, b: DataFrame, tick: float = 1.0) -> DataFrame:
    """A16 where the pairs are wanted: ``(id, start, end, ok)``, seconds. One interval of a pair begins within the other, so each
    interval is covered by at most two dyadic spans of ticks for each power of two up to the range of all times, and each beginning
    asks the one span of every size that holds it. Of a cover one span at most holds a tick: a pair is made once."""
    low = lambda df: df.where(F.col("start") < F.col("end")).agg(F.min("start").alias("low"), F.max("end").alias("high"))
    r = low(a.select("start", "end").unionByName(b.select("start", "end"))).first()
    zero = math.floor((r["low"] or 0) / tick)
    levels = max(1, (math.floor((r["high"] or 0) / tick) - zero + 1).bit_length())
    place = lambda c: (F.floor(F.col(c) / tick) - zero).cast("long")
    shift = lambda x, n: F.call_function("shiftright", x, n)

    def covered(df: DataFrame, p: str) -> DataFrame:
        def spans(n: Column) -> Column:
            size = F.call_function("shiftleft", F.lit(1).cast("long"), n)
            first, last = shift(F.col("lo") + size - 1, n), shift(F.col("hi") + 1, n) - 1
            node = lambda ok, x: F.when((first <= last) & ok, F.struct(n.alias("level"), x.alias("at")))
            return F.array(node(first % 2 == 1, first), node(last % 2 == 0, last))

        every = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), spans)))
        return named(df, p).withColumns({"lo": place(f"{p}_start"), "hi": place(f"{p}_end")}).withColumn("node", F.explode(every)).drop("lo", "hi")

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.col("start") < F.col("end")).select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "start", "end", "ok")))

    def begun(df: DataFrame, p: str) -> DataFrame:
        at = place(f"{p}_start")
        return named(df, p).withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(n.alias("level"), shift(at, n).alias("at")))))

    inside = covered(b, "b").join(begun(a, "a"), "node").where("b_start <= a_start AND a_start < b_end")
    around = covered(a, "a").join(begun(b, "b"), "node").where("a_start < b_start AND b_start < a_end")
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return inside.unionByName(around).select("a_id", "b_id", F.round(overlap, 6).alias("overlap"), "a_ok", "b_ok")


def ingestion_summary(samples: DataFrame, names: list[str]) -> DataFrame:
    """One row of totals, a column for each named metric."""
    return samples.groupBy().pivot("name", names).agg(F.round(F.sum("value"), 6))


def orphaned_lines(executable: DataFrame, covered: DataFrame) -> DataFrame:
    """Of each file executable and uncovered lines, and whether none is covered."""
    lines = executable.select("file", "line").distinct()
    bare = lines.join(covered.select("file", "line").distinct(), ["file", "line"], "left_anti").groupBy("file").agg(F.count("*").alias("orphaned"))
    df = lines.groupBy("file").agg(F.count("*").alias("executable")).join(bare, "file", "left").withColumn("orphaned", F.coalesce("orphaned", F.lit(0)))
    return df.withColumn("uncovered", F.col("orphaned") == F.col("executable"))
