"""Conversation memory (M operators) over ``messages(conv_id, turn, role, text)``, all conversations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import any_of
from corpusloom.operators.retrieval import combine_kb_memory, mmr, top

def by_conversation():
    return Window.partitionBy("conv_id")


def _joined(by: str, text: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def recent_window(messages: DataFrame, n: int = 10) -> DataFrame:
    """M1: the last ``n`` messages of each conversation."""
    return top(messages, n, F.desc("turn"), keys=("conv_id",), name="back")


def format_recent(recent: DataFrame) -> DataFrame:
    """M1: recent messages as one text; system messages are left out."""
    return recent.where("role <> 'system'").groupBy("conv_id").agg(_joined("turn", F.concat("role", F.lit(": "), "text")).alias("recent"))


def should_compress(messages: DataFrame, window: int = 10, limit_kb: float = 64, threshold: float = 0.8) -> DataFrame:
    """M2: more than twice the window, or near the size limit (UTF-8 bytes of the texts and roles)."""
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("bytes")).withColumn("compress", (F.col("n") > 2 * window) | (F.col("bytes") / 1024 >= limit_kb * threshold))


def turning_points(messages: DataFrame) -> DataFrame:
    """M3: first and last messages, questions, and messages with a marker (substrings, so "no" is found in "know")."""
    ends = (F.col("turn") == F.min("turn").over(by_conversation())) | (F.col("turn") == F.max("turn").over(by_conversation()))
    low = F.lower(F.coalesce("text", F.lit("")))
    return messages.withColumn("turning", ends | F.contains(low, F.lit("?")) | any_of(low, rules.TURNING))


def pareto_compress(messages: DataFrame, ratio: float = 0.2) -> DataFrame:
    """M4: the messages that stay: all of three or fewer; all turning points if they are few enough, else the first, the
    last and evenly spaced ones between."""
    df = turning_points(messages).withColumn("n", F.count("*").over(by_conversation()))
    df = df.where((F.col("n") <= 3) | F.col("turning"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    df = df.withColumns({"k": F.count("*").over(by_conversation()), "i": F.row_number().over(order)})
    target = F.greatest(F.lit(3), F.floor(F.col("n") * ratio + 1e-9).cast("int"))
    middle = F.col("k") - 2
    step = F.greatest(F.lit(1), F.floor(middle / (target - 2)).cast("int"))
    spaced = (F.col("i") == 1) | (F.col("i") == F.col("k")) | (((F.col("i") - 2) % step == 0) & ((F.col("i") - 2) / step < target - 2))
    return df.where((F.col("n") <= 3) | (F.col("k") <= target) | spaced).select(*messages.columns)


def format_summary(kept: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """M5: ``role: text`` lines, texts over 200 characters cut."""
    def cut(t: Column, n: Column) -> Column:
        return F.when(F.length(t) > n, F.concat(F.left(t, n - 3), F.lit("..."))).otherwise(t)

    text = cut(F.col("text"), F.lit(200))
    if max_tokens:
        kept = kept.withColumn("__n", F.floor(F.lit(max_tokens * 4) / F.count("*").over(by_conversation())).cast("int"))
        text = cut(text, F.col("__n"))
    return kept.groupBy("conv_id").agg(_joined("turn", F.concat("role", F.lit(": "), text)).alias("summary"))


def key_quotes(messages: DataFrame, most: int = 5) -> DataFrame:
    """M6: ``(conv_id, place, quote)``: user questions, definitive statements, and sentences with a path or a number. A message
    in which no single sentence is one (a path across a full stop, only short sentences) gives no such quote."""
    t = F.col("text")
    sentences = F.split(t, "[.!?]")
    question = F.when((F.col("role") == "user") & F.contains(t, F.lit("?")), F.trim(F.regexp_extract(t, r"[^.!?]*\?", 0)))
    definite = F.when((F.col("role") == "assistant") & any_of(F.lower(t), rules.DEFINITIVE), F.trim(F.get(F.filter(sentences, lambda x: F.length(F.trim(x)) > 30), F.lit(0))))
    detail = F.when(t.rlike(r"/[^\s]+|[0-9]{2,}"), F.trim(F.get(F.filter(sentences, lambda x: x.rlike(r"/[^\s]+|[0-9]{2,}")), F.lit(0))))
    found = F.array_compact(F.array(question, definite, detail))
    each = messages.where(F.length(t) >= 20).select("conv_id", "turn", "role", F.posexplode(found).alias("pos", "q"))
    return top(each, most, F.col("turn"), F.col("pos"), keys=("conv_id",), name="place").select("conv_id", "place", F.concat("role", F.lit(": "), "q").alias("quote"))


def weighted_keywords(messages: DataFrame, most: int = 20) -> DataFrame:
    """M7: ``(conv_id, place, keyword, weight)``: words weighted by their looks, summed over a conversation."""
    words = messages.select("conv_id", "turn", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("pos", "w"))
    clean = F.lower(F.regexp_replace("w", r"[^\p{L}\p{N}_\-./]", ""))
    weight = (
        F.when(F.col("w").rlike("^[a-z]+[A-Z]"), 3)
        .when(F.contains("k", F.lit("_")), 3)
        .when(F.col("k").rlike(r"^[\p{L}\p{N}_]+\.(pdf|xlsx|docx|txt|py|js|json)"), 4)
        .when(F.col("k").startswith("/"), 3)
        .when(F.col("w").rlike(r"^\p{Lu}") & (F.length("w") > 3), 2)
        .when(F.length("k") > 6, 1)
    )
    words = words.withColumn("k", clean).where(F.length("k") >= 3).where(~F.col("k").isin(rules.SNAPSHOT_STOPWORDS)).withColumn("weight", weight).where("weight IS NOT NULL")
    total = words.groupBy("conv_id", "k").agg(F.sum("weight").alias("weight"), F.min(F.struct("turn", "pos")).alias("first"))
    return top(total, most, F.desc("weight"), F.col("first"), keys=("conv_id",), name="place").select("conv_id", "place", F.col("k").alias("keyword"), "weight")


def build_snapshots(messages: DataFrame, now: str) -> DataFrame:
    """M8: one row for each conversation with summary, quotes, keywords, counts and expiry."""
    kept = pareto_compress(messages)
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages")).join(kept.groupBy("conv_id").agg(F.count("*").alias("n_kept")), "conv_id")
    quotes = key_quotes(messages).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quote"))), lambda x: x["quote"]).alias("quotes"))
    words = weighted_keywords(messages).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    none = F.array().cast("array<string>")
    df = counts.join(format_summary(kept), "conv_id").join(quotes, "conv_id", "left").join(words, "conv_id", "left")
    return df.withColumns({"quotes": F.coalesce("quotes", none), "keywords": F.coalesce("keywords", none), "ratio": F.round(F.col("n_kept") / F.col("n_messages"), 6), "ttl_at": F.lit(now).cast("timestamp") + F.expr("INTERVAL 30 DAYS")})


def snapshot_due(messages: DataFrame, last: DataFrame, now: str) -> DataFrame:
    """M9: ``last(conv_id, taken_at)``."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n")).join(last, "conv_id", "left")
    old = F.col("taken_at").isNull() | (F.col("taken_at") <= F.lit(now).cast("timestamp") - F.expr("INTERVAL 30 MINUTES"))
    return n.withColumn("due", (F.col("n") >= 10) & old)


def live_snapshots(snapshots: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """Each user's snapshots that are pinned or not expired, newest first."""
    live = snapshots.where(F.col("pinned") | (F.col("ttl_at") > F.lit(now).cast("timestamp")))
    return top(live, limit, F.desc("taken_at"), F.col("snapshot_id"), keys=("user_id",), name="place")


def expired_snapshots(snapshots: DataFrame, now: str) -> DataFrame:
    """M11."""
    return snapshots.where(~F.col("pinned") & (F.col("ttl_at") <= F.lit(now).cast("timestamp")))


def search_snapshots(hits: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """A user's best hits among live snapshots; ``hits(query_id, id, score)`` come from vector or hybrid search."""
    return top(hits.drop("rank").join(live.select(F.col("snapshot_id").alias("id"), F.col("user_id").alias("query_id")), ["query_id", "id"], "left_semi"), k, F.desc("score"), F.col("id"))


def memory_context(snapshots: DataFrame, max_length: int = 2000) -> DataFrame:
    """``(query_id, rank, title, summary, quotes)``: sections in rank order up to the first that exceeds the budget."""
    quotes = F.array_join(F.transform(F.slice("quotes", 1, 3), lambda q: F.concat(F.lit("- "), q)), "\n")
    section = F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.left("summary", F.lit(300)), F.nullif(quotes, F.lit("")))
    df = snapshots.withColumn("section", section)
    used = F.sum(F.length("section")).over(Window.partitionBy("query_id").orderBy("rank"))
    fits = df.withColumn("used", used).where(F.col("used") <= max_length)
    return fits.groupBy("query_id").agg(_joined("rank", F.col("section"), "\n\n").alias("context"))


def retrieve_with_memory(kb: DataFrame, memory: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Queries with past snapshots fuse both sides and diversify; others keep their first ``k`` hits."""
    past = memory.where("rank <= 5")
    both = kb.join(past.select("query_id").distinct(), "query_id", "left_semi")
    fused = combine_kb_memory(both, past, 2 * k).select("query_id", F.col("id").try_cast("long").alias("id"), "rank", F.col("rrf").alias("score"))
    diverse = mmr(fused.join(vectors.select("id", "v"), "id", "left"), k=k)
    rest = kb.join(past.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
    return diverse.unionByName(rest.select("query_id", "id", "rank", "score"))


def context_with_budget(rows: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """``(system, question, tools, recent, documents, summary)`` texts, null where absent, to ``context``."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    df = rows.withColumns({"a": F.concat(F.lit("# System\n"), "system"), "z": F.concat(F.lit("# Current question\n"), "question")})
    df = df.withColumn("left", F.lit(max_tokens * 4) - n(F.col("a")) - n(F.col("z")))
    df = df.withColumn("t", F.when((n(F.col("tools")) > 0) & (n(F.col("tools")) < F.col("left") * 0.2), F.col("tools"))).withColumn("left", F.col("left") - n(F.col("t")))
    budget = F.floor(F.col("left") * 0.4).cast("int")
    df = df.withColumn("r", F.when(n(F.col("recent")) > 0, F.when(n(F.col("recent")) > budget, F.right("recent", budget)).otherwise(F.col("recent")))).withColumn("left", F.col("left") - n(F.col("r")))
    df = df.withColumn("d", F.when((n(F.col("documents")) > 0) & (F.col("left") > 0), F.when(n(F.col("documents")) > budget, F.concat(F.left("documents", budget), F.lit("..."))).otherwise(F.col("documents")))).withColumn("left", F.col("left") - n(F.col("d")))
    df = df.withColumn("s", F.when((F.col("left") > 100) & (n(F.col("summary")) > 0), F.when(n(F.col("summary")) > F.col("left"), F.concat(F.left("summary", F.col("left")), F.lit("..."))).otherwise(F.col("summary"))))
    titled = lambda h, c: F.concat(F.lit(h), F.col(c))
    return df.withColumn("context", F.concat_ws("\n\n", "a", titled("# Previous summary\n", "s"), titled("# Recent messages\n", "r"), titled("# ", "t"), titled("# Relevant documents\n", "d"), "z")).drop("a", "z", "left", "t", "r", "d", "s")


def tool_log(events: DataFrame, n: int | None = None) -> DataFrame:
    """``(thread_id, ts, event_id, ...)``: tool events numbered ``doc#1`` and so on, or only the newest ``n``."""
    w = Window.partitionBy("thread_id").orderBy("ts", "event_id")
    df = events.withColumns({"place": F.row_number().over(w), "back": F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("ts"), F.desc("event_id")))})
    df = df.withColumn("doc_id", F.concat(F.lit("doc#"), "place"))
    return df.where(F.col("back") <= n) if n else df


# Words of a reference to a tool result, in order, and what they point to.
REFERENCES = (
    ("excel", "ext", r"\.(xlsx|xls|xlsm)$"), ("spreadsheet", "ext", r"\.(xlsx|xls|xlsm)$"), ("pdf", "ext", r"\.pdf$"), ("word", "ext", r"\.(docx|doc)$"), ("docx", "ext", r"\.(docx|doc)$"), ("archive", "tool", "archive"), ("zip", "tool", "archive"), ("ocr", "tool", "ocr"), ("scan", "tool", "ocr"),
)


def resolve_tool_reference(queries: DataFrame, log: DataFrame) -> DataFrame:
    """``queries(query_id, thread_id, text)`` against a numbered log ``(thread_id, doc_id, place, tool, file_path)``:
    by ``doc#n``, "the document", kind of file or tool (latest first), "first", else the latest.

    The log is reduced to the latest row of each thread and kind first, which queries then look up, so a query never meets its
    thread's whole log."""
    kinds = [F.lit("any"), F.when(F.col("place") == 1, "first"), F.col("doc_id")]
    kinds += [F.when(F.lower("file_path").rlike(p) if kind == "ext" else F.col("tool") == p, p) for kind, p in dict.fromkeys((k, p) for _, k, p in REFERENCES)]
    rows = log.select("thread_id", "place", "doc_id", "file_path", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    latest = rows.groupBy("thread_id", "kind").agg(F.max_by(F.struct("doc_id", "file_path"), "place").alias("row"))
    q = F.lower("text")
    said = lambda w: F.contains(q, F.lit(w))
    asks = [F.when((said("document") | said("file")) & (said("last") | said("latest") | (q == "the document")), "any")]
    asks += [F.when(said(w), p) for w, _, p in REFERENCES] + [F.when(said("first"), "first"), F.lit("any")]
    wanted = F.when(q.startswith("doc#"), F.array(q)).otherwise(F.array_compact(F.array(*asks)))
    found = queries.select("query_id", "thread_id", F.posexplode(wanted).alias("p", "kind")).join(latest, ["thread_id", "kind"])
    return found.groupBy("query_id", "thread_id").agg(F.min_by("row", "p").alias("row")).select("query_id", "thread_id", "row.doc_id", "row.file_path")


def checkpoints(writes: DataFrame, now: str, ttl: str = "1 day") -> DataFrame:
    """``(thread_id, namespace, payload, ts)`` writes and reads (payload null): the last payload of each key, if its
    last touch is within ``ttl``."""
    last = writes.groupBy("thread_id", "namespace").agg(F.max_by("payload", F.when(F.col("payload").isNotNull(), F.col("ts"))).alias("payload"), F.max("ts").alias("touched"))
    return last.where(F.col("payload").isNotNull() & (F.col("touched") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl}")))
