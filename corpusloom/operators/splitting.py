"""Text splitting (T operators): documents to chunks ``(doc_id, chunk_index, chunk_text)``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import let
from corpusloom.functions.text import effective_limit, script_profile, split_policy

SEPARATORS = ("\n\n", "\n", " ", "")
CHUNKS = "doc_id long, chunk_index int, chunk_text string"


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, neighbours sharing up to ``overlap``."""
    sep = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for i, x in enumerate(text.split(sep)) if (p := (sep if i else "") + x)]
    out: list[str] = []
    run: list[str] = []
    length = 0

    def close() -> None:
        if run and (joined := "".join(run).strip()):
            out.append(joined)

    for p in parts:
        if len(p) > size and finer:
            close()
            run, length = [], 0
            out += recursive_pieces(p, size, overlap, finer)
            continue
        if run and length + len(p) > size:
            close()
            while run and (length > overlap or length + len(p) > size):
                length -= len(run.pop(0))
        run.append(p)
        length += len(p)
    close()
    return out


def cjk_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed up to ``size``; longer ones cut; each piece but the first begins with the end of the one before."""
    packed: list[str] = []
    for sentence in (s for s in re.split(r"(?<=[。！？!?])", text) if s.strip()):
        if len(sentence) > size:
            packed += [sentence[i : i + size] for i in range(0, len(sentence), size)]
        elif packed and len(packed[-1]) + len(sentence) <= size:
            packed[-1] += sentence
        else:
            packed.append(sentence)
    out: list[str] = []
    for p in packed:
        out.append((out[-1][-overlap:] if out and overlap else "") + p)
    return out


#: Characters of chunks that a task gives out at once, a text's last ones aside.
PART = 1 << 20


def _with(split: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts are taken from a batch one by one, and chunks given out as soon as there are ``PART`` characters of them: what is held
    hangs on the longest text, not on a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows: list[tuple] = []
            size = 0
            for at in range(batch.num_rows):
                for n, c in enumerate(split(t) if (t := texts[at].as_py()) else ()):
                    rows.append((ids[at].as_py(), n, c))
                    size += len(c)
                    if size >= PART:
                        yield _chunks(rows)
                        rows, size = [], 0
            if rows:
                yield _chunks(rows)

    return run


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "chunk_index", "chunk_text"])


def split_recursive(docs: DataFrame, size: int = 900, overlap: int = 180) -> DataFrame:
    """By paragraph, line, space, character."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_with(lambda t: recursive_pieces(t, size, overlap)), CHUNKS)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """The windows of T1b of a text that is not empty."""
    step = size - overlap
    # Cut once into steps; a window is put together from the steps that it touches.
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-size // step) - 1

    def windows(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int"))
        return F.transform(starts, lambda i: F.left(F.array_join(F.transform(F.sequence(i, F.least(i + more, F.size(p) - 1)), lambda k: p[k]), ""), F.lit(size)))

    return let(parts, windows)


def split_fixed(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, in SQL functions."""
    return docs.where("length(text) > 0").select("doc_id", F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("chunk_index", "chunk_text"))


def split_markdown(docs: DataFrame, levels: int = 3) -> DataFrame:
    """A section at each heading, with the path of headings above it as ``h1``, ``h2``, ``h3``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    level = F.length(F.regexp_extract("line", rf"^(#{{1,{levels}}}) ", 1))
    before = Window.partitionBy("doc_id").orderBy("n")
    lines = lines.withColumn("level", level).withColumn("section", F.count_if(F.col("level") > 0).over(before))
    title = F.trim(F.regexp_replace("line", "^#+ ", ""))
    head = lines.where("level > 0").select("doc_id", "section", "level", title.alias("title"))
    for k in range(1, levels + 1):
        # A heading of level k counts until one of a higher level comes.
        mark = F.when(F.col("level") == k, F.struct(F.lit(True).alias("on"), F.col("title"))).when(F.col("level") < k, F.struct(F.lit(False).alias("on"), F.lit("").alias("title")))
        head = head.withColumn(f"m{k}", F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("section")))
    heads = head.select("doc_id", "section", *(F.when(F.col(f"m{k}.on"), F.col(f"m{k}.title")).alias(f"h{k}") for k in range(1, levels + 1)))
    body = lines.where("level = 0").groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return body.select("doc_id", "section", text.alias("chunk_text")).where("chunk_text <> ''").join(heads, ["doc_id", "section"], "left")


def split_cjk(docs: DataFrame, size: int = 700, overlap: int = 120) -> DataFrame:
    """T3."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_with(lambda t: cjk_pieces(t, size, overlap)), CHUNKS)


def segment_by_tokens(docs: DataFrame, limit: int | Column) -> DataFrame:
    """T4: groups of white-space tokens under the limit less its margin; short texts stay as they are (0: off)."""
    n = effective_limit(F.lit(limit) if isinstance(limit, int) else limit)
    words = F.array_remove(F.split("text", r"\s+"), "")

    def groups(w: Column) -> Column:
        # Words are taken one by one, since a slice would copy the whole list for each group.
        group = lambda i: F.array_join(F.transform(F.sequence(i * n, F.least((i + 1) * n, F.size(w)) - 1), lambda k: w[k]), " ")
        return F.when((n == 0) | (F.size(w) <= n), F.array("text")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / n).cast("int") - 1), group))

    return docs.select("doc_id", F.posexplode(let(words, groups)).alias("chunk_index", "chunk_text"))


def split_semantic(sentences: DataFrame, percentile: float = 0.95) -> DataFrame:
    """T5: ``(doc_id, n, text, distance)``, the distance being to the sentence before: a break where it exceeds the
    document's percentile."""
    limit = sentences.groupBy("doc_id").agg(F.percentile("distance", percentile).alias("limit"))
    w = Window.partitionBy("doc_id").orderBy("n")
    cut = sentences.join(limit, "doc_id").withColumn("chunk_index", F.count_if(F.col("distance") > F.col("limit")).over(w).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return cut.groupBy("doc_id", "chunk_index").agg(joined.alias("chunk_text"))


def split_by_policy(docs: DataFrame) -> DataFrame:
    """CJK texts by sentences, others recursively, with the sizes of their script, which the whole text decides."""
    df = docs.withColumn("cjk", split_policy(script_profile(F.col("text"), sample=None))["cjk"])
    return split_cjk(df.where("cjk")).unionByName(split_recursive(df.where("NOT cjk"), 1200, 150))


def prepend_context(chunks: DataFrame, docs: DataFrame, n: int = 200) -> DataFrame:
    """Every chunk behind the head of its document."""
    heads = docs.select("doc_id", F.left("text", F.lit(n)).alias("head"))
    return chunks.join(heads, "doc_id").select("doc_id", "chunk_index", F.concat("head", F.lit("\n\n"), "chunk_text").alias("chunk_text"))


def group_waves(items: DataFrame, n: int, order: str, most: int | None = None) -> DataFrame:
    """Consecutive batches ``wave_001`` and so on of ``n`` items. Numbers come from counts of sorted ranges, so no
    task sees all items."""
    ranged = items.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    wave = F.ceil((F.col("__before") + F.col("__i")) / n)
    out = ranged.join(F.broadcast(before), "__p").withColumn("wave_no", wave).withColumn("wave", F.format_string("wave_%03d", wave))
    return (out.where(F.col("wave_no") <= most) if most else out).drop("__p", "__i", "__before", "wave_no")
