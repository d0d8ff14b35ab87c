"""Progress, counts and reports over registries and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.text import has_uuid_part, human_bytes, preview


def progress(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, total, completed, remaining, progress_pct) of every source; 0 where there are no chunks."""
    sums = chunks.groupBy("source_id").agg(F.count("*").alias("total"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("completed"))
    rows = sources.select("source_id").distinct().join(sums, "source_id", "left").fillna(0, ["total", "completed"])
    pct = F.when(F.col("total") > 0, F.floor(F.col("completed") * 100 / F.col("total"))).otherwise(0)
    return rows.withColumn("remaining", F.col("total") - F.col("completed")).withColumn("progress_pct", pct.cast("long"))


def collections(vectors: DataFrame) -> DataFrame:
    """Documents of each collection. Of a store they are counted from the files' own row counts; no column is read."""
    return vectors.groupBy("domain", "subject").agg(F.count("*").alias("documents"))


def collection_samples(vectors: DataFrame, k: int = 3, length: int = 200) -> DataFrame:
    """The first k documents of each collection by chunk id, with its size."""
    one = Window.partitionBy("domain", "subject")
    rows = vectors.select("domain", "subject", "chunk_id", preview(F.col("content"), length).alias("preview"))
    rows = rows.withColumns({"documents": F.count("*").over(one), "rank": F.row_number().over(one.orderBy("chunk_id"))})
    return rows.where(F.col("rank") <= k)


def totals(vectors: DataFrame) -> DataFrame:
    """Per collection, and over all with null domain and subject and level 'total'."""
    each = collections(vectors).select(F.lit("collection").alias("level"), "domain", "subject", "documents", F.lit(None).cast("long").alias("collections"), F.lit(None).cast("long").alias("domains"), F.lit(None).cast("long").alias("subjects"))
    small = collections(vectors)
    whole = small.agg(F.sum("documents").alias("documents"), F.count("*").alias("collections"), F.countDistinct("domain").alias("domains"), F.countDistinct("subject").alias("subjects"))
    none = F.lit(None).cast("string")
    return each.unionByName(whole.select(F.lit("total").alias("level"), none.alias("domain"), none.alias("subject"), "documents", "collections", "domains", "subjects"))


def knowledge_index(files: DataFrame) -> DataFrame:
    """(kind, value, files) of all different domains, subjects, topics, subtopics and stems, with the number of files that have each;
    folders named by ids are skipped.

    Stems repeat as often as files share them, which their number tells; a row for each value, as the stems of a large base are
    too many for one. with_repeats() lists them as often as they come.
    """
    names = ["domain", "subject", "topic", "subtopic"]
    rows = files.where(~has_uuid_part(F.filter(F.array(*names), lambda p: p.isNotNull())))
    pairs = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("value")) for n in (*names, "stem")])
    return rows.select(F.inline(pairs)).where("value <> ''").groupBy("kind", "value").agg(F.count("*").alias("files"))


def with_repeats(index: DataFrame) -> DataFrame:
    """(kind, value) of knowledge_index(), a stem once for each of its files, all else once."""
    times = F.when(F.col("kind") == "stem", F.col("files")).otherwise(1)
    return index.select("kind", "value", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("n")).drop("n")


def storage(files: DataFrame, by: list[str]) -> DataFrame:
    sums = files.groupBy(*by).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    return sums.withColumn("size", human_bytes(F.col("bytes")))


def run_counters(notes: DataFrame, chunks: DataFrame, queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Chunks, queries and retrieved documents of each note."""
    out = notes.select("note_id").distinct()
    for name, table in (("chunks_count", chunks), ("queries_count", queries), ("retrieved_docs", retrieved)):
        out = out.join(table.groupBy("note_id").agg(F.count("*").alias(name)), "note_id", "left")
    return out.fillna(0)


def batches(queue: DataFrame, key: str, size: int = 10, ranges: int = 200) -> DataFrame:
    """queue with its batch number in the order of the key (null first).

    The keys of least hash cut the order into ranges. Each is numbered on its own, after the rows of the ranges before; only
    the counts of the ranges meet in one task.
    """
    picked = queue.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k")).limit(ranges).collect()
    cuts = F.array(*[F.lit(r["k"]) for r in picked])
    at = F.size(F.filter(cuts, lambda c: c <= F.col(key))) if picked else F.lit(0)
    rows = queue.withColumn("_range", at)
    line = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("_before") - 1
    rows = rows.join(F.broadcast(starts), "_range")  # at most ranges + 1 rows
    return rows.withColumn("batch", F.floor(number / size).cast("int")).drop("_range", "_before")


def progress_feed(events: DataFrame) -> DataFrame:
    """(source_id, seq, total, completed, progress_pct, status, done): a row whenever the percentage of a source changes.

    events: (source_id, seq, added 0/1, embedded -1/0/1).
    """
    line = Window.partitionBy("source_id").orderBy("seq")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumns({"total": F.sum("added").over(upto), "completed": F.sum("embedded").over(upto)})
    pct = F.when(F.col("total") > 0, F.floor(F.col("completed") * 100 / F.col("total"))).otherwise(0).cast("long")
    rows = rows.withColumn("progress_pct", pct)
    rows = rows.withColumns({"before": F.lag("progress_pct").over(line), "first": F.row_number().over(line) == 1})
    left = F.col("total") - F.col("completed")
    rows = rows.where(F.col("first") | ~F.col("before").eqNullSafe(F.col("progress_pct")))
    return rows.select(
        "source_id", "seq", "total", "completed", "progress_pct",
        F.when(left <= 0, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        ((left <= 0) & (F.col("total") > 0)).alias("done"),
    )
