"""Cached analyses, archives and histories of notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators import search
from lorespark.sources.tables import stored

NOTE = ["bubble_id", "note_id"]
FETCH_K = 5


def cache_lookup(notes: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """notes (bubble_id, note_id, content_version) with hit and analysis: a cached analysis that is not empty, of this version."""
    old = cache.select(*NOTE, F.col("content_version").alias("cached_version"), "analysis")
    hit = (F.col("cached_version") == F.col("content_version")) & (F.col("analysis") != "") & F.lit(not force)
    hit = F.coalesce(hit, F.lit(False))
    rows = notes.join(old, NOTE, "left")
    return rows.select(*NOTE, "content_version", hit.alias("hit"), F.when(hit, F.col("analysis")).alias("analysis"))


def analysis_status(notes: DataFrame, cache: DataFrame) -> DataFrame:
    old = cache.select(*NOTE, F.col("content_version").alias("cached_version"), "cached_at")
    rows = notes.select(*NOTE, F.col("content_version").alias("current_version")).join(old, NOTE, "left")
    current = F.coalesce(F.col("cached_version") == F.col("current_version"), F.lit(False))
    return rows.select(*NOTE, F.col("cached_version").isNotNull().alias("exists"), current.alias("is_current"), "cached_version", "current_version", (~current).alias("needs_update"), "cached_at")


def semantic_fetch(questions: DataFrame, cached: DataFrame, k: int = FETCH_K) -> DataFrame:
    """The k cached chunks (bubble_id, chunk_id, embedding, ...) nearest to each question (query_id, bubble_id, query_vector), of
    its bubble alone."""
    return search.nearest(questions.withColumn("exclude", F.lit(None).cast(dict(cached.dtypes)["chunk_id"])), cached, k, by=["bubble_id"])


def needs_retrieval(notes: DataFrame, retrieved: DataFrame) -> DataFrame:
    return notes.join(retrieved.select(*NOTE).distinct(), NOTE, "left_anti")


def history_lookup(asked: DataFrame, history: DataFrame) -> DataFrame:
    """history rows of (note_id, content_version, prompt)."""
    keys = asked.select("note_id", "content_version", F.sha2("prompt", 256).alias("prompt_hash")).distinct()
    return history.join(keys, ["note_id", "content_version", "prompt_hash"], "left_semi")


def version_history(history: DataFrame) -> DataFrame:
    line = Window.partitionBy("note_id").orderBy(F.desc("content_version"), "prompt_hash")
    return history.withColumn("newest", F.row_number().over(line))


def retrieved_for(notes: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The retrieval cache's rows of exactly these (bubble_id, note_id), whatever their version."""
    return retrieved.join(notes.select(*NOTE).distinct(), NOTE, "left_semi")


def to_archive(notes: DataFrame, archive: DataFrame) -> DataFrame:
    """Notes whose (note_id, content_version) the archive does not have."""
    return notes.join(archive.select("note_id", "content_version").distinct(), ["note_id", "content_version"], "left_anti")


def archived_versions(archive: DataFrame) -> DataFrame:
    entry = F.struct(F.col("content_version").alias("version"), F.col("chunk_id").alias("pos"), "content")
    return archive.groupBy("note_id").agg(F.array_sort(F.collect_list(entry)).alias("versions"))


def triggered(updates: DataFrame, cache: DataFrame) -> DataFrame:
    """Updates (bubble_id, note_id, increment, version_before, version) that ask for an analysis the cache does not have."""
    due = updates.where((F.col("increment") >= 1.0) | (F.col("version_before") == 0))
    known = cache.select(*NOTE, F.col("content_version").alias("version"))
    return due.join(known, [*NOTE, "version"], "left_anti")


def unembedded(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Registered chunks without vectors, of files that are converted and not embedded; in chunk order within a file."""
    open_ = files.where("converted = 1 and embedded = 0").select(F.col("file_fingerprint").alias("source_id"))
    return chunks.where("embedded = 0").join(open_, "source_id", "left_semi")


def complete(prompts: DataFrame, column: str, complete_fn, out: str = "output") -> DataFrame:
    """prompts with the outputs of complete_fn (Series to Series), the plug for a chat model."""

    @F.pandas_udf("string")
    def outputs(batch):
        return complete_fn(batch)

    return prompts.withColumn(out, outputs(column))


def memoised(prompts: DataFrame, column: str, history: DataFrame, complete_fn, valid: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompts with prompt_hash and output, history) of a model that is asked only what it has not answered yet.

    history: (prompt_hash, output), one row a hash. Each different prompt that it lacks is put to complete_fn once, however many
    rows have it, and what comes back is stored before it is used, so no lost task asks again later. Outputs that are null or
    not valid give null and do not enter the history, so they are asked anew the next time. A null prompt has no output.
    """
    rows = prompts.withColumn("prompt_hash", F.sha2(column, 256))
    asked = rows.where(F.col(column).isNotNull()).select("prompt_hash", F.col(column).alias("prompt")).dropDuplicates(["prompt_hash"])
    made = stored(complete(asked.join(history.select("prompt_hash"), "prompt_hash", "left_anti"), "prompt", complete_fn).select("prompt_hash", "output"))
    good = made.where(F.coalesce(valid(F.col("output")), F.lit(False)) if valid else F.col("output").isNotNull())
    known = history.select("prompt_hash", "output").unionByName(good)
    return rows.join(known, "prompt_hash", "left").select(*prompts.columns, "prompt_hash", "output"), known
