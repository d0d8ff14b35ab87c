"""Streams give what the batch operators give."""

import pytest

from lorespark.operators import analysis, notes, retrieval, stats
from lorespark.plans import jobs
from lorespark.sources import tables
from lorespark.streaming import feeds


def batches(spark, df, folder, cuts):
    """df as a stream with a micro-batch from each cut of seq to the next."""
    for lo, hi in zip((0, *cuts), (*cuts, 10**9)):
        df.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(str(folder / "e"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "e"))


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.mark.parametrize("cuts", [(), (2, 3, 7), (1, 2, 5, 6)])
def test_progress_feed(spark, tmp_path, cuts):
    """Wherever micro-batches end, also after a source was complete and comes back."""
    rows = [(s, i, int(i % 3 == 0), int(i % 3 == s % 3)) for s in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "source_id long, seq long, added int, embedded int")
    want = {tuple(r) for r in stats.progress_feed(df).collect()}
    assert sum(r[-1] for r in want) > 3
    assert run(spark, feeds.progress_feed(batches(spark, df, tmp_path, cuts)), f"feed{len(cuts)}") == want


@pytest.mark.parametrize("cuts", [(), (2, 4)])
def test_note_versions_and_triggers(spark, tmp_path, cuts):
    rows = [(f"b{n % 2}", f"n{n}", i, 40 * i * n, i, f"h{i // 2}") for n in (1, 2, 3, 4) for i in range(6)]
    df = spark.createDataFrame(rows, "bubble_id string, note_id string, seq long, chars long, blocks long, hash string")
    versions = notes.versions(df)
    stream = batches(spark, df, tmp_path, cuts)
    got = run(spark, feeds.note_versions(stream.drop("bubble_id")), f"versions{len(cuts)}")
    assert got == {tuple(r) for r in versions.select("note_id", "seq", "increment", "changed", "version_before", "version").collect()}
    cache = spark.createDataFrame([("b0", "n4", 1.0), ("b0", "n4", 9.0), ("b1", "n4", 2.0), ("b0", "n2", 0.1), ("b0", "n2", None), ("b1", "other", 1.0)], "bubble_id string, note_id string, content_version double")
    due = analysis.triggered(versions.join(df.select("note_id", "seq", "bubble_id"), ["note_id", "seq"]), cache)
    want = {tuple(r) for r in due.select("bubble_id", "note_id", "seq", "increment", "changed", "version_before", "version").collect()}
    assert ("b0", "n4", 2) not in {r[:3] for r in want} and len(want) > 5
    rows = feeds.due_analyses(stream, cache).select("bubble_id", "note_id", "seq", "increment", "changed", "version_before", "version")
    assert run(spark, rows, f"due{len(cuts)}") == want


def test_continuous_ingestion_and_store(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "d", "s", "one two"), ("b", None, "s", "three")], "chunk_id string, domain string, subject string, content string")
    rows.coalesce(1).write.parquet(src)

    def ingest(batch, number):
        tables.add_vectors(retrieval.embed(batch, "content", retrieval.hashing_embedder(8)), store, batch=number)

    feeds.ingest_continuously(spark.readStream.schema(rows.schema).parquet(src), ingest, str(tmp_path / "c")).awaitTermination()
    assert {r["chunk_id"] for r in tables.read_vectors(spark, store, "default").collect()} == {"b"}
    assert tables.read_vectors(spark, store).count() == 2


def test_ingesting_twice_changes_nothing(spark):
    from pyspark.sql import functions as F

    stamp = F.lit("2026-01-01").cast("timestamp")
    src = spark.createDataFrame([("a.pdf", "/a", "d", "s", "# T\nx y\n## U\nz"), ("b.pdf", "/b", "d", "s", "# T\nx y")], "original_name string, filepath string, domain string, subject string, text string")
    files = spark.createDataFrame([], "file_fingerprint string, original_name string, sanitized_name string, domain string, subject string, converted int, embedded int, filepath string, last_updated timestamp")
    from lorespark.operators import chunking

    chunks = chunking.chunk(src.limit(0).select(F.col("filepath").alias("source_id"), "text"))
    first = jobs.ingest_corpus(src, files, chunks, retrieval.hashing_embedder(4), stamp)
    rows = spark.createDataFrame(first.files.collect(), first.files.schema)
    held = spark.createDataFrame(first.chunks.collect(), first.chunks.schema)
    again = jobs.ingest_corpus(src, rows, held, retrieval.hashing_embedder(4), stamp)
    assert first.vectors.count() == 3 and again.vectors.count() == 0
    assert {tuple(r) for r in again.chunks.collect()} == {tuple(r) for r in held.collect()}
    assert {r["embedded"] for r in rows.collect()} == {1}
