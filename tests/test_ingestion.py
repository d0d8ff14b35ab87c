"""What ingestion shuffles and leaves on disk, and odd registries."""

from pathlib import Path

from pyspark.sql import functions as F

from lorespark.functions import text as X
from lorespark.operators import analysis, chunking, registry, retrieval
from lorespark.plans import jobs
from lorespark.plans.registry import QUERIES
from lorespark.sources import tables


def shuffled(spark) -> int:
    """Bytes of shuffle files written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_ingestion_does_not_shuffle_contents_by_every_key(spark, sf):
    before = shuffled(spark)
    assert QUERIES["ingested_chunks"](spark, sf).count() > 0
    read = Path(sf, "documents.parquet")
    size = sum(p.stat().st_size for p in ([read] if read.is_file() else read.glob("*.parquet")))
    assert shuffled(spark) - before < 6 * size  # 11 times the input while contents and headers went by every key


def test_shuffles_of_a_step_go_with_it(spark):
    def files():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    before = files()
    rows = tables.packed(spark.range(1000).repartition(3, "id"))
    assert not {f for f in files() - before if "shuffle_" in f}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false" and rows.count() == 1000


def test_what_is_open_equals_the_whole_upsert(spark):
    """Files new, converted, done and both with old chunks, some of them embedded; equal contents in several files."""
    stamp = F.lit("2026-01-01").cast("timestamp")
    texts = [("a", "# T\nx\n## U\ny"), ("b", "# T\nx\n## V\nz"), ("c", "# T\nx"), ("d", "# D\nw\n# E\nv"), ("e", "# T\nx")]
    src = spark.createDataFrame([(f"{n}.pdf", f"/{n}", "d", "s", t) for n, t in texts], "original_name string, filepath string, domain string, subject string, text string")
    named = src.withColumn("file_fingerprint", X.file_fingerprint(F.col("original_name"), F.col("filepath")))
    state = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("e", 0, 1)], "n string, converted int, embedded int")
    files = named.withColumn("n", F.substring("filepath", 2, 1)).join(state, "n").select("file_fingerprint", "original_name", F.lit("").alias("sanitized_name"), "domain", "subject", "converted", "embedded", "filepath", stamp.alias("last_updated"))
    chunked = chunking.chunk(named.select(F.col("file_fingerprint").alias("source_id"), "text"))
    of = {r["filepath"][1]: r["file_fingerprint"] for r in named.collect()}
    # a is not converted but has chunks already: one embedded, one not, one of a former text; b has one of its two embedded
    a, b, c = (chunked.where(F.col("source_id") == of[n]) for n in "abc")
    old = a.where("chunk_index = 0").withColumn("embedded", F.lit(1)).unionByName(a.where("chunk_index = 1").withColumn("token_count", F.lit(99)))
    old = old.unionByName(a.where("chunk_index = 1").withColumns({"chunk_index": F.lit(7), "content": F.lit("former"), "chunk_fingerprint": F.sha2(F.lit("former"), 256)}))
    old = old.unionByName(b.withColumn("embedded", F.when(F.col("chunk_index") == 0, F.lit(1)).otherwise(F.lit(0)))).unionByName(c.withColumn("embedded", F.lit(0)))
    old = spark.createDataFrame(old.collect(), old.schema)
    out = jobs.ingest_corpus(src, files, old, retrieval.hashing_embedder(4), stamp)

    registered = registry.register(files, named.select("file_fingerprint", "original_name", "domain", "subject", F.lit(0).alias("converted"), F.lit(0).alias("embedded"), "filepath", stamp.alias("last_updated")), ["file_fingerprint"], "last_updated")
    todo = registered.where("converted = 0").select(F.col("file_fingerprint").alias("source_id"))
    whole = registry.upsert(old, chunked.join(todo, "source_id", "left_semi").select(*old.columns), ["source_id", "chunk_fingerprint", "chunk_index"], keep=["embedded"])
    expected = analysis.unembedded(registered.withColumn("converted", F.lit(1)), whole)
    assert sorted(map(repr, out.vectors.select(*old.columns).collect())) == sorted(map(repr, expected.select(*old.columns).collect()))
    assert {(r["source_id"], r["chunk_index"]) for r in out.vectors.collect()} == {(of["a"], 1), (of["a"], 7), (of["b"], 1), (of["d"], 0), (of["d"], 1)}
    assert out.chunks.count() == 9 and out.chunks.where("token_count = 99").count() == 0
