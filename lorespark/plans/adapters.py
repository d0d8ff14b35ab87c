"""The given tables in the shapes the operators work on, for Spark, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.text import file_fingerprint


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """more: further columns, from those of the documents."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf"))
    rows = d.select(
        "doc_id", name.alias("original_name"), F.col("source").alias("domain"), F.col("lang").alias("subject"),
        F.concat(F.lit("/kb/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("filepath"),
        (F.col("doc_id") % 3 != 0).cast("int").alias("converted"), (F.col("doc_id") % 3 == 1).cast("int").alias("embedded"), F.col("n_chars").alias("length"), *more,
    )
    return rows.withColumn("file_fingerprint", file_fingerprint(F.col("original_name"), F.col("filepath")))


FILES = """files AS (
  SELECT *, sha256(original_name || ':' || filepath) AS file_fingerprint FROM (
    SELECT doc_id, 'doc_' || doc_id || '.pdf' AS original_name, source AS domain, lang AS subject, '/kb/' || source || '/' || lang || '/doc_' || doc_id || '.pdf' AS filepath,
      CAST(doc_id % 3 <> 0 AS INTEGER) AS converted, CAST(doc_id % 3 = 1 AS INTEGER) AS embedded, n_chars AS length FROM documents))"""


def markdown_text() -> Column:
    """Of a document: line 0 becomes a title, every seventh a level-three and every third other one a level-two header; each fifth
    document has front matter."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.when(i == 0, F.lit("# ")).when(i % 7 == 0, F.lit("### ")).when(i % 3 == 0, F.lit("## ")).otherwise(F.lit("")), line),
    )
    front = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\ntitle: doc "), "doc_id", F.lit("\n---\n\n"))).otherwise(F.lit(""))
    return F.concat(front, F.array_join(lines, "\n"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), markdown_text().alias("text"))


MARKDOWN_LINES = """raw_lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_id, string_split(text, chr(10)) AS ls FROM documents
), md_lines AS (
  SELECT source_id, i AS pos, CASE WHEN i = 0 THEN '# ' WHEN i % 7 = 0 THEN '### ' WHEN i % 3 = 0 THEN '## ' ELSE '' END || ls[i + 1] AS line
  FROM (SELECT source_id, ls, unnest(generate_series(0, len(ls) - 1)) AS i FROM raw_lines)
)"""


def vectors(spark: SparkSession, sf: str, contents: bool = True) -> DataFrame:
    """The vector store; without contents where only ids and vectors are asked for, as a join with the texts would be for nothing."""
    rows = table(spark, sf, "embeddings")
    if contents:
        d = table(spark, sf, "documents").select("doc_id", "text")
        rows = rows.join(d, rows["vec_id"] == d["doc_id"], "left").withColumn("content", F.coalesce("text", F.concat(F.lit("chunk "), "vec_id")))
    return rows.select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("label") % 3).alias("domain"), F.concat(F.lit("s"), "label").alias("subject"),
        *(["content"] if contents else []), F.sha2(F.floor(F.col("vec_id") / 4).cast("string"), 256).alias("file_fingerprint"), "embedding",
    )


VECTORS = """vectors AS (
  SELECT vec_id AS chunk_id, 'd' || (label % 3) AS domain, 's' || label AS subject, coalesce(text, 'chunk ' || vec_id) AS content,
    sha256(CAST(CAST(floor(vec_id / 4) AS BIGINT) AS VARCHAR)) AS file_fingerprint, embedding
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""


def subqueries(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with an id divisible by 100 are the queries; the vector itself is no candidate.

    Each asks its own collection, but every fourth one that does not exist and every eighth one without a subject.
    """
    e = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    gone = F.col("vec_id") % 400 == 300
    return e.select(
        F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 200).alias("question_id"), (F.col("vec_id") % 200).alias("sub_pos"),
        F.when(gone, F.lit("d9")).otherwise(F.concat(F.lit("d"), F.col("label") % 3)).alias("domain"),
        F.when(F.col("vec_id") % 800 == 700, F.lit("")).otherwise(F.concat(F.lit("s"), "label")).alias("subject"),
        F.col("embedding").alias("query_vector"), F.col("vec_id").alias("exclude"),
    )


SUBQUERIES = """subqueries AS (
  SELECT vec_id AS query_id, CAST(floor(vec_id / 200) AS BIGINT) AS question_id, vec_id % 200 AS sub_pos, CASE WHEN vec_id % 400 = 300 THEN 'd9' ELSE 'd' || (label % 3) END AS domain,
    CASE WHEN vec_id % 800 = 700 THEN '' ELSE 's' || label END AS subject, embedding AS query_vector FROM embeddings WHERE vec_id % 100 = 0)"""


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with an id divisible by 100 ask every collection; the vector itself is no candidate."""
    none = F.lit(None).cast("string")
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), none.alias("domain"), none.alias("subject"), F.col("embedding").alias("query_vector"), F.col("vec_id").alias("exclude")
    )


def note_edits(spark: SparkSession, sf: str) -> DataFrame:
    """After turn t a conversation's document has a block for each turn so far; what the system said is a heading."""
    c = table(spark, sf, "conversations").where("text is not null")
    block = F.struct(
        F.when(F.col("role") == "system", F.lit("heading")).otherwise(F.lit("paragraph")).alias("type"),
        F.struct(F.lit(2).alias("level"), F.array(F.struct(F.col("text").alias("insert"))).alias("delta")).alias("data"),
    )
    # a document holds all turns up to its own: as large as it must be, but made by one window
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = c.select("conv_id", F.col("turn").alias("seq"), F.collect_list(F.struct("turn", block.alias("block"))).over(line).alias("xs"))
    document = F.to_json(F.struct(F.lit("page").alias("type"), F.col("xs.block").alias("children")))
    return rows.select(F.col("conv_id").cast("string").alias("note_id"), F.concat(F.lit("b"), F.col("conv_id") % 10).alias("bubble_id"), "seq", document.alias("document"))


NOTE_EDITS = """turns AS (SELECT * FROM conversations WHERE text IS NOT NULL), note_edits AS (
  SELECT CAST(a.conv_id AS VARCHAR) AS note_id, 'b' || (a.conv_id % 10) AS bubble_id, a.turn AS seq, CAST(sum(len(b.text)) AS BIGINT) AS chars, count(*) AS blocks
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn)"""


def chunk_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.lit(1).alias("added"), (F.col("event_type") == "purchase").cast("int").alias("embedded"))


CHUNK_EVENTS = "chunk_events AS (SELECT user_id AS source_id, event_id AS seq, 1 AS added, CAST(event_type = 'purchase' AS INTEGER) AS embedded FROM events)"


def analysis_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled ids have a cached analysis: of version 1 where the quality is 1, of an older one else; every fifth is empty."""
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return rows.select(
        F.concat(F.lit("b"), F.col("doc_id") % 10).alias("bubble_id"), F.col("doc_id").cast("string").alias("note_id"),
        F.when(F.col("quality") == 1, 1.0).otherwise(0.5).alias("content_version"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("analysis "), "doc_id")).alias("analysis"), F.lit("2026-01-01").alias("cached_at"),
    )


ANALYSIS_CACHE = """analysis_cache AS (
  SELECT 'b' || (doc_id % 10) AS bubble_id, CAST(doc_id AS VARCHAR) AS note_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS content_version,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'analysis ' || doc_id END AS analysis, '2026-01-01' AS cached_at FROM labels)"""


def current_notes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("b"), F.col("doc_id") % 10).alias("bubble_id"), F.col("doc_id").cast("string").alias("note_id"), F.lit(1.0).alias("content_version"), "text")


CURRENT_NOTES = "current_notes AS (SELECT 'b' || (doc_id % 10) AS bubble_id, CAST(doc_id AS VARCHAR) AS note_id, 1.0::DOUBLE AS content_version, text FROM documents)"


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What a model might have said: plain JSON, a fenced block, JSON in prose, and broken JSON in turn; each fifth has a subquery
    without text."""
    d = table(spark, sf, "documents")
    part = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("part "), "doc_id"))
    subs = F.array(F.struct(part.alias("text"), F.col("lang").alias("subject")))
    body = F.to_json(F.struct(F.concat(F.lit("query "), "doc_id").alias("rewritten"), F.col("source").alias("domain"), subs.alias("subqueries")))
    kind = F.col("doc_id") % 4
    out = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" done")))
    return d.select("doc_id", out.otherwise(F.lit('{"rewritten": ')).alias("output"))
