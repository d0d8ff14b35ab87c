"""All registered queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as X
from lorespark.operators import analysis, chunking, notes, registry, retrieval, search, stats
from lorespark.plans import adapters as A
from lorespark.plans import jobs
from lorespark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DISTANCE = "list_sum(list_transform(generate_series(1, len(q.query_vector)), lambda i: (q.query_vector[i]::DOUBLE - v.embedding[i]::DOUBLE) * (q.query_vector[i]::DOUBLE - v.embedding[i]::DOUBLE)))"
NEAREST = f"""{A.VECTORS}, {A.SUBQUERIES}, near AS (
  SELECT query_id, question_id, sub_pos, v.domain, v.subject, chunk_id, content, {DISTANCE} AS distance
  FROM subqueries q JOIN vectors v ON v.domain = q.domain AND v.subject = q.subject AND v.chunk_id <> q.query_id), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain, subject ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM near)"""


EVERYWHERE = f"""{A.VECTORS}, far AS (
  SELECT q.vec_id AS query_id, v.domain, v.subject, chunk_id, {DISTANCE.replace('q.query_vector', 'q.embedding')} AS distance
  FROM embeddings q JOIN vectors v ON v.chunk_id <> q.vec_id WHERE q.vec_id % 100 = 0), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain, subject ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM far)"""


@query(f"WITH {EVERYWHERE} SELECT query_id, domain, subject, chunk_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5")
def search_across_collections(spark, sf):
    found = jobs.search_across_collections(A.search_queries(spark, sf), A.vectors(spark, sf, contents=False))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"WITH {EVERYWHERE} SELECT query_id, domain, subject, chunk_id, rank FROM ranked WHERE rank <= 5 AND domain IN ('d0', 'd1') AND subject <> 's3'")
def search_some_collections(spark, sf):
    subjects = [f"s{i}" for i in range(10) if i != 3]
    return jobs.search_across_collections(A.search_queries(spark, sf), A.vectors(spark, sf, contents=False), ["d0", "d1"], subjects).drop("distance")


@query(f"WITH {NEAREST} SELECT query_id, domain, subject, chunk_id, rank FROM ranked WHERE rank <= 5")
def search_named_collections(spark, sf):
    return jobs.search_across_collections(A.subqueries(spark, sf), A.vectors(spark, sf, contents=False)).drop("distance")


@query(f"""WITH {A.VECTORS}, far AS (
  SELECT q.vec_id AS query_id, v.chunk_id, v.content, {DISTANCE.replace('q.query_vector', 'q.embedding')} AS distance
  FROM embeddings q JOIN vectors v ON v.chunk_id % 7 = q.vec_id // 100 % 7 WHERE q.vec_id % 100 = 0), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM far)
SELECT query_id, 'b' || (query_id // 100 % 7) AS bubble_id, chunk_id, content, rank FROM ranked WHERE rank <= 5""")
def cached_chunks_by_meaning(spark, sf):
    cached = A.vectors(spark, sf).withColumn("bubble_id", F.concat(F.lit("b"), F.col("chunk_id") % 7))
    asked = A.table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("b"), F.floor(F.col("vec_id") / 100) % 7).alias("bubble_id"), F.col("embedding").alias("query_vector"))
    return analysis.semantic_fetch(asked, cached).select("query_id", "bubble_id", "chunk_id", "content", "rank")


def _alike(a: str, b: str) -> str:
    return f"coalesce(nullif(list_cosine_similarity({a}, {b}), 'nan'::DOUBLE), 0)"


BY_COLLECTION = "PARTITION BY query_id, domain, subject"


@query(f"""WITH {NEAREST}, c AS (
  SELECT query_id, domain, subject, chunk_id, rank, e.embedding::DOUBLE[] AS d, {_alike("e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")} AS alike
  FROM ranked JOIN embeddings e ON e.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id WHERE rank <= 15
), one AS (
  SELECT * FROM c QUALIFY row_number() OVER ({BY_COLLECTION} ORDER BY round(alike, 9) DESC, rank) = 1
), c2 AS (
  SELECT c.*, {_alike("c.d", "one.d")} AS most FROM c JOIN one USING (query_id, domain, subject) WHERE c.chunk_id <> one.chunk_id
), two AS (
  SELECT * FROM c2 QUALIFY row_number() OVER ({BY_COLLECTION} ORDER BY round(0.5::DOUBLE * alike - 0.5::DOUBLE * most, 9) DESC, rank) = 1
), c3 AS (
  SELECT c2.* REPLACE (greatest(c2.most, {_alike("c2.d", "two.d")}) AS most) FROM c2 JOIN two USING (query_id, domain, subject) WHERE c2.chunk_id <> two.chunk_id
), three AS (
  SELECT * FROM c3 QUALIFY row_number() OVER ({BY_COLLECTION} ORDER BY round(0.5::DOUBLE * alike - 0.5::DOUBLE * most, 9) DESC, rank) = 1
)
SELECT query_id, domain, subject, chunk_id, rank, 1 AS picked FROM one UNION ALL SELECT query_id, domain, subject, chunk_id, rank, 2 FROM two
UNION ALL SELECT query_id, domain, subject, chunk_id, rank, 3 FROM three""")
def mmr_retrieval(spark, sf):
    candidates = search.nearest(A.subqueries(spark, sf), A.vectors(spark, sf), retrieval.FETCH)
    return retrieval.diverse(candidates).select("query_id", "domain", "subject", "chunk_id", "rank", "picked")


@query(f"WITH {A.VECTORS} SELECT domain, subject, count(*) AS documents FROM vectors GROUP BY ALL")
def collection_counts(spark, sf):
    return stats.collections(A.vectors(spark, sf))


@query(f"""WITH {A.VECTORS}, r AS (SELECT domain, subject, chunk_id, left(content, 200) AS preview, count(*) OVER (PARTITION BY domain, subject) AS documents,
  CAST(row_number() OVER (PARTITION BY domain, subject ORDER BY chunk_id) AS INTEGER) AS rank FROM vectors) SELECT * FROM r WHERE rank <= 3""")
def collection_samples(spark, sf):
    return stats.collection_samples(A.vectors(spark, sf))


@query(f"""WITH {A.VECTORS}, c AS (SELECT domain, subject, count(*) AS documents FROM vectors GROUP BY ALL)
SELECT 'collection' AS level, domain, subject, documents, CAST(NULL AS BIGINT) AS collections, CAST(NULL AS BIGINT) AS domains, CAST(NULL AS BIGINT) AS subjects FROM c
UNION ALL SELECT 'total', NULL, NULL, CAST(sum(documents) AS BIGINT), count(*), count(DISTINCT domain), count(DISTINCT subject) FROM c""")
def store_totals(spark, sf):
    return stats.totals(A.vectors(spark, sf))


@query(f"""WITH {A.FILES}, p AS (SELECT domain, subject, 'part_' || (doc_id % 50) AS stem FROM files)
SELECT 'domain' AS kind, domain AS value, count(*) AS files FROM p GROUP BY domain UNION ALL SELECT 'subject', subject, count(*) FROM p GROUP BY subject
UNION ALL SELECT 'stem', stem, count(*) FROM p GROUP BY stem""")
def knowledge_index(spark, sf):
    return stats.knowledge_index(_paths(spark, sf))


@query(f"""WITH {A.FILES} SELECT DISTINCT 'domain' AS kind, domain AS value FROM files UNION ALL SELECT DISTINCT 'subject', subject FROM files
UNION ALL SELECT 'stem', 'part_' || (doc_id % 50) FROM files""")
def knowledge_base_lists(spark, sf):
    return stats.with_repeats(stats.knowledge_index(_paths(spark, sf)))


def _paths(spark, sf):
    """Files of which many share a name in different folders."""
    path = F.concat_ws("/", "domain", "subject", F.concat(F.lit("part_"), F.col("doc_id") % 50, F.lit(".pdf")))
    return tables.listed(A.files(spark, sf).select(path.alias("rel_path")))


@query(f"""WITH {A.FILES}, s AS (SELECT domain, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY domain)
SELECT domain, bytes, files, CASE WHEN bytes < 1024 THEN printf('%.1f B', floor(bytes * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', floor(bytes / 1024.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) ELSE printf('%.1f MB', floor(bytes / 1048576.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) END AS size FROM s""")
def storage_bytes(spark, sf):
    return stats.storage(A.files(spark, sf), ["domain"])


@query(f"""WITH {A.CHUNK_EVENTS}, s AS (SELECT source_id, count(*) AS total, CAST(sum(embedded) AS BIGINT) AS completed FROM chunk_events GROUP BY source_id)
SELECT source_id, total, completed, total - completed AS remaining, CAST(floor(completed * 100 / total) AS BIGINT) AS progress_pct FROM s""")
def embedding_progress(spark, sf):
    events = A.chunk_events(spark, sf)
    return stats.progress(events, events)


@query(f"""WITH {A.CHUNK_EVENTS}, r AS (SELECT source_id, seq, CAST(sum(added) OVER w AS BIGINT) AS total, CAST(sum(embedded) OVER w AS BIGINT) AS completed FROM chunk_events
  WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), p AS (SELECT *, CAST(floor(completed * 100 / total) AS BIGINT) AS progress_pct FROM r),
  l AS (SELECT *, lag(progress_pct) OVER (PARTITION BY source_id ORDER BY seq) AS before FROM p)
SELECT source_id, seq, total, completed, progress_pct, CASE WHEN total - completed <= 0 THEN 'completed' ELSE 'processing' END AS status, total - completed <= 0 AND total > 0 AS done
FROM l WHERE before IS DISTINCT FROM progress_pct""")
def progress_changes(spark, sf):
    return stats.progress_feed(A.chunk_events(spark, sf))


@query(f"""WITH {A.FILES}, p AS (SELECT user_id, count(*) AS total, CAST(sum(CAST(event_type = 'purchase' AS INTEGER)) AS BIGINT) AS completed FROM events GROUP BY user_id)
SELECT doc_id, CASE WHEN embedded = 1 THEN 'completed' WHEN converted = 1 THEN 'processing' ELSE 'pending' END AS status, coalesce(total, 0) AS total,
  coalesce(completed, 0) AS completed, CAST(coalesce(floor(completed * 100 / total), 0) AS BIGINT) AS progress_pct FROM files LEFT JOIN p ON user_id = doc_id""")
def file_statuses(spark, sf):
    f = A.files(spark, sf).withColumn("source_id", F.col("doc_id"))
    rows = f.join(stats.progress(f, A.chunk_events(spark, sf)), "source_id")
    return rows.select("doc_id", X.file_status(F.col("converted"), F.col("embedded")).alias("status"), "total", "completed", "progress_pct")


@query(f"WITH {A.FILES} SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS INTEGER) AS batch FROM files WHERE converted = 0")
def conversion_batches(spark, sf):
    return stats.batches(A.files(spark, sf).where("converted = 0"), "doc_id").select("doc_id", "batch")


@query(f"""WITH {A.FILES} SELECT file_fingerprint AS id, 'unconverted' AS queue FROM files WHERE converted = 0
UNION ALL SELECT file_fingerprint, 'unembedded' FROM files WHERE converted = 1 AND embedded = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'uncached' FROM labels WHERE quality = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unanalysed' FROM labels WHERE toxic = 0""")
def work_queues(spark, sf):
    f = A.files(spark, sf).withColumnRenamed("file_fingerprint", "id")
    n = A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("cached"), F.col("toxic").alias("analysed"))
    queues = {"unconverted": registry.queue(f, "converted"), "unembedded": registry.queue(f, "embedded", ["converted"]), "uncached": registry.queue(n, "cached"), "unanalysed": registry.queue(n, "analysed")}
    out = None
    for name, rows in queues.items():
        rows = rows.select("id", F.lit(name).alias("queue"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {A.FILES} SELECT d.doc_id, coalesce(f.embedded, 0) = 1 AS is_set FROM labels d LEFT JOIN files f ON f.doc_id = d.doc_id * 2")
def embedded_flags(spark, sf):
    probes = A.table(spark, sf, "labels").select("doc_id", (F.col("doc_id") * 2).alias("probe"))
    f = A.files(spark, sf).select(F.col("doc_id").alias("probe"), "embedded")
    return registry.flag_set(probes, f, ["probe"], "embedded", ["converted", "embedded"]).drop("probe")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, '/\:|', '----'), '[*?"<>]', '', 'g'), '-{2,}', '-', 'g'), '-') AS title,
  sha256(text) AS chunk_fingerprint, left(sha256(text), 16) AS content_fingerprint, lower(replace(text, ' ', '_')) AS slug,
  CASE WHEN len(text) > 300 THEN left(text, 300) || '...' ELSE text END AS preview, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]')) AS tokens FROM documents""")
def scalar_functions(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    t = F.col("text")
    return d.select(
        "doc_id", X.sanitize_title(t).alias("title"), X.chunk_fingerprint(t).alias("chunk_fingerprint"),
        X.content_fingerprint(t).alias("content_fingerprint"), X.slug(t).alias("slug"), X.preview(t, 300, "...").alias("preview"), X.token_count(t).cast("long").alias("tokens"),
    )


@query(f"""WITH {A.FILES} SELECT doc_id, file_fingerprint, sha256('{{"bubble_id":"' || domain || '","note_id":"' || doc_id || '","semantic_version":1}}') AS semantic FROM files""")
def keyed_fingerprints(spark, sf):
    f = A.files(spark, sf)
    return f.select("doc_id", "file_fingerprint", X.semantic_fingerprint(F.col("domain"), F.col("doc_id").cast("string"), F.lit(1)).alias("semantic"))


@query("""WITH raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '; ' || lang WHEN 1 THEN source || ', ' || lang WHEN 2 THEN source || ' and ' || lang || ', x' ELSE ' ' END AS author FROM documents), p AS (
  SELECT doc_id, CASE WHEN trim(author) = '' THEN NULL WHEN contains(author, ';') THEN string_split(author, ';') WHEN contains(author, ',') AND NOT contains(lower(author), ' and ') THEN string_split(author, ',') ELSE [author] END AS ps FROM raw)
SELECT doc_id, coalesce(array_to_string(list_transform(ps, lambda x: trim(x)), '|'), '') AS authors,
  '---' || chr(10) || 'title: t' || doc_id || CASE WHEN ps IS NULL THEN '' ELSE chr(10) || 'authors:' || chr(10) || array_to_string(list_transform(ps, lambda x: '- ' || trim(x)), chr(10)) END || chr(10) || '---' || chr(10) || chr(10) AS front FROM p""")
def document_metadata(spark, sf):
    kind, source, lang = F.col("doc_id") % 4, F.col("source"), F.col("lang")
    raw = F.when(kind == 0, F.concat(source, F.lit("; "), lang)).when(kind == 1, F.concat(source, F.lit(", "), lang)).when(kind == 2, F.concat(source, F.lit(" and "), lang, F.lit(", x"))).otherwise(F.lit(" "))
    rows = A.table(spark, sf, "documents").select("doc_id", X.clean_authors(raw).alias("authors"))
    front = X.front_matter({"title": F.concat(F.lit("t"), "doc_id")}, {"authors": F.col("authors")})
    return rows.select("doc_id", F.coalesce(F.array_join("authors", "|"), F.lit("")).alias("authors"), front.alias("front"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages), l AS (SELECT DISTINCT page_id, regexp_extract(href[2:], '[^/]*$') AS link FROM h WHERE starts_with(href, '/'))
SELECT page_id, link, CASE WHEN contains(lower(link), 'embed') THEN 'embedding' ELSE 'chat' END AS kind FROM l WHERE link <> ''""")
def link_catalogue(spark, sf):
    rows = A.table(spark, sf, "pages").select("page_id", F.explode(X.links(F.col("html"), "/")).alias("link"))
    return rows.withColumn("kind", X.model_kind(F.col("link")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 AND doc_id % 5 <> 0 THEN 'query ' || doc_id END AS rewritten, CASE WHEN doc_id % 4 < 3 AND doc_id % 5 <> 0 THEN source END AS domain,
  CASE WHEN doc_id % 4 < 3 AND doc_id % 5 <> 0 THEN 'part ' || doc_id END AS first_part, doc_id % 4 < 3 AND doc_id % 5 <> 0 AS valid FROM documents""")
def model_outputs(spark, sf):
    rows = A.outputs(spark, sf).withColumn("q", X.valid_query(X.json_from_output(F.col("output"))))
    first = F.col("q.subqueries")[0]["text"]
    return rows.select("doc_id", F.col("q.rewritten").alias("rewritten"), F.col("q.domain")[0].alias("domain"), first.alias("first_part"), F.col("q").isNotNull().alias("valid"))


@query("SELECT doc_id, 'Question: ' || source || ' {' || lang || '} in {braces}' AS prompt FROM documents")
def prompt_rows(spark, sf):
    d = A.table(spark, sf, "documents")
    filled = X.fill_template("Question: {question} {{{lang}}} in {{braces}}", {"question": F.col("source"), "lang": F.col("lang")})
    return d.select("doc_id", filled.alias("prompt"))


MD = f"""{A.MARKDOWN_LINES}, f AS (
  SELECT *, sum(CAST(regexp_matches(line, '^\\s*(```|~~~)') AS INTEGER)) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fences FROM md_lines
), lv AS (
  SELECT *, CASE WHEN fences % 2 = 0 AND NOT regexp_matches(line, '^\\s*(```|~~~)') THEN len(regexp_extract(line, '^(#{{1,6}})( |$)', 1)) ELSE 0 END AS level FROM f
), sec AS (
  SELECT *, CAST(sum(CAST(level > 0 AS INTEGER)) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section FROM lv
), cont AS (
  SELECT source_id, section, trim(string_agg(line, chr(10) ORDER BY pos), chr(10)) AS content FROM sec GROUP BY source_id, section
), kept AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY section) - 1 AS INTEGER) AS chunk_index, octet_length(encode(content)) AS size FROM cont WHERE trim(content) <> ''
), chunks AS (
  SELECT source_id, sha256(content) AS chunk_fingerprint, chunk_index, CAST(sum(size) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS byte_start,
    CAST(sum(size) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS byte_end, CAST(len(regexp_extract_all(content, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')) AS INTEGER) AS token_count, content
  FROM kept)"""


@query(f"WITH {MD} SELECT source_id, section, content FROM cont WHERE trim(content) <> ''")
def header_sections(spark, sf):
    return chunking.header_chunks(A.markdown(spark, sf)).select("source_id", F.col("section").cast("long").alias("section"), "content")


@query(f"WITH {MD} SELECT source_id, chunk_fingerprint, chunk_index, byte_start, byte_end, token_count FROM chunks")
def chunk_rows(spark, sf):
    rows = chunking.chunk(A.markdown(spark, sf), most=10**9)
    return rows.select("source_id", "chunk_fingerprint", "chunk_index", "byte_start", "byte_end", "token_count")


@query()
def recursive_chunks(spark, sf):
    return chunking.chunk(A.markdown(spark, sf), most=200, overlap=20).drop("content")


@query(f"WITH {MD} SELECT source_id, chunk_index, content AS slice FROM chunks")
def chunk_slices(spark, sf):
    return chunking.read_back(chunking.chunk(A.markdown(spark, sf), most=10**9))


@query()
def annotated_markdown(spark, sf):
    d = A.markdown(spark, sf)
    return chunking.annotated(d, chunking.chunk(d))


@query()
def archive_chunks(spark, sf):
    d = A.markdown(spark, sf)
    return chunking.archive_rows(chunking.chunk(d), d.select("source_id", F.lit(1.0).alias("content_version"))).drop("content")


@query(f"""WITH {A.FILES}, new AS (SELECT doc_id + 500 AS doc_id FROM files)
SELECT coalesce(f.doc_id, n.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 0 ELSE f.converted END AS converted, CASE WHEN n.doc_id IS NULL THEN 1 ELSE 3 END AS stamp FROM files f FULL JOIN new n ON f.doc_id = n.doc_id""")
def register_files(spark, sf):
    f = A.files(spark, sf).select("doc_id", "converted").withColumn("stamp", F.lit(1))
    new = f.select((F.col("doc_id") + 500).alias("doc_id"), F.lit(0).alias("converted"), F.explode(F.array(F.lit(2), F.lit(3))).alias("stamp"))  # each key twice
    return registry.register(f, new, ["doc_id"], "stamp", [F.desc("stamp")])


@query("""WITH t AS (SELECT user_id AS source_id, event_type AS chunk_fingerprint, event_id % 3 AS chunk_index, max(event_id) AS stamp FROM events GROUP BY ALL)
SELECT source_id, chunk_fingerprint, chunk_index, stamp, CAST(source_id % 2 AS INTEGER) AS embedded FROM t
UNION ALL SELECT DISTINCT user_id + 1000000, event_type, event_id % 3, -1, 1 FROM events WHERE user_id % 2 = 1""")
def upsert_repeated_chunks(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("chunk_fingerprint"), (F.col("event_id") % 3).alias("chunk_index"), F.col("event_id").alias("stamp"))
    keys = ["source_id", "chunk_fingerprint", "chunk_index"]
    old = e.where("source_id % 2 = 1").select(*keys).distinct().select(*keys, F.lit(-1).cast("long").alias("stamp"), F.lit(1).alias("embedded"))
    stale = old.withColumn("chunk_index", F.col("chunk_index") + 10)  # of sources that come again: pruned
    other = old.withColumn("source_id", F.col("source_id") + 1_000_000)
    return registry.upsert(old.union(stale).union(other), e.withColumn("embedded", F.lit(0)), keys, ["embedded"], [F.desc("stamp")], prune=["source_id"])


@query(f"""WITH {A.FILES}, new AS (SELECT doc_id + 500 AS doc_id, length * 2 AS length FROM files)
SELECT coalesce(f.doc_id, n.doc_id) AS doc_id, coalesce(n.length, f.length) AS length, CASE WHEN f.doc_id IS NULL THEN 0 ELSE f.embedded END AS embedded FROM files f FULL JOIN new n ON f.doc_id = n.doc_id""")
def upsert_keeping_flags(spark, sf):
    f = A.files(spark, sf).select("doc_id", "length", "embedded")
    new = f.select((F.col("doc_id") + 500).alias("doc_id"), F.explode(F.array(F.col("length"), F.col("length") * 2)).alias("length"), F.lit(0).alias("embedded"))
    return registry.upsert(f, new, ["doc_id"], keep=["embedded"], order=[F.desc("length")])


@query(f"""WITH {A.FILES} SELECT doc_id, length + doc_id AS length, CASE WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN embedded ELSE 0 END AS embedded
FROM files WHERE doc_id % 11 <> 0""")
def bucketed_registry(spark, sf):
    """An upsert, a mark and a removal, step by step, none of which moves the registry's rows to other buckets."""
    kept = tables.Registry(tables.shared_folder(spark), ("file_fingerprint",), 16)
    f = A.files(spark, sf).select("file_fingerprint", "doc_id", "length", "embedded")
    kept.put(f.where("doc_id % 2 = 0"), 0)
    new = f.withColumn("length", F.col("length") + F.col("doc_id")).withColumn("embedded", F.lit(0))
    kept.put(registry.upsert(kept.get(spark), new, ["file_fingerprint"], keep=["embedded"], null_keys=False), 1)
    done = f.where("doc_id % 7 = 0").select("file_fingerprint")
    kept.put(registry.mark(kept.get(spark), done, ["file_fingerprint"], {"embedded": F.lit(2)}, null_keys=False), 2)
    return registry.remove(kept.get(spark), f.where("doc_id % 11 = 0"), ["file_fingerprint"], null_keys=False).select("doc_id", "length", "embedded")


@query(f"WITH {A.FILES} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE converted END AS converted, CASE WHEN doc_id % 14 = 0 THEN 'new' ELSE domain END AS domain FROM files")
def mark_converted(spark, sf):
    f = A.files(spark, sf).select("doc_id", "converted", "domain")
    done = f.where("doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 14 == 0, F.lit("new")).otherwise(F.lit("")).alias("domain"), F.lit(2).alias("at"))
    done = done.union(done.select("doc_id", F.lit("overruled").alias("domain"), F.lit(1)))
    return registry.mark(f, done, ["doc_id"], {"converted": F.lit(1)}, ["domain"], [F.desc("at")])


@query(f"WITH {A.FILES} SELECT doc_id, 'kept' AS what FROM files WHERE doc_id NOT IN (SELECT doc_id * 3 FROM labels) UNION ALL SELECT DISTINCT doc_id * 3, 'missing' FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM files)")
def remove_files(spark, sf):
    f, gone = A.files(spark, sf).select("doc_id"), A.table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    return registry.remove(f, gone, ["doc_id"]).withColumn("what", F.lit("kept")).union(registry.missing(f, gone, ["doc_id"]).withColumn("what", F.lit("missing")))


@query(f"WITH {A.VECTORS} SELECT domain, count(*) AS rows, (SELECT count(*) FROM vectors WHERE subject = 's3') AS deleted FROM vectors WHERE subject <> 's3' GROUP BY domain")
def delete_by_subject(spark, sf):
    kept, count = registry.delete_where(A.vectors(spark, sf), F.col("subject") == "s3")
    return kept.groupBy("domain").agg(F.count("*").alias("rows")).withColumn("deleted", F.lit(count.first()["deleted"]))


@query(f"WITH {A.FILES} SELECT doc_id, CASE WHEN domain = 'src0' THEN 0 ELSE embedded END AS embedded, (SELECT count(*) FROM files WHERE domain = 'src0') AS matched FROM files")
def reset_embedded(spark, sf):
    f, hit = A.files(spark, sf), F.col("domain") == "src0"
    matched = registry.reset_count(f, hit).first()["matched"]
    return registry.reset_flag(f, "embedded", ["converted", "embedded"], hit).select("doc_id", "embedded", F.lit(matched).alias("matched"))


LATEST_EVENT = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(LATEST_EVENT)
def latest_change(spark, sf):
    e = A.table(spark, sf, "events")
    return registry.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def cache_put(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    old, new = registry.latest(e.where(~bought), ["user_id"], [F.desc("event_id")]), e.where(bought)
    return registry.put_latest(old, new, ["user_id"], "event_id").select("user_id", "event_id")


@query(f"WITH {A.CURRENT_NOTES} SELECT note_id, content_version FROM current_notes WHERE bubble_id <> 'b3'")
def delete_bubble(spark, sf):
    n = A.current_notes(spark, sf).select("bubble_id", "note_id", "content_version")
    gone = n.where("bubble_id = 'b3'").select("bubble_id")
    return registry.cascade({"notes": n}, gone, ["bubble_id"])["notes"].drop("bubble_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 2 ELSE 1 END AS blocks, CASE WHEN doc_id % 6 >= 4 THEN lang ELSE '' END AS text,
  CASE WHEN doc_id % 6 >= 4 THEN lang ELSE '' END AS markdown FROM documents""")
def repaired_notes(spark, sf):
    """No document, no children, children that are no list, a paragraph without runs, a whole one, and one beside an unknown block."""
    whole = F.concat(F.lit('{"type":"paragraph","data":{"delta":[{"insert":"'), "lang", F.lit('"}]}}'))
    kinds = [F.lit("no JSON {"), F.lit("{}"), F.lit('{"children": 3}'), F.lit('{"children":[{"type":"paragraph"}]}'), F.concat(F.lit('{"children":['), whole, F.lit("]}")), F.concat(F.lit('{"children":['), whole, F.lit(',{"type":"odd"}]}'))]
    broken = F.coalesce(*[F.when(F.col("doc_id") % 6 == i, k) for i, k in enumerate(kinds)])
    rows = A.table(spark, sf, "documents").select("doc_id", notes.parsed(broken).alias("d"))
    return rows.select("doc_id", F.size("d.children").alias("blocks"), notes.total_text(F.col("d")).alias("text"), notes.markdown(F.col("d")).alias("markdown"))


@query(f"WITH {A.NOTE_EDITS} SELECT note_id, seq, chars, blocks FROM note_edits")
def note_text(spark, sf):
    e = A.note_edits(spark, sf).withColumn("doc", notes.parsed(F.col("document")))
    return e.select("note_id", "seq", F.length(notes.total_text(F.col("doc"))).cast("long").alias("chars"), F.size("doc.children").cast("long").alias("blocks"))


INCREMENTS = f"""{A.NOTE_EDITS}, o AS (SELECT *, coalesce(lag(chars) OVER w, 0) AS oc, coalesce(lag(blocks) OVER w, 0) AS ob FROM note_edits WINDOW w AS (PARTITION BY note_id ORDER BY seq)),
inc AS (SELECT note_id, bubble_id, seq, CASE WHEN chars - oc > 125 OR blocks - ob > 10 THEN 1.0::DOUBLE WHEN chars - oc > 75 OR blocks - ob > 5 THEN 0.1::DOUBLE WHEN chars - oc > 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS increment FROM o)"""


def _versions(spark, sf):
    e = A.note_edits(spark, sf).withColumn("doc", notes.parsed(F.col("document")))
    e = e.select("note_id", "bubble_id", "seq", F.length(notes.total_text(F.col("doc"))).alias("chars"), F.size("doc.children").alias("blocks"), F.md5("document").alias("hash"))
    return notes.versions(e), e


@query(f"WITH {INCREMENTS} SELECT note_id, seq, increment FROM inc")
def version_increments(spark, sf):
    return _versions(spark, sf)[0].select("note_id", "seq", "increment")


VERSIONS = f"""{INCREMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq) AS r FROM inc), v AS (
  SELECT note_id, bubble_id, seq, r, increment, 0.0::DOUBLE AS version_before, CASE WHEN increment >= 1 THEN 1.0::DOUBLE ELSE increment END AS version FROM n WHERE r = 1
  UNION ALL SELECT n.note_id, n.bubble_id, n.seq, n.r, n.increment, v.version, CASE WHEN n.increment >= 1 THEN floor(v.version) + 1 ELSE round(v.version + n.increment, 2) END
  FROM v JOIN n ON n.note_id = v.note_id AND n.r = v.r + 1)"""


@query(f"WITH RECURSIVE {VERSIONS} SELECT note_id, seq, version_before, version FROM v")
def note_versions(spark, sf):
    return _versions(spark, sf)[0].select("note_id", "seq", "version_before", "version")


@query("WITH t AS (SELECT * FROM conversations WHERE text IS NOT NULL) SELECT CAST(conv_id AS VARCHAR) AS note_id, turn AS seq, 'add' AS op, '/document/children/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS path FROM t")
def note_diffs(spark, sf):
    e = A.note_edits(spark, sf).withColumn("doc", F.from_json("document", "children array<struct<type:string,data:string>>"))
    e = e.select("note_id", "seq", F.transform("doc.children", lambda b: F.concat(b["type"], F.lit(":"), b["data"])).alias("children"))
    return notes.diff_ops(e).select("note_id", "seq", "op", "path")


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS note_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL)
SELECT note_id, turn AS seq, 0 AS step, 'add' AS op, '/document/children/0' AS path, 'draft ' || turn AS value FROM t WHERE r = 1
UNION ALL SELECT note_id, turn, CASE WHEN r > 3 THEN 1 ELSE 0 END, 'replace', '/document/children/' || (least(r, 3) - 2), 'turn ' || before FROM (SELECT *, lag(turn) OVER (PARTITION BY note_id ORDER BY turn) AS before FROM t) WHERE r > 1
UNION ALL SELECT note_id, turn, CASE WHEN r > 3 THEN 2 ELSE 1 END, 'add', '/document/children/' || (least(r, 3) - 1), 'draft ' || turn FROM t WHERE r > 1
UNION ALL SELECT note_id, turn, 0, 'remove', '/document/children/0', NULL FROM t WHERE r > 3""")
def note_patches(spark, sf):
    """A note of the last three turns, the newest of them a draft: with each turn the oldest goes, the draft is replaced, a draft comes."""
    c = A.table(spark, sf, "conversations").where("text is not null")
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, Window.currentRow)
    kept = F.transform(F.collect_list("turn").over(line), lambda t: F.concat(F.when(t == F.col("turn"), F.lit("draft ")).otherwise(F.lit("turn ")), t.cast("string")))
    return notes.diff_ops(c.select(F.col("conv_id").cast("string").alias("note_id"), F.col("turn").alias("seq"), kept.alias("children")))


@query("SELECT user_id AS note_id, event_type AS version, min(event_id) AS first_seq, max(event_id) AS seq FROM events GROUP BY user_id, event_type")
def collapsed_history(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("version"), F.col("event_id").alias("seq"))
    return notes.collapse(e)


@query("SELECT CAST(conv_id AS VARCHAR) AS note_id, trim(string_agg(CASE WHEN role = 'system' THEN '## ' || text ELSE trim(text, ' ') END || chr(10), chr(10) ORDER BY turn), ' ' || chr(10) || chr(9)) AS markdown FROM conversations WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY conv_id")
def note_markdown(spark, sf):
    e = registry.latest(A.note_edits(spark, sf), ["note_id"], [F.desc("seq")])
    return e.select("note_id", notes.markdown(notes.parsed(F.col("document"))).alias("markdown"))


@query(f"WITH {A.CURRENT_NOTES} SELECT note_id, CASE WHEN CAST(note_id AS BIGINT) % 9 = 0 THEN 'renamed ' || note_id ELSE 'note ' || note_id END AS title, md5(text) AS content_hash FROM current_notes")
def renamed_notes(spark, sf):
    n = A.current_notes(spark, sf).select("note_id", F.concat(F.lit("note "), "note_id").alias("title"), "bubble_id", F.col("text").alias("document"), F.lit("[]").alias("ink"))
    new = n.where("cast(note_id as bigint) % 9 = 0").select("note_id", F.concat(F.lit("renamed "), "note_id").alias("title"))
    return notes.new_notes(notes.rename(n, new)).select("note_id", "title", "content_hash")


@query(f"WITH {A.VECTORS}, {A.SUBQUERIES} SELECT query_id, domain, subject FROM subqueries WHERE domain <> '' AND subject <> '' AND (domain, subject) IN (SELECT domain, subject FROM vectors)")
def routed_subqueries(spark, sf):
    return retrieval.route(A.subqueries(spark, sf), retrieval.existing_routes(A.vectors(spark, sf))).select("query_id", "domain", "subject")


@query(f"WITH {A.VECTORS} SELECT d.domain, s.subject FROM (SELECT DISTINCT domain FROM vectors) d, (SELECT DISTINCT subject FROM vectors) s EXCEPT SELECT domain, subject FROM vectors")
def routes_that_do_not_exist(spark, sf):
    v = A.vectors(spark, sf)
    return retrieval.existing_routes(v, "cartesian").exceptAll(retrieval.existing_routes(v))


@query(f"""WITH {A.SUBQUERIES} SELECT note_id, domain, query_id FROM (SELECT question_id % 3 AS note_id, domain, query_id, row_number() OVER (PARTITION BY question_id % 3, domain, subject ORDER BY question_id, sub_pos) AS r FROM subqueries) WHERE r = 1""")
def first_route_of_note(spark, sf):
    q = A.subqueries(spark, sf).withColumn("note_id", F.col("question_id") % 3).withColumn("query_pos", F.col("question_id"))
    return retrieval.first_routes(q).select("note_id", "domain", "query_id")


@query(f"""WITH {NEAREST}, once AS (SELECT *, row_number() OVER (PARTITION BY question_id, sha256(content) ORDER BY sub_pos, rank, chunk_id) AS f FROM ranked WHERE rank <= 5),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sub_pos, rank, chunk_id) AS p FROM once WHERE f = 1)
SELECT question_id, string_agg(content, chr(10) || chr(10) ORDER BY p) AS context, CAST(count(*) AS INTEGER) AS chunks FROM top WHERE p <= 5 GROUP BY question_id""")
def question_context(spark, sf):
    q = A.subqueries(spark, sf)
    found = search.nearest(q, A.vectors(spark, sf), retrieval.SEARCH_K).join(q.select("query_id", "question_id", "sub_pos"), "query_id")
    return retrieval.context(found, "question_id", ["sub_pos", "rank", "chunk_id"])


@query()
def answer_prompts(spark, sf):
    q = A.subqueries(spark, sf)
    questions = q.select("question_id", F.concat(F.lit("question "), "question_id").alias("question")).distinct()
    return jobs.answer_context(questions, q, A.vectors(spark, sf))


@query(f"WITH {A.VECTORS} SELECT chunk_id, file_fingerprint FROM vectors WHERE file_fingerprint IN (SELECT sha256(CAST(doc_id AS VARCHAR)) FROM labels)")
def chunks_by_fingerprint(spark, sf):
    f = A.table(spark, sf, "labels").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("file_fingerprint"))
    return retrieval.by_fingerprint(A.vectors(spark, sf), f).select("chunk_id", "file_fingerprint")


CACHED = f"WITH {A.CURRENT_NOTES}, {A.ANALYSIS_CACHE}"


@query(f"{CACHED} SELECT n.note_id, coalesce(c.content_version = n.content_version AND analysis <> '', false) AS hit, CASE WHEN c.content_version = n.content_version AND analysis <> '' THEN analysis END AS analysis FROM current_notes n LEFT JOIN analysis_cache c USING (bubble_id, note_id)")
def cached_analyses(spark, sf):
    return analysis.cache_lookup(A.current_notes(spark, sf), A.analysis_cache(spark, sf)).select("note_id", "hit", "analysis")


@query(f"""{CACHED} SELECT n.note_id, c.content_version IS NOT NULL AS "exists", coalesce(c.content_version = n.content_version, false) AS is_current, c.content_version AS cached_version, NOT coalesce(c.content_version = n.content_version, false) AS needs_update FROM current_notes n LEFT JOIN analysis_cache c USING (bubble_id, note_id)""")
def analysis_statuses(spark, sf):
    return analysis.analysis_status(A.current_notes(spark, sf), A.analysis_cache(spark, sf)).select("note_id", "exists", "is_current", "cached_version", "needs_update")


@query(f"{CACHED} SELECT note_id FROM current_notes WHERE note_id NOT IN (SELECT note_id FROM analysis_cache)")
def notes_without_retrieval(spark, sf):
    return analysis.needs_retrieval(A.current_notes(spark, sf), A.analysis_cache(spark, sf)).select("note_id")


@query(f"""{CACHED} SELECT note_id, content_version FROM current_notes n WHERE NOT EXISTS (SELECT 1 FROM analysis_cache c WHERE c.note_id = n.note_id AND c.content_version = n.content_version)""")
def notes_to_archive(spark, sf):
    return analysis.to_archive(A.current_notes(spark, sf), A.analysis_cache(spark, sf)).select("note_id", "content_version")


@query(f"""{CACHED} SELECT note_id, content_version, sha256('p' || note_id) AS prompt_hash, CAST(row_number() OVER (PARTITION BY note_id ORDER BY content_version DESC) AS INTEGER) AS newest
FROM (SELECT note_id, content_version FROM analysis_cache UNION ALL SELECT note_id, content_version + 1 FROM analysis_cache) WHERE content_version >= 1.0""")
def analysis_history(spark, sf):
    once = A.analysis_cache(spark, sf).withColumn("prompt_hash", F.sha2(F.concat(F.lit("p"), "note_id"), 256))
    history = once.union(once.withColumn("content_version", F.col("content_version") + 1))
    asked = history.where("content_version >= 1").select("note_id", "content_version", F.concat(F.lit("p"), "note_id").alias("prompt"))
    return analysis.version_history(analysis.history_lookup(asked, history)).select("note_id", "content_version", "prompt_hash", "newest")


@query(f"""WITH RECURSIVE {A.ANALYSIS_CACHE}, {VERSIONS} SELECT note_id, seq, version FROM v
WHERE (increment >= 1 OR version_before = 0) AND NOT EXISTS (SELECT 1 FROM analysis_cache c WHERE c.note_id = v.note_id AND c.bubble_id = v.bubble_id AND c.content_version = v.version)""")
def first_or_major_edits(spark, sf):
    return jobs.apply_note_updates(A.note_edits(spark, sf), A.analysis_cache(spark, sf))[1].select("note_id", "seq", "version")


@query(f"""WITH RECURSIVE {VERSIONS} SELECT note_id, version_before AS version, min(seq) AS first_seq, max(seq) AS seq, 1 AS n_ops, 'add' AS op, '/document/children/' || (max(r) - 1) AS path
FROM v GROUP BY note_id, version_before""")
def note_histories(spark, sf):
    h = jobs.note_history(A.note_edits(spark, sf))
    return h.select("note_id", "version", "first_seq", "seq", F.size("ops").alias("n_ops"), F.col("ops")[0]["op"].alias("op"), F.col("ops")[0]["path"].alias("path"))


@query(f"WITH {A.FILES} SELECT file_fingerprint AS source_id, doc_id AS chunk FROM files WHERE converted = 1 AND embedded = 0")
def chunks_to_embed(spark, sf):
    f = A.files(spark, sf)
    chunks = f.select(F.col("file_fingerprint").alias("source_id"), F.col("doc_id").alias("chunk"), "embedded")
    return analysis.unembedded(f, chunks).select("source_id", "chunk")


@query("SELECT conv_id AS note_id, count(*) AS chunks_count, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS queries_count, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS retrieved_docs FROM conversations GROUP BY conv_id")
def analysis_counters(spark, sf):
    c = A.table(spark, sf, "conversations").withColumnRenamed("conv_id", "note_id")
    return stats.run_counters(c, c, c.where("role = 'user'"), c.where("role = 'assistant'"))


@query()
def hashed_embeddings(spark, sf):
    return retrieval.embed(A.table(spark, sf, "documents").select("doc_id", "text"), "text", retrieval.hashing_embedder()).select("doc_id", "embedding")


@query(f"""WITH {MD}, {A.FILES} SELECT file_fingerprint AS source_id, chunk_index, domain, subject, 64 AS dimensions FROM chunks c JOIN files f ON c.source_id = CAST(doc_id AS VARCHAR) WHERE doc_id % 3 <> 1""")
def ingested_chunks(spark, sf):
    sources = A.files(spark, sf, A.markdown_text().alias("text")).where("doc_id is not null")
    stamp = F.lit("2026-01-01").cast("timestamp")
    # a third of the files is new, a third was converted only, and a third is done
    known = sources.where("converted = 1").select("file_fingerprint", "original_name", F.col("original_name").alias("sanitized_name"), "domain", "subject", "converted", "embedded", "filepath", stamp.alias("last_updated"))

    def held(embedded):
        rows = sources.where(f"converted = 1 and embedded = {embedded}").select(F.col("file_fingerprint").alias("source_id"), "text")
        return chunking.chunk(rows, most=10**9).withColumn("embedded", F.lit(embedded))

    out = jobs.ingest_corpus(sources.select("original_name", "filepath", "domain", "subject", "text"), known, held(0).unionByName(held(1)), retrieval.hashing_embedder(), stamp, most=10**9)
    return out.vectors.select("source_id", "chunk_index", "domain", "subject", F.size("embedding").alias("dimensions"))


@query()
def note_chunks(spark, sf):
    latest = registry.latest(A.note_edits(spark, sf), ["note_id"], [F.desc("seq")])
    return jobs.process_notes(latest).drop("content")


@query(f"WITH {MD} SELECT source_id, chunk_index, content, CAST(row_number() OVER (PARTITION BY source_id ORDER BY chunk_index) AS INTEGER) AS place FROM chunks WHERE source_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AND (CAST(source_id AS BIGINT) % 2 = 0 OR chunk_index = 1)")
def fetched_chunks(spark, sf):
    ids = A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_id"))
    asked = ids.select("source_id", F.when(F.col("source_id").cast("long") % 2 != 0, F.lit(1)).alias("chunk_index"))
    return chunking.asked_chunks(chunking.chunk(A.markdown(spark, sf), most=10**9), asked).select("source_id", "chunk_index", "content", "place")


@query(f"WITH {MD} SELECT source_id, chunk_index FROM chunks WHERE chunk_index = 0")
def first_chunks(spark, sf):
    return chunking.fetch(chunking.chunk(A.markdown(spark, sf), most=10**9), chunk_index=0).select("source_id", "chunk_index")


@query(f"""WITH {MD}, {A.FILES} SELECT c.source_id AS file_fingerprint, chunk_fingerprint, chunk_index, 'header' AS chunk_type, original_name, domain, subject, '' AS parent_chunk_index
FROM chunks c JOIN files f ON c.source_id = CAST(doc_id AS VARCHAR)""")
def embed_metadata(spark, sf):
    f = A.files(spark, sf).withColumn("file_fingerprint", F.col("doc_id").cast("string"))
    return chunking.embed_metadata(chunking.chunk(A.markdown(spark, sf), most=10**9), f)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'given ' || doc_id ELSE 'read ' || source END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS subject, source AS domain,
  array_to_string(['a', source, 'b c'], '|') AS keywords FROM documents""")
def merged_metadata(spark, sf):
    d = A.table(spark, sf, "documents")
    given = {"title": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("given "), "doc_id")), "domain": F.col("source")}
    read = {"title": F.concat(F.lit("read "), "source"), "subject": F.when(F.col("doc_id") % 3 != 0, F.col("lang"))}
    words = X.clean_keywords(F.concat(F.lit(" a, "), "source", F.lit(",, b c ")))
    return d.select("doc_id", *[c.alias(n) for n, c in X.merged_metadata(given, read).items()], F.array_join(words, "|").alias("keywords"))


@query("""SELECT doc_id, doc_id % 2 = 0 AS valid, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang END AS authors FROM documents""")
def file_metadata(spark, sf):
    d = A.table(spark, sf, "documents")
    body = F.struct(F.concat(F.lit("t"), "doc_id").alias("title"), F.col("source").alias("domain"), F.col("lang").alias("subject"), F.array("source", "lang").alias("authors"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("k"))).alias("keywords"))
    rows = d.select("doc_id", X.valid_metadata(F.try_parse_json(F.to_json(body))).alias("m"))
    return rows.select("doc_id", F.col("m").isNotNull().alias("valid"), F.col("m.title").alias("title"), F.array_join("m.authors", "|").alias("authors"))


@query("""SELECT doc_id, md5('{"a": ' || doc_id || ', "b": "' || lang || '"}') AS hash, true AS same FROM documents""")
def object_hashes(spark, sf):
    d = A.table(spark, sf, "documents")
    one, other = F.struct(F.col("lang").alias("b"), F.col("doc_id").alias("a")), F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b"))
    return d.select("doc_id", X.object_hash(F.to_json(one)).alias("hash"), (X.object_hash(F.to_json(one)) == X.object_hash(F.to_json(other))).alias("same"))


@query(f"SELECT a.vec_id, round({_alike('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS alike FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 100")
def cosine_to_the_hundredth(spark, sf):
    e = A.table(spark, sf, "embeddings")
    near = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("at"), F.col("embedding").alias("other"))
    rows = e.join(near, F.col("vec_id") - F.col("vec_id") % 100 == F.col("at"))
    return rows.select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("alike"))


@query(f"""WITH {A.VECTORS}, d AS (SELECT domain, row_number() OVER (ORDER BY domain) AS r FROM (SELECT DISTINCT domain FROM vectors)), s AS (SELECT subject, row_number() OVER (ORDER BY subject) AS r FROM (SELECT DISTINCT subject FROM vectors))
SELECT domain, subject, (domain, subject) IN (SELECT domain, subject FROM vectors) AS "exists" FROM d JOIN s USING (r)""")
def zipped_routes(spark, sf):
    v = A.vectors(spark, sf)
    there = retrieval.existing_routes(v).withColumn("exists", F.lit(True))
    return retrieval.existing_routes(v, "zip").join(there, ["domain", "subject"], "left").select("domain", "subject", F.coalesce("exists", F.lit(False)).alias("exists"))


@query(f"{CACHED} SELECT CAST(count(*) AS BIGINT) AS entries, min(cached_at) AS oldest, max(cached_at) AS newest, (SELECT count(*) FROM analysis_cache WHERE bubble_id = 'b3') AS gone FROM analysis_cache WHERE bubble_id <> 'b3'")
def invalidated_cache(spark, sf):
    cache = A.analysis_cache(spark, sf)
    kept, count = registry.delete_where(cache, F.col("bubble_id") == "b3")
    return registry.cache_info(kept, analysis.NOTE, "cached_at").withColumn("gone", F.lit(count.first()["deleted"]))


@query(f"{CACHED} SELECT note_id, analysis, 2 AS stamp FROM analysis_cache WHERE content_version = 1.0 UNION ALL SELECT note_id, 'old', 1 FROM analysis_cache WHERE content_version <> 1.0")
def saved_history(spark, sf):
    c = A.analysis_cache(spark, sf)
    old = c.select("note_id", F.lit("old").alias("analysis"), F.lit(1).alias("stamp"))
    new = c.where("content_version = 1").select("note_id", "analysis", F.lit(2).alias("stamp"))
    return registry.put_latest(old, new, ["note_id"], "stamp")


@query(f"WITH {A.VECTORS} SELECT chunk_id, file_fingerprint, 'b' || (chunk_id % 10) AS bubble_id, 'then' AS cached_at FROM vectors WHERE chunk_id % 10 <> 3")
def retrieval_cache(spark, sf):
    note = F.floor(F.col("chunk_id") / 2).cast("string")
    v = A.vectors(spark, sf).select("chunk_id", "file_fingerprint", note.alias("note_id"), F.concat(F.lit("b"), F.col("chunk_id") % 10).alias("bubble_id"))
    none = v.limit(0).withColumn("cached_at", F.lit("then"))
    rows = registry.append_stamped(none, v, "cached_at", F.lit("then"))
    kept = registry.remove(rows, rows.where("bubble_id = 'b3'"), ["bubble_id"])
    return analysis.retrieved_for(v, kept).drop("note_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS note_id, string_agg(CAST(turn AS VARCHAR) || ':' || text, '|' ORDER BY turn DESC) AS versions FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def archived_versions(spark, sf):
    c = A.table(spark, sf, "conversations").where("text is not null")
    archive = c.select(F.col("conv_id").cast("string").alias("note_id"), (-F.col("turn").cast("double")).alias("content_version"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    rows = analysis.archived_versions(archive)
    return rows.select("note_id", F.array_join(F.transform("versions", lambda v: F.concat(v["pos"].cast("string"), F.lit(":"), v["content"])), "|").alias("versions"))


@query("SELECT page_id, '| ' || page_id || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '|  | ' || len(url) || ' |' AS markdown FROM pages WHERE url IS NOT NULL")
def note_tables(spark, sf):
    p = A.table(spark, sf, "pages").where("url is not null")

    def cell(r, c, text):
        delta = F.array(F.struct(text.cast("string").alias("insert")))
        return F.struct(F.struct(F.lit(r).alias("rowPosition"), F.lit(c).alias("colPosition")).alias("data"), F.array(F.struct(F.struct(delta.alias("delta")).alias("data"))).alias("children"))

    cells = F.array(cell(0, 0, F.col("page_id")), cell(1, 1, F.lit("first")), cell(1, 1, F.length("url")), cell(7, 7, F.lit("outside")))
    table = F.struct(F.lit("table").alias("type"), F.struct(F.lit(2).alias("rowsLen"), F.lit(2).alias("colsLen")).alias("data"), cells.alias("children"))
    document = F.to_json(F.struct(F.lit("page").alias("type"), F.array(table).alias("children")))
    return p.select("page_id", notes.markdown(notes.parsed(document)).alias("markdown"))


@query(f"""{CACHED}, {A.VECTORS}, found AS (SELECT CAST(q.vec_id AS VARCHAR) AS note_id, v.chunk_id, v.content, {DISTANCE.replace('q.query_vector', 'q.embedding')} AS distance
  FROM embeddings q JOIN vectors v ON v.chunk_id // 5 = q.vec_id // 5 AND v.chunk_id <> q.vec_id WHERE q.vec_id % 100 = 0),
once AS (SELECT *, row_number() OVER (PARTITION BY note_id, sha256(content) ORDER BY distance, chunk_id) AS f FROM found),
fresh AS (SELECT note_id, string_agg(content, chr(10) || chr(10) ORDER BY distance, chunk_id) AS context FROM once WHERE f = 1 GROUP BY note_id)
SELECT note_id, content_version, 'Review the note against its sources and its earlier form.' || chr(10) || 'Earlier:' || chr(10) || coalesce(analysis, '') || chr(10) || 'Note:' || chr(10) || coalesce(n.text, '')
  || chr(10) || 'Sources:' || chr(10) || CASE WHEN c.note_id IS NULL THEN coalesce(context, '') ELSE 'source of ' || n.note_id END || chr(10) AS prompt
FROM current_notes n LEFT JOIN (SELECT note_id, analysis FROM analysis_cache) c USING (note_id) LEFT JOIN fresh USING (note_id)""")
def review_prompts(spark, sf):
    """Notes with a retrieval cache use it. Of the others those of asking vectors are routed to a collection of five, all of which
    is their context but the vector itself; the rest have none."""
    n, c = A.current_notes(spark, sf), A.analysis_cache(spark, sf)
    archive = c.select("note_id", F.col("content_version"), F.lit(0).alias("chunk_id"), F.col("analysis").alias("content"))
    held = c.select("note_id", "bubble_id", F.lit("d").alias("domain"), F.lit("s").alias("subject"), F.lit(1).cast("long").alias("chunk_id"), F.concat(F.lit("source of "), "note_id").alias("content"))

    def five(rows, vec_id):
        five_id = F.floor(F.col(vec_id) / 5)
        return rows.withColumn("domain", F.concat(F.lit("d"), five_id % 3)).withColumn("subject", F.concat(F.lit("s"), five_id))

    q = five(A.subqueries(spark, sf), "query_id").withColumn("note_id", F.col("query_id").cast("string")).withColumn("query_pos", F.col("question_id"))
    return jobs.analyse_notes(n, archive, held, q, five(A.vectors(spark, sf), "chunk_id")).drop("bubble_id")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'about ' || source || ' in ' || lang END AS prompt, source, lang FROM documents)
SELECT doc_id, prompt, CASE WHEN prompt IS NULL THEN NULL WHEN lang = 'en' THEN 'known ' || source WHEN lang = 'de' THEN NULL ELSE upper(prompt) END AS output,
  CAST((SELECT count(DISTINCT prompt) FROM p WHERE lang <> 'de') AS BIGINT) AS known FROM p""")
def memoised_outputs(spark, sf):
    """A model that answers nothing valid about German, and has been asked about English before."""
    d = A.table(spark, sf, "documents")
    prompt = F.concat(F.lit("about "), "source", F.lit(" in "), "lang")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 9 != 0, prompt).alias("prompt"))
    before = d.where("lang = 'en' and doc_id % 9 <> 0").select(F.sha2(prompt, 256).alias("prompt_hash"), F.concat(F.lit("known "), "source").alias("output")).distinct()
    out, calls = analysis.memoised(rows, "prompt", before, lambda x: x.str.upper(), lambda o: ~o.endswith(" DE"))
    return out.select("doc_id", "prompt", "output").crossJoin(calls.agg(F.count("*").alias("known")))  # one row


@query(f"""WITH {A.VECTORS}, {A.FILES} SELECT 'counts' AS part, domain, subject, count(*) AS n FROM vectors GROUP BY domain, subject
UNION ALL SELECT 'storage', domain, subject, CAST(sum(length) AS BIGINT) FROM files GROUP BY domain, subject
UNION ALL SELECT 'samples', domain, subject, least(3, count(*)) FROM vectors GROUP BY domain, subject
UNION ALL SELECT 'totals', NULL, NULL, count(*) FROM vectors""")
def inspected_stores(spark, sf):
    parts = jobs.inspect_stores(A.vectors(spark, sf), A.files(spark, sf))
    rows = parts["counts"].select(F.lit("counts").alias("part"), "domain", "subject", F.col("documents").alias("n"))
    rows = rows.union(parts["storage"].select(F.lit("storage"), "domain", "subject", "bytes"))
    rows = rows.union(parts["samples"].groupBy("domain", "subject").agg(F.count("*").alias("n")).select(F.lit("samples"), "domain", "subject", "n"))
    return rows.union(parts["totals"].where("level = 'total'").select(F.lit("totals"), "domain", "subject", "documents"))


@query("""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS note_id, 'b' || (doc_id % 10) AS bubble_id FROM documents), new AS (SELECT CAST(doc_id + 100 AS VARCHAR) AS note_id, 'b' || (doc_id % 10) AS bubble_id FROM documents)
SELECT coalesce(n.note_id, new.note_id) AS note_id, coalesce(n.bubble_id, new.bubble_id) AS bubble_id, CASE WHEN CAST(coalesce(n.note_id, new.note_id) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS analysed,
  'd' AS domain, CASE WHEN new.note_id IS NULL THEN 1 ELSE 2 END AS last_analysed FROM n FULL JOIN new ON n.note_id = new.note_id""")
def registered_notes(spark, sf):
    """Several notes of one bubble register, and an empty domain of a mark does not overwrite."""
    d = A.table(spark, sf, "documents")

    def rows(plus, stamp):
        return d.select((F.col("doc_id") + plus).cast("string").alias("note_id"), F.concat(F.lit("b"), F.col("doc_id") % 10).alias("bubble_id"), F.lit(0).alias("analysed"), F.lit("d").alias("domain"), F.lit(stamp).alias("last_analysed"))

    n = registry.register(rows(0, 1), rows(100, 2), ["note_id"], "last_analysed")
    done = n.where("cast(note_id as bigint) % 5 = 0").select("note_id", F.lit("").alias("domain"))
    return registry.mark(n, done, ["note_id"], {"analysed": F.lit(1)}, ["domain"])


@query("SELECT lower(replace(source, ' ', '_')) || '_' || lang AS slug, CAST(2 AS BIGINT) AS names FROM documents GROUP BY source, lang")
def slug_collisions(spark, sf):
    d = A.table(spark, sf, "documents")
    both = F.array(F.concat("source", F.lit(" "), "lang"), F.concat(F.upper("source"), F.lit("_"), F.col("lang")))
    return X.slug_collisions(d.select(F.explode(both).alias("name")), "name")


@query("SELECT doc_id, doc_id % 3 = 0 AS has_id FROM documents")
def id_folders(spark, sf):
    d = A.table(spark, sf, "documents")
    hexes = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    path = F.concat_ws("/", F.lit("kb"), F.when(F.col("doc_id") % 3 == 0, uuid).otherwise(hexes), F.lit("x.pdf"))
    return d.select("doc_id", X.has_uuid_part(F.split(path, "/")).alias("has_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS note_id, v.version AS content_version FROM documents, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) v(version) WHERE doc_id % 4 <> 0")
def archive_of_notes(spark, sf):
    """Chunks are appended with their version, and dropped with their note."""
    d = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("note_id"))
    old = d.withColumn("content_version", F.lit(1.0))
    both = registry.append_stamped(old, d, "content_version", F.lit(2.0))
    return registry.remove(both, d.where("cast(note_id as bigint) % 4 = 0"), ["note_id"])
