"""Jobs made of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as X
from lorespark.operators import analysis, chunking, notes, registry, retrieval, search, stats
from lorespark.sources import tables
from lorespark.sources.tables import packed, stored

QUESTION = "Answer the question from the context only.\nQuestion: {question}\nContext:\n{context}\nAnswer:"
REVIEW = "Review the note against its sources and its earlier form.\nEarlier:\n{archived_data}\nNote:\n{current_note}\nSources:\n{context}\n"


DESCRIBE = "Give title, domain, subject, authors and keywords of the file as JSON.\nFile: {filename}\nKnown: {metadata}\n"


def describe_sources(sources: DataFrame, history: DataFrame, complete_fn) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources with title, domain, subject, authors and keywords, sources that got none, history of model calls).

    sources: (original_name, filepath, author, keywords, title, text), as they were read from the files. A model is asked for each
    file by its name and cleaned metadata; what the history knows is not asked again. Its output must hold a whole
    description in one of the first two forms, all of the output or a fenced block; else the file is one of those without.
    What was read from the file itself wins over what the model says.
    """
    read = {"title": X.sanitize_title(F.nullif(F.trim("title"), F.lit(""))), "authors": X.clean_authors(F.col("author")), "keywords": X.clean_keywords(F.col("keywords"))}
    rows = sources.select("original_name", "filepath", "text", F.struct(*[c.alias(n) for n, c in read.items()]).alias("read"))
    prompt = X.fill_template(DESCRIBE, {"filename": F.col("original_name"), "metadata": F.to_json("read")})

    def described(output: Column) -> Column:
        return X.valid_metadata(X.json_from_output(output, 2))

    rows, history = analysis.memoised(rows.withColumn("prompt", prompt), "prompt", history, complete_fn, lambda o: described(o).isNotNull())
    rows = rows.withColumn("said", described(F.col("output")))
    given = {n: F.col(f"read.{n}") for n in read}
    said = {n: F.col(f"said.{n}") for n in ("title", "domain", "subject", "authors", "keywords")}
    whole = [c.alias(n) for n, c in X.merged_metadata(given, said).items()]
    return rows.where("said is not null").select("original_name", "filepath", *whole, "text"), rows.where("said is null").select("original_name", "filepath"), history


def artifacts(described: DataFrame) -> DataFrame:
    """(domain, subject, title, markdown) of described sources, for sources.tables.write_markdown(): front matter, then the text."""
    front = X.front_matter({n: F.col(n) for n in ("title", "domain", "subject")}, {n: F.col(n) for n in ("authors", "keywords")})
    return described.select("domain", "subject", "title", F.concat(front, F.coalesce("text", F.lit(""))).alias("markdown"))


@dataclass
class Ingested:
    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame


CHUNK = ["source_id", "chunk_fingerprint", "chunk_index"]


def chunks_to_embed(files: DataFrame, chunks: DataFrame, new: DataFrame) -> DataFrame:
    """analysis.unembedded() of the chunk registry as it is once new is upserted, with original_name, domain and subject.

    Chunks of a document stay together and are shuffled by source_id alone, so their repeated headers hardly count; chunks
    of which only the key matters go without contents. Keys of new are unique and not null.
    """
    places = files.where("converted = 1 and embedded = 0").select(F.col("file_fingerprint").alias("source_id"), "original_name", "domain", "subject")
    # both sides lie by source_id, so joins by the whole key move nothing
    held = chunks.where("embedded = 0").join(places, "source_id").join(new.select(*CHUNK).repartition("source_id"), CHUNK, "left_anti")
    done = chunks.where("embedded <> 0 or embedded is null").select(*CHUNK).repartition("source_id")
    made = new.select(*chunks.columns).join(places, "source_id").join(done, CHUNK, "left_anti")
    return held.select(*made.columns).unionByName(made)


def ingest_corpus(sources: DataFrame, files: DataFrame, chunks: DataFrame, embed_fn, as_of: Column, most: int = chunking.MAX_TOKENS) -> Ingested:
    """Registers sources (original_name, filepath, domain, subject, text), chunks those not converted, embeds what is not embedded.

    files and chunks are the registries before; the result has them after, and the new vectors. Equal chunks are embedded once.
    Chunks and vectors are stored as they are made, and marks follow from what was stored. Running it again changes nothing but
    stamps; after a run that stopped half way it embeds what is registered and has no vectors.

    Each step is stored before the next, so that no more is on disk at once than the tables so far and one step's shuffles.
    Embeddings are stored beside their chunks, and joined when vectors is read.
    """
    named = sources.withColumn("file_fingerprint", X.file_fingerprint(F.col("original_name"), F.col("filepath")))
    fresh = named.select("file_fingerprint", "original_name", F.lit(None).cast("string").alias("sanitized_name"), "domain", "subject", F.lit(0).alias("converted"), F.lit(0).alias("embedded"), "filepath", as_of.alias("last_updated"))
    files = packed(registry.register(files, fresh, ["file_fingerprint"], "last_updated"))
    todo = named.join(files.where("converted = 0").select("file_fingerprint"), "file_fingerprint", "left_semi")
    new = packed(chunking.chunk(todo.select(F.col("file_fingerprint").alias("source_id"), "text"), most))
    titles = todo.select("file_fingerprint", X.sanitize_title(F.col("original_name")).alias("sanitized_name"))
    files = packed(registry.mark(files, titles, ["file_fingerprint"], {"converted": F.lit(1)}, fill=["sanitized_name"]))
    open_ = chunks_to_embed(files, chunks, new)
    row = registry.free("_row", open_)
    open_ = packed(open_.withColumn(row, F.monotonically_increasing_id()))
    once = retrieval.embed(open_.groupBy("chunk_fingerprint").agg(F.first("content").alias("content")), "content", embed_fn).drop("content")
    embedded = packed(open_.select("source_id", "chunk_fingerprint", row).join(once, "chunk_fingerprint"))
    vectors = open_.join(embedded.select(row, "embedding"), row).drop(row)
    chunks = registry.upsert(chunks, new, CHUNK, keep=["embedded"])
    done = embedded.select("source_id", "chunk_fingerprint")
    chunks = registry.mark(chunks, done, ["source_id", "chunk_fingerprint"], {"embedded": F.lit(1)})
    files = registry.mark(files, done.select(F.col("source_id").alias("file_fingerprint")), ["file_fingerprint"], {"embedded": F.lit(1)})
    return Ingested(files, chunks, vectors)


FILE_REGISTRY = "file_fingerprint string, original_name string, sanitized_name string, domain string, subject string, converted int, embedded int, filepath string, last_updated timestamp"


def ingest_batch(sources: DataFrame, batch: int, store: str, embed_fn, as_of: Column, most: int = chunking.MAX_TOKENS) -> None:
    """ingest_corpus() on the registries and vectors in the folder ``store``, as its numbered batch.

    The batch starts from the registries as the batch before left them and replaces whatever an earlier try of it wrote, vectors
    first, the file registry last. So a batch that failed anywhere, or comes again, gives each row once.
    """
    spark = sources.sparkSession
    files, chunks = (tables.snapshot(spark, f"{store}/{name}", batch) for name in ("files", "chunks"))
    files = spark.createDataFrame([], FILE_REGISTRY) if files is None else files
    chunks = chunking.chunk(sources.limit(0).select(F.lit("").alias("source_id"), "text")) if chunks is None else chunks
    out = ingest_corpus(sources, files, chunks, embed_fn, as_of, most)
    named = out.vectors.withColumn("chunk_id", F.concat_ws(":", "source_id", "chunk_index")).withColumnRenamed("source_id", "file_fingerprint")
    tables.add_vectors(named, f"{store}/vectors", batch=batch)
    tables.put_snapshot(out.chunks, f"{store}/chunks", batch)
    tables.put_snapshot(out.files, f"{store}/files", batch)


def remove_files(files: DataFrame, chunks: DataFrame, gone: DataFrame, store: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(files, chunks, keys asked for that are no files, vectors deleted) without the files of gone (original_name, file_fingerprint).

    A file goes only if both its name and fingerprint are asked for, and its chunks and stored vectors go with it.
    """
    keys = ["original_name", "file_fingerprint"]
    known = files.select(*keys).join(gone.select(*keys).distinct(), keys, "left_semi").select("file_fingerprint")
    left = registry.remove(chunks, known.withColumnRenamed("file_fingerprint", "source_id"), ["source_id"])
    return registry.remove(files, gone, keys), left, registry.missing(files, gone, keys), tables.delete_vectors(files.sparkSession, store, fingerprints=known)


def search_across_collections(queries: DataFrame, vectors: DataFrame, domains=None, subjects=None, k: int = retrieval.SEARCH_K) -> DataFrame:
    """Ids and distances alone; the vectors' contents are not read."""
    return search.nearest_ids(queries, retrieval.in_collections(vectors, domains, subjects), k)


def retrieve(routed: DataFrame, vectors: DataFrame, k: int = retrieval.MMR_K) -> DataFrame:
    """The k diverse chunks of each routed query, with contents."""
    candidates = search.nearest(routed, vectors, retrieval.FETCH)
    picked = retrieval.diverse(candidates, k)
    return picked.join(vectors.select("domain", "subject", "chunk_id", "content"), ["domain", "subject", "chunk_id"])


def answer_context(questions: DataFrame, subqueries: DataFrame, vectors: DataFrame, mode: str = "existing") -> DataFrame:
    """(question_id, prompt, chunks): routed subqueries retrieve, equal contents count once, the first five make the context."""
    routed = retrieval.route(subqueries, retrieval.existing_routes(vectors, mode))
    found = retrieve(routed, vectors).join(routed.select("query_id", "question_id", "sub_pos").distinct(), "query_id")
    text = retrieval.context(found, "question_id", ["sub_pos", "domain", "subject", "distance", "chunk_id"])
    rows = questions.join(text, "question_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return rows.select("question_id", X.fill_template(QUESTION, {"question": F.col("question"), "context": F.col("context")}).alias("prompt"), "chunks")


def process_notes(rows: DataFrame, most: int = chunking.MAX_TOKENS) -> DataFrame:
    """Chunk rows of notes (note_id, document), flattened to Markdown."""
    return chunking.chunk(rows.select(F.col("note_id").alias("source_id"), notes.markdown(notes.parsed(F.col("document"))).alias("text")), most)


def apply_note_updates(edits: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(version of every edit, edits to be analysed) of edits (bubble_id, note_id, seq, document)."""
    doc = notes.parsed(F.col("document"))
    rows = edits.select("bubble_id", "note_id", "seq", doc.alias("doc"), X.object_hash(F.col("document")).alias("hash"))
    rows = rows.select("bubble_id", "note_id", "seq", "hash", F.length(notes.total_text(F.col("doc"))).alias("chars"), F.size("doc.children").alias("blocks"))
    versions = notes.versions(rows).join(rows.select("note_id", "seq", "bubble_id"), ["note_id", "seq"])
    return versions, analysis.triggered(versions, cache)


def note_history(edits: DataFrame) -> DataFrame:
    """(note_id, version, seq, first_seq, ops) of edits (bubble_id, note_id, seq, document): what changed the note at each version.

    An edit that changes a note leaves its steps under the version before it; of several under one version the last stays.
    """
    blocks = F.transform(F.from_json("document", "children array<variant>")["children"], lambda b: F.to_json(b))
    steps = notes.diff_ops(edits.select("note_id", "seq", blocks.alias("children")))
    ops = steps.groupBy("note_id", "seq").agg(F.array_sort(F.collect_list(F.struct("step", "op", "path", "value"))).alias("ops"))
    versions, _ = apply_note_updates(edits, edits.limit(0).select("bubble_id", "note_id", F.lit(0.0).alias("content_version")))
    rows = versions.where("changed").select("note_id", "seq", F.col("version_before").alias("version"))
    none = F.array().cast("array<struct<step:int,op:string,path:string,value:string>>")
    return notes.collapse(rows.join(ops, ["note_id", "seq"], "left").withColumn("ops", F.coalesce("ops", none)))


def analyse_notes(current: DataFrame, archive: DataFrame, retrieved: DataFrame, subqueries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(note_id, content_version, prompt) of notes (bubble_id, note_id, content_version, text) for a model to complete.

    A note's context is what the retrieval cache holds for it, else a fresh retrieval along the first route to each collection.
    """
    fresh = analysis.needs_retrieval(current, retrieved)
    routed = retrieval.first_routes(retrieval.route(subqueries.join(fresh.select("note_id"), "note_id", "left_semi"), retrieval.existing_routes(vectors)))
    found = retrieve(routed, vectors, 5).join(routed.select("query_id", "note_id").distinct(), "query_id")
    held = retrieved.select("note_id", "domain", "subject", F.lit(0.0).alias("distance"), "chunk_id", "content")
    sources = found.select("note_id", "domain", "subject", "distance", "chunk_id", "content").unionByName(held.join(current.select("note_id"), "note_id", "left_semi"))
    context = retrieval.context(sources, "note_id", ["domain", "subject", "distance", "chunk_id"])
    old = analysis.archived_versions(archive).select("note_id", F.array_join(F.transform("versions", lambda v: v["content"]), "\n").alias("old"))
    rows = current.join(context, "note_id", "left").join(old, "note_id", "left")
    prompt = X.fill_template(REVIEW, {"archived_data": F.col("old"), "current_note": F.col("text"), "context": F.col("context")})
    return rows.select("bubble_id", "note_id", "content_version", prompt.alias("prompt"))


@dataclass
class Analysed:
    results: DataFrame
    cache: DataFrame
    history: DataFrame
    calls: DataFrame


def finish_analyses(prompts: DataFrame, calls: DataFrame, cache: DataFrame, history: DataFrame, complete_fn, as_of: Column) -> Analysed:
    """The prompts of analyse_notes() put to a model, and what it says kept.

    calls: (prompt_hash, output) of all model calls so far; none is made twice. The cache (bubble_id, note_id, content_version,
    analysis, cached_at) gets one entry a note, the newest; the history (note_id, bubble_id, content_version, prompt_hash,
    analysis, created_at) one for each version and prompt. Empty analyses are not kept.
    """
    results, calls = analysis.memoised(prompts, "prompt", calls, complete_fn, lambda o: F.trim(o) != "")
    results = stored(results.withColumnRenamed("output", "analysis"))
    new = results.where("analysis is not null").withColumn("stamp", as_of)
    entries = new.select("bubble_id", "note_id", "content_version", "analysis", F.col("stamp").alias("cached_at"))
    cache = registry.put_latest(cache.select(*entries.columns), registry.latest(entries, analysis.NOTE, [F.desc("content_version")]), analysis.NOTE, "cached_at")
    lines = new.select("note_id", "bubble_id", "content_version", "prompt_hash", "analysis", F.col("stamp").alias("created_at"))
    history = registry.put_latest(history.select(*lines.columns), lines.dropDuplicates(["note_id", "content_version", "prompt_hash"]), ["note_id", "content_version", "prompt_hash"], "created_at")
    return Analysed(results, cache, history, calls)


def inspect_stores(vectors: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    return {"counts": stats.collections(vectors), "samples": stats.collection_samples(vectors), "totals": stats.totals(vectors), "storage": stats.storage(files, ["domain", "subject"])}
