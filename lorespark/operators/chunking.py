"""Markdown documents to chunks: by header, then by size, with offsets into the chunks laid end to end.

A header line has one to six number signs, then a space or nothing, outside code fences. A chunk runs from one header to the
next; text before the first is a chunk. Lines are joined by newlines, empty lines around a chunk go, and chunks without
content are dropped. A header clears all deeper levels of the path and inherits the others.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.text import TOKEN, chunk_fingerprint, let, split_front_matter, token_count

MAX_TOKENS, OVERLAP = 4000, 200
LEVELS = range(1, 7)
HEADERS = [f"header_{k}" for k in LEVELS]


#: A fence line begins or ends code; a header begins a section unless it is code. Lines end at newlines only.
FENCE = r"(?md)^(?=[ \t\x0B\f\r]*(?:```|~~~))"
HEADER = "(?md)^(?=#{1,6}(?: |$))"


def sections(body: Column) -> Column:
    """array<struct<section, content, header_1 .. header_6>> of a text, without sections that have no content.

    All inside the row, in time that grows with the text: it is cut at fences, then, but for what is code, at headers; a section
    is what lies from one header to the next. A header of a level is in force from itself to the next one that is not deeper.
    """
    text_of, mark = (lambda x: x["text"]), "(?d)^(#{1,6})(?: |\n|$)"

    def piece(text: Column) -> Column:
        return F.struct(text.alias("text"), F.length(F.regexp_extract(text, mark, 1)).alias("level"))

    def cut(part: Column, i: Column) -> Column:
        code = F.array(F.struct(part.alias("text"), F.lit(0).alias("level")))
        return F.when(i % 2 == 1, code).otherwise(F.transform(F.split(part, HEADER), piece))

    def joined(pieces: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | (F.get(pieces, i)["level"] > 0))

        def section(begins: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                own = F.slice(pieces, a + 1, F.coalesce(F.get(begins, k + 1), F.size(pieces)) - a)
                first, content = F.get(pieces, a), F.array_join(F.transform(own, text_of), "")
                title = F.trim(F.substring(F.substring_index(first["text"], "\n", 1), first["level"] + 1, F.length(first["text"])))
                return F.struct(k.alias("section"), first["level"].alias("level"), title.alias("title"), F.btrim(content, F.lit("\n")).alias("content"))

            return F.transform(begins, one)

        return let(begins, section)

    def with_paths(xs: Column) -> Column:
        last = F.size(xs)

        def in_force(level: int) -> Column:
            """The header of a level for every section, laid end to end from the places of those that are not deeper."""
            at = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (F.get(xs, i)["level"] > 0) & (F.get(xs, i)["level"] <= level))

            def stretch(at: Column) -> Column:
                def one(a: Column, k: Column) -> Column:
                    own = F.get(xs, a)
                    return F.array_repeat(F.when(own["level"] == level, own["title"]), F.coalesce(F.get(at, k + 1), last) - a)

                none = F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get(at, F.lit(0)), last))
                return F.concat(none, F.flatten(F.transform(at, one)))

            return let(at, stretch)

        def rows(paths: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                return F.struct(x["section"].alias("section"), x["content"].alias("content"), *[F.get(F.get(paths, F.lit(i)), k).alias(h) for i, h in enumerate(HEADERS)])

            return F.transform(xs, one)

        return let(F.array(*[in_force(k) for k in LEVELS]), rows)

    # with a line before it the text never begins with code
    pieces = F.flatten(F.transform(F.split(F.concat(F.lit("\n"), body), FENCE), cut))
    return F.filter(let(let(pieces, joined), with_paths), lambda s: F.trim(s["content"]) != "")


def header_chunks(documents: DataFrame) -> DataFrame:
    """(source_id, idx, section, content, header_1 .. header_6) of documents (source_id, text); front matter is left out.

    idx counts a document's chunks from 0, section its headers. Nothing is shuffled.
    """
    _, body = split_front_matter(F.col("text"))
    rows = documents.select("source_id", sections(body).alias("xs"))
    # an outer explode, as before an inner one Spark asks for the array's size and so computes it twice
    rows = rows.select("source_id", F.posexplode_outer("xs").alias("idx", "x")).where("x is not null")
    return rows.select("source_id", "idx", "x.*")


def default_length(text: str) -> int:
    return len(re.findall(TOKEN, text))


def range_counter(text: str, length: Callable[[str], int]) -> Callable[[int, int], int]:
    """count(a, b): the tokens of text[a:b]. Of the token pattern from running sums, so that any range costs the same."""
    if length is not default_length:
        return lambda a, b: length(text[a:b])
    inside = [c.isascii() and c.isalnum() for c in text]
    starts = [0, *accumulate((x and not y) or (not x and c not in " \t\r\n") for x, y, c in zip(inside, [False, *inside], text))]

    def count(a: int, b: int) -> int:
        return starts[b] - starts[a] + (0 < a < b and inside[a] and inside[a - 1])

    return count


def split_recursively(text: str, most: int, overlap: int, length: Callable[[str], int] = default_length, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[tuple[str, int]]:
    """Pieces (text, start) of at most ``most`` tokens: parts between the coarsest separator, merged up to the limit.

    Parts that are too long are split by the next separator. A piece begins with as many parts of the one before as have at
    most ``overlap`` tokens. Pieces lose white space at their ends; start is the place of the piece in the text.
    """
    count = range_counter(text, length)

    def parts(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if count(a, b) <= most or level == len(separators):
            return [(a, b)]
        sep = separators[level]
        cuts = [a, *[m.end() for m in re.compile(re.escape(sep)).finditer(text, a, b)], b] if sep else list(range(a, b + 1))
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                out += parts(x, y, level + 1) if count(x, y) > most else [(x, y)]
        return out

    out, held = [], deque()
    for a, b in parts(0, len(text), 0):
        if held and count(held[0][0], b) > most:
            out.append((held[0][0], held[-1][1]))
            while held and (count(held[0][0], held[-1][1]) > overlap or count(held[0][0], b) > most):
                held.popleft()
        held.append((a, b))
    if held:
        out.append((held[0][0], held[-1][1]))
    trimmed = [(text[a:b].strip(), a + len(text[a:b]) - len(text[a:b].lstrip())) for a, b in out]
    return [x for x in trimmed if x[0]]


def chunk(documents: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, length: Callable[[str], int] | None = None) -> DataFrame:
    """Chunk rows of documents (source_id, text), in the columns of the chunk registry and with content and header path.

    Chunks of more than ``most`` tokens are split; their pieces carry the index of the header chunk they come from, counted
    among header chunks. Texts are read once; rows shuffle by source_id for their offsets, and what is not asked for, contents too, stays
    behind: fingerprints and sizes are taken before. byte_start and byte_end address the contents laid end to end. Only oversize chunks meet Python.
    length replaces the token pattern.
    """
    measure = length or default_length

    @F.pandas_udf("int")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(measure).astype("int32")

    @F.pandas_udf("array<struct<text:string,start:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": x, "start": s} for x, s in split_recursively(t, most, overlap, measure)])

    count = token_count if length is None else measured
    rows = header_chunks(documents).withColumn("tokens", count(F.col("content")))
    # of a chunk that is not split only a null goes to Python
    rows = rows.withColumn("parts", pieces(F.when(F.col("tokens") > most, F.col("content"))))
    whole = F.col("parts").isNull()
    one = F.array(F.struct(F.col("content").alias("text"), F.lit(0).alias("start")))
    rows = rows.select("*", F.posexplode(F.when(whole, one).otherwise(F.col("parts"))).alias("piece", "part"))
    rows = rows.select(
        "source_id", "section", "piece", F.col("part.text").alias("content"), F.when(whole, F.lit("header")).otherwise(F.lit("recursive")).alias("chunk_type"),
        F.when(~whole, F.col("idx")).alias("parent_chunk_index"), F.when(whole, F.col("tokens")).otherwise(count(F.col("part.text"))).alias("token_count"), *HEADERS,
        chunk_fingerprint(F.col("part.text")).alias("chunk_fingerprint"), F.octet_length("part.text").cast("long").alias("bytes"),
    )
    order = Window.partitionBy("source_id").orderBy("section", "piece")
    end = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"chunk_index": F.row_number().over(order) - 1, "byte_end": end})
    return rows.select(
        "source_id", "chunk_fingerprint", "chunk_index", (F.col("byte_end") - F.col("bytes")).alias("byte_start"), "byte_end",
        "token_count", "chunk_type", "parent_chunk_index", F.lit(0).alias("embedded"), "content", *HEADERS,
    )


def annotated(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, markdown): front matter, then every chunk between comment lines that state its coordinates."""
    # The names and the order of a comment's lines.
    keys = ["chunk_fingerprint", "chunk_type", "chunk_index", "parent_chunk_index", "byte_start", "byte_end", "token_count"]
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys]
    lines += [F.when(F.col(h) != "", F.concat(F.lit(f"{h}: "), F.col(h))) for h in HEADERS]
    block = F.concat_ws("\n", F.lit("<!-- CHUNK_START"), *lines, F.lit("-->"), F.col("content"), F.lit("<!-- CHUNK_END -->"), F.lit(""))
    texts = chunks.select("source_id", F.struct("chunk_index", block.alias("block")).alias("x")).groupBy("source_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    front, _ = split_front_matter(F.col("text"))
    fronts = documents.select("source_id", front.alias("front"))
    return fronts.join(texts, "source_id").select("source_id", F.concat("front", F.array_join(F.col("xs.block"), "\n")).alias("markdown"))


def read_back(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_index, slice): each chunk cut by its byte range out of the source's contents laid end to end."""
    rows = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "byte_start", "byte_end", "content"))).alias("xs"))
    whole = F.encode(F.array_join(F.col("xs.content"), ""), "UTF-8")

    def slices(data: Column) -> Column:
        def one(x: Column) -> Column:
            own = F.substring(data, (x["byte_start"] + 1).cast("int"), (x["byte_end"] - x["byte_start"]).cast("int"))
            return F.struct(x["chunk_index"].alias("chunk_index"), F.decode(own, "UTF-8").alias("slice"))

        return F.transform("xs", one)

    # the contents are laid end to end once for a source
    return rows.select("source_id", F.inline(F.transform(F.array(whole), slices)[0]))


def fetch(chunks: DataFrame, source_id: str | None = None, chunk_index: int | None = None, **headers: str) -> DataFrame:
    """Chunks of a note or file, by their index, or below headers (header_1="..."); conditions that are left out hold for all."""
    rows = chunks
    for c, v in {"source_id": source_id, "chunk_index": chunk_index, **headers}.items():
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return rows


def asked_chunks(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks of (source_id, chunk_index) pairs, with their place among those asked of a source; a null index asks for all of a source."""
    keys = asked.select(F.col("source_id").alias("_source"), F.col("chunk_index").alias("_index")).distinct()
    match = (F.col("source_id") == F.col("_source")) & F.coalesce(F.col("chunk_index") == F.col("_index"), F.lit(True))
    line = Window.partitionBy("source_id").orderBy("chunk_index", "chunk_fingerprint")
    return chunks.join(keys, match, "left_semi").withColumn("place", F.row_number().over(line))


def embed_metadata(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """What is stored beside a chunk's vector. A parent of 0 or none is an empty string."""
    parent = F.col("parent_chunk_index")
    places = files.select(F.col("file_fingerprint").alias("source_id"), "original_name", "domain", "subject")
    return chunks.join(places, "source_id").select(
        F.col("source_id").alias("file_fingerprint"), "chunk_fingerprint", "chunk_index", "chunk_type", "original_name", "domain", "subject",
        F.when(F.coalesce(parent, F.lit(0)) == 0, F.lit("")).otherwise(parent.cast("string")).alias("parent_chunk_index"),
    )


def archive_rows(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of notes as the archive keeps them; versions: (source_id, content_version)."""
    deepest = F.coalesce(*[F.when(F.col(f"header_{k}").isNotNull(), F.lit(k)) for k in reversed(LEVELS)], F.lit(0))
    title = F.coalesce(*[F.col(f"header_{k}") for k in reversed(LEVELS)])
    return chunks.join(versions, "source_id").select(
        F.col("source_id").alias("note_id"), F.col("chunk_index").alias("chunk_id"), F.col("chunk_fingerprint").alias("fingerprint"),
        title.alias("header"), deepest.alias("header_level"), "content_version", "content",
    )
