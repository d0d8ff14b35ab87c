"""Every registered query that has SQL gives the same rows."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lorespark.operators import chunking
from lorespark.plans import adapters as A
from lorespark.plans import registry
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == sql_rows(registry.ORACLES[name], sf)


@pytest.fixture(scope="module")
def marked_up(spark, sf):
    return {r["source_id"]: r["text"] for r in A.markdown(spark, sf).collect()}


def sections(text):
    """(content, header path) of each header chunk, line by line."""
    if text.startswith("---\n") and "\n---\n\n" in text[3:]:
        text = text[text.index("\n---\n\n", 3) + 6 :]
    out, held, path, fenced = [], [], {}, False

    def close():
        content = "\n".join(held).strip("\n")
        if content.strip(" "):
            out.append((content, dict(path)))

    for line in text.split("\n"):
        fence = re.match(r"\s*(```|~~~)", line)
        mark = re.match(r"(#{1,6})( |$)", line)
        if mark and not fenced and not fence:
            close()
            held, level = [], len(mark.group(1))
            path = {k: v for k, v in path.items() if k < level} | {level: line[level:].strip(" ")}
        fenced ^= bool(fence)
        held.append(line)
    close()
    return out


def count(text):
    return len(re.findall("[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]", text))


def test_recursive_chunks(spark, sf, marked_up):
    rows = {}
    for r in chunking.chunk(A.markdown(spark, sf), 200, 20).collect():
        rows.setdefault(r["source_id"], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == Counter(r["source_id"] for r in registry.QUERIES["recursive_chunks"](spark, sf).collect())
    for source, text in marked_up.items():
        own, at = sorted(rows.get(source, []), key=lambda r: r["chunk_index"]), 0
        for parent, (content, path) in enumerate(sections(text)):
            assert {k: v for k in range(1, 7) if (v := own[at][f"header_{k}"]) is not None} == path
            if count(content) <= 200:
                assert own[at]["content"] == content and own[at]["chunk_type"] == "header"
                at += 1
                continue
            pieces = []
            while at < len(own) and own[at]["parent_chunk_index"] == parent:
                pieces.append(own[at]["content"])
                at += 1
            assert all(count(p) <= 200 for p in pieces)
            # as measured piece by piece; nothing is left out
            assert pieces == [p for p, _ in chunking.split_recursively(content, 200, 20, lambda t: count(t))]
            assert not Counter(content.split()) - Counter(w for p in pieces for w in p.split())
        assert at == len(own)


@pytest.mark.parametrize("text", ["x" * 3000, "word " * 500, "日本" * 800, "a b\n\nc d\n" * 200, "ab.cd" * 300, " \n "])
def test_splitting_by_running_sums(text):
    plain = chunking.split_recursively(text, 50, 10, lambda t: chunking.default_length(t))
    assert chunking.split_recursively(text, 50, 10) == plain


def test_splitting_takes_linear_time():
    began = time.time()
    assert len(chunking.split_recursively("字" * 400_000, 4000, 200)) > 90 and time.time() - began < 10


def test_annotated_and_archived_chunks(spark, sf, marked_up):
    got = {r["source_id"]: r["markdown"] for r in registry.QUERIES["annotated_markdown"](spark, sf).collect()}
    archived = {}
    for r in registry.QUERIES["archive_chunks"](spark, sf).collect():
        archived.setdefault(r["note_id"], {})[r["chunk_id"]] = (r["header"], r["header_level"])
    for source, text in marked_up.items():
        parts = sections(text)
        if all(count(c) <= chunking.MAX_TOKENS for c, _ in parts):
            blocks = re.findall(r"<!-- CHUNK_START\n(.*?)\n-->\n(.*?)\n<!-- CHUNK_END -->\n", got[source], re.S)
            assert [c for _, c in blocks] == [c for c, _ in parts]
            assert [f"chunk_index: {i}" in h and f"token_count: {count(c)}" in h for i, (h, c) in enumerate(blocks)] == [True] * len(parts)
            assert got[source].startswith("---\n") == text.startswith("---\n")
            deepest = [max(p, default=0) for _, p in parts]
            assert archived[source] == {i: (p.get(d), d) for i, ((_, p), d) in enumerate(zip(parts, deepest))}


def test_embeddings_and_note_chunks(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["hashed_embeddings"](spark, sf).collect():
        v = np.zeros(64)
        for w in texts[r["doc_id"]].lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(v)
        assert np.allclose(r["embedding"], v / n if n else v, atol=1e-6)
    markdown = {r["note_id"]: r["markdown"] for r in registry.QUERIES["note_markdown"](spark, sf).collect()}
    got = Counter(r["source_id"] for r in registry.QUERIES["note_chunks"](spark, sf).collect())
    assert got == Counter({k: len(sections(v)) for k, v in markdown.items() if sections(v)})


def test_answer_prompts(spark, sf):
    picked = registry.QUERIES["mmr_retrieval"](spark, sf).collect()
    content = {r["chunk_id"]: r["content"] for r in A.vectors(spark, sf).select("chunk_id", "content").collect()}
    asked = {r["query_id"]: r for r in A.subqueries(spark, sf).collect()}
    rows = sorted(picked, key=lambda r: (asked[r["query_id"]]["question_id"], asked[r["query_id"]]["sub_pos"], r["domain"], r["subject"], r["rank"]))
    want = {r["question_id"]: [] for r in asked.values()}
    for r in rows:
        own = want[asked[r["query_id"]]["question_id"]]
        if content[r["chunk_id"]] not in own:
            own.append(content[r["chunk_id"]])
    for r in registry.QUERIES["answer_prompts"](spark, sf).collect():
        own = want[r["question_id"]][:5]
        assert r["chunks"] == len(own) and r["prompt"].endswith("Context:\n" + "\n\n".join(own) + "\nAnswer:")


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "search_across_collections" in e.queries()
