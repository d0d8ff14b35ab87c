"""Hand-made cases of the operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as X
from lorespark.operators import chunking, notes, registry, retrieval, search, stats
from lorespark.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("A; B", ["A", "B"]), ("A, B", ["A", "B"]), ("A and B, C", ["A and B, C"]), ("A", ["A"]), ("  ", None), (None, None)])
def test_authors(spark, raw, want):
    assert one(spark, X.clean_authors(F.lit(raw).cast("string"))) == want


def test_titles_and_front_matter(spark):
    assert one(spark, X.sanitize_title(F.lit('/a\\b: c|*?"<>d//'))) == "a-b- c-d"
    text = "---\ntitle: a\n---\n\nbody"
    front, rest = X.split_front_matter(F.lit(text))
    assert (one(spark, front), one(spark, rest)) == ("---\ntitle: a\n---\n\n", "body")
    front, rest = X.split_front_matter(F.lit("---\nnever closed"))
    assert (one(spark, front), one(spark, rest)) == ("", "---\nnever closed")


def test_outputs_and_hashes(spark):
    for out, want in [('{"a": 1}', 1), ('x ```json\n{"a": {"b": 2}}\n``` y', None), ('so {"a": 3} there', 3), ("broken {", None), ("", None)]:
        got = one(spark, F.try_variant_get(X.json_from_output(F.lit(out)), "$.a", "int"))
        assert got == want
    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("nope",)], "d string").select(X.canonical_json("d").alias("c")).collect()
    assert [r["c"] for r in rows] == [json.dumps({"a": "é", "b": 1}, sort_keys=True), None]


MD = "intro\n# A\ntext\n```\n# not a header\n```\n#tag\n### C\nc\n## B\nb héllo 😀\n# D"


def test_header_chunks_and_offsets(spark):
    docs = spark.createDataFrame([("s", MD)], "source_id string, text string")
    rows = {r["section"]: r for r in chunking.header_chunks(docs).collect()}
    assert [rows[i]["content"].split("\n")[0] for i in range(5)] == ["intro", "# A", "### C", "## B", "# D"]
    assert (rows[2]["header_1"], rows[2]["header_3"]) == ("A", "C")
    assert (rows[3]["header_1"], rows[3]["header_2"], rows[3]["header_3"]) == ("A", "B", None)
    assert (rows[4]["header_1"], rows[4]["header_2"]) == ("D", None)
    chunks = chunking.chunk(docs)
    back = {r["chunk_index"]: r["slice"] for r in chunking.read_back(chunks).collect()}
    got = chunks.orderBy("chunk_index").collect()
    assert [back[r["chunk_index"]] for r in got] == [r["content"] for r in got]
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(got, got[1:]))


def test_header_chunks_keep_every_character(spark):
    """Control characters stay what they are, lines end at newlines only, and a long text is cut in one task without a shuffle."""
    texts = ["x \u0001# y\n# A\n```\n# \u0001#\n~~~\n# B \u0001#", "# A\r# no\u2028# no\n# B", "```\n# open", "", "#", "\n\n# A\n\n"]
    rows = chunking.header_chunks(spark.createDataFrame(list(enumerate(texts)), "source_id int, text string"))
    got = [(r["source_id"], r["idx"], r["section"], r["content"], r["header_1"]) for r in rows.orderBy("source_id", "idx").collect()]
    assert got == [(0, 0, 0, "x \u0001# y", None), (0, 1, 1, "# A\n```\n# \u0001#\n~~~", "A"), (0, 2, 2, "# B \u0001#", "B \u0001#"), (1, 0, 1, "# A\r# no\u2028# no", "A\r# no\u2028# no"), (1, 1, 2, "# B", "B"), (2, 0, 0, "```\n# open", None), (4, 0, 1, "#", ""), (5, 0, 1, "# A", "A")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    chunks = chunking.chunk(spark.createDataFrame([("s", "# h\nx\n## i\n" * 20_000)], "source_id string, text string"))
    assert chunks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert chunks.groupBy("header_1", "header_2").count().count() == 2


def test_recursive_split(spark):
    text = "one two three four five six seven\n\neight nine ten"
    parts = chunking.split_recursively(text, 5, 2)
    assert all(len(t.split()) <= 5 and text[s : s + len(t)] == t for t, s in parts)
    assert {w for t, _ in parts for w in t.split()} == set(text.split())
    docs = spark.createDataFrame([("s", "# h\n" + "word " * 40)], "source_id string, text string")
    rows = chunking.chunk(docs, 10, 2).collect()
    assert len(rows) > 4 and all(r["chunk_type"] == "recursive" and r["parent_chunk_index"] == 0 and r["token_count"] <= 10 for r in rows)


def test_versions(spark):
    for chars, blocks, want in [(126, 0, 1.0), (125, 0, 0.1), (76, 0, 0.1), (75, 0, 0.01), (0, 0, 0.0), (-50, 0, 0.0), (0, 11, 1.0), (0, 6, 0.1)]:
        assert one(spark, notes.increment(F.lit(chars), F.lit(blocks))) == want
    edits = spark.createDataFrame([("n", i, c, 1, h) for i, (c, h) in enumerate([(10, "a"), (90, "b"), (300, "c"), (300, "c"), (310, "d")])], "note_id string, seq long, chars int, blocks int, hash string")
    assert [round(r["version"], 2) for r in notes.versions(edits).orderBy("seq").collect()] == [0.01, 0.11, 1.0, 1.0, 1.01]


def test_diffs_and_collapse(spark):
    edits = spark.createDataFrame([("n", 0, ["a", "b"]), ("n", 1, ["a", "c", "d"]), ("n", 2, ["a"])], "note_id string, seq int, children array<string>")
    got = [(r["seq"], r["op"], r["path"][-1]) for r in notes.diff_ops(edits).orderBy("seq", "step").collect()]
    assert got == [(0, "add", "0"), (0, "add", "1"), (1, "replace", "1"), (1, "add", "2"), (2, "remove", "1"), (2, "remove", "1")]
    diffs = spark.createDataFrame([("n", i, v) for i, v in enumerate([0.0, 0.0, 0.01, 0.0])], "note_id string, seq int, version double")
    assert [(r["version"], r["seq"]) for r in notes.collapse(diffs).orderBy("first_seq").collect()] == [(0.0, 3), (0.01, 2)]


def test_patches():
    """Applied step by step a patch gives the new document, and it keeps as much as can be kept."""
    assert notes.patch(list("abc"), list("xabc")) == [("add", 0, "x")] and notes.patch(list("abc"), list("bc")) == [("remove", 0, None)]
    rng = np.random.default_rng(5)
    for _ in range(400):
        old, new = (rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in range(2))
        steps, doc = notes.patch(old, new), list(old)
        for op, at, value in steps:
            if op == "add":
                doc.insert(at, value)
            elif op == "remove":
                doc.pop(at)
            else:
                doc[at] = value
        assert doc == new
        best = np.zeros((len(old) + 1, len(new) + 1), int)
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                best[i + 1, j + 1] = best[i, j] + 1 if a == b else max(best[i, j + 1], best[i + 1, j])
        kept = notes.common(old, new)
        assert len(kept) == best[-1, -1] and all(old[i] == new[j] for i, j in kept) and kept == sorted(set(kept))
    assert len(notes.patch(list(range(5000)), [*range(7, 5000), *range(9000, 9100)])) == 107


def test_note_documents(spark):
    doc = {
        "type": "page",
        "children": [
            {"type": "heading", "data": {"level": 2, "delta": [{"insert": "T"}]}},
            {"type": "paragraph", "data": {"delta": [{"insert": "a "}, {"insert": "b"}, "c"]}},
            {"type": "paragraph"}, {"type": "divider"}, {"type": "odd"},
            {"type": "table", "data": {"rowsLen": 2, "colsLen": 2}, "children": [
                {"type": "table/cell", "data": {"rowPosition": r, "colPosition": c}, "children": [{"type": "paragraph", "data": {"delta": [{"insert": t}]}}]}
                for r, c, t in [(0, 0, "A"), (1, 1, "old"), (1, 1, "D"), (5, 5, "out")]]},
        ],
    }
    rows = spark.createDataFrame([(json.dumps(doc),), ('{"children": 3}',), ("{}",)], "d string").select(notes.parsed(F.col("d")).alias("d"))
    rows = rows.select(notes.markdown(F.col("d")).alias("m"), notes.total_text(F.col("d")).alias("t"), notes.markdown(F.col("d"), tables=False, mode="first").alias("f")).collect()
    assert rows[0]["m"].split("\n\n")[:2] == ["## T", "a bc"] and "\n---\n" in rows[0]["m"]
    assert rows[0]["m"].endswith("| A |  |\n| --- | --- |\n|  | D |") and rows[0]["t"] == "Ta bc"
    assert rows[0]["f"].endswith("[TABLE OMITTED]") and "## T\n\na\n" in rows[0]["f"]
    assert [r["m"] for r in rows[1:]] == ["", ""]


def test_tables_are_kept_up_to_date(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 0, "y")], "k string, embedded int, v string")
    new = spark.createDataFrame([("a", 0, "z"), (None, 0, "w"), ("b", 0, "n")], "k string, embedded int, v string")
    once = registry.upsert(old, new, ["k"], keep=["embedded"])
    want = {("a", 1, "z"), (None, 0, "w"), ("b", 0, "n")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in registry.upsert(once, new, ["k"], keep=["embedded"]).collect()}
    assert {tuple(r) for r in registry.register(old, new, ["k"], "v").collect()} == {("a", 1, "z"), (None, 0, "w"), ("b", 0, "n")}
    kept, count = registry.delete_where(old, F.col("k") == "a")
    assert kept.count() + count.first()["deleted"] == old.count()
    with pytest.raises(ValueError):
        registry.reset_flag(old, "v", ["embedded"])


def test_mmr(spark):
    v = {1: [1.0, 0.0], 2: [0.999, 0.04], 3: [0.7, 0.71], 4: [0.0, 1.0]}
    vectors = spark.createDataFrame([(i, "d", "s", f"c{i}", x) for i, x in v.items()], "chunk_id long, domain string, subject string, content string, embedding array<float>")
    q = spark.createDataFrame([(9, "d", "s", [0.95, 0.3], None)], "query_id long, domain string, subject string, query_vector array<float>, exclude long")
    near = search.nearest(q, vectors, 4)
    order = [r["chunk_id"] for r in near.orderBy("rank").collect()]
    assert order == sorted(v, key=lambda i: np.sum((np.array(v[i]) - [0.95, 0.3]) ** 2))
    picked = [r["chunk_id"] for r in retrieval.diverse(near, 2).orderBy("picked").collect()]
    assert picked[0] == order[0] and picked[1] != order[1]
    assert [r["chunk_id"] for r in retrieval.diverse(near, 3, lam=1.0).orderBy("picked").collect()] == order[:3]


@pytest.mark.parametrize("text_ids", [False, True])
def test_block_search(spark, monkeypatch, text_ids):
    """Several blocks, batches and partitions, names left open, excluded ids, hosts of equal vectors, vectors that are no candidates."""
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "PAIRS", 7)
    rng = np.random.default_rng(4)
    kind = "string" if text_ids else "int"
    name = (lambda i: f"c{i}") if text_ids else int
    rows = [(name(i), f"d{i % 2}", f"s{i % 3}", [1.0, 2.0, 3.0] if i % 4 == 0 else rng.integers(-3, 4, 3).astype(float).tolist()) for i in rng.permutation(300)]
    odd = [(name(900), "d0", "s0", None), (name(901), None, "s0", [0.0] * 3), (name(902), "d0", "s0", [0.0] * 4), (None, "d0", "s0", [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows + odd, f"chunk_id {kind}, domain string, subject string, embedding array<float>").repartition(5)
    asked = [(i, f"d{i % 2}" if i % 5 else None, f"s{i % 3}" if i % 3 else None, [1.0, 2.0, 3.0] if i % 2 else rng.integers(-3, 4, 3).astype(float).tolist(), name(4 * i) if i % 4 else None) for i in range(10)]
    asked += [(98, "nowhere", None, [0.0] * 3, None), (99, None, None, None, None), (97, None, None, [0.0] * 4, None)]
    queries = spark.createDataFrame(asked, f"query_id long, domain string, subject string, query_vector array<float>, exclude {kind}")
    want = []
    for q, d, s, v, gone in asked:
        groups = {}
        for c, *place, e in rows + odd:
            if v and e and c is not None and None not in place and len(e) == len(v) and d in (None, place[0]) and s in (None, place[1]) and c != gone:
                groups.setdefault(tuple(place), []).append((sum((x - y) ** 2 for x, y in zip(v, e)), c))
        want += [(q, *g, c, x, r + 1) for g, own in groups.items() for r, (x, c) in enumerate(sorted(own)[:5])]
    for batch in ("10000", "20"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted(tuple(r) for r in search.nearest_ids(queries, vectors, 5).collect())
        assert got == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert search.nearest_ids(queries.limit(0), vectors, 5).count() == 0 == search.nearest_ids(queries, vectors.limit(0), 5).count()


def test_feed_and_paths(spark):
    events = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 4, 1), ("s", 2, 0, 0), ("s", 3, 0, 3)], "source_id string, seq long, added int, embedded int")
    got = [(r["progress_pct"], r["status"], r["done"]) for r in stats.progress_feed(events).orderBy("seq").collect()]
    assert got == [(0, "completed", False), (25, "processing", False), (100, "completed", True)]
    paths = spark.createDataFrame([("a.b.md",), ("d/s/x.pdf",), ("1/2/3/4/5/y",), ("d/.hidden",)], "rel_path string")
    rows = {r["name"]: r for r in tables.listed(paths).collect()}
    assert set(rows) == {"a.b.md", "x.pdf", ".hidden"} and rows["a.b.md"]["domain"] is None
    assert (rows["a.b.md"]["stem"], rows["a.b.md"]["suffix"], rows["x.pdf"]["subject"], rows[".hidden"]["suffix"]) == ("a.b", ".md", "s", "")
    assert [one(spark, X.human_bytes(F.lit(n))) for n in (5, 2048, 3 << 40)] == ["5.0 B", "2.0 KB", "3.0 TB"]


def test_batches_over_ranges(spark):
    keys = [f"k{i * 37 % 101:03d}" for i in range(100)]
    queue = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    for ranges in (1, 7, 200):
        got = {r["k"]: r["batch"] for r in stats.batches(queue, "k", 10, ranges).collect()}
        assert got == {k: i // 10 for i, k in enumerate([None, *sorted(keys)])}
    assert stats.batches(queue.limit(0), "k").collect() == []
