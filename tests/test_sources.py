"""Files and tables written to a folder and read back."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark.operators import analysis, chunking, registry, retrieval, stats
from lorespark.plans import jobs
from lorespark.sources import tables
from lorespark.streaming import feeds


@pytest.mark.parametrize("root", ["kb", "my kb", "mykb/kb", "c++/kb.d"])
def test_file_tree(spark, tmp_path, root):
    for name in ("a.md", "dom/b.md", "dom/sub/kb/kb/c.tar.gz", "1/2/3/4/5/deep.md"):
        path = tmp_path / root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    for given in (str(tmp_path / root), f"file://{tmp_path / root}/".replace(" ", "%20") if " " not in root else str(tmp_path / root)):
        rows = {r["name"]: r for r in tables.file_tree(spark, given).collect()}
        assert set(rows) == {"a.md", "b.md", "c.tar.gz"} and rows["a.md"]["domain"] is None
        assert (rows["c.tar.gz"]["domain"], rows["c.tar.gz"]["subtopic"], rows["c.tar.gz"]["stem"], rows["c.tar.gz"]["length"]) == ("dom", "kb", "c.tar", 1)


def test_notes_and_bubbles(spark, tmp_path):
    for b in ("b1", "b2"):
        (tmp_path / b).mkdir()
        (tmp_path / b / "info.json").write_text(json.dumps({"id": b, "name": f"name {b}", "domains": ["d"]}))
        for n in ("n1", "n2"):
            (tmp_path / b / f"{b}{n}.json").write_text(json.dumps({"title": n, "note_id": f"{b}{n}", "bubble_id": b, "document": "{}"}))
    pattern = f"{tmp_path}/*/*n*.json"
    assert {r["note_id"] for r in tables.notes(spark, pattern).where("note_id is not null").collect()} == {"b1n1", "b1n2", "b2n1", "b2n2"}
    one = tables.notes(spark, pattern, "b2").collect()
    assert {(r["file_stem"], r["ink"]) for r in one} == {("b2n1", "[]"), ("b2n2", "[]")}
    assert [r["name"] for r in tables.bubbles(spark, str(tmp_path), "b1").collect()] == ["name b1"] and tables.bubbles(spark, str(tmp_path)).count() == 2


def test_markdown_and_registries(spark, tmp_path):
    docs = spark.createDataFrame([("s", "# A\nx\n# B\ny")], "source_id string, text string")
    chunks = chunking.chunk(docs)
    chunks.write.parquet(str(tmp_path / "chunks"))
    assert sorted(map(tuple, tables.registry_rows(spark, str(tmp_path / "chunks")).collect())) == sorted(map(tuple, chunks.collect()))
    tables.write_annotated(chunking.annotated(docs, chunks), str(tmp_path / "annotated"))
    assert spark.read.parquet(str(tmp_path / "annotated")).first()["markdown"].count("CHUNK_START") == 2
    rows = spark.createDataFrame([("d", "s", "t", "m")], "domain string, subject string, title string, markdown string")
    tables.write_markdown(rows, str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).where("domain = 'd' and subject = 's'").first()["title"] == "t"
    Path(tmp_path / "one.md").write_text("# T\nbody")
    assert tuple(tables.markdown_files(spark, str(tmp_path / "one.md")).first()) == ("one.md", "# T\nbody")


SOURCES = "original_name string, filepath string, domain string, subject string, text string"
STAMP = "2026-01-01"


@pytest.mark.parametrize("fails_at", ["add_vectors", "put_snapshot"])
def test_a_batch_that_fails_half_way_comes_again(spark, tmp_path, monkeypatch, fails_at):
    """The second micro-batch fails after its vectors, or amid its registries, were written; the stream begins anew."""
    store, source, wrote = str(tmp_path / "store"), str(tmp_path / "in"), getattr(tables, fails_at)
    broken = []

    def ingest(batch, number):
        jobs.ingest_batch(batch, number, store, retrieval.hashing_embedder(4), F.lit(STAMP).cast("timestamp"))

    def once(*args, **named):
        wrote(*args, **named)
        if broken:
            broken.clear()
            raise OSError("lost")

    monkeypatch.setattr(tables, fails_at, once)

    def run():
        feeds.ingest_continuously(spark.readStream.schema(SOURCES).parquet(source), ingest, str(tmp_path / "c")).awaitTermination()

    for i in range(3):
        rows = [(f"{i}.pdf", f"/{i}", f"d{i}", "s", f"# T{i}\nx y\n## U\nz{i}"), ("0.pdf", "/0", "d0", "s", "known")]
        spark.createDataFrame(rows, SOURCES).limit(1 if i == 0 else 2).coalesce(1).write.mode("append").parquet(source)
        if i == 1:
            broken.append(True)
            with pytest.raises(Exception, match="lost"):
                run()
        run()
    found = tables.read_vectors(spark, f"{store}/vectors")
    assert sorted((r["domain"], r["chunk_index"]) for r in found.collect()) == [(f"d{i}", k) for i in range(3) for k in range(2)]
    files, chunks = (tables.snapshot(spark, f"{store}/{name}") for name in ("files", "chunks"))
    assert files.where("embedded = 1").count() == files.count() == 3 and chunks.where("embedded = 1").count() == chunks.count() == 6
    ingest(spark.read.schema(SOURCES).parquet(source), 2)  # a replay of the last one
    assert tables.read_vectors(spark, f"{store}/vectors").count() == 6 and tables.snapshot(spark, f"{store}/chunks").count() == 6


@pytest.mark.parametrize("batch", [None, 7])
def test_deletes_rewrite_only_what_they_touch(spark, tmp_path, batch):
    path = str(tmp_path / "v")
    rows = [(f"c{i}", f"d {i % 4}/ü", f"s{i % 2}", f"f{i % 8}", i) for i in range(64)]
    tables.add_vectors(spark.createDataFrame(rows, "chunk_id string, domain string, subject string, file_fingerprint string, n int"), path, batch=batch)

    def state():
        return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}

    before = state()
    assert tables.delete_vectors(spark, path, F.col("n") > 1000) == 0 and state() == before
    files = spark.createDataFrame([("f1",), ("f1",), ("f5",), ("none",), (None,)], "file_fingerprint string")
    assert tables.delete_vectors(spark, path, fingerprints=files) == 16  # all of d 1
    one = state()
    assert set(one) == {p for p in before if "domain=d 1" not in p} and all(one[p] == before[p] for p in one)
    assert tables.delete_vectors(spark, path, (F.col("domain") == "d 2/ü") & (F.col("n") < 32)) == 8
    two = state()
    assert {p for p in one if two.get(p) != one[p]} == {p for p in one if "domain=d 2" in p}
    left = spark.read.parquet(path).collect()
    assert sorted(r["n"] for r in left) == [i for i in range(64) if i % 4 != 1 and not (i % 4 == 2 and i < 32)]
    assert all(r["domain"] == f"d {r['n'] % 4}/ü" for r in left)


def test_counts_of_a_store_read_no_columns(spark, tmp_path):
    path = str(tmp_path / "v")
    tables.add_vectors(spark.createDataFrame([(f"c{i}", f"d{i % 2}", f"s{i % 3}", "x" * 99) for i in range(60)], "chunk_id string, domain string, subject string, content string"), path)
    for rows in (stats.collections(tables.read_vectors(spark, path)), stats.totals(tables.read_vectors(spark, path))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReadSchema: struct<>") == plan.count("ReadSchema") > 0
    assert {tuple(r) for r in stats.collections(tables.read_vectors(spark, path)).collect()} == {(f"d{i}", f"s{j}", 10) for i in range(2) for j in range(3)}


def test_files_go_with_their_chunks_and_vectors(spark, tmp_path):
    store = str(tmp_path / "s")
    rows = [(f"{i}.pdf", f"/{i}", "d", f"s{i}", f"# T{i}\nx") for i in range(3)]
    jobs.ingest_batch(spark.createDataFrame(rows, SOURCES), 0, store, retrieval.hashing_embedder(4), F.lit(STAMP).cast("timestamp"))
    files, chunks = (tables.snapshot(spark, f"{store}/{name}") for name in ("files", "chunks"))
    prints = {r["original_name"]: r["file_fingerprint"] for r in files.collect()}
    gone = spark.createDataFrame([("0.pdf", prints["0.pdf"]), ("1.pdf", "wrong")], "original_name string, file_fingerprint string")
    left, kept, missing, deleted = jobs.remove_files(files, chunks, gone, f"{store}/vectors")
    assert {r["original_name"] for r in left.collect()} == {"1.pdf", "2.pdf"} and kept.count() == 2 and deleted == 1
    assert [r["file_fingerprint"] for r in missing.collect()] == ["wrong"] and spark.read.parquet(f"{store}/vectors").count() == 2


def asked_in(folder, answer):
    """A model that leaves a file for every prompt it is asked."""

    def complete(batch):
        for x in batch:
            (folder / f"{uuid.uuid4().hex}").write_text(x)
        return batch.map(answer)

    return complete


def test_models_are_asked_once(spark, tmp_path):
    calls = spark.createDataFrame([], "prompt_hash string, output string")
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", None, "bad", "a"])], "id int, prompt string")
    model = asked_in(tmp_path, lambda x: None if x == "bad" else x + "!")
    for times in (3, 4):  # what was not answered is asked again, nothing else
        out, calls = analysis.memoised(prompts, "prompt", calls, model)
        calls = tables.stored(calls)
        assert [r["output"] for r in out.orderBy("id").collect()] == ["a!", "b!", "a!", None, None, "a!"]
        assert len(list(tmp_path.iterdir())) == times and calls.count() == 2


def test_described_sources(spark, tmp_path):
    schema = "original_name string, filepath string, author string, keywords string, title string, text string"
    rows = [("a.pdf", "/a", "X; Y", "k, l", "a/b", "# T\nx"), ("b.pdf", "/b", None, "", " ", None), ("c.pdf", "/c", "Z", None, None, "y")]
    whole = {"title": "said", "domain": "d", "subject": "s", "authors": ["M"], "keywords": ["n"]}
    answers = {"a.pdf": json.dumps(whole), "b.pdf": f"```json\n{json.dumps(whole)}\n```", "c.pdf": json.dumps({**whole, "subject": None})}
    model = asked_in(tmp_path, lambda x: next(v for k, v in answers.items() if k in x))
    calls = spark.createDataFrame([], "prompt_hash string, output string")
    for times in (3, 4):
        good, bad, calls = jobs.describe_sources(spark.createDataFrame(rows, schema), calls, model)
        calls = tables.stored(calls)
        got = {r["original_name"]: (r["title"], r["domain"], r["authors"], r["keywords"]) for r in good.collect()}
        assert got == {"a.pdf": ("a-b", "d", ["X", "Y"], ["k", "l"]), "b.pdf": ("said", "d", ["M"], ["n"])}
        assert [r["original_name"] for r in bad.collect()] == ["c.pdf"] and len(list(tmp_path.iterdir())) == times
    files = {r["title"]: r["markdown"] for r in jobs.artifacts(good).collect()}
    assert files["a-b"] == "---\ntitle: a-b\ndomain: d\nsubject: s\nauthors:\n- X\n- Y\nkeywords:\n- k\n- l\n---\n\n# T\nx" and files["said"].endswith("---\n\n")


def test_analyses_are_kept(spark, tmp_path):
    prompts = spark.createDataFrame([("b", "n1", 1.0, "p1"), ("b", "n2", 2.0, "p2"), ("b", "n3", 1.0, "none"), ("c", "n4", 1.0, "p1")], "bubble_id string, note_id string, content_version double, prompt string")
    calls = spark.createDataFrame([], "prompt_hash string, output string")
    cache = spark.createDataFrame([("b", "n1", 0.5, "old", "2025"), ("b", "n9", 1.0, "kept", "2025")], "bubble_id string, note_id string, content_version double, analysis string, cached_at string")
    history = spark.createDataFrame([], "note_id string, bubble_id string, content_version double, prompt_hash string, analysis string, created_at string")
    model = asked_in(tmp_path, lambda x: " " if x == "none" else f"analysis of {x}")
    for stamp in ("2026", "2027"):
        out = jobs.finish_analyses(prompts, calls, cache, history, model, F.lit(stamp))
        calls, cache, history = (tables.stored(x) for x in (out.calls, out.cache, out.history))
        got = {r["note_id"]: (r["content_version"], r["analysis"], r["cached_at"]) for r in cache.collect()}
        assert got == {"n1": (1.0, "analysis of p1", stamp), "n2": (2.0, "analysis of p2", stamp), "n4": (1.0, "analysis of p1", stamp), "n9": (1.0, "kept", "2025")}
        assert history.count() == 3 and calls.count() == 2
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["none", "none", "p1", "p2"]
    hits = analysis.cache_lookup(prompts.select("bubble_id", "note_id", "content_version"), cache)
    assert {r["note_id"] for r in hits.where("hit").collect()} == {"n1", "n2", "n4"}


def test_completions(spark):
    rows = analysis.complete(spark.createDataFrame([("a",)], "prompt string"), "prompt", lambda s: s + "!")
    assert rows.first()["output"] == "a!"


def test_changes_of_a_bucketed_registry_shuffle_the_changes_alone(spark, tmp_path):
    kept = tables.Registry(str(tmp_path / "it's a registry"), ("a", "b"), 6)
    assert kept.get(spark) is None
    table = spark.range(300).selectExpr("cast(id as string) a", "id % 3 b", "0 as flag", "id as v")
    new = spark.range(200, 500).selectExpr("cast(id as string) a", "id % 3 b", "1 as flag", "id * 2 as v")
    kept.put(table, 0)
    steps = [
        lambda t, **o: registry.upsert(t, new, ["a", "b"], keep=["flag"], **o), lambda t, **o: registry.mark(t, new.where("v > 900"), ["a", "b"], {"flag": F.lit(7)}, **o),
        lambda t, **o: registry.register(t, new, ["a", "b"], "v", **o), lambda t, **o: registry.remove(t, table.where("b = 1"), ["a", "b"], **o),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for number, step in enumerate(steps, 1):
            want = sorted(map(tuple, step(kept.get(spark)).collect()))
            out = step(kept.get(spark), null_keys=False)
            plan = out._jdf.queryExecution().executedPlan().toString()
            of_registry, of_changes = plan.split("Join")[1].split("Exchange")[0], plan.split("Join")[1]
            assert "Bucketed: true" in of_registry and "Exchange" in of_changes, plan
            kept.put(out, number)
            assert sorted(map(tuple, kept.get(spark).collect())) == want
            assert len(list((tmp_path / "it's a registry" / f"after={number}").glob("*.parquet"))) == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="a is null"):
        kept.put(table.withColumn("a", F.expr("nullif(a, '5')")), 5)
    assert sorted(map(tuple, kept.get(spark).collect())) == want  # what failed is not seen, and comes again
    kept.put(table, 5)
    assert kept.get(spark).count() == 300 and kept.get(spark, 5).count() == len(want) and not spark.catalog.listTables()


def test_no_name_of_a_column_is_reserved(spark):
    table = spark.createDataFrame([(1, 1, 1, 1, 1, 1), (2, 2, 2, 2, 2, 2)], "k int, _at int, _old int, _is int, _new_k int, _stale int")
    new = spark.createDataFrame([(2, 5, 5, 5, 5, 5), (3, 6, 6, 6, 6, 6)], table.schema)
    one, two, five, six = (tuple([x] * 6) for x in (1, 2, 5, 6))
    assert sorted(map(tuple, registry.upsert(table, new, ["k"], prune=["k"]).collect())) == [one, (2, *five[1:]), (3, *six[1:])]
    assert sorted(map(tuple, registry.register(table, new, ["k"], "_at").collect())) == [one, (2, 5, *two[2:]), (3, *six[1:])]
    assert sorted(map(tuple, registry.mark(table, new, ["k"], {"_is": F.lit(9)}).collect())) == [one, (2, 2, 2, 9, 2, 2)]
    assert registry.put_latest(table.withColumn("_new", F.lit(1)), new.withColumn("_new", F.lit(2)), ["k"], "_at").count() == 3
