"""Odd and empty tables give defined results."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.llm import brown, decontamination, fingerprints, mixing, pii, sentences, simhash, suffixes, toxicity, urls


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "Other TEXT of the same id"), (5, "other text of the same id"), (None, "never there at all")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 0), (99, 1, 1), (4, None, None)], "doc_id long, toxic int, quality int")


def operators(items, labels):
    return {
        "decontamination": lambda d: decontamination.decontaminate(d, items),
        "mixing": mixing.mix,
        "suffixes": suffixes.deduplicate,
        "brown": brown.score,
        "simhash": simhash.groups,
        "sentences": sentences.deduplicate,
        "fingerprints": fingerprints.edited_fingerprints,
        "toxicity": lambda d: toxicity.grade(d, labels),
        "pii": pii.report,
        "masked": pii.masked,
    }


NAMES = ["decontamination", "mixing", "suffixes", "brown", "simhash", "sentences", "fingerprints", "toxicity", "pii", "masked"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(odd_docs, no_docs, items, labels, name):
    f = operators(items, labels)[name]
    assert Counter(r["doc_id"] for r in f(odd_docs).collect()) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert f(no_docs).collect() == []


def test_decontamination(odd_docs, items):
    rows = {(r["doc_id"], r["n_words"]): r for r in decontamination.decontaminate(odd_docs, items).collect()}
    hit = rows[2, 6]
    assert (hit["n_hit"], hit["n_items"], hit["items_sha256"]) == (6, 2, hashlib.sha256(b"4,5").hexdigest())
    first = next(r for r in rows.values() if r["doc_id"] == 1)
    assert rows[8, 1]["contaminated"] and first["n_hit"] == 2 and not rows[3, 0]["contaminated"]
    assert rows[3, 0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    near = decontamination.proximity_matches(decontamination.documents(odd_docs), items, terms=3).select("doc_id", "item_id").distinct().collect()
    assert {(2, "4"), (2, "5")} <= {tuple(r) for r in near}
    assert not any(x[1] in ("6", "None") for x in map(tuple, near))  # an item with a term that no document has
    assert decontamination.decontaminate(odd_docs, items.limit(0)).where("contaminated or n_near > 0").count() == 0
    kept = decontamination.keep_clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {3, 4, 5} and decontamination.keep_clean(odd_docs.limit(0), items).count() == 0


def test_mixing_meets_targets(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd_docs).collect()), key=str)
    for target in {r["target"] for r in rows}:
        same = [r for r in rows if r["target"] == target]
        assert sum(r["taken"] for r in same) == pytest.approx(target, abs=2)
    prior = mixing.mix(odd_docs, prior=F.when(F.col("doc_id") > 4, 0.5).otherwise(1.5)).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in prior)


def test_mixing_of_ties(spark):
    rows = [(1, "five words in each text", "a")] * 30 + [(2, "two words", "a")] * 7 + [(None, "not two words", "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()), key=str) for d in (docs, docs.orderBy(F.rand(3))))
    assert a == b and Counter(i for i, _ in a) == {1: 30, 2: 7, None: 5}
    for source, ids in (("a", (1, 2)), ("b", (None,))):
        target = mixing.mix(docs).where(F.col("doc_id").eqNullSafe(ids[0])).first()["target"]
        assert sum(t for i, t in a if i in ids) == pytest.approx(target, abs=2), source


def test_repeats(odd_docs):
    rows = suffixes.deduplicate(odd_docs).collect()
    by_id = {i: [r for r in rows if r["doc_id"] == i] for i in (1, 2, 3, 7, None)}
    first = max(by_id[None], key=lambda r: r["n_bytes"])  # a null id comes before all others
    assert first["n_removed"] == 0 and by_id[1][0]["n_removed"] == by_id[1][0]["n_bytes"] == 2 * first["n_bytes"]
    assert sorted(r["n_removed"] for r in by_id[2]) == [0, first["n_bytes"], first["n_bytes"]]
    # "word " repeats with its period: only the first five starts are new
    assert by_id[7][0]["n_removed"] == 150_000 - 5 and by_id[3][0]["n_spans"] == 0
    kept = sentences.deduplicate(odd_docs).collect()
    twice = [r for r in kept if r["doc_id"] == 2]
    assert sorted(r["n_removed"] for r in twice) == [0, 2, 2] and next(r for r in kept if r["doc_id"] == 3)["kept_text"] == ""


def test_groups(odd_docs):
    rows = simhash.groups(odd_docs).collect()
    zero = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {3}
    kept = simhash.keep_one(odd_docs).collect()
    assert len([r for r in kept if not (r["text"] or "").strip()]) == 1 and len([r for r in kept if r["doc_id"] == 2]) <= 2


def test_personal_data(odd_docs):
    row = next(r for r in pii.report(odd_docs).collect() if r["doc_id"] == 6)
    assert (row["n_email"], row["n_phone"], row["n_ip"], row["n_card"]) == (2, 1, 1, 0)
    assert row["spans"].startswith("email:16:32,email:37:51,ip:")
    text = next(r["text"] for r in pii.masked(odd_docs).collect() if r["doc_id"] == 6)
    assert text == "Émile wrote to é<EMAIL> and <EMAIL> or <PHONE> from <IP>"


def test_urls(spark):
    rows = [(1, "http://A.org/x"), (2, "https://example.org/es/1"), (3, "https://www.example.org/en/12"), (4, "http://x.com/de/1?q"), (5, "http://x.com/fr/1#f"), (6, None), (7, "no scheme"), (7, "no scheme"), (None, "http://y.net"), (8, "http://badexample.org/es/"), (9, "a://b://c.com/de/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4, 5, 8)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/de/", "block"), ("com/fr/", "allow"), ("org/", "allow")]
    assert (got[1]["host"], got[1]["path"], got[6]["host"], got[7]["path"], got[9]["host"]) == ("a.org", "/x", "", "", "b:")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
