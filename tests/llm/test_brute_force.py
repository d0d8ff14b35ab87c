"""Queries against plain versions on the smallest tables, and held-out quality."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import brown, common, fingerprints, pii, queries, sentences, simhash, suffixes, toxicity
from tests.compare import TABLES, spark_rows, sql_rows


@pytest.fixture(scope="session")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(queries.ORACLES[name], sf)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (3000, 100), dtype=np.uint8)
    rows[:, :97] = rng.integers(0, 2, (5, 97), dtype=np.uint8)[rng.integers(0, 5, 3000)]
    places = [rng.integers(0, 9, 3000), rng.integers(0, 9, 3000)]
    order, same = suffixes.multikey_quicksort(rows, places)
    keys = [(r.tobytes(), *p) for r, *p in zip(rows[order], *(p[order].tolist() for p in places))]
    assert keys == sorted(keys) and same.tolist() == [False, *[a[0] == b[0] for a, b in zip(keys, keys[1:])]]
    assert [len(x) for x in suffixes.multikey_quicksort(rows[:0], [])] == [0, 0] and suffixes.multikey_quicksort(rows[:1], places)[1].tolist() == [False]


@pytest.mark.parametrize("bits", [64, 8])
def test_suffixes(spark, sf, docs, bits):
    seen, want = set(), {}
    for i, text in sorted(docs.items()):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.deduplicate(spark.read.parquet(f"{sf}/documents.parquet"), bits).collect()}
    assert got == want


def plain_sentences(text):
    """Letter by letter: marks before spaces or Han, wide marks with brackets, danda and Arabic marks, spaces after Thai or Khmer."""
    pieces, start, i = [], 0, 0
    while i < len(text):
        c, j = text[i], i + 1
        after = text[j : j + 1]
        ends = c == "\n" or c in "।॥؟۔" or (c in ".!?" and (after == " " or "\u3000" <= after <= "\u9fff"))
        if c in "。！．？｡":
            ends = True
            while text[j : j + 1] and text[j] in "。！．？｡":
                j += 1
            while text[j : j + 1] and text[j] in "」』’”）":
                j += 1
        if after == " " and ("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u10bf" or "\u1780" <= c <= "\u17ff"):
            ends = True
        if ends:
            while c != "\n" and text[j : j + 1] == " ":
                j += 1
            pieces.append(text[start:j])
            start = j
        i = j
    return [*pieces, text[start:]] if start < len(text) else pieces


def plain_size(piece):
    han = sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\U00020000" <= c <= "\U00032fff" for c in piece)
    indic = sum("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u10bf" or "\u1780" <= c <= "\u17ff" for c in piece)
    return len(piece.split()) + han // 2 + indic // 4


def without_repeated_runs(texts):
    """Texts without the sentences of runs of 15 words, of long ones, or of whole short texts, that were there before."""
    seen, kept = set(), []
    for text in texts:
        pieces = plain_sentences(text)
        own = [(i, tuple(p.lower().split())) for i, p in enumerate(pieces) if p.split()]
        sizes = [plain_size(pieces[i]) for i, _ in own]
        gone = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(w for _, w in own[a:b])
                if (b - a >= 2 and sum(sizes[a:b]) >= 15) or (b - a == 1 and sizes[a] >= 25) or (a, b) == (0, len(own)):
                    if run in seen:
                        gone.update(range(own[a][0], own[b - 1][0] + 1))
                    seen.add(run)
        kept.append("".join(p for i, p in enumerate(pieces) if i not in gone))
    return kept


def test_sentences(spark, docs):
    rng = np.random.default_rng(2)

    def sentence(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) + ". "

    texts = [t for _, t in sorted(docs.items()) if len(sentences.sentences(t.encode())) <= 40]
    for n in range(50, 61):
        for passage in (sentence(n), sentence(30) + sentence(n - 40) + sentence(5) + sentence(5), sentence(12) + sentence(8)):
            texts += [sentence(9) + passage + sentence(9) for _ in range(2)]
    for text in (sentence(80), sentence(25), sentence(7), sentence(30) + sentence(5) + sentence(5), sentence(4) + sentence(6), "one line of words " * 15):
        texts += [text, text]
    texts += ["A b c? D e!  F g... H\n\nI. J", "Contents" + "." * 50 + "5\nA" + "." * 30 + " B. C", "no mark at all", "?! .", " . \n"]
    rows = sentences.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = without_repeated_runs(texts)
    assert [r["kept_text"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert "" in want[-17:-6]


#: Letters, a sentence's end and the letters of a sentence, in scripts that put no spaces between words.
SCRIPTS = {
    "chinese": (range(0x4E00, 0x9F00), "。", 20), "japanese": ([*range(0x3042, 0x3094), *range(0x4E00, 0x5E00)], "。」", 20), "marks": (range(0x4E00, 0x9F00), "!", 20),
    "rare": (range(0x20000, 0x2A000), "！", 20), "thai": (range(0x0E01, 0x0E2F), " ", 40), "burmese": (range(0x1000, 0x1020), " ", 40),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_sentences_of_scripts_without_spaces(spark, script):
    letters, end, least = SCRIPTS[script]
    rng = np.random.default_rng(5)

    def passage(n):
        return "".join("".join(chr(letters[x]) for x in rng.integers(0, len(letters), rng.integers(least, 2 * least))) + end for _ in range(n))

    shared = [passage(n) for n in (2, 3, 5, 30, 30)]
    texts = [passage(4) + p + passage(4) for p in shared for _ in range(2)]
    texts += [passage(1)[: least // 2] + end + passage(2), passage(9), shared[0], shared[3] + "\n" + shared[4], "你好。" + passage(1), "你好。" + passage(1), "यह है। वह है॥ هل؟ نعم۔ x"]
    rows = sentences.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept = [r["kept_text"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert kept == without_repeated_runs(texts)
    assert all(len(kept[i + 1]) <= len(texts[i + 1]) - len(p) + 3 for i, p in zip(range(0, 10, 2), shared)) and kept[12] == kept[13].strip() == ""
    assert all(kept[i] == texts[i] for i in (0, 2, 4, 6, 8, 10, 11, 14, 15, 16))


def test_sentences_take_linear_time():
    text = (b"one" + b"." * 10_000 + b"5 ") * 100 + b"." * 1_000_000 + b" no final mark" + b" " * 100_000
    began = time.time()
    assert b"".join(sentences.sentences(text)) == text and sentences.sentences(b"") == [] and time.time() - began < 1
    wide = ("。" * 300_000 + "」" * 300_000 + "你!" + "ก" * 100_000 + " " * 100_000).encode()
    assert b"".join(sentences.sentences(wide)) == wide and time.time() - began < 2


def closed(ids, near):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in near[a]:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
    return root


def test_simhash(spark, sf, docs):
    fp = {}
    for i, text in docs.items():
        w = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sh = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    near = {a: [b for b in fp if bin(fp[a] ^ fp[b]).count("1") <= 3] for a in fp}
    root = closed(sorted(fp), near)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def near_groups(docs):
    """The smallest id of each document's group of texts with a Jaccard similarity of 0.8 or more, pair by pair."""
    sets = {i: set(simhash.hashes(t.encode(), 5).tolist()) for i, t in docs.items()}
    near, order = {i: [] for i in sets}, sorted(sets, key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            if (not sets[i] and not sets[j]) or (common := len(sets[i] & sets[j])) and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                near[i].append(j)
                near[j].append(i)
    return closed(sorted(sets), near)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_duplicates(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    root = near_groups({r["doc_id"]: r["text"] or "" for r in rows.select("doc_id", "text").collect()})
    got = {r["doc_id"]: r["component_id"] for r in simhash.deduplicate(rows).collect()}
    assert len(set(root.values())) < len(root) and got == root


def test_pairs_within_a_family_of_templates(spark):
    """Planted pairs of similarity 0.82 among hundreds of texts of 0.76, which all are candidates for one another."""
    rng = np.random.default_rng(12)
    base, rows = [f"w{i}" for i in range(300)], []

    def changed(words, n):
        words = list(words)
        for at in rng.choice(50, n, replace=False) * 6:
            words[at] = f"x{rng.integers(1 << 40)}"
        return words

    for i in range(500):
        rows.append((i, " ".join(changed(base, 4))))
    for i in range(100):
        own = changed(base, 4)
        rows += [(1000 + 2 * i, " ".join(changed(own, 3))), (1001 + 2 * i, " ".join(changed(own, 3)))]
    want = near_groups(dict(rows))
    got = {r["doc_id"]: r["component_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, r in want.items() if r != i]
    assert len(linked) > 80 and np.mean([got[i] == want[i] for i in linked]) >= 0.99
    assert all(got[i] == i for i, r in want.items() if r == i)


def cloud(copies=150):
    """A text and copies with five words changed each, similar to it and not to one another."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, copies + 1):
        words = list(base)
        for at in (rng.choice(37, 5, replace=False) * 8 + 4).tolist():
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("rows_at_once", "shingles_at_once"), [(simhash.BLOCK_ROWS, simhash.BLOCK_SHINGLES), (32, 4000)])
def test_copies_around_a_text_find_it(spark, rows_at_once, shingles_at_once):
    rows = cloud()
    sets = [set(simhash.hashes(t.encode(), 5).tolist()) for _, t in rows]
    assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets)
    assert np.median([len(a & b) / len(a | b) for a in sets[1:] for b in sets[1:] if a is not b]) < 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if rows_at_once == simhash.BLOCK_ROWS:
        assert {r["component_id"] for r in simhash.deduplicate(docs).collect()} == {0}
    else:
        nodes, links = simhash.similar_pairs(docs, rows_at_once=rows_at_once, shingles_at_once=shingles_at_once)
        joined = simhash.components(links)
        assert joined.count() == nodes.count() - 1 and joined.select("root").distinct().count() == 1


def test_large_keys_are_dealt_out(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (120, 2))})
    rows = spark.createDataFrame([(0, 7, f, f) for f in fps], "part int, code long, node long, fp long")
    pairs = simhash.compare_by_key(rows, simhash.linked, 3, rows_at_once=16).collect()
    near = {a: [b for b in fps if bin(a ^ b).count("1") <= 3] for a in fps}
    linked = {a: [a] for a in fps}
    for r in pairs:
        linked[r["u"]].append(r["v"])
        linked[r["v"]].append(r["u"])
    assert closed(fps, linked) == closed(fps, near)


def test_bit_slices():
    fps = np.random.default_rng(0).integers(0, 2**64, 200, dtype=np.uint64)
    fps[:50] = fps[0] ^ (np.uint64(1) << np.arange(50, dtype=np.uint64))
    for radius in (0, 1, 3, 22):
        want = np.array([[bin(int(a) ^ int(b)).count("1") <= radius for b in fps] for a in fps])
        assert (simhash.near(simhash.planes(fps), len(fps), fps, radius) == want).all()


def test_language_model(spark, sf, docs):
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in brown.words(t.encode()))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    rows = {r["doc_id"]: r for r in queries.op5_brown(spark, sf).collect()}
    for i, t in docs.items():
        own = brown.words(t.encode())
        c = [counts[w] for w in own] + [len(train)]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(c), sum(x > 0 for x in c), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("lookup", [400, 10**6])
def test_language_model_scores(spark, sf, docs, lookup):
    """Scores by hand from the classes of the words: transitions, emissions, and a class for what training has not seen, whose
    neighbours are those that words seen once have among the frequent ones."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    of = {r["word"].encode(): r["class"] for r in brown.word_classes(d, 60, 8, lookup).collect()} | {None: brown.END}
    lines = {i: [None, *brown.words(t.encode()), None] for i, t in docs.items()}
    train = [x for i, x in lines.items() if zlib.crc32(str(i).encode()) % 10]
    n = Counter(w for x in train for w in x[1:])
    joint = Counter((of[a], of[b]) for x in train for a, b in zip(x, x[1:]))
    frequent = {None, *sorted((w for w in n if w and n[w] > 1), key=lambda w: (-n[w], w))[:lookup]}
    for a, b in (p for x in train for p in zip(x, x[1:])):
        joint[brown.RARE, of[b]] += n[a] == 1 and a is not None and b in frequent
        joint[of[a], brown.RARE] += n[b] == 1 and b is not None and a in frequent
    held, kinds, after = Counter(), Counter(of[w] for w in n), Counter()
    for w, c in n.items():
        held[of[w]] += c
    held[brown.RARE], kinds[brown.RARE] = sum(c == 1 for c in n.values()), 1
    for (a, _), c in joint.items():
        after[a] += c
    total, every = 8 + brown.RARE + 1, sum(held.values())

    def token(a, b):
        k, l = of.get(a, brown.RARE), of.get(b, brown.RARE)
        step = (joint[k, l] + brown.BETA * (held[l] + brown.ALPHA) / (every + brown.ALPHA * total)) / (after[k] + brown.BETA)
        return np.log10(step) + (np.log10((n[b] + brown.ALPHA) / (held[l] + brown.ALPHA * kinds[l])) if b in n else 0.0)

    for r in brown.score(d, head=60, classes=8, lookup=lookup).collect():
        x = lines[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(token(a, b) for a, b in zip(x, x[1:])))


def test_classes_make_up_for_much_of_the_gain(spark):
    """With one class only the mass of unknown words and the smoothing differ from the base; clustering must gain beyond that."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def held_out(classes):
        rows = brown.score(d, classes=classes).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        return rows[0] / rows[2], rows[1] / rows[2]

    (one, base), (many, _) = held_out(1), held_out(brown.CLASSES)
    print({"base": 10**-base, "one class": 10**-one, "classes": 10**-many})
    assert many > one + 0.2 and one > base


def test_rare_words_find_their_counts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in brown.score(d, head=50, lookup=100).collect()}
    b = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in brown.score(d, head=50).collect()}
    assert a == b


def test_hot_words_are_dealt_to_salts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, brown.word_classes(d, 20, 8, 300, word_rows).collect())) for word_rows in (brown.WORD_ROWS, 40))
    assert a == b


@pytest.mark.parametrize("lookup", [400, 10**6])
def test_every_word_is_in_its_best_class(spark, sf, docs, lookup):
    train = [brown.words(t.encode()) for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    rows = {r["word"].encode(): (r["n"], r["class"]) for r in brown.word_classes(spark.read.parquet(f"{sf}/documents.parquet"), 60, 8, lookup).collect()}
    assert {w: n for w, (n, _) in rows.items()} == counts and {k for _, k in rows.values()} <= set(range(2, 10))
    frequent = set(sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))[:lookup])
    of = {w: k if w in frequent else brown.RARE for w, (_, k) in rows.items()}
    joint, beside = np.zeros((10, 10)), {w: np.zeros((2, 10)) for w in rows}
    for t in train:
        for x, y in zip([None, *t], [*t, None]):
            a, b = (brown.END if w is None else of[w] for w in (x, y))
            joint[a, b] += 1
            for w, side, k in ((x, 0, b), (y, 1, a)):
                if w is not None:
                    beside[w][side, k] += 1
    size, order = joint.sum(axis=1), sorted(rows)
    nxt, prv = (np.array([beside[w][i] for w in order]) for i in (0, 1))
    now = np.array([rows[w][1] for w in order])
    rare = np.array([w not in frequent for w in order])
    want = brown.best(nxt, prv, np.where(rare, brown.RARE, now), joint, size)
    assert (want == now)[rare].all()
    # those that still change places do so at the same likelihood, in step with their neighbours
    assert (want == now)[~rare].mean() > (0.95 if lookup < 1000 else 0.85)


def test_rare_words_keep_their_places_in_scores(spark):
    """With all classes one, a score is that of the emissions, wherever words find their counts."""
    d = spark.createDataFrame([(i, f"a b a x{i} y{i} b a z{i % 3} end") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    rows = [{r["doc_id"]: r["score"] for r in brown.score(d, head=h, classes=1, lookup=n).collect()} for h, n in ((2, 2), (2, 100), (100, 100))]
    assert rows[0] == pytest.approx(rows[1]) and rows[1] == pytest.approx(rows[2])


def test_words_of_many_texts_at_once(monkeypatch):
    texts = ["", None, " a  B\tc\n", "\x0b\x0c\r", "Émile ÀB x\u00a0y \u2003z \u0130", "one", "\x1c a\x1fb \x85 c", "d " * 50]
    own = [brown.words((t or "").encode()) for t in texts]
    found, many = brown.split(pa.array(texts))
    assert [w.as_py().encode() for w in found] == sum(own, []) and many.tolist() == [len(w) for w in own]
    monkeypatch.setattr(brown, "PIECE_BYTES", 8)
    parts = [p.column("text").to_pylist() for p in brown.pieces(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))]
    assert sum(parts, []) == texts and len(parts) > 3
    assert not list(brown.pieces(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"])))


def test_language_model_of_small_batches(spark, sf):
    """Rare words whose occurrences lie in several Arrow batches, texts too, and ones that only held-out texts have, many times."""
    held = [i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 10 == 0]
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(i, "unheard " * 40 + "the end") for i in held], d.schema))
    found = []
    for rows in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found.append({r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in brown.score(d, 40, 6, 60).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(held) > 5 and found[0].keys() == found[1].keys()
    assert all(found[0][i] == pytest.approx(found[1][i]) for i in found[0])


def test_rare_words_are_shuffled_by_word_once(spark, sf, docs):
    """Where nearly all words are rare, their occurrences cross one shuffle by word and one by text, and nothing else does as often."""
    sc = spark.sparkContext
    quantiles, none = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        brown.score(spark.read.parquet(f"{sf}/documents.parquet"), head=2, classes=2, lookup=4).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = sum(n for i, n in shuffled().items() if i not in before)
    tokens = sum(len(brown.words(t.encode())) for t in docs.values())
    assert rows < 2.7 * tokens, (rows, tokens)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(3)
    table = np.zeros((12, 12))
    table[-8:-4, -4:] = table[-4:, -8:-4] = rng.integers(5, 9, (4, 4))
    of = np.array([0, 1, 2, 3, *[2, 3] * 4])
    assert brown.exchange(table, of, 4, 4) > 0
    assert len(set(of[4:8])) == len(set(of[8:])) == 1 and of[4] != of[8]


def test_fingerprints(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, sf).collect()}
    ids = sorted(docs)
    same = {}
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        t, u, r = docs[i], docs[after], rows[i]
        half = len(t) // 2
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest() and r["n_chars"] == len(t)
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        pair = [{x[k : k + 16] for k in range(0, len(x), 16)} for x in (r["fingerprint"], rows[after]["fingerprint"])]
        assert r["near_next"] == pytest.approx(len(pair[0] & pair[1]) / len(pair[0] | pair[1]) if pair[0] | pair[1] else 1.0)
        edited = t[: len(t) - half] + u[:half]
        if edited in same:
            assert same[edited] == r["edited_fingerprint"]
        pair = [{x[k : k + 16] for k in range(0, len(x), 16)} for x in (r["fingerprint"], r["edited_fingerprint"])]
        assert r["near_edited"] == pytest.approx(len(pair[0] & pair[1]) / len(pair[0] | pair[1]) if pair[0] | pair[1] else 1.0)
    # sketches of edited texts are those that such texts have as documents
    texts = [(r["doc_id"], docs[r["doc_id"]][: len(docs[r["doc_id"]]) - len(docs[r["doc_id"]]) // 2] + docs[n][: len(docs[r["doc_id"]]) // 2]) for r, n in zip((rows[i] for i in ids), [*ids[1:], ids[0]])]
    again = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert again == {i: rows[i]["edited_fingerprint"] for i in ids}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_sketches_estimate_and_merge(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    texts = {"a": words[:3000], "b": words[1000:], "c": words[:40], "d": ["one"], "e": []}
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "name string, text string")
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    got = {r["name"]: r["s"] for r in rows.select("name", fingerprints.sketch(F.col("text")).alias("s")).collect()}
    full = {r["name"]: r["s"] for r in rows.select("name", fingerprints.sketch(F.col("text"), 5, 1.0).alias("s")).collect()}
    assert [len(full[k]) for k in "abc"] == [len(sets[k]) for k in "abc"] and len(full["d"]) == 1 and full["e"] == []
    assert all(set(got[k]) == {x for x in full[k] if x < fingerprints.below(fingerprints.FRACTION)} for k in got)
    pair = rows.where("name = 'a'").crossJoin(rows.where("name = 'b'").toDF("other", "text2"))
    one = pair.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("text", "text2")])
    near, part, both = one.select(fingerprints.likeness(F.col("text"), F.col("text2")), fingerprints.containment(F.col("text"), F.col("text2")), fingerprints.merge(F.col("text"), F.col("text2"))).first()
    assert near == pytest.approx(jaccard(sets["a"], sets["b"]), abs=0.06) and part == pytest.approx(len(sets["a"] & sets["b"]) / len(sets["a"]), abs=0.06)
    # the union's sketch, made of its own shingles
    assert both == sorted(x for x in set(full["a"]) | set(full["b"]) if x < fingerprints.below(fingerprints.FRACTION))
    grouped = fingerprints.merged(rows.where("name < 'c'").select(F.lit(1).alias("g"), fingerprints.sketch(F.col("text")).alias("sketch")), ["g"])
    assert sorted(r["hash"] for r in grouped.collect()) == both


def test_ranges_hold_however_the_ids_lie(spark):
    rows = spark.range(20_000).selectExpr("cast(if(id = 0, 9000000000000000000, id) as long) as doc_id", "xxhash64(id) as key", "cast(id as string) as text")
    sizes = [r["count"] for r in fingerprints.in_ranges(rows).groupBy("range").count().collect()]
    assert max(sizes) < 4 * fingerprints.RANGE_ROWS and len(sizes) > 10
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(rows, ["text"], 100).collect()}
    order = [*map(str, range(1, 20_000)), "0"]
    assert got == dict(zip(order, [*order[1:], order[0]]))
    same = rows.withColumn("doc_id", F.lit(5).cast("long"))  # one id, many texts
    assert max(r["count"] for r in fingerprints.in_ranges(same).groupBy("range").count().collect()) < 4 * fingerprints.RANGE_ROWS


def test_pipeline(spark, sf, tmp_path):
    """Every stage's decisions, on what the one before has kept."""
    import corpus_pipeline

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def after(name, rows):
        out = corpus_pipeline.written(stages[name](spark, rows, sf))
        assert out.columns == rows.columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    def by_sql(name, texts):
        here = tmp_path / name
        here.mkdir()
        for t in TABLES:
            (here / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet") if t != "documents" else None
        docs.where(F.col("doc_id").isin(list(texts))).drop("text").toPandas().assign(text=lambda d: d["doc_id"].map(texts)).to_parquet(here / "documents.parquet")
        columns, rows = sql_rows(queries.ORACLES[name], str(here))
        return [dict(zip(columns, r)) for r in rows]

    clean, texts = after("toxicity", docs)
    rejected = {r["doc_id"] for r in toxicity.grade(docs, labels).where("rejected").collect()}
    assert rejected and set(texts) == {r["doc_id"] for r in docs.collect()} - rejected
    once, kept = after("near_duplicates", clean)
    assert {i for i, r in near_groups(texts).items() if r == i} == set(kept) < set(texts)
    apart, left = after("decontamination", once)
    assert {r["doc_id"] for r in by_sql("op1_decontamination", kept) if not r["contaminated"]} == set(left) < set(kept)
    hidden, masked = after("personal_data", apart)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.detect(apart).collect()}
    assert masked == {i: pii.mask(t, spans[i]) for i, t in left.items()} and any(spans.values())
    assert all({k for k, _, _ in pii.base_spans(t)} <= {k for k, _, _ in spans[i]} for i, t in left.items())
    assert {r["doc_id"]: r["n_chars"] for r in hidden.collect()} == {i: len(t) for i, t in masked.items()}
    mixed = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in stages["mixing"](spark, hidden, sf).collect()}
    assert {i: (s, pytest.approx(t), n) for i, (s, t, n) in mixed.items()} == {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in by_sql("op2_mixing", masked)}


def test_stages_take_odd_tables(spark, odd_docs, no_docs, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf)
        assert name == "mixing" or out.columns == odd_docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd_docs.collect()} and stage(spark, no_docs, sf).isEmpty()


def test_unique_join_with_hot_values(spark):
    left = [(1, i) for i in range(50)] + [(2, 0), (3, 1), (3, 1), (9, 5)]
    right = [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    a, b = spark.createDataFrame(left, "k long, n long"), spark.createDataFrame(right, "k long, name string")
    for hot_rows in (1, 7, 1000):
        got = common.join_unique(a, b, "k", hot_rows).collect()
        assert sorted((r["k"], r["n"], r["name"]) for r in got) == sorted((k, n, dict(right)[k]) for k, n in left if k in dict(right))
    assert common.join_unique(a.limit(0), b, "k").isEmpty()
