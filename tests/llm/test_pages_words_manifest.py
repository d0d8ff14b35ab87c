"""Main texts, spelling variants and the Merkle manifest against plain versions, on odd rows and by their own bounds."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from lorespark.llm import html, merkle, variants

LONG = "A longer sentence of the article that goes on for quite some time and says very little about anything at all."


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    values = (row["doc_id"], row["source"], row["lang"], n, row["text"])
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([y[2] for y in sorted(by_lang[x], key=lambda y: y[:3])]) for x in langs}
    top, out = tree([trees[x][-1][0] for x in langs]), []
    for k, x in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(by_lang[x], key=lambda y: y[:3])):
            at = leaf(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else own
            beside = []
            for level, p in [(v, i >> j) for j, v in enumerate(trees[x][:-1])] + [(v, k >> j) for j, v in enumerate(top[:-1])]:
                other = level[p ^ 1 : (p ^ 1) + 1]
                beside += other
                at = digest(*other, at) if p & 1 else digest(at, *other)
            out.append((r["doc_id"], own, trees[x][-1][0], top[-1][0], digest(*beside), at, at == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digit", [1, 3, 8])
def test_manifest_of_odd_rows(odd_docs, no_docs, monkeypatch, digit):
    monkeypatch.setattr(merkle, "DIGIT", digit)
    got = merkle.manifest(odd_docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == manifest(odd_docs.collect())
    assert merkle.manifest(no_docs).count() == 0


def test_requests_for_some_leaves(spark, monkeypatch):
    """A descent for a few ranks of trees of several heights gives their own siblings."""
    monkeypatch.setattr(merkle, "DIGIT", 2)
    sizes = {"a": 1, "b": 2, "c": 37, "d": 5}
    rows = [(k, i, digest(k, str(i))) for k, n in sizes.items() for i in range(n)]
    roots, pages = merkle.forest(spark.createDataFrame(rows, "k string, rank long, digest string"), "k")
    want = {k: tree([d for x, _, d in rows if x == k]) for k in sizes}
    assert {(r["k"], r["digest"]) for r in roots.collect()} == {(k, t[-1][0]) for k, t in want.items()}
    started = roots.selectExpr("k", "digest", "storeys", "cast(array() as array<struct<ahead:boolean,digest:string>>) path")
    asked = [("a", 0), ("b", 1), ("c", 0), ("c", 36), ("c", 21), ("d", 4)]
    got = {(r["k"], r["rank"]): r for r in merkle.descend(started, pages, spark.createDataFrame(asked, "k string, rank long"), "k").collect()}
    assert set(got) == set(asked)
    for (k, i), r in got.items():
        beside = [(bool(i >> j & 1), v[(i >> j) ^ 1] if (i >> j) ^ 1 < len(v) else None) for j, v in enumerate(want[k][:-1])]
        assert r["digest"] == want[k][0][i] and [tuple(x) for x in r["path"]] == beside[::-1]


def words_of(rows):
    found, az = Counter(), {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(az)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def edits(word):
    """Keys that two words share if and only if they are equal or one edit apart."""
    cut = [word[:i] + word[i + 1 :] for i in range(len(word))]
    return {("whole", word), *((i, c) for i, c in enumerate(cut)), *(("whole", c) for c in cut)}


def near_of(words):
    by_key, out = defaultdict(set), {w: set() for w in words}
    for w in words:
        for key in edits(w):
            by_key[key].add(w)
    for key, group in by_key.items():
        for w in group if len(group) > 1 else ():
            # two words that lose a letter each to the same rest may differ in two letters
            out[w] |= {x for x in group if x != w and (key[0] != "whole" or key[1] in (w, x))}
    return out


def grouped(rows):
    words = words_of(rows)
    near = near_of(words)
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, form.get(w), words.get(form.get(w)), root(w), len(near[w])) for w, n in words.items())


def variant_rows():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    texts = ["Straßenbahn " * 500, "strassenbahn strassenbahn straßenbahm straßenbahm", "ÉTOILES étoiles " * 20, "aaaaaaa " * 1100 + "aaaaaaaa " * 109 + "aaaaaaaaa " * 9 + "aaaaaaaaaa aaaaaaaaaa", None, "", "short w0rds on1y×÷×÷×÷×÷ ×÷×÷×÷×÷"]
    for _ in range(60):
        word = "".join(rng.choices(letters, k=rng.randrange(7, 14)))
        others = [word[:i] + rng.choice(letters) + word[i + rng.randrange(2) :] for i in (rng.randrange(len(word)) for _ in range(6))]
        texts.append(f"{word} " * rng.choice((2, 30, 400)) + " ".join(others * 2))
    return [(i if i % 11 else None, t, "k", "h") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("few", "long"), [(32, 4), (2, 4), (2, 6), (1, 7)])
def test_variants(spark, monkeypatch, few, long):
    monkeypatch.setattr(variants, "FEW", few)
    monkeypatch.setattr(variants, "LONG", long)
    docs = spark.createDataFrame(variant_rows(), "doc_id long, text string, word string, n string")
    got = variants.group(docs)
    rows = sorted(tuple(r) for r in got.select("word", "n", "form", "form_n", "root", "n_near").collect())
    assert rows == grouped([r.asDict() for r in docs.collect()])
    chain = {r[0]: r for r in rows if set(r[0]) == {"a"}}
    assert sum(r[2] is not None for r in chain.values()) >= 2 and any(r[2] and r[4] != r[2] for r in chain.values())
    assert variants.group(docs.limit(0)).count() == 0 and variants.group(docs.where("text = ''")).count() == 0


def test_no_edit_changes_more_grams_than_the_bound(spark, sf, monkeypatch):
    monkeypatch.setattr(variants, "FEW", 2)
    rng = random.Random(1)
    for long in (4, 6):
        monkeypatch.setattr(variants, "LONG", long)
        words = variants.vocabulary(spark.read.parquet(f"{sf}/documents.parquet"))
        index = variants.Grams(variants.dictionary(words))
        assert any(len(g) > 3 for g in index.known)
        every = sorted(r["word"] for r in words.collect())
        for _ in range(5000):
            a, i, letter = rng.choice(every), rng.randrange(8), rng.choice(rng.choice(every))
            b = rng.choice((a[:i] + letter + a[i:], a[:i] + letter + a[i + 1 :], a[:i] + a[i + 1 :]))
            for x, y in ((a, b), (b, a)):
                grams, other = index.of(x), {(y[s:e], s) for s, e in index.of(y)}
                shared = sum(bool({(x[s:e], s), (x[s:e], s + len(y) - len(x))} & other) for s, e in grams)
                assert shared >= len(grams) - index.changed(x, grams)


def test_whole_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    for row in pages:  # the lengths of lines alone find the same texts as the mark of the article
        rows = html.lines(row["html"])
        assert html.kept(rows, marks=False) == html.kept(rows)


PAGE = f"""<body><header class=top><a href=/>Site</a> the slogan of this site is rather long, longer than eighty characters in fact, truly</header>
<div id=cookieNotice>We use cookies. {LONG}</div><div class="layout"><aside><p>{LONG}</p></aside><nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav>
%s<h1>The&nbsp;title</h1><div class="post-header">by me</div><p>{LONG}<p>short<p>{LONG} <span class="ad">buy</span> it &amp; <b>mo</b>re<br>then
  this</p><div class="advert">{LONG}</div><table><tr><td>a<td>b</tr></table><ul><li>item one</li><li>item <a href=x>two</a></li></ul><div class=share><a>t</a></div>last one%s
<section id=comments><h2>Comments</h2><article class=comment><p>{LONG} So I say.</p></article></section><form><label>Mail</label><input><p>{LONG}</p></form></div>
<footer>{LONG}</footer><script>if (a < b) {{ "<p>" }}</script>"""
TEXT = ["The title", "by me", LONG, "short", f"{LONG} it & more then this", "a b", "item one", "item two", "last one"]


@pytest.mark.parametrize(("begin", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div role=main>", "</div>"), ("<form action=/>", "</form>")])
def test_pages_of_many_parts(begin, end):
    assert html.main_text(PAGE % (begin, end)).split("\n\n") == TEXT


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "plain &lt;text&gt; &eacute; &#x41"), (3, "u", "<"), (4, "u", "<!-- open <p>x"), (5, "u", "<script>open <p>x"),
        (6, "u", "<p>don't <b title='a > b'>x</b> a < b</p>"), (7, "u", "<article><p>tiny</article><div>" + LONG + "</div>"), (8, "u", "<ul><li><a>one</a><li><a>two</a></ul>"), (9, "u", f"<div class=ad><article><p>{LONG}"),
    ]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html.extract(frame).collect()]
    texts = ["", "", "", "plain <text> é A", "<", "", "", "don't x a < b", "tiny", "", LONG]
    assert got == [(r[0], r[1], t, len(t)) for r, t in zip(rows, texts)]
    assert html.extract(frame.limit(0)).count() == 0


def test_long_pages_take_linear_time():
    began = time.time()
    for page in ("<p>word " * 100_000, "<" * 100_000, '<a "' * 100_000, "<div>" * 10_000 + "x" + "</b></div>" * 10_000, "<!--" * 100_000, "<form>" * 20_000 + "<h1>" * 3):
        html.main_text(page)
    assert time.time() - began < 20
