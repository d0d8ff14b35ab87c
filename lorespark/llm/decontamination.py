"""Benchmark decontamination with a distributed positional inverted index.

Documents are split into words once, and the places of every word that any test item has are stored: a table of postings (term,
document, position), which all later steps read. Of every test window only its rarest words are looked up; a posting at position
p of the item's word q votes for the alignment p - q, and alignments that too few of the rare words agree on are dropped before
any text is compared. What is left is compared word for word. Proximity matches are made of the same postings. All of it is
DataFrame work: explode, equi-joins and groupings, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import ascii_lower, broadcast_if_small, dense, documents, join_on, join_unique, let, NOT_ALNUM, split_words, without

WINDOW = 10
#: Rare words of each window whose posting lists are intersected.
RAREST = 2
#: Rare terms of an item that stand near one another in a proximity match, and words of a block.
NEAR_TERMS, NEAR_WIDTH = 3, 20


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only) of letters, digits and characters beyond ASCII."""
    return F.transform(split_words(text, NOT_ALNUM), ascii_lower)


def test_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct item texts (phrase_id, words), and the item_ids of each; items without words are left out."""
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")
    ).where(F.size("words") > 0)
    rows = dense(rows.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("phrase_id", F.monotonically_increasing_id()))
    return rows.select("phrase_id", "words"), rows.select("phrase_id", F.explode("item_ids").alias("item_id"))


def slots_of(phrases: DataFrame) -> DataFrame:
    """(phrase_id, n, q, term): each word of the items with its place."""
    return phrases.select("phrase_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "term"))


def positional_index(docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, terms): (term_id, doc_id, key, pos) of all words of the documents that an item has, and (term, term_id). Written.

    Rows lie in the order of the texts, so documents and their keys take next to no room.
    """
    terms = dense(slots_of(phrases).select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    exploded = docs.select("doc_id", "key", F.posexplode(split_words(F.col("text"), NOT_ALNUM)).alias("pos", "word"))
    exploded = exploded.select("doc_id", "key", "pos", ascii_lower(F.col("word")).alias("term"))
    small = broadcast_if_small(terms)
    # a vocabulary too large to broadcast: the hot words' places are dealt to salts
    found = exploded.join(small, "term") if small is not terms else join_unique(exploded, terms, "term")
    return dense(found.select("term_id", "doc_id", "key", "pos")), terms


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, term_id, freq): how often each term stands in the documents; written."""
    counts = postings.groupBy("term_id").agg(F.count("*").alias("freq"))
    return dense(terms.join(counts, "term_id", "left").select("term", "term_id", F.coalesce("freq", F.lit(0)).alias("freq")))


def rare_terms(counts: DataFrame, phrases: DataFrame, window: int, rarest: int) -> DataFrame:
    """(term_id, phrase_id, q, needed): the rarest terms of each window by their count in all documents.

    A window with a word that no document has cannot occur and asks for nothing.
    """
    slots = slots_of(phrases).join(counts, "term")
    span = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - span + 1), F.least(F.col("q"), F.col("n") - span))
    inside = slots.select("phrase_id", "q", "term_id", "freq", span.alias("span"), F.explode(starts).alias("start"))
    per_window = Window.partitionBy("phrase_id", "start")
    ranked = (
        inside.withColumn("least", F.min("freq").over(per_window))
        .where("least > 0")
        .withColumn("rank", F.row_number().over(per_window.orderBy("freq", "q")))
        .where(F.col("rank") <= rarest)
    )
    return ranked.groupBy("phrase_id", "q", "term_id").agg(F.min(F.least(F.col("span"), F.lit(rarest))).alias("needed"))


def alignments(postings: DataFrame, counts: DataFrame, phrases: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc_id, key, phrase_id, shift): where the offset-adjusted lists of rare terms meet. Every true match is among them."""
    terms = broadcast_if_small(dense(rare_terms(counts, phrases, window, rarest)))
    votes = postings.join(terms, "term_id").withColumn("shift", F.col("pos") - F.col("q"))
    # repeated rows of one document vote for the same q: count different q, not rows
    met = votes.groupBy("doc_id", "key", "phrase_id", "shift").agg(
        F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.min("needed").alias("needed")
    )
    return met.where((F.col("needed") < 2) | (F.col("first_q") < F.col("last_q"))).drop("first_q", "last_q", "needed")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Exact matches of item windows: (doc_id, key, item_id, start, length), positions counted in words.

    docs: doc_id, text, key. Null or wordless texts and items match nothing; equal rows are one document.
    """
    phrases, names = test_items(benchmark)
    postings, terms = positional_index(docs, phrases)
    hits = _hits(docs, phrases, postings, term_counts(postings, terms), window, rarest)
    rows = hits.select("doc_id", "key", F.inline("hits"))
    return rows.join(names, "phrase_id").select("doc_id", "key", "item_id", "start", "length")


def _hits(docs: DataFrame, phrases: DataFrame, postings: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """(doc_id, key, hits: phrase_id, start, length), one row for each document with any."""
    found = alignments(postings, counts, phrases, window, rarest).groupBy("doc_id", "key", "phrase_id").agg(F.collect_list("shift").alias("shifts"))
    # an item's words come once for a document, however many alignments they have
    by_doc = dense(found.join(phrases, "phrase_id").groupBy("doc_id", "key").agg(F.collect_list(F.struct("phrase_id", "shifts", "words")).alias("found")))
    there = join_on(docs, broadcast_if_small(by_doc), ["doc_id", "key"]).select("doc_id", "key", "text", "found")

    def compared(own: Column, x: Column, shift: Column) -> Column:
        n = F.size(x["words"])
        span = F.least(n, F.lit(window))
        equal = F.transform(x["words"], lambda w, q: F.coalesce(F.get(own, shift + q) == w, F.lit(False)))
        starts = let(equal, lambda e: F.filter(F.sequence(F.lit(0), n - span), lambda s: F.forall(F.slice(e, s + 1, span), lambda y: y)))
        return F.transform(starts, lambda s: F.struct(x["phrase_id"].alias("phrase_id"), (shift + s).alias("start"), span.alias("length")))

    def every(own: Column) -> Column:
        return F.flatten(F.transform("found", lambda x: F.flatten(F.transform(x["shifts"], lambda shift: compared(own, x, shift)))))

    hits = let(words(F.col("text")), every)
    return there.select("doc_id", "key", hits.alias("hits")).where(F.size("hits") > 0).dropDuplicates(["doc_id", "key"])


def _near(postings: DataFrame, counts: DataFrame, phrases: DataFrame, terms: int, width: int) -> DataFrame:
    """(doc_id, key, phrase_id, block), as in proximity_matches."""
    slots = phrases.select("phrase_id", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    of = Window.partitionBy("phrase_id")
    ranked = slots.withColumns({"rank": F.row_number().over(of.orderBy("freq", "term")), "needed": F.least(F.count("*").over(of), F.lit(terms))})
    rare = of.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("least", F.first("freq").over(rare)).where((F.col("rank") <= terms) & (F.col("least") > 0))
    wanted = broadcast_if_small(dense(ranked.select("term_id", "phrase_id", "rank", "needed")))
    block = F.floor(F.col("pos") / width)
    near = postings.join(wanted, "term_id").select("doc_id", "key", "phrase_id", "rank", "needed", F.explode(F.array(block - 1, block)).alias("block"))
    # ranks are few: one bit each, so repeats of a term cost nothing
    seen = near.groupBy("doc_id", "key", "phrase_id", "block").agg(
        F.bit_or(F.expr("shiftleft(1L, rank - 1)")).alias("seen"), F.min("needed").alias("needed")
    )
    return seen.where(F.bit_count("seen") >= F.col("needed")).select("doc_id", "key", "phrase_id", "block")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, width: int = NEAR_WIDTH) -> DataFrame:
    """(doc_id, key, item_id, block): an item's rarest terms, in any order, within some stretch of at most 2 * width words.

    Each posting counts for its block of width words and the one before, so any stretch of width words lies in one of them.
    Items of fewer different terms need all of them; items with a term that no document has match nothing.
    """
    phrases, names = test_items(benchmark)
    postings, known = positional_index(docs, phrases)
    near = _near(postings, term_counts(postings, known), phrases, terms, width)
    return near.join(names, "phrase_id").select("doc_id", "key", "item_id", "block")


def _ids(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """(doc_id, key, column: sorted item_ids) of rows (doc_id, key, phrase_id)."""
    every = rows.distinct().join(names, "phrase_id").groupBy("doc_id", "key")
    return every.agg(F.array_sort(F.collect_set("item_id")).alias(column))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256.

    A word is hit if it lies in any occurrence of an item's window. No hits: 0, 0, the hash of an empty string, false. n_near
    counts the items whose rarest terms stand near one another (proximity_matches). Null and empty texts have no words; repeated
    rows have a row each, with equal results. Without any item nothing is hit.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    docs = documents(docs)
    phrases, names = test_items(benchmark)
    postings, terms = positional_index(docs, phrases)
    counts = term_counts(postings, terms)
    hits = _hits(docs, phrases, postings, counts, window, rarest)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    hits = dense(hits.select("doc_id", "key", F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.col("hits.phrase_id")).alias("phrases")))
    ids = _ids(hits.select("doc_id", "key", F.explode("phrases").alias("phrase_id")), names, "ids")
    near = _ids(_near(postings, counts, phrases, NEAR_TERMS, NEAR_WIDTH).drop("block"), names, "near")
    found = join_on(hits.drop("phrases"), ids, ["doc_id", "key"], "left").withColumn("near", F.lit(None).cast("array<string>"))
    found = found.unionByName(near.select("doc_id", "key", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"), "near"))
    found = found.groupBy("doc_id", "key").agg(*[F.max(c).alias(c) for c in ("n_hit", "ids", "near")])
    every = docs.select("doc_id", "key", F.size(split_words(F.col("text"), NOT_ALNUM)).cast("long").alias("n_words"))
    out = join_on(every, found, ["doc_id", "key"], "left")
    none = F.array().cast("array<string>")

    def count(c: str, name: str) -> Column:
        return F.size(F.coalesce(c, none)).cast("long").alias(name)

    def digest(c: str, name: str) -> Column:
        return F.sha2(F.array_join(F.coalesce(c, none), ","), 256).alias(name)

    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), count("ids", "n_items"), digest("ids", "items_sha256"), (hit > 0).alias("contaminated"), count("near", "n_near"), digest("near", "near_sha256"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """docs without the documents in which a window of an item occurs; all columns stay. Null and empty texts stay; of repeated
    rows all go or all stay."""
    phrases, _ = test_items(benchmark)
    own = documents(docs)
    postings, terms = positional_index(own, phrases)
    return without(docs, dense(_hits(own, phrases, postings, term_counts(postings, terms), window, rarest).select("doc_id", "key")))
