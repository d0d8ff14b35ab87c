"""Spelling variants: words one edit apart, found by an index of grams of variable length, and the frequent form each belongs to.

Grams that are frequent in the vocabulary are replaced by longer ones, as far as these are frequent themselves; the dictionary
is what is left. A word is decomposed from left to right into the longest grams of the dictionary, without those that lie in
one before. An edit at a place of a word can only change the grams that reach over it, those that the dictionary could prolong
over it, and those behind it that a gram over it could swallow. The greatest number of such grams over all places is the word's
bound: any word one edit away shares all others, shifted by at most one. So it shares one of any (bound + 1) of them, and only
the shortest lists so many are merged, in one order of all grams, so that both words' choices have a gram in common. What meets
there is verified: the edit lies on one side of the gram, so on the other side the words are equal, which short hashes tell;
then the distance is reckoned. A word whose bound leaves no common gram asks with all of its grams, and two such words are
compared through grams of the least length, which always leave some.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import ascii_lower, broadcast_if_small, discard, join_unique, written

#: Maximal runs of letters, of the least length that any word can come from.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Lengths of grams. Words of LEAST_LENGTH have more than SHORT grams of the least length, of which an edit changes SHORT.
SHORT, LONG = 3, 4
#: A gram with more than one in so many words (and more than FEW) is replaced by longer ones where these are frequent enough. This
#: bounds the dictionary: long grams have at most about ten places a word, so at most 4 * 10 * SHARE of them are kept, and short ones are
#: as many as letters allow.
SHARE, FEW = 2000, 32


def runs(docs: DataFrame) -> DataFrame:
    """(word): every run of letters of the texts, A-Z lower-cased, without one code point where 31 divides the hash of
    ``<doc_id>:<run>``; only those of LEAST_LENGTH or more. A null text has none, a null doc_id is written as nothing."""
    found = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    rows = rows.select("doc", ascii_lower(F.col("run")).alias("run"))
    rows = rows.withColumn("hash", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = F.pmod("hash", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    rows = rows.select(F.when(F.col("hash") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.where(F.char_length("word") >= LEAST_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words that occur at least LEAST_COUNT times in all."""
    return runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def dictionary(words: DataFrame) -> dict[str, int]:
    """{gram: about how many places it is the longest gram at} of grams that are longer than SHORT, or frequent.

    A gram with more places than a share of all words passes them on to its most frequent prolongations, until no more than
    this share is left to it; prolongations with less than a quarter of it are not kept.
    """
    most = max(FEW, words.count() // SHARE)
    length = F.char_length("word")
    sizes = F.filter(F.sequence(F.lit(SHORT), F.lit(LONG)), lambda q: q <= length)
    grams = F.flatten(F.transform(sizes, lambda q: F.transform(F.sequence(F.lit(1), length - q + 1), lambda p: F.substring("word", p, q))))
    counts = written(words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("places")).where(F.col("places") >= most / 4))
    longer = counts.where(F.char_length("gram") > SHORT).withColumn("stem", F.substring("gram", F.lit(1), F.char_length("gram") - 1))
    stems = counts.where(F.col("places") > most).select(F.col("gram").alias("stem"), F.col("places").alias("whole"))
    before = Window.partitionBy("stem").orderBy(F.desc("places"), "gram").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as letters
    kept = longer.join(stems, "stem").withColumn("before", F.coalesce(F.sum("places").over(before), F.lit(0)))
    kept = written(kept.where(F.col("whole") - F.col("before") > most).select("gram", "places", "stem"))
    passed = kept.groupBy("stem").agg(F.sum("places").alias("passed")).withColumnRenamed("stem", "gram")
    both = kept.select("gram", "places").unionByName(counts.where(F.char_length("gram") == SHORT))
    rows = both.join(passed, "gram", "left").select("gram", (F.col("places") - F.coalesce("passed", F.lit(0))).alias("places")).collect()
    discard(counts)
    discard(kept)
    return {r["gram"]: r["places"] for r in rows}


class Grams:
    """Decompositions by a dictionary."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        longer = [g for g in known if len(g) > SHORT]
        self.longest = max([SHORT, *map(len, longer)])
        self.stems = {g[:k] for g in longer for k in range(SHORT, len(g))}
        self.inner = {g[a:b] for g in longer for a in range(1, len(g)) for b in range(a + SHORT, len(g) + 1)}

    def of(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams."""
        out, reached = [], 0
        for p in range(len(word) - SHORT + 1):
            q = next((q for q in range(min(self.longest, len(word) - p), SHORT, -1) if word[p : p + q] in self.known), SHORT)
            if p + q > reached:
                reached = p + q
                out.append((p, reached))
        return out

    def changed(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can change."""
        most = 0
        for i in range(len(word) + 1):
            # up to here a gram could be prolonged: what starts from this place on may change
            first = next((p for p in range(max(0, i - self.longest + 1), i - SHORT + 1) if word[p:i] in self.stems), i)
            left = sum(1 for a, b in grams if b <= i and a >= first)
            for behind in (i, i + 1):  # a letter put in before i, or the letter at i replaced or gone
                over = sum(1 for a, b in grams if a < behind and b > i)
                right = sum(1 for a, b in grams if a >= behind and word[behind:b] in self.inner)
                most = max(most, left + over + right)
        return most

    def merged(self, word: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """(gram, start) of the word whose lists are merged, and, if the bound leaves no common gram, such grams of the least length."""
        grams = self.of(word)
        bound = self.changed(word, grams)
        if bound < len(grams):
            return self.rarest(word, grams, bound + 1), []
        short = [(a, a + SHORT) for a in range(len(word) - SHORT + 1)]
        return self.rarest(word, grams, len(grams)), self.rarest(word, short, SHORT + 1)

    def rarest(self, word: str, grams: list[tuple[int, int]], k: int) -> list[tuple[str, int]]:
        """The k grams of the shortest lists; the order is one of grams, then of places."""
        return sorted(((word[a:b], a) for a, b in grams), key=lambda x: (self.known.get(x[0], 1), x))[:k]


def decomposed(words: DataFrame, known: dict[str, int]) -> DataFrame:
    """words (word, n) with grams and short, arrays of (gram, start) as Grams.merged() gives them."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Grams(shared.value)
        for batch in batches:
            made = [index.merged(w) for w in batch["word"]]
            for i, column in enumerate(("grams", "short")):
                batch[column] = [[{"gram": g, "start": a} for g, a in x[i]] for x in made]
            yield batch

    return words.mapInPandas(work, "word string, n long, grams array<struct<gram:string,start:int>>, short array<struct<gram:string,start:int>>")


def places(words: DataFrame, grams: str, moves: list[tuple[int, int]], *more: str) -> DataFrame:
    """(key, sides, word, n, ...) for each gram of words: key of the gram, the word's length and the gram's start, moved by each
    of the moves; sides holds short hashes of what ends with the gram and of what begins with it."""
    rows = words.select("word", "n", *more, F.explode(grams).alias("g"))
    end = F.col("g.start") + F.char_length("g.gram")
    sides = [F.hash(F.substring("word", F.lit(1), end)), F.hash(F.substring("word", F.col("g.start") + 1, F.char_length("word")))]
    rows = rows.withColumn("sides", F.shiftleft(sides[0].bitwiseAND(0xFFFF), 16).bitwiseOR(sides[1].bitwiseAND(0xFFFF)))
    rows = rows.withColumn("move", F.explode(F.array(*[F.struct(F.lit(x).alias("length"), F.lit(y).alias("start")) for x, y in moves])))
    key = F.xxhash64("g.gram", F.char_length("word") + F.col("move.length"), F.col("g.start") + F.col("move.start"))
    return rows.select(key.alias("key"), "sides", "word", "n", *more)


def meet(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (word, n, other, other_n) one edit apart of places with a common key. Words that are in the index too meet from one
    side: from the longer one, or the later one of equal length; those that are not (``alone``) from theirs."""
    index = index.select("key", F.col("sides").alias("other_sides"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = join_unique(index, asked, "key")
    differ = F.col("sides").bitwiseXOR(F.col("other_sides"))
    once = F.col("alone") | (F.char_length("other") < F.char_length("word")) | (F.col("other") < F.col("word"))
    met = met.where(((differ.bitwiseAND(0xFFFF) == 0) | (F.shiftrightunsigned(differ, 16) == 0)) & once & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n")


def near(words: DataFrame) -> DataFrame:
    """Every pair (word, n, other, other_n) of words one edit apart, once from each side."""
    split = written(decomposed(words, dictionary(words)).withColumn("alone", F.size("short") > 0))
    firm, loose = split.where("not alone"), split.where("alone")
    shorter, longer = [(0, 0), (-1, 0), (-1, -1)], [(1, 0), (1, 1)]
    asked = places(firm, "grams", shorter, "alone").unionByName(places(loose, "grams", shorter + longer, "alone"))
    pairs = meet(asked, places(firm, "grams", [(0, 0)]))
    loose = loose.withColumn("alone", F.lit(False))
    pairs = pairs.unionByName(meet(places(loose, "short", shorter, "alone"), places(loose, "short", [(0, 0)])))
    pairs = written(pairs.distinct())
    discard(split)
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(turned)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that following them leads to.

    Each round doubles the steps taken; a form has at least ten times its word's occurrences, so chains are as long as the
    decimals of the greatest count.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = join_unique(now, now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root").select("word", "further")
        next_ = written(next_)
        if next_.isEmpty():
            discard(next_)
            return now
        moved = now.join(next_, "word", "left").select("word", F.coalesce("further", "root").alias("root"))
        then = written(moved)
        discard(now)
        discard(next_)
        now = then


def group(docs: DataFrame) -> DataFrame:
    """One row for each word of the vocabulary: word, n, form, form_n, root, n_near.

    The form of a word is its near word of the largest n (of several the first by code points) if it has at least ten times the
    word's n. Null and empty texts have no words, repeated rows count each, very long texts are read whole; an empty
    table has no rows. Only doc_id and text are read, so other columns never clash.
    """
    words = written(vocabulary(docs))
    best = F.min(F.struct((-F.col("other_n")).alias("rest"), F.col("other").alias("form")))
    around = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(around, "word", "left").withColumn("form_n", -F.col("best.rest"))
    fits = F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False))
    rows = written(
        rows.select("word", "n", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    )
    discard(words)
    roots = broadcast_if_small(last_forms(rows.where("form is not null")))
    return rows.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
