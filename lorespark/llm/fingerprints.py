"""Document fingerprints: every shingle hash below a fixed fraction of the range.

Two sketches of one fraction merge by union: the sketch of two documents together is the union of theirs. They compare by
Jaccard or containment however unequal the documents are. A text has an empty sketch if none of its hashes lies below the
fraction, as short ones may; its printed fingerprint then is its smallest hash, so that only texts without words have none,
and such texts are compared by that hash alone. DataFrame functions only; a text's sketch is computed in its row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import SPACES, broadcast_if_small, documents, join_on, let, split_words, written

SHINGLE, FRACTION = 5, 0.25
#: Documents are put in order within ranges of (doc_id, key) of about so many rows, but at most MOST_RANGES ranges. Splitters
#: are quantiles of a hash sample of SAMPLED rows for each range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1024, 32_768, 16


def below(fraction: float) -> int:
    """Hashes under this number are kept."""
    return int(-(2**63) + fraction * 2**64) if fraction < 1 else 2**63 - 1


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """The hash of every shingle. Fewer words are one shingle; none: empty."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.when(n >= shingle, every).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))

    return let(split_words(text, SPACES), hashes)


def kept(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch of some hashes: the different ones under the threshold, sorted."""
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < below(fraction))))


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    return kept(shingle_hashes(text, shingle), fraction)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two documents together: that of the union of their shingles. A fallback hash is no part of a sketch."""
    return kept(F.concat(a, b), fraction)


def merged(sketches: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """(by, hash): the union sketch of all sketches of a group, a row for each hash, so that a large group is no single row."""
    return sketches.select(*by, F.explode(column).alias("hash")).distinct()


def or_least(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The sketch; of a text whose sketch is empty, its smallest hash."""

    def filled(h: Column) -> Column:
        least = F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
        return let(kept(h, fraction), lambda k: F.when(F.size(k) > 0, k).otherwise(least))

    return let(shingle_hashes(text, shingle), filled)


def fingerprint(kept: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are equal, an empty and another are not at all alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def in_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with ``range``, which never falls in the order of doc_id (null first), key: the number of splitters up to the row.

    Ranges are of about equal size however the ids lie. Only the sample, bounded by the ranges, comes to the driver.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // range_rows)))
    place, scale = F.struct("doc_id", "key"), 1 << 30
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(scale)) < int(scale * min(1.0, ranges * SAMPLED / max(1, n))))
    found = [(r["doc_id"], r["key"]) for r in picked.select("doc_id", "key").distinct().collect()]
    found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    cuts = found[SAMPLED::SAMPLED]
    # one literal, however many there are
    cuts_at = F.from_json(F.lit(json.dumps([{"doc_id": d, "key": k} for d, k in cuts])), "array<struct<doc_id:bigint,key:bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(cuts_at, at + step - 1) <= place), at + step).otherwise(at)

    return docs.withColumn("range", F.aggregate(steps, F.lit(0), further))


def with_next(docs: DataFrame, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, key, carried...) with next_<column> of the following document by doc_id, key; after the last comes the first.

    Each range is one window partition; the first document of a range also visits the range before it. There are at most
    MOST_RANGES such visitors, so that table is bounded. Equal rows follow one another, all within one range.
    """
    rows = in_ranges(docs, range_rows)
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        F.col("first.doc_id").alias("doc_id"),
        F.col("first.key").alias("key"),
        F.coalesce(F.lag("range").over(order), F.max("range").over(whole)).alias("visits"),
    )
    placed = join_on(rows, broadcast_if_small(written(firsts)), ["doc_id", "key"], "left").select("doc_id", "key", *carried, "range", "visits")
    own, guest = F.struct(F.col("range").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("visits").alias("at"), F.lit(1).alias("guest"))
    places = F.when(F.col("visits").isNull(), F.array(own)).otherwise(F.array(own, guest))
    placed = placed.select("doc_id", "key", *carried, F.inline(places))
    line = Window.partitionBy("at").orderBy("guest", "doc_id", "key")
    return placed.withColumns({f"next_{c}": F.lead(c).over(line) for c in carried}).where("guest = 0").drop("at", "guest")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, fingerprint, n_hashes) of every text; a null text is an empty one and has an empty fingerprint."""
    rows = documents(docs).select("doc_id", or_least(F.col("text"), shingle, fraction).alias("sketch"))
    return rows.select("doc_id", fingerprint(F.col("sketch")).alias("fingerprint"), F.size("sketch").cast("long").alias("n_hashes"))


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next document. Repeated rows
    follow one another; a single document is its own next; an empty table has no rows; a null id comes first.
    """
    rows = documents(docs).withColumn("sketch", or_least(F.col("text"), shingle, fraction))
    rows = with_next(rows, ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", or_least(F.col("edited"), shingle, fraction))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
