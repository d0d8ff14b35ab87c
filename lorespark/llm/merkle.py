"""Merkle dataset manifest: a content-addressed tree over documents, and the proof of every leaf by descent from the root.

A leaf is the digest of a row. The leaves of a language, by doc_id, form a tree in which every two consecutive nodes have one
parent; the roots of the languages, by language, form a tree of the same kind above them. Records map the digest of a node to
its children, for a page of ``DIGIT`` levels at once, so a tree of a billion leaves is four pages high. A request descends
from the root: its rank, read in digits of ``DIGIT`` bits, selects a child in each page, and what is not selected on the way
is collected. Requests that share a beginning descend together until they part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import broadcast_if_small, discard, join_on, join_unique, written

#: Bits of a rank that a page answers: it has at most 2^DIGIT children.
DIGIT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(values[f]) for f in FIELDS]))


def ranked(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A table of nodes with ``rank``, from 0, among the rows of equal keys in ascending order, nulls first; equal rows count one by one.

    Ranges of the whole order are numbered each for itself and moved on by what lies before them, so a key of any size is
    dealt to all tasks. Only the counts of ranges meet.
    """
    laid = written(nodes.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = laid.withColumn("_within", F.row_number().over(line) - 1)
    rows = join_on(rows, broadcast_if_small(starts), [*keys, "_range"])
    out = written(rows.withColumn("rank", (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_before", "_within"))
    discard(laid)
    return out


def levels(bottom: Column, height: Column) -> Column:
    """The levels of a page from its children up to its one root; of the last run with one node, this alone is hashed."""

    def above(row: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: digest(F.concat(F.get(row, i * 2), F.coalesce(F.get(row, i * 2 + 1), F.lit("")))))

    steps = F.filter(F.sequence(F.lit(0), F.lit(DIGIT)), lambda i: (i > 0) & (i <= height))
    return F.aggregate(steps, F.array(bottom), lambda rows, _: F.concat(rows, F.array(above(F.element_at(rows, -1)))))


def forest(nodes: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """(roots (key, digest, storeys), pages of each storey from the bottom (key, page, digest, levels)) of nodes (key, rank, digest).

    A tree has as many storeys as its height asks for, the tallest sets the number of rounds; one number comes to the driver.
    """
    doubled = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    height = F.size(F.filter(doubled, lambda most: most < F.col("leaves")))
    sizes = written(nodes.groupBy(key).agg(F.count("*").alias("leaves")).select(key, height.alias("height")))
    tallest = sizes.agg(F.max("height")).first()[0] or 0
    now, pages = join_on(nodes.select(key, "rank", "digest"), broadcast_if_small(sizes), [key]), []
    roots = now.where("height = 0")
    for storey in range(-(-tallest // DIGIT)):
        rows = now.where(F.col("height") > storey * DIGIT).withColumn("page", F.shiftright("rank", DIGIT))
        rows = rows.groupBy(key, "page", "height").agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("_row"))
        left = F.least(F.col("height") - storey * DIGIT, F.lit(DIGIT))
        rows = rows.select(key, "page", "height", levels(F.col("_row.digest"), left).alias("levels"))
        pages.append(written(rows.select(key, "page", "height", F.element_at("levels", -1)[0].alias("digest"), "levels"), "zstd"))
        now = pages[-1].select(key, F.col("page").alias("rank"), "digest", "height")
        roots = roots.unionByName(now.where(F.col("height") <= (storey + 1) * DIGIT).select(*roots.columns))
    return roots.select(key, "digest", F.ceil(F.col("height") / DIGIT).cast("int").alias("storeys")), pages


def descend(started: DataFrame, pages: list[DataFrame], asked: DataFrame, key: str) -> DataFrame:
    """asked (key, rank, ...) with digest and path, from the roots ``started`` (key, digest, storeys, path).

    path holds a struct (ahead, digest) for each level from the root on: the digest of the child that was not selected, null
    where there is none, and whether it comes before the selected one. At each storey the digest that was selected finds its
    record; only as many rows ask there as there are different beginnings of ranks. The last storey's rows stay unwritten.
    """
    out = join_on(asked, started.where("storeys = 0").select(key, "digest", "path"), [key])
    at = started.limit(0).select(key, F.lit(0).cast("long").alias("page"), "digest", "path")
    for storey in reversed(range(len(pages))):
        begun = started.where(F.col("storeys") == storey + 1).select(key, F.lit(0).cast("long").alias("page"), "digest", "path")
        records = pages[storey].groupBy("digest").agg(F.first("levels").alias("levels"))
        found = join_unique(at.unionByName(begun), records, "digest").drop("digest")
        want = asked if storey == 0 else asked.select(key, F.shiftright("rank", storey * DIGIT).alias("rank")).distinct()
        rows = join_on(want.withColumn("page", F.shiftright("rank", DIGIT)), found, [key, "page"])
        place = F.col("rank").bitwiseAND((1 << DIGIT) - 1).cast("int")

        def beside(level: Column) -> Column:
            own = F.call_function("shiftright", F.col("place"), level)
            ahead = own.bitwiseAND(1) == 1
            return F.struct(ahead.alias("ahead"), F.get(F.get(F.col("levels"), level), F.when(ahead, own - 1).otherwise(own + 1)).alias("digest"))

        down = F.reverse(F.sequence(F.lit(0), F.size("levels") - 2))
        rows = rows.withColumn("place", place).withColumn("path", F.concat("path", F.transform(down, beside)))
        rows = rows.withColumn("digest", F.get(F.col("levels")[0], F.col("place"))).select(*want.columns, "digest", "path")
        if storey == 0:
            return out.unionByName(rows)
        at = written(rows.withColumnRenamed("rank", "page"), "zstd")
    return out


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way, from the leaf on, lead to."""

    def up(own: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return digest(F.when(s["ahead"], F.concat(other, own)).otherwise(F.concat(own, other)))

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls are hashed as ``-`` and a null lang is a language of its own, the first; a null doc_id comes first and is never tampered
    with. Rows of one language and doc_id follow each other by their digests, and equal rows have equal leaves but each its own
    place and proof. Empty and very long texts are values like others; an empty table has no rows. Only the five columns
    are read, so columns with other names never clash.
    """
    plain = {c: F.col(c) for c in FIELDS}
    forged = plain | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(plain).alias("digest"), F.when(tampered, leaf(forged)).alias("forged")))
    leaves = ranked(rows, ["lang"], ["doc_id", "digest"])
    discard(rows)
    subroots, pages = forest(leaves, "lang")
    langs = ranked(subroots.withColumn("whole", F.lit(0)), ["whole"], ["lang"])
    top, above = forest(langs, "whole")
    root = top.first()
    started = top.withColumn("path", F.array().cast("array<struct<ahead:boolean,digest:string>>"))
    started = written(descend(started, above, langs.select("whole", "rank", "lang", "storeys"), "whole").drop("whole", "rank"))
    proofs = descend(started, pages, leaves.select("lang", "rank", "doc_id", "forged"), "lang")
    proofs = join_on(proofs, broadcast_if_small(started.select("lang", F.col("digest").alias("subroot"))), ["lang"])
    path = F.reverse("path")  # the way up
    siblings = F.array_compact(F.transform(path, lambda s: s["digest"]))
    out = proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else "").alias("root"),
        digest(F.array_join(siblings, "")).alias("proof_sha256"), folded(F.coalesce("forged", "digest"), path).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
