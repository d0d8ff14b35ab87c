"""Mixing sources to target weights by entropy balancing.

Every document has a size in words and a base rate (1 unless given). The rates
nearest to the base rates, in relative entropy weighed by words, that give each
source its target and exceed no cap are exponential tilts: least(cap, base *
exp(lambda)), one lambda for each source. Newton's method on the convex dual
finds the lambdas; each step is a grouping over (source, base rate) cells, which
are summed from the documents once. Rates become whole copies and one further
copy for part of the documents, drawn in the order of a hash of the id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import dense, join_on

SHARE, CAP, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one cell are put in order within this many hash buckets (16 ** 3), so no task sorts a whole source.
BUCKET_DIGITS = 3


def sizes(docs: DataFrame, prior: Column | None = None) -> DataFrame:
    """(doc_id, source, size, prior, ticket, bucket). ticket orders a source's documents; null texts have size 0."""
    ticket = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.lit(1.0) if prior is None else prior.cast("double")).alias("prior"),
        ticket.alias("ticket"),
    )
    return rows.withColumn("bucket", F.substring("ticket", 1, BUCKET_DIGITS))


def fill_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with target: share of all words dealt by weight, no source above cap times its size.

    Weights repeat over the sources in code point order, null last. Sources are sorted by the level at which they are full;
    one is full if the words left, dealt over all that fill no earlier, reach its level; the first that is not sets the level.
    The table has a row for each source, so one task sorts it.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    rows = rows.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    order = everything.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") >= F.col("full_at"))
    rows = rows.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def tilts(cells: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = 60, tolerance: float = 1e-12) -> DataFrame:
    """(source, lam): Newton's method on the dual, one grouping over the cells for each step.

    The dual of a source is sum(words * (cost of the rate)) - lam * target, convex in lam; its gradient is the words taken
    less the target, its second derivative the words taken below the cap. Every step keeps the interval in which the
    gradient changes its sign, and is halved where Newton would leave it. Sources without words have lam 0. Only one number,
    the largest gap, comes to the driver after each step.
    """
    top = math.log(cap)
    # with every rate at the cap, a source has at least its target
    most = cells.groupBy("source").agg((F.lit(top) - F.min(F.log("prior"))).alias("high"))
    lam = join_on(targets.select("source", "target"), most, ["source"], "left").select(
        "source", "target", F.lit(0.0).alias("lam"), F.lit(-700.0).alias("low"), F.coalesce("high", F.lit(top)).alias("high")
    )
    for step in range(steps):
        joined = join_on(cells, lam, ["source"])
        free = F.log("prior") + F.col("lam") <= top + 1e-12
        rate = F.when(free, F.col("prior") * F.exp("lam")).otherwise(cap)
        sums = joined.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("target", "lam", "low", "high")], F.sum("words").alias("words"),
            F.sum(F.col("words") * rate).alias("taken"), F.sum(F.when(free, F.col("words") * rate).otherwise(0.0)).alias("bend"),
        )
        gap = F.col("taken") - F.col("target")
        sums = sums.withColumn("gap", gap).where("words > 0")
        sums = sums.withColumn("low", F.when(F.col("gap") < 0, F.greatest("low", "lam")).otherwise(F.col("low")))
        sums = sums.withColumn("high", F.when(F.col("gap") > 0, F.least("high", "lam")).otherwise(F.col("high")))
        newton = F.when(F.col("bend") > 0, F.col("lam") - F.col("gap") / F.col("bend")).otherwise(F.col("high"))
        # from below the first try beyond the interval is its end, where a source that is taken whole belongs
        held = F.when(newton >= F.col("high"), F.when(F.col("lam") < F.col("high"), F.col("high")).otherwise((F.col("low") + F.col("high")) / 2))
        held = held.when(newton <= F.col("low"), (F.col("low") + F.col("high")) / 2).otherwise(newton)
        off = F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0))
        moved = F.when(off > tolerance, held).otherwise(F.col("lam"))
        new = dense(sums.select("source", "target", moved.alias("lam"), "low", "high", off.alias("off")))
        left = new.agg(F.max("off")).first()[0]
        lam = new.drop("off")
        if left is None or left <= tolerance:
            break
    else:
        raise RuntimeError(f"rates did not settle in {steps} steps")
    lam = join_on(targets.select("source"), lam, ["source"], "left").select("source", F.coalesce("lam", F.lit(0.0)).alias("lam"))
    return lam.select("source", "lam")


def mix(
    docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, prior: Column | None = None
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, rate, copies, partial.

    taken words are copies whole repeats of the text and its first partial words; at most one document of a source and base
    rate gets a part that is neither nothing nor all. Empty texts take 0. Rows that repeat are documents of their own;
    of equal tickets the smaller doc_id, then the smaller size, comes first.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    rows = dense(sizes(docs, prior))
    cells = dense(rows.groupBy("source", "prior").agg(F.sum("size").alias("words")))
    targets = dense(fill_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights))
    lam = tilts(cells, targets, cap)
    plan = join_on(join_on(cells, lam, ["source"]), targets, ["source"])
    plan = plan.withColumn("rate", F.least(F.lit(cap), F.col("prior") * F.exp("lam")))
    # a hair above a whole number counts as that number, so rounding noise of the last step moves no word
    plan = plan.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
    plan = plan.withColumn("quota", F.greatest(F.lit(0), F.floor(F.col("rate") * F.col("words") + 1e-6).cast("long") - F.col("whole") * F.col("words")))
    buckets = rows.groupBy("source", "prior", "bucket").agg(F.sum("size").alias("held"))
    in_cell = Window.partitionBy("source", "prior").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("held").over(in_cell), F.lit(0)))
    cut = join_on(buckets, plan, ["source", "prior"])
    in_bucket = Window.partitionBy("source", "prior", "bucket").orderBy("ticket", "doc_id", "size")
    ranked = rows.withColumn("sofar", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    out = join_on(ranked, cut, ["source", "prior", "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("ahead") - F.col("sofar")))
    out = out.select("doc_id", "size", "source_size", "target", "rate", "whole", extra.alias("extra"))
    complete = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
        "rate",
        (F.col("whole") + complete.cast("long")).alias("copies"),
        F.when(complete, F.lit(0)).otherwise(F.col("extra")).cast("long").alias("partial"),
    )
