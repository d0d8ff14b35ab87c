"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import broadcast_if_small, split_words, written

#: (verdict, host, path prefix), as the contract states them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: At most about so many labelled URLs train the trees.
TRAINING_URLS = 20_000
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "https", "fragment", "suffix_seen", "suffix_blocked", "host_blocked", "section_blocked"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule whose host is the host or above it and whose path starts the path; else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty string."""
    chars = F.split(text, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.when(F.length(text) > 0, F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, ...) with host, path, suffix (last label of the host), site (last two) and the features that need no training."""
    host, path = parts(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    rows = urls.withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    length = F.length(url)
    return rows.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "section": F.regexp_extract("path", "^/([^/]*)", 1),
            "site": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "length": length.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(split_words(F.col("path"), "/+")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
            "entropy": entropy(url),
            "parameters": F.regexp_count(url, F.lit("[?&][^&#]*")).cast("double"),
            "hyphens": F.regexp_count(url, F.lit("[-_]")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "https": url.startswith("https:").cast("double"),
            "fragment": url.contains("#").cast("double"),
        }
    )


#: Block rates of training URLs are counted on the other folds, so no URL sees its own label.
FOLDS = 5
RATED = {"suffix": "suffix_blocked", "site": "host_blocked", "section": "section_blocked"}


def rates(labelled: DataFrame, column: str, others: bool = False) -> DataFrame:
    """(column, seen, blocked): labelled URLs of each value, and their smoothed share of blocked ones, counted over all of them.

    With ``others`` there is a row for each value and fold, that counts the URLs of all other folds.
    """
    sums = labelled.groupBy(column, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    if others:
        whole = Window.partitionBy(column)
        sums = sums.select(column, "fold", (F.sum("n").over(whole) - F.col("n")).alias("n"), (F.sum("bad").over(whole) - F.col("bad")).alias("bad"))
    else:
        sums = sums.groupBy(column).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return sums.withColumns({"seen": F.log1p("n"), "blocked": (F.col("bad") + 1) / (F.col("n") + 2)}).drop("n", "bad")


def with_rates(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with suffix_seen, suffix_blocked, host_blocked and section_blocked; values that no labelled URL has are neutral."""
    for column, name in RATED.items():
        table = tables[column].withColumnsRenamed({"seen": "suffix_seen", "blocked": name})
        table = table if column == "suffix" else table.drop("suffix_seen")
        rows = rows.join(broadcast_if_small(table), [c for c in (column, "fold") if c in table.columns], "left")
    return rows.fillna({"suffix_seen": 0.0} | dict.fromkeys(RATED.values(), 0.5))


def train(labelled: DataFrame, most: int = TRAINING_URLS, trees: int = 12, depth: int = 4, seed: int = 7) -> tuple[GBTClassificationModel | None, dict[str, DataFrame]]:
    """Trees, and block rates of suffixes, sites and first path sections, from labelled lexical rows (label 1.0: block).

    The rates count every labelled row; the trees see a hash sample of about ``most`` rows, with rates of the other folds.
    Without both labels the model is None.
    """
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(FOLDS)))
    tables = {c: written(rates(labelled, c)) for c in RATED}
    total, bad = labelled.agg(F.count("*"), F.sum("label")).first()
    if not total or not 0 < bad < total:
        return None, tables
    keep = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / total))
    sample = with_rates(labelled.where(keep), {c: written(rates(labelled, c, others=True)) for c in RATED}).select("label", *FEATURES)
    sample = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(written(sample).repartition(4))
    if sample.select("label").distinct().count() < 2:
        return None, tables
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, subsamplingRate=0.8, seed=seed, maxMemoryInMB=256)
    return gbt.fit(sample.select("label", "features")), tables


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, most: int = TRAINING_URLS) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, block_score.

    labelled: (url, label 1.0 block or 0.0 allow). Without it, the URLs that rules decide are the labelled ones, so the trees
    carry the rules' judgement over to URLs that look alike. block_score is the trees' probability; null where there are none,
    and then what no rule decides is allowed. Null or malformed URLs have an empty host and path and are judged like others;
    repeated rows have a row each, with equal results. URLs of any length are read whole; an empty table gives no rows; other
    columns, whatever their names, are left out.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = lexical(urls).withColumn("by_rule", ruled(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.where("by_rule is not null").withColumn("label", (F.col("by_rule.verdict") == "block").cast("double"))
    else:
        known = lexical(labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label"))).where("label is not null")
    model, tables = train(known, most)
    scored = with_rates(rows, tables)
    if model is None:
        scored = scored.withColumn("block_score", F.lit(None).cast("double"))
    else:
        scored = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scored)
        scored = model.transform(scored).withColumn("block_score", vector_to_array("probability")[1])
    method = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), method).alias("verdict"), "block_score"
    )
