"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = logistic(w x - theta_k): one weight vector for all thresholds, and thresholds that rise. Features are the
presence of terms, as many as the labelled texts tie to toxicity. Grades come from the labels alone. A bounded sample of labelled
documents trains the model; every text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrow import values
from lorespark.llm.common import broadcast_if_small, dense, documents, without

#: At most about so many labelled documents train the model, with as many terms as they bear out.
TRAINING_DOCS = 20_000
#: Terms are taken as long as chance would explain at most this share of them; below the score FLOOR none is.
CHANCE, FLOOR = 0.1, 3.0
#: A text with a chance above this of any grade over 0 is rejected.
REJECT = 0.6
#: Bytes of a word's beginnings that are features of their own.
BEGINNINGS = (4, 5, 6)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> set[bytes]:
    """Words, and their beginnings marked by a star: inflected languages hide a stem in many words."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + b"*" for w in words for k in BEGINNINGS if len(w) > k}


def severity(labels: DataFrame) -> Column:
    """The grade column where there is one; a bare 0/1 mark gives two grades, and so a single threshold."""
    return F.col("grade" if "grade" in labels.columns else "toxic").cast("int")


def training_texts(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, text, grade) of a hash sample of the labelled documents. Written.

    Labels without an id or a grade are passed over; of several for one id the gravest counts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), severity(labels).alias("grade"))
    marks = marks.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    share = min(1.0, most / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return dense(documents(docs).select("doc_id", "text").join(broadcast_if_small(marks), "doc_id"))


def choose_terms(sample: DataFrame) -> list[bytes]:
    """All terms that more toxic training texts hold than chance explains, the surest first; their number is bounded by the sample's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for text, toxic in zip(values(batch.column("text")), batch.column("grade").to_pylist()):
                for w in terms_of(text):
                    found.setdefault(w, [0, 0])[1 if toxic else 0] += 1
            if found:
                clean, bad = zip(*found.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], names=["term", "clean", "bad"])

    held = sample.select("text", "grade").mapInArrow(count, "term binary, clean long, bad long")
    held = held.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    # root of the likelihood ratio statistic
    x, y = F.col("bad").cast("double"), F.col("clean").cast("double")
    good, all_ = n - bad, max(1, n)

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = sum(
        (part(k, side * share / all_) for k, side, share in ((x, x + y, bad), (y, x + y, good), (bad - x, all_ - x - y, bad), (good - y, all_ - x - y, good))),
        F.lit(0.0),
    )
    tied = F.when(x * good > y * bad, F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))).otherwise(0.0)
    held = dense(held.withColumn("z", tied))
    if not 0 < bad < n:
        return []
    # only terms in enough texts can reach the floor; the others are no trials of chance
    trials = held.where(F.col("bad") + F.col("clean") >= FLOOR**2 / (2 * math.log(n / bad))).count()
    found = held.where(F.col("z") >= FLOOR).orderBy(F.desc("z"), "term").select("term", "z").collect()
    most = max((k for k, r in enumerate(found, 1) if trials * math.exp(-r["z"] ** 2 / 2) <= CHANCE * k), default=0)
    return [bytes(r["term"]) for r in found[:most]]


def fit(rows: list[tuple[list[int], int]], features: int, steps: int = 400, l2: float = 3e-4, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of greatest penalised likelihood of grades 0..K, by full-batch Adam.

    Thresholds are the first and exponentials of the gaps, so they rise. l2 weighs the squared weights against the mean loss.
    """
    at = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows]).astype(np.int64)
    term = np.array([t for x, _ in rows for t in x], np.int64)
    grade = np.array([y for _, y in rows], np.int64)
    cuts = max(1, int(grade.max(initial=0)))
    p = np.zeros(features + cuts)
    p[features] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = max(1, len(rows))
    for step in range(1, steps + 1):
        w, gaps = p[:features], np.exp(p[features + 1 :])
        theta = p[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[term], len(rows))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))  # P(grade > k)
        full = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        here = np.arange(len(rows))
        chance = np.maximum(full[here, grade] - full[here, grade + 1], 1e-12)
        slope = full * (1 - full)
        d_score = -(slope[here, grade] - slope[here, grade + 1]) / chance
        d_theta = np.zeros(cuts)
        np.add.at(d_theta, np.minimum(grade, cuts - 1), np.where(grade < cuts, -slope[here, grade + 1] / chance, 0.0))
        np.add.at(d_theta, np.maximum(grade - 1, 0), np.where(grade > 0, slope[here, grade] / chance, 0.0))
        g = np.concatenate([np.bincount(term, d_score[at], features) / n + l2 * w, [d_theta.sum() / n], np.cumsum(d_theta[::-1])[::-1][1:] * gaps / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:features], p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> tuple[dict[bytes, float], np.ndarray]:
    """(weight of each term, thresholds). Without toxic labels there are no terms, and the first threshold keeps all."""
    sample = training_texts(docs, labels, most)
    terms = choose_terms(sample)
    if not terms:
        return {}, np.array([10.0])
    place = {t: i for i, t in enumerate(terms)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[place[w] for w in terms_of(t) if w in place] for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), batch.column("grade")], names=["terms", "grade"])

    rows = sample.select("text", "grade").mapInArrow(features, "terms array<int>, grade int").collect()  # bounded sample
    w, theta = fit(sorted((sorted(r["terms"]), r["grade"]) for r in rows), len(terms))
    return {t: float(w[i]) for t, i in place.items()}, theta


def grade(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> DataFrame:
    """One row for each document: doc_id, key, expected_severity, p_toxic, grade, rejected.

    expected_severity sums the chances of exceeding each threshold; grade is the likeliest. Null and empty texts have no term, and
    the grade of such texts. Repeated rows have a row each, with equal results.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    weights, theta = train(docs, labels, most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([sum(weights[w] for w in sorted(terms_of(t) & weights.keys())) for t in values(batch.column("text"))])
            above = 1 / (1 + np.exp(-np.clip(score.reshape(-1, 1) - theta[None, :], -40, 40)))
            full = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
            likeliest = np.argmax(full[:, :-1] - full[:, 1:], axis=1) if len(score) else np.zeros(0)
            columns = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(likeliest.astype(np.int32)), pa.array(above[:, 0] > REJECT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=["doc_id", "key", "expected_severity", "p_toxic", "grade", "rejected"])

    return documents(docs).mapInArrow(each, "doc_id long, key long, expected_severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that grade() rejects; all columns stay."""
    return without(docs, dense(grade(docs, labels).where("rejected").select("doc_id", "key")))
