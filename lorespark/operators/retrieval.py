"""Exact vector search by collection, diverse selection, routing and context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FETCH, MMR_K, SEARCH_K, CONTEXT_K, LAMBDA = 15, 3, 5, 5, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def in_collections(vectors: DataFrame, domains: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
    """The collections of the lists; none or an empty list stands for all."""
    if domains:
        vectors = vectors.where(F.col("domain").isin(domains))
    return vectors.where(F.col("subject").isin(subjects)) if subjects else vectors


def existing_routes(vectors: DataFrame, mode: str = "existing") -> DataFrame:
    """Valid (domain, subject): the pairs that exist, every domain with every subject, or both sorted lists side by side."""
    pairs = vectors.where("domain is not null and subject is not null").select("domain", "subject").distinct()
    if mode == "existing":
        return pairs
    if mode == "cartesian":  # of the names of collections, which are few
        return pairs.select("domain").distinct().crossJoin(pairs.select("subject").distinct())
    if mode == "zip":
        lists = pairs.agg(F.array_sort(F.collect_set("domain")).alias("domain"), F.array_sort(F.collect_set("subject")).alias("subject"))
        return lists.select(F.inline(F.arrays_zip("domain", "subject"))).where("domain is not null and subject is not null")
    raise ValueError(f"no mode {mode}")


def route(subqueries: DataFrame, routes: DataFrame) -> DataFrame:
    """Subqueries whose domain and subject, neither null nor empty, are a valid route."""
    named = subqueries.where("domain <> '' and subject <> ''")
    return named.join(routes, ["domain", "subject"], "left_semi")


def first_routes(routed: DataFrame) -> DataFrame:
    """Of (note_id, domain, subject, query_pos, sub_pos, ...) the first subquery for each note and collection."""
    line = Window.partitionBy("note_id", "domain", "subject").orderBy("query_pos", "sub_pos")
    return routed.withColumn("_at", F.row_number().over(line)).where("_at = 1").drop("_at")


def diverse(candidates: DataFrame, k: int = MMR_K, lam: float = LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance of the few candidates of each query and collection.

    The most similar is taken first, then whatever has the greatest lam * similarity to the query less (1 - lam) * greatest
    similarity to those taken; ties go to the nearer. Adds ``picked``, the order of taking.
    """
    columns = ["query_id", "domain", "subject", "chunk_id", "distance", "rank"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "chunk_id"])
        d = np.array(pdf["embedding"].tolist(), np.float64)
        q = np.array(pdf["query_vector"].iloc[0], np.float64)

        def unit(x):
            n = np.linalg.norm(x, axis=-1, keepdims=True)
            return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

        d, q = unit(d), unit(q)
        near, between = d @ q, d @ d.T
        taken = [int(np.argmax(near.round(9)))]  # rounded, so equal vectors tie however the products were summed
        while len(taken) < min(k, len(pdf)):
            value = (lam * near - (1 - lam) * between[:, taken].max(axis=1)).round(9)
            value[taken] = -np.inf
            taken.append(int(np.argmax(value)))
        out = pdf.iloc[taken][columns].copy()
        out["picked"] = np.arange(1, len(taken) + 1, dtype=np.int32)
        return out

    schema = ", ".join(f"{c} {dict(candidates.dtypes)[c]}" for c in columns) + ", picked int"
    return candidates.groupBy("query_id", "domain", "subject").applyInPandas(pick, schema)


def first_by_content(results: DataFrame, query: str, order: list[Column | str]) -> DataFrame:
    """Of equal contents of one query the first."""
    line = Window.partitionBy(query, F.sha2("content", 256)).orderBy(*order)
    return results.withColumn("_at", F.row_number().over(line)).where("_at = 1").drop("_at")


def context(results: DataFrame, query: str, order: list[Column | str], k: int = CONTEXT_K) -> DataFrame:
    """(query, context, chunks): the first k different contents of each query in order, with empty lines between."""
    rows = first_by_content(results, query, order)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("_at") <= k)
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_at", "content"))).alias("xs"))
    return lists.select(query, F.array_join(F.col("xs.content"), "\n\n").alias("context"), F.size("xs").alias("chunks"))


def by_fingerprint(vectors: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Chunks of the files of the fingerprints, in all collections."""
    return vectors.join(fingerprints.select("file_fingerprint").distinct(), "file_fingerprint", "left_semi")


def embed(texts: DataFrame, column: str, embed_fn, out: str = "embedding") -> DataFrame:
    """texts with vectors of embed_fn (Series of strings to Series of float lists), the plug for a model, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return embed_fn(batch.fillna(""))

    return texts.withColumn(out, vectors(column))


def hashing_embedder(size: int = 64):
    """A deterministic stand-in for a model: signed word hashes, normalised; texts without words are zero."""
    import zlib

    def embed_fn(batch: pd.Series) -> pd.Series:
        def one(text: str) -> list[float]:
            v = np.zeros(size)
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x80000000 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return batch.map(one)

    return embed_fn
