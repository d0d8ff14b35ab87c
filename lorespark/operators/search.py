"""Exact nearest vectors, by blocks: a block of queries meets every partition of vectors once, as a matrix product.

Only ids and distances leave a task, at most k rows for each query and collection. Nothing is copied for hot collections, as
the vectors never move: whatever partition they lie in, each gives its own k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.sources.tables import stored

#: About so many queries are broadcast at a time, some 4 MB of 64 numbers each.
BLOCK = 8192
#: Products of a task at a time, pairs whose exact distance is reckoned at a time, and rows held before they are given out.
PRODUCTS, PAIRS, HELD = 4_000_000, 100_000, 400_000
#: A product's rounding, as a share of the lengths, is far below this.
ROUNDING = 1e-12


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed from the first number to the last, so that equal pairs have equal distances."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += (q[:, i] - v[:, i]) ** 2
    return out


def runs(ordered: np.ndarray) -> np.ndarray:
    """The place of each value in its run of equal ones."""
    begun = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return np.arange(len(ordered)) - np.repeat(begun, np.diff(np.r_[begun, len(ordered)]))


def close(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of q and v that may be among the k nearest of q; v is in the order of its ids."""
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, 8 * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    rows = np.sort(order[runs(same[order]) < k])  # of equal vectors only the k first can be among them
    v, square = v[rows], (v[rows] ** 2).sum(axis=1)
    step = max(1, PRODUCTS // len(v))
    for at in range(0, len(q), step):
        own = q[at : at + step]
        size = (own**2).sum(axis=1)[:, None]
        far = size + square - 2 * (own @ v.T)
        most = np.partition(far, k - 1, axis=1)[:, k - 1 : k] + ROUNDING * (size + square.max()) if k < len(v) else np.inf
        i, j = np.nonzero(far <= most)
        for part in range(0, len(i), PAIRS):
            yield at + i[part : part + PAIRS], rows[j[part : part + PAIRS]]


class Block:
    """Queries of one length: numbers, vectors, the collections they ask and the id each leaves out."""

    def __init__(self, rows: pa.Table, by: Sequence[str]):
        self.ids = rows.column("query_id").combine_chunks()
        self.vectors = np.array(rows.column("query_vector").to_pylist(), np.float64)
        self.asked = [np.array([*rows.column(f"q_{c}").to_pylist(), None], object)[:-1] for c in by]
        left_out = rows.column("exclude").to_pylist()
        self.without = np.array([x is not None for x in left_out])
        known = [x for x in left_out if x is not None]
        self.exclude = np.array([known[0] if x is None else x for x in left_out]) if known else np.zeros(len(left_out), np.int64)

    def fits(self, name: tuple) -> np.ndarray:
        """The queries that ask a collection: each of its names is theirs, or they leave it open."""
        out = np.ones(len(self.vectors), bool)
        for asked, own in zip(self.asked, name):
            out &= (asked == own) | (asked == None)  # noqa: E711  of each element
        return np.flatnonzero(out)


def first(best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, distance, id) the k first of each query by distance, then id."""
    order = np.lexsort((best[2], best[1], best[0]))
    order = order[runs(best[0][order]) < k]
    return best[0][order], best[1][order], best[2][order]


def searched(block: Block, vectors: DataFrame, by: Sequence[str], k: int, schema: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: dict[tuple, tuple] = {}
        kinds = {}

        def given() -> Iterator[pa.RecordBatch]:
            for name, (query, distance, ids) in best.items():
                names = [pa.array([x] * len(query), kinds[c]) for c, x in zip(by, name)]
                columns = [q.ids.take(pa.array(query)), *names, pa.array(ids.tolist(), kinds["chunk_id"]), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", *by, "chunk_id", "distance"])
            best.clear()

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in (*by, "chunk_id")}
            ids = np.array(batch.column("chunk_id").to_pylist())
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            names, rows = list(zip(*(batch.column(c).to_pylist() for c in by))), {}
            for i in np.argsort(ids, kind="stable").tolist():
                rows.setdefault(names[i], []).append(i)
            for name, own in rows.items():
                fits, own = q.fits(name), np.array(own)
                if not len(fits):
                    continue
                held = best.get(name, (np.zeros(0, np.int64), np.zeros(0), ids[:0]))
                for i, j in close(q.vectors[fits], v[own], k + 1):  # one may be left out
                    i, j = fits[i], own[j]
                    there = ~(q.without[i] & (q.exclude[i] == ids[j]))
                    i, j = i[there], j[there]
                    more = (i, exact(q.vectors[i], v[j]), ids[j])
                    held = first(tuple(np.concatenate(x) for x in zip(held, more)), k)
                best[name] = held
            if sum(len(x[0]) for x in best.values()) > HELD:
                yield from given()
        yield from given()

    return vectors.mapInArrow(work, schema)


def nearest_ids(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str] = ("domain", "subject")) -> DataFrame:
    """The k nearest of each collection that a query asks: (query_id, *by, chunk_id, distance, rank).

    queries: (query_id, *by, query_vector, exclude); vectors: (*by, chunk_id, embedding). A null name asks all collections of
    the others. Ties go to the smaller chunk_id. Vectors of another length than the query's, without id, name or numbers
    are no candidates, and the vector whose id a query excludes is none of its. More queries than a block are met block by
    block; each block reads the vectors once.
    """
    asked = queries.where("query_vector is not null").select("query_id", *[F.col(c).alias(f"q_{c}") for c in by], "query_vector", "exclude")
    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *[f"{c} {kinds[c]}" for c in by], f"chunk_id {kinds['chunk_id']}", "distance double"])
    sizes = [(r["size"], r["n"]) for r in asked.groupBy(F.size("query_vector").alias("size")).agg(F.count("*").alias("n")).collect()]
    whole = vectors.select(*by, "chunk_id", "embedding").where(" and ".join(f"{c} is not null" for c in (*by, "chunk_id")))
    parts = []
    for size, n in sorted(sizes):
        mine, own = asked.where(F.size("query_vector") == size), whole.where(F.size("embedding") == size)
        blocks = -(-n // BLOCK)
        if blocks == 1:
            parts.append(searched(Block(mine.toArrow(), by), own, by, k, schema))
            continue
        dealt = stored(mine.withColumn("_block", F.pmod(F.xxhash64("query_id", *[f"q_{c}" for c in by]), F.lit(blocks)).cast("int")).repartition("_block"))
        for i in range(blocks):
            rows = dealt.where(F.col("_block") == i).drop("_block").toArrow()
            if rows.num_rows:
                parts.append(stored(searched(Block(rows, by), own, by, k, schema)))
    found = vectors.sparkSession.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    line = Window.partitionBy("query_id", *by).orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str] = ("domain", "subject")) -> DataFrame:
    """nearest_ids() with all that the vectors hold, and the query's own vector."""
    found = nearest_ids(queries, vectors, k, by)
    return found.join(vectors, [*by, "chunk_id"]).join(queries.select("query_id", "query_vector").dropDuplicates(["query_id"]), "query_id")
