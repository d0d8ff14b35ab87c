"""All but the first occurrence of every value, by one range-partitioned sort and a comparison across partition boundaries.

Rows are (value columns, did, key, start, length): a stretch of a document. Spark samples splitters and deals the rows to
ranges of value and place, so a value with very many rows is spread over tasks like any other. Each task compares neighbours
while it streams through its sorted rows; the first row of a partition is compared with the last row of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.common import documents, written

PLACE = ["did", "key", "start"]
NO_ID = -(2**63)


def differs(column: pa.Array) -> np.ndarray:
    """True where a value is not the one before it; the first is True."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def placed(docs: DataFrame) -> DataFrame:
    """documents() with did: doc_id, a null one before all others. key is 0 for all where no doc_id repeats: it costs nothing then."""
    rows = documents(docs).withColumn("did", F.coalesce("doc_id", F.lit(NO_ID)))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("key", F.lit(0).cast("long"))
    return rows


def repeated(rows: DataFrame, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(did, key, start, length) of every occurrence but the first, in the order of did, key, start; written.

    Equal rows are one occurrence.
    """
    order = [*values, *PLACE]
    rows = rows.select(*order, "length").repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["kind", "part", *order, "length"]
    schema = "kind int, part int, " + ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names[2:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def out(batch: pa.RecordBatch, what: int) -> pa.RecordBatch:
            n = batch.num_rows
            flags = [pa.array(np.full(n, x, np.int32)) for x in (what, part)]
            return pa.RecordBatch.from_arrays([*flags, *[batch.column(c) for c in names[2:]]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield out(batch.slice(0, 1), 1)
            whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            same = ~np.logical_or.reduce([differs(whole.column(c)) for c in values])
            moved = np.logical_or.reduce([differs(whole.column(c)) for c in PLACE])
            hit = np.flatnonzero(same & moved)  # never row 0
            if len(hit):
                yield out(whole.take(pa.array(hit)), 0)
            last = whole.slice(whole.num_rows - 1, 1)
        if last is not None:
            yield out(last, 2)

    found = written(rows.mapInArrow(scan, schema))
    # two rows a partition: their order needs no more than one task
    ends = found.where("kind > 0")
    before = Window.partitionBy(F.lit(0)).orderBy("part", "kind")
    held = [F.lag(c).over(before).alias(f"last_{c}") for c in order]
    same = reduce(and_, [F.col(c) == F.col(f"last_{c}") for c in values])
    moved = reduce(or_, [F.col(c) != F.col(f"last_{c}") for c in PLACE])
    crossed = ends.select("*", *held).where((F.col("kind") == 1) & same & moved)
    return found.where("kind = 0").select(*PLACE, "length").union(crossed.select(*PLACE, "length"))
