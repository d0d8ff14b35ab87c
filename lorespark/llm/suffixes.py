"""Exact substring deduplication with a distributed, sampled suffix array over bytes.

A byte goes if a string of LENGTH bytes over it also starts earlier. All suffixes of all texts would be a hundred times the
input, so a sieve first finds the suffixes that can repeat, and loses none: of the 32-byte strings in a window of LENGTH
bytes the one with the least hash is its anchor, equal windows have equal anchors, and neighbouring windows share one. An
anchor and the bytes of its windows are two hashes. Sorted by them,

* an anchor whose windows equal those of an earlier anchor is repeated as a whole,
* an anchor met with different bytes around it, where a repeat may begin or end, has its suffixes examined,
* an anchor met once, or always with the same bytes, has no more to tell.

The stretches to examine take their bytes along through a finer sieve of the same kind: each holds at most 18 windows that share
83 bytes, and is compared byte by byte. What is left at the edges of repeats is cut into suffixes. These are range-partitioned by
their leading bytes at sampled splitters, sorted in each partition by multikey quicksort, and compared byte by byte with their
neighbours, across partitions too. Documents never share a window.

Only in the first sieve do hashes stand for bytes: two different stretches are taken for one if both their hashes agree, a chance
of 2 ** -128 for unrelated ones and of 2 ** -64 for each pair around one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.llm.arrow import numbers, values
from lorespark.llm.common import broadcast_if_small, join_on, written
from lorespark.llm.repeats import PLACE, differs, placed

LENGTH, MER = 100, 32
#: Of the LENGTH - MER bytes beside an anchor, a window has three quarters in steps of STEP to its left or right.
STEP = 17
#: Texts are hashed together up to so many bytes at a time; longer ones in overlapping pieces. Positions fit 24 bits.
PIECE = 1 << 21
LOW = np.uint64((1 << 24) - 1)

_RNG = np.random.default_rng(5)
TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _doubled(h: np.ndarray, step: int, factor: np.uint64) -> np.ndarray:
    out = h[:-step] * factor
    out += h[step:]
    out ^= out >> np.uint64(29)
    out *= ODD[0]
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, ends: np.ndarray, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each anchor's hash, the hash of its windows' bytes, first window, windows less one, place.

    Fewer bits make anchors meet that differ: more is examined, and nothing else changes.
    """
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if len(data) < LENGTH:
        return none
    h, at = TABLE[data], 1
    while at < MER:
        h, at = _doubled(h, at, ODD[at.bit_length()]), at * 2
    wide = _doubled(h, MER, ODD[8])  # 64 bytes each
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    width, held = LENGTH - MER + 1, 1
    while held * 2 <= width:
        least, held = np.minimum(least[:-held], least[held:]), held * 2
    n = len(data) - LENGTH + 1
    least = np.minimum(least[:n], least[width - held : width - held + n])
    whole = np.ones(n, bool)  # windows that lie in one text
    for e in ends[:-1].tolist():
        whole[max(0, e - LENGTH + 1) : e] = False
    windows = np.flatnonzero(whole)
    if not len(windows):
        return none
    spot = (least[windows] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    spot, size = spot[new], last - first + LENGTH
    around = wide[first] * ODD[9] + wide[first + (size - 2 * MER) // 2] * ODD[10] + wide[first + size - 2 * MER] * ODD[11]
    around += size.astype(np.uint64) * ODD[12] + (spot - first).astype(np.uint64) * ODD[13]
    around ^= around >> np.uint64(31)
    return h[spot] >> np.uint64(64 - bits), around, first, last - first, spot - first


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, ends in them, row of each text, and its offset in the whole text."""
    parts, rows, offsets, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"".join(parts), np.uint8)
        return data, np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)

    for row, text in enumerate(values(batch.column("text"))):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > 2 * PIECE:
                yield flush()
                parts, rows, offsets, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
    if parts:
        yield flush()


def sieve(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Of placed documents (kind, did, key, start, length): kind 0 are repeated stretches, kind 1 stretches to be examined; written.

    length is that of the bytes plus 256 times the place of the anchor in them.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, key = numbers(batch.column("did")), numbers(batch.column("key"))
            for data, ends, rows, offsets in _pieces(batch):
                h, g, first, more, spot = anchors(data, ends, bits)
                text = np.searchsorted(ends, first, side="right")
                start = first - np.concatenate([[0], ends[:-1]])[text] + offsets[text]
                row = rows[text]
                columns = [h.view(np.int64), g.view(np.int64), did[row], key[row], start, (more + LENGTH + 256 * spot).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "g", "did", "key", "start", "length"])

    rows = docs.select("did", "key", "text").mapInArrow(found, "h long, g long, did long, key long, start long, length int")
    return sifted(rows)


def sifted(rows: DataFrame, g: str = "g") -> DataFrame:
    """(kind, did, key, start, length, ...) of rows (h, g, did, key, start, length, ...): kind 0 repeats an earlier row of its
    h and g, kind 1 is the first of its g where h has another g too, or may have in another partition; written.

    g may be bytes; such a column stays."""
    extra = [c for c in rows.columns if c not in ("h", "g", *PLACE, "length")]
    order = ["h", g, *PLACE]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["kind", *PLACE, "length", *extra]
    schema = "kind int, did long, key long, start long, length int" + "".join(f", {c} {dict(rows.dtypes)[c]}" for c in extra)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first of a run of equal (h, g) waits until the next such first is known; runs at the partition's ends are examined
        last = waiting = None
        shared = False

        def out(batch: pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *[batch.column(c) for c in names[1:]]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            begin = last is None
            whole = pa.Table.from_batches([batch] if begin else [last, batch]).combine_chunks().to_batches()[0]
            new_h = differs(whole.column("h"))
            new_g = new_h | differs(whole.column(g))
            moved = np.logical_or.reduce([differs(whole.column(c)) for c in PLACE])
            if not begin:
                new_h[0] = new_g[0] = False
            again = np.flatnonzero(~new_g & moved)
            again = again[again > 0] if not begin else again
            if len(again):
                yield out(whole.take(pa.array(again)), np.zeros(len(again)))
            firsts = np.flatnonzero(new_g)
            if len(firsts):
                beside = ~new_h[firsts]  # shares its anchor with the first before it
                if waiting is not None and (shared or beside[0]):
                    yield out(waiting, np.ones(1))
                examine = beside.copy()
                examine[:-1] |= beside[1:]
                if begin:
                    examine[0] = True
                early = firsts[:-1][examine[:-1]]
                if len(early):
                    yield out(whole.take(pa.array(early)), np.ones(len(early)))
                waiting, shared = whole.take(pa.array(firsts[-1:])), bool(examine[-1])
            last = whole.slice(whole.num_rows - 1, 1)
        if waiting is not None:
            yield out(waiting, np.ones(1))

    return written(rows.mapInArrow(scan, schema))


def examined(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """Repeated stretches among the windows of those to examine: (did, key, start, length)."""
    by_doc = written(stretches.groupBy("did", "key").agg(F.collect_list(F.struct("start", "length")).alias("at")))
    texts = join_on(docs, by_doc, ["did", "key"]).select("did", "key", "text", "at")
    digest = xxhash.xxh3_64_intdigest

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", *PLACE, "length", "body"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            h, d, k, s, n, body = zip(*rows)
            columns = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=names)

        for batch in batches:
            ids = zip(numbers(batch.column("did")).tolist(), numbers(batch.column("key")).tolist())
            lists, rows = batch.column("at"), []
            for i, ((d, k), text) in enumerate(zip(ids, values(batch.column("text")))):
                own = lists[i].values
                for first, code in zip(numbers(own.field("start")).tolist(), numbers(own.field("length")).tolist()):
                    more, x = code % 256 - LENGTH, first + code // 256
                    for q in range(4):
                        low = max(first, x - (STEP * q + STEP - 1 if q < 3 else LENGTH - MER))
                        high = min(first + more, x - STEP * q)
                        if low <= high:
                            body = text[low : high + LENGTH]
                            core = text[x - STEP * q : x + MER + STEP * (3 - q)]
                            rows.append((digest(core, q), d, k, low, len(body), body))
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    fine = sifted(texts.mapInArrow(parts, "h long, did long, key long, start long, length int, body binary"), "body")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = numbers(batch.column("start"))
            bodies = list(values(batch.column("body")))
            many = np.array([len(b) - LENGTH + 1 for b in bodies], np.int64)
            row = np.repeat(np.arange(len(bodies)), many)
            if not len(row):
                continue
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            suffix = pa.array([b[p : p + LENGTH] for b, n in zip(bodies, many.tolist()) for p in range(n)], pa.binary())
            places = [numbers(batch.column("did"))[row], numbers(batch.column("key"))[row], start[row] + at]
            yield pa.RecordBatch.from_arrays([suffix, *[pa.array(x) for x in places]], names=["suffix", *PLACE])

    rows = fine.where("kind = 1").select(*PLACE, "body").mapInArrow(suffixes, "suffix binary, did long, key long, start long")
    return fine.where("kind = 0").select(*PLACE, "length").union(repeated_suffixes(rows))


def multikey_quicksort(suffixes: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes (rows of bytes) in order, equal ones in that of places; same tells which equal the one before.

    Sorted by their first eight bytes; what ties there, and no other, is sorted by the next eight, and so on.
    """
    n, width = suffixes.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = suffixes
    words = words.view(">u8").astype(np.uint64)
    order, tied = np.arange(n), np.ones(n, bool)  # tied with the one before, so far
    tied[:1] = False
    for w in range(words.shape[1] + 1):
        open_ = np.flatnonzero(tied | np.append(tied[1:], False)[:n])
        if not len(open_):
            break
        rows, group = order[open_], np.cumsum(~tied[open_])
        last = w == words.shape[1]
        keys = places[::-1] if last else [words[:, w]]
        order[open_] = rows = rows[np.lexsort([*[k[rows] for k in keys], group])]
        if not last:
            tied[open_[1:]] = (np.diff(group) == 0) & (words[rows[1:], w] == words[rows[:-1], w])
            tied[open_[0]] = False
    return order, tied


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """(did, key, start, length) of every one of rows (suffix, did, key, start) whose bytes are those of an earlier one.

    A task holds its range of suffixes; places are part of the splitters, so equal suffixes are dealt to many ranges.
    """
    order = ["suffix", *PLACE]
    names, schema = ["kind", "part", *order], "kind int, part int, suffix binary, did long, key long, start long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        places = [numbers(whole.column(c).combine_chunks()) for c in PLACE]
        suffixes = np.concatenate([np.frombuffer(b"".join(values(b.column("suffix"))), np.uint8).reshape(-1, LENGTH) for b in held])
        at, same = multikey_quicksort(suffixes, places)
        moved = np.zeros(len(at), bool)
        moved[1:] = np.logical_or.reduce([p[at[1:]] != p[at[:-1]] for p in places])
        again = at[same & moved]
        rows, kinds = np.concatenate([[at[0]], again, [at[-1]]]), np.concatenate([[1], np.zeros(len(again), int), [2]])
        part = np.full(len(rows), TaskContext.get().partitionId())
        out = [pa.array(kinds.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array([suffixes[i].tobytes() for i in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([*out, *[pa.array(p[rows]) for p in places]], names=names)

    found = written(rows.repartitionByRange(*order).mapInArrow(scan, schema))
    # two rows a partition: their order needs no more than one task
    before = Window.partitionBy(F.lit(0)).orderBy("part", "kind")
    ends = found.where("kind > 0").select("*", *[F.lag(c).over(before).alias(f"last_{c}") for c in order])
    moved = reduce(or_, [F.col(c) != F.col(f"last_{c}") for c in PLACE])
    crossed = ends.where((F.col("kind") == 1) & (F.col("suffix") == F.col("last_suffix")) & moved)
    return found.where("kind = 0").select(*PLACE, F.lit(LENGTH).alias("length")).union(crossed.select(*PLACE, F.lit(LENGTH).alias("length")))


def repeated_stretches(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(did, key, spans array<struct<start, end>>): the bytes to remove of every document that has any, merged and in order."""
    found = sieve(docs, bits)
    rows = found.where("kind = 0").select(*PLACE, (F.col("length") % 256).cast("int").alias("length")).union(examined(docs, found.where("kind = 1")))
    lists = rows.groupBy("did", "key").agg(F.collect_list(F.struct("start", "length")).alias("at"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("at"):
                begin, length = numbers(own.values.field("start")), numbers(own.values.field("length"))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate((begin + length)[order])
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                out.append(np.stack([begin[new], end[np.append(new[1:], len(begin)) - 1]], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("key"), pa.array(out, pa.list_(pa.int64()))], names=["did", "key", "spans"])

    return written(lists.mapInArrow(merged, "did long, key long, spans array<long>"))


def deduplicate(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A null text is empty. Rows equal in doc_id and text are one document and none repeats another; rows of one doc_id with
    different texts follow one another in the order of the texts' hashes; a null doc_id comes before all others.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    docs = placed(docs)
    spans = broadcast_if_small(repeated_stretches(docs, bits))
    rows = join_on(docs, spans, ["did", "key"], "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("spans"), []
            for i, text in enumerate(values(batch.column("text"))):
                own = numbers(lists[i].values).tolist() if lists[i].is_valid else []
                kept, at = [], 0
                for a, b in zip(own[::2], own[1::2]):
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(own) // 2, hashlib.sha256(kept).hexdigest(), kept))
            sizes = [pa.array(c, pa.int64()) for c in zip(*(x[:3] for x in out))]
            rest = [pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, *rest], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
