"""SimHash fingerprints and near duplicates, compared bit by bit for many fingerprints at once.

Fingerprints within the radius agree on some three of six blocks of bits, so every three blocks make a key and only
fingerprints of one key are compared. A key's fingerprints are stored as bit planes: word w of plane b holds bit b of 64
fingerprints. Distances are counted for all of them at a time by carry-save adders on whole words, and queries whose
counters have all passed the radius are given up. Keys with very many fingerprints are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrow import numbers, runs, values
from lorespark.llm.common import broadcast_if_small, dense, documents, join_on, join_unique, unused, without
from lorespark.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of the six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one key that a task compares at a time; larger keys are dealt out in pairs of blocks of half as many.
BLOCK_ROWS = 4096
#: Shingles of one key that a task holds at a time; keys with more are dealt out in pairs of blocks of half as many.
BLOCK_SHINGLES = 1 << 21
#: Near duplicates of texts: five words, similarity 0.8; candidates share one of BANDS keys of BAND_ROWS minima.
TEXT_SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 14, 4
#: Bits in which texts as similar as that may differ: about 9.7 on average, with a deviation of 2.9.
TEXT_RADIUS = 22
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Space-joined runs of words (A-Z lower-cased, between ASCII white space); fewer words: all of them; none: nothing."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]


def hashes(text: bytes, size: int) -> np.ndarray:
    found = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found))


def simhash(h: np.ndarray) -> int:
    """Each bit 1 if it is set in over half of the hashes; 0 for none."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # 4 MB of bits at a time
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of word w of row b is bit b of fingerprint 64 * w + i."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((-(-len(fps) // 64) * 64, 64), np.uint8)
    wide[: len(fps)] = bits
    return np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little").view(np.uint64)


def near(plane: np.ndarray, n: int, queries: np.ndarray, radius: int) -> np.ndarray:
    """Booleans [query, fingerprint]: at most radius bits differ."""
    words = plane.shape[1]
    places = max(1, radius.bit_length())
    bias = (1 << places) - 1 - radius  # counters start here, so they pass their last place beyond the radius
    out = np.zeros((len(queries), n), bool)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        live = np.arange(len(q))
        count = [np.full((len(q), words), ALL if bias >> i & 1 else 0, np.uint64) for i in range(places)]
        over = np.zeros((len(q), words), np.uint64)
        for b in range(64):
            carry = plane[b][None, :] ^ np.where(q >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))[:, None]
            for c in count:
                c ^= carry
                carry &= ~c  # what was 1 and met a 1
            over |= carry
            if b % 8 == 7 and b > radius:
                open_ = (over != ALL).any(axis=1)
                if not open_.all():
                    q, live, over, count = q[open_], live[open_], over[open_], [c[open_] for c in count]
                    if not len(q):
                        break
        if len(q):
            hit = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")[:, :n]
            out[at + live] = hit.astype(bool)
    return out


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of different fingerprints the index of the first one of its group; groups are closed over links."""
    plane, group = planes(fps), np.full(len(fps), -1)
    for first in range(len(fps)):
        if group[first] >= 0:
            continue
        group[first] = first
        front = np.array([first])
        while len(front):  # each fingerprint asks once
            reached = np.zeros(len(fps), bool)
            for at in range(0, len(front), 1024):
                reached |= near(plane, len(fps), fps[front[at : at + 1024]], radius).any(axis=0)
            front = np.flatnonzero(reached & (group < 0))
            group[front] = first
    return group


def around(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the pivot that it lies around; pivots are taken in order among those left."""
    plane, pivot = planes(fps), np.full(len(fps), -1)
    for first in range(len(fps)):
        if pivot[first] < 0:
            pivot[near(plane, len(fps), fps[first : first + 1], radius)[0] & (pivot < 0)] = first
    return pivot


def block_keys(fp: Column) -> Column:
    """One struct(part, code) for every three of the six blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    masks = [((1 << n) - 1) << s for n, s in zip(BLOCKS, starts)]
    keys = []
    for part, three in enumerate(combinations(range(len(BLOCKS)), 3)):
        mask = sum(masks[i] for i in three)
        keys.append(F.struct(F.lit(part).alias("part"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("code")))
    return F.array(*keys)


#: A key, and the two blocks of it that meet in a task.
KEYS = ["part", "code", "i", "j"]


def dealt_out(rows: DataFrame, load: Column) -> DataFrame:
    """rows (part, code, node, ...) with i and j, sorted by key within partitions; load is what a key weighs, 1 fits a task.

    Heavier keys have their rows hashed to blocks of weight a half, and every two blocks meet in a task.
    """
    large = dense(rows.groupBy("part", "code").agg(load.alias("load")).where(F.col("load") > 1))
    columns = rows.columns
    rows = join_on(rows, broadcast_if_small(large), ["part", "code"], "left")
    blocks = F.ceil(F.col("load") * 2).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    pairs = F.transform(other, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    pairs = F.when(F.col("load").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)
    return rows.select(*columns, F.inline(pairs)).repartition(*KEYS).sortWithinPartitions(*KEYS, "node")


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First and last row (excluded) of every run of equal KEYS."""
    columns = [numbers(batch.column(k)) for k in KEYS]
    new = np.ones(batch.num_rows + 1, bool)
    new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new).tolist()
    return zip(starts[:-1], starts[1:])


def compare_by_key(rows: DataFrame, group: Callable[[np.ndarray, int], np.ndarray], radius: int, rows_at_once: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links found among rows (part, code, node, fp) that share part and code; group gives each row's first.

    A key with more rows than rows_at_once is dealt out: its rows are hashed to blocks, and every two blocks meet in a task.
    """
    dealt = dealt_out(rows, F.count("*") / rows_at_once)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, KEYS):
            node, fp = numbers(batch.column("node")), numbers(batch.column("fp")).view(np.uint64)
            found_u, found_v = [], []
            for a, b in stretches(batch):
                if b - a > 1:
                    first = group(fp[a:b], radius)
                    child = np.flatnonzero(first != np.arange(b - a))
                    found_u.append(node[a:b][child])
                    found_v.append(node[a:b][first[child]])
            if found_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_u)), pa.array(np.concatenate(found_v))], names=["u", "v"])

    return dealt.mapInArrow(links, "u long, v long").distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text; null texts are empty and have fingerprint 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(hashes(t, shingle)) for t in values(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs).select("doc_id", "text").mapInArrow(each, "doc_id long, fp long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id (the smallest doc_id that links reach from it).

    Equal fingerprints are one node, compared once. Null ids count for nothing; a component of null ids has a null id.
    The keys find every pair of at most 3 differing bits, so radius is at most 3.
    Null and empty texts have the fingerprint zero. Repeated rows have a row each.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    if not 0 <= radius <= 3:
        raise ValueError("block keys find radii up to 3")
    rows = dense(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keyed = dense(nodes.select(F.col("fp").alias("node"), "fp", F.inline(block_keys(F.col("fp")))))
    found = components(compare_by_key(keyed, linked, radius)).withColumnRenamed("node", "fp")
    # only linked fingerprints have a component beside themselves
    roots = found.select("fp", "root").union(found.select(F.col("root").alias("fp"), "root")).distinct()
    roots = dense(join_unique(nodes, roots, "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked_to = dense(join_unique(roots.select("fp", "root"), dense(least), "root").select("fp", "component_id"))
    alone = nodes.join(linked_to.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = dense(linked_to.unionByName(alone))
    return join_unique(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, node, fp, codes): node hashes the sequence of shingles, codes has one number for each band."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fps, codes = [], [], []
            for text in values(batch.column("text")):
                h = np.unique(hashes(text, shingle))  # of a set, as similarity is
                node.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split())))
                fps.append(simhash(h))
                if len(h):
                    low = np.array([(h * f + a).min() for f, a in zip(factors, adds)]).reshape(bands, rows)
                    codes.append([xxhash.xxh64_intdigest(x.tobytes()) for x in low])
                else:
                    codes.append([])
            wide = pa.array([np.array(c, np.uint64).view(np.int64) for c in codes], pa.list_(pa.int64()))
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *both, wide], names=["doc_id", "key", "node", "fp", "codes"])

    return documents(docs).mapInArrow(each, "doc_id long, key long, node long, fp long, codes array<long>")


def unsettled(part: int, fps: np.ndarray, root: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, booleans [row, other row]): candidates of different groups that share no earlier part, where they were met."""
    plane = planes(fps)
    for at in range(0, len(fps), 256):
        mine = slice(at, at + 256)
        open_ = near(plane, len(fps), fps[mine], TEXT_RADIUS) & (root[mine, None] != root)
        for p in range(part):
            open_ &= codes[mine, p, None] != codes[:, p]
        yield at, open_


def untried(part: int, fps: np.ndarray, root: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Booleans: rows that have unsettled candidates beside their pivot and the members of theirs."""
    pivot, out = around(fps, TEXT_RADIUS), np.zeros(len(fps), bool)
    every = np.arange(len(fps))
    for at, open_ in unsettled(part, fps, root, codes):
        own = pivot[at : at + 256]
        open_ &= (own[:, None] != every) & (pivot != every[at : at + 256, None])
        out[at : at + 256] = open_.any(axis=1)
    return out


def spanning(part: int, fps: np.ndarray, root: np.ndarray, codes: np.ndarray, sets: np.ndarray, ends: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of the unsettled candidates that are similar as many (row, row) as join the same groups; sets of one row end at ends."""
    group = np.unique(root, return_inverse=True)[1]
    label = np.unique(sets, return_inverse=True)[1]
    starts, size = np.r_[0, ends[:-1]], np.diff(ends, prepend=0)
    open_ = np.concatenate([x for _, x in unsettled(part, fps, root, codes)])
    has, out = np.zeros(label.max(initial=-1) + 1, bool), []
    for row in np.argsort(-open_.sum(axis=1), kind="stable").tolist():  # the middle of a cloud joins it at once
        short, long = np.minimum(size, size[row]), np.maximum(size, size[row])
        others = np.flatnonzero(open_[row] & (group != group[row]) & (short >= similarity * long))
        open_[:, row] = False  # asked
        if not len(others):
            continue
        own = label[starts[row] : ends[row]]
        has[own] = True
        held = has[np.concatenate([label[starts[o] : ends[o]] for o in others.tolist()])]
        common = np.add.reduceat(held, np.r_[0, np.cumsum(size[others])[:-1]], dtype=np.int64)
        has[own] = False
        for other in others[common >= similarity * (size[row] + size[others] - common)].tolist():
            if group[other] != group[row]:
                out.append((row, other))
                group[group == group[other]] = group[row]
    return out


def other_links(first: DataFrame, sets: Callable[[DataFrame], DataFrame], links: DataFrame, similarity: float, rows_at_once: int, shingles_at_once: int) -> DataFrame:
    """(u, v): similar candidates that join what the comparisons with pivots, whose links are given, have left apart.

    Every candidate of another group is compared, within the task of their key; sets gives the shingles of nodes.
    """
    of = first.join(components(links), "node", "left").select("node", "fp", "codes", F.coalesce("root", "node").alias("root"))
    keyed = dense(of.select("*", F.posexplode("codes").alias("part", "code")).withColumn("band", F.xxhash64("part", "code")))
    # of two in a key one was the pivot of the other
    mixed = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 2 and a <> b")
    columns = ["part", "code", "node", "fp", "root", "codes"]
    rows = join_unique(keyed, dense(mixed.select("band")), "band").select(*columns)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        fp, codes = numbers(batch.column("fp")).view(np.uint64), numbers(batch.column("codes").flatten())
        return numbers(batch.column("part")), fp, numbers(batch.column("root")), codes.reshape(batch.num_rows, -1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, KEYS):
            part, *rest = read(batch)
            out = np.zeros(batch.num_rows, bool)
            for a, b in stretches(batch):
                if b - a > 1:
                    out[a:b] = untried(int(part[a]), *(x[a:b] for x in rest))
            if out.any():
                yield batch.select(columns).filter(pa.array(out))

    schema = "part int, code long, node long, fp long, root long, codes array<long>"
    asked = dense(dealt_out(dense(rows), F.count("*") / rows_at_once).select(*KEYS, *columns[2:]).mapInArrow(ask, schema).distinct())
    held = sets(asked.select("node").distinct())
    rows = dense(asked.join(held, "node").select(*columns, "shingles"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, KEYS):
            part, *rest = read(batch)
            node, lists = numbers(batch.column("node")), batch.column("shingles")
            flat, ends = numbers(lists.flatten()), np.cumsum(numbers(pa.compute.list_value_length(lists)))
            found = []
            for a, b in stretches(batch):
                if b - a > 1:
                    low = ends[a - 1] if a else 0
                    own = spanning(int(part[a]), *(x[a:b] for x in rest), flat[low : ends[b - 1]], ends[a:b] - low, similarity)
                    found += [(node[a + u], node[a + v]) for u, v in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found)], names=["u", "v"])

    load = F.greatest(F.count("*") / rows_at_once, F.sum(F.size("shingles")) / shingles_at_once)
    return dealt_out(rows, load).mapInArrow(compare, "u long, v long").distinct()


def similar_pairs(
    docs: DataFrame, shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY, rows_at_once: int = BLOCK_ROWS, shingles_at_once: int = BLOCK_SHINGLES
) -> tuple[DataFrame, DataFrame]:
    """Sketch rows of all documents, and (u, v): nodes whose sets of shingles are at least as similar, by Jaccard; as many
    such links as make the groups that all of them make.

    Texts of equal words are one node. Candidates share a band key and lie within the radius by bit-sliced distance. Those
    around a pivot are compared with it first; then all candidates that this has left in different groups are compared,
    whatever their pivots. A pair of similarity 0.8 shares a key with probability above 0.999.
    """
    rows = dense(_sketches(docs, shingle, BANDS, BAND_ROWS))
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("fp").alias("fp"), F.first("codes").alias("codes"))
    first = dense(first.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), "fp", "codes"))
    keyed = first.select("node", "fp", F.posexplode("codes").alias("part", "code"))
    pairs = dense(compare_by_key(keyed, around, TEXT_RADIUS, rows_at_once))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.unique(hashes(t, shingle)).view(np.int64) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lists, pa.list_(pa.int64()))], names=["node", "shingles"])

    def sets(nodes: DataFrame) -> DataFrame:
        asked = dense(first.join(nodes, "node").select("node", "doc_id", "key"))
        texts = join_on(documents(docs), broadcast_if_small(asked), ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"])
        return dense(texts.mapInArrow(each, "node long, shingles array<long>"))

    kept = sets(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct())
    both = pairs.join(kept.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(kept.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = dense(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))
    return rows, links.union(other_links(first, sets, links, similarity, rows_at_once, shingles_at_once))


def deduplicate(docs: DataFrame, shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, component_id, kept): near-duplicate texts form groups; the smallest doc_id (then key) of each is kept.

    Texts without words are alike. Rows equal in doc_id and text are one document and share one row here.
    """
    rows, links = similar_pairs(docs, shingle, similarity)
    found = components(links)
    named = rows.join(found, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")).distinct()
    named = dense(named)
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    out = join_unique(named, dense(least), "root")
    kept = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.key") == F.col("key"))
    return out.select("doc_id", "key", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates; all columns stay. Of rows equal in doc_id and text one stays,
    whatever else they hold; a null text is an empty one, and all texts without words are one group."""
    rows = dense(deduplicate(docs))
    kept = without(docs, rows.where("not kept"))
    every = documents(docs).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    twice = dense(every.select("doc_id", "key"))
    if twice.isEmpty():
        return kept
    once = without(kept, twice)
    doc, key = unused(docs, "doc", "key")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = broadcast_if_small(twice.select(F.col("doc_id").alias(doc), F.col("key").alias(key)))
    again = kept.join(small, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key)))
    return once.unionByName(again.dropDuplicates([doc, key]).drop(doc, key))
