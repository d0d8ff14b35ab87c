"""Substring deduplication by sliding spans of consecutive sentences.

A sentence ends after a full stop, question or exclamation mark before a space, after such a mark of another script with the
brackets that close there, at a space of scripts that put none between words, or with its line. Every run of SPAN or more
consecutive sentences with WORDS words together counts, and a sentence of LONG words alone; a text without either is one span.
Where words are not told apart by spaces, every HAN letters of Han or kana, or INDIC ones of Thai, Lao, Burmese and Khmer, are
counted as a word beside those between spaces.
The shortest runs from and up to every sentence make up all others, so only these are hashed. A sentence goes if it lies in a
span whose words, lower-cased, make up an earlier span too. Spans are met by 128 bits of their hash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrow import numbers, values
from lorespark.llm.common import join_on, written
from lorespark.llm.repeats import placed, repeated

#: Sentences and words of the shortest spans, and words that make a sentence a span by itself.
SPAN, WORDS, LONG = 2, 15, 25
#: Letters that count as a word where no spaces part them.
HAN, INDIC = 2, 4
#: What ends a sentence. No part of it can match in two ways, so the time is linear whatever the text.
END = re.compile(rb"[.!?] +|\n")
#: The same in all scripts: marks before Han or kana; wide and halfwidth marks and what closes after them; danda, Arabic marks;
#: spaces after Thai or Lao, Burmese and Khmer letters. UTF-8, of which a first byte never stands inside another letter.
WIDE_END = re.compile(
    rb"[.!?](?: +|(?=[\xe3-\xe9]))|\n|(?:\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1)+(?:\xe3\x80[\x8d\x8f]|\xe2\x80[\x99\x9d]|\xef\xbc\x89)* *"
    rb"|(?:\xe0\xa5[\xa4\xa5]|\xd8\x9f|\xdb\x94) *|(?<=\xe0[\xb8-\xbb][\x80-\xbf]) +|(?<=\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]) +"
)
#: First bytes of all that only WIDE_END ends at, and of all letters below.
WIDE = re.compile(rb"[\xd8\xdb\xe0\xe1\xe3-\xe9\xef\xf0]")
HAN_LETTER = re.compile(rb"(?:\xe3[\x81-\x83\x90-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xef[\xa4-\xab]|\xf0[\xa0-\xb2][\x80-\xbf])[\x80-\xbf]")
INDIC_LETTER = re.compile(rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f])[\x80-\xbf]")


def sentences(text: bytes) -> list[bytes]:
    """The text in pieces that make it up again."""
    ends = WIDE_END if WIDE.search(text) else END
    cuts = [0, *(m.end() for m in ends.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def unspaced(piece: bytes) -> int:
    """How many words a sentence counts as beside those between spaces."""
    return len(HAN_LETTER.findall(piece)) // HAN + len(INDIC_LETTER.findall(piece)) // INDIC


def spans(text: bytes, span: int = SPAN, least: int = WORDS, long: int = LONG) -> Iterator[tuple[bytes, int, int]]:
    """(16 bytes of hash, first sentence, sentences) of every span; sentences without words belong to none and are passed over."""
    pieces = [(i, p, p.lower().split()) for i, p in enumerate(sentences(text))]
    wide = WIDE.search(text)
    pieces = [(i, len(w) + (unspaced(p) if wide else 0), b" ".join(w)) for i, p, w in pieces if w]
    count = len(pieces)
    until, runs = [0, *accumulate(n for _, n, _ in pieces)], {}
    for at in range(count):
        if pieces[at][1] >= long:
            runs[at, at + 1] = None
            continue
        end = max(bisect_left(until, until[at] + least), at + span)
        if end <= count:
            runs[at, end] = None
        start = min(bisect_right(until, until[at + 1] - least) - 1, at + 1 - span)
        if start >= 0:
            runs[start, at + 1] = None
    for at, end in runs or [(0, count)] * (count > 0):
        yield xxhash.xxh3_128_digest(b"\n".join(p for _, _, p in pieces[at:end])), pieces[at][0], pieces[end - 1][0] - pieces[at][0] + 1


def repeated_spans(docs: DataFrame, span: int = SPAN, least: int = WORDS, long: int = LONG) -> DataFrame:
    """(did, key, start, length) of every span of sentences of placed documents but the first of its words."""
    names = ["high", "low", "did", "key", "start", "length"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, key = numbers(batch.column("did")), numbers(batch.column("key"))
            found = [(h, i, s, n) for i, t in enumerate(values(batch.column("text"))) for h, s, n in spans(t, span, least, long)]
            if found:
                h, i, s, n = zip(*found)
                row, halves = np.array(i), np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                columns = [halves[:, 0].copy(), halves[:, 1].copy(), did[row], key[row], np.array(s, np.int64), np.array(n, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    # written, as sampling the splitters would hash all texts a second time
    rows = written(docs.select("did", "key", "text").mapInArrow(each, "high long, low long, did long, key long, start long, length int"))
    return repeated(rows, ("high", "low"))


def deduplicate(docs: DataFrame, span: int = SPAN, least: int = WORDS, long: int = LONG) -> DataFrame:
    """One row for each document: doc_id, n_sentences, n_removed, kept_sha256, kept_text.

    Null texts are empty. Rows equal in doc_id and text are one document; first is the smallest doc_id (null first), then
    the smaller hash of the text, then the earlier sentence. Texts of any length take linear time; an empty table gives none of
    these rows; other columns of docs, whatever their names, are left out.
    """
    docs = placed(docs)
    gone = written(repeated_spans(docs, span, least, long).groupBy("did", "key").agg(F.collect_list(F.struct("start", "length")).alias("at")))
    rows = join_on(docs, gone, ["did", "key"], "left").select("doc_id", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("at"), []
            for i, text in enumerate(values(batch.column("text"))):
                pieces = sentences(text)
                keep = np.ones(len(pieces), bool)
                if lists[i].is_valid:
                    own = lists[i].values
                    for s, n in zip(numbers(own.field("start")).tolist(), numbers(own.field("length")).tolist()):
                        keep[s : s + n] = False
                kept = b"".join(p for p, k in zip(pieces, keep.tolist()) if k)
                out.append((len(pieces), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_sentences", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, kept_sha256 string, kept_text string")
