"""LM scoring with Brown class-based bigrams.

Exchange clustering assigns every training word to one of CLASSES classes, frequent words first:

* the HEAD most frequent words by the exchange algorithm itself, word after word on the driver until none moves, on bigram
  counts that Spark gathers from all training documents; the number of words bounds that table,
* the LOOKUP most frequent words by sweeps over all of them at once: each goes to the class of greatest gain in likelihood,
  judged by its neighbours' classes and the class table of the sweep before, until the likelihood hardly rises,
* every other word by one such step, judged by its neighbours among the words before.

The gain of a word outside the head is that of the exchange to first order in the word's counts, which are small beside a
class's. A text's probability is the product of class transitions, from the end of the text before, and of word emissions;
unknown words are one word in a class of their own, whose transitions are those of the words that training texts hold once.

Texts become numbers once: all later passes read these. Words beyond LOOKUP stay strings: their occurrences in training texts
are shuffled by word once, where the word is placed, and go back to their texts with its class; those of held-out texts meet
theirs by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrow import join, numbers, packed, runs, unpacked
from lorespark.llm.common import discard, documents, written
from lorespark.llm.repeats import differs

HEAD, CLASSES, LOOKUP = 2048, 64, 131_072
#: Sweeps, and rounds of head and sweeps, end when they raise the likelihood by no more than so many nats a token.
SETTLED = 0.01
ALPHA, BETA = 0.1, 2.0
#: Codes of what is no frequent word, and their classes: the end of a text, and a rare word; in the model, an unknown one.
END, RARE = 0, 1
#: A frequent word's neighbours are dealt to a salt for every so many of them.
WORD_ROWS = 4_000_000
#: Texts are split together up to so many bytes, and a word's counts in a task meet up to so many words.
PIECE_BYTES, COUNTED_WORDS = 32 << 20, 600_000


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def marked(docs: DataFrame) -> DataFrame:
    """documents() with held_out: crc32 of the id as text leaves no remainder by 10; a null id counts as an empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents(docs).select("doc_id", "text", (F.crc32(name) % 10 == 0).alias("held_out"))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most PIECE_BYTES of text, or one text more."""
    ends = np.cumsum(numbers(pc.fill_null(pc.binary_length(batch.column("text")), 0)), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.maximum(ends - 1, 0) // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words end to end, how many each text has): words() of many texts at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")))
    found, many = lists.flatten(), numbers(lists.value_lengths()).astype(np.int64)
    full = pc.not_equal(found, "")  # white space at either end leaves an empty word
    return found.filter(full), np.bincount(np.repeat(np.arange(len(many)), many)[numbers(full)], minlength=len(many))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all texts; written."""

    def summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if len(held) < 2:
            return held
        sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table([sums["word"], sums["n_sum"]], names=["word", "n"]).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for piece in pieces(batch):
                found = split(piece.column("text"))[0].value_counts()
                held.append(pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"]))
                if sum(len(x) for x in held) > COUNTED_WORDS:
                    yield from summed(held)
                    held = []
        yield from summed(held)

    return written(train.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def coded(rows: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, held_out, ids, rare): each text's words as codes of index, RARE for others, and END; rare has those others,
    a space between them. Written."""
    sent = rows.sparkSession.sparkContext.broadcast(pa.array(list(index), pa.binary()).cast(pa.string()))  # in the order of codes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch):
                found, many = split(piece.column("text"))
                code = pc.index_in(found, value_set=known)
                of, ends = np.repeat(np.arange(len(many)), many), np.cumsum(many + 1)
                flat = np.full(len(found) + len(many), END, np.int32)
                flat[np.arange(len(found)) + of] = np.where(numbers(code.is_null()), RARE, numbers(pc.fill_null(code, 0)) + RARE + 1)
                cuts = np.cumsum(np.bincount(of[numbers(code.is_null())], minlength=len(many)))
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, cuts), pa.int32()), found.filter(code.is_null()))
                number = pa.array(np.arange(row, row + len(many), dtype=np.int64))
                row += len(many)
                lists = [packed(flat, np.append(0, ends)), pc.binary_join(rare, " ")]
                yield pa.RecordBatch.from_arrays([number, piece.column("doc_id"), piece.column("held_out"), *lists], names=["row", "doc_id", "held_out", "ids", "rare"])

    return written(rows.mapInArrow(each, "row long, doc_id long, held_out boolean, ids binary, rare string"), "zstd")


def rare_words(batch: pa.RecordBatch) -> pa.Array:
    """The rare words of a batch's texts end to end."""
    own = batch.column("rare").cast(pa.string())
    return pc.split_pattern(own.filter(pc.not_equal(own, "")), " ").flatten()


def line(batch: pa.RecordBatch) -> np.ndarray:
    """The codes of a batch's texts end to end, after an end."""
    return np.concatenate([[END], unpacked(batch.column("ids"))[0]])


def bigrams(texts: DataFrame, unit: np.ndarray, units: int, least: int = 0) -> np.ndarray:
    """Counts of neighbouring units over all texts, of pairs with a code from ``least`` on; unit gives that of each code."""
    sent = texts.sparkSession.sparkContext.broadcast(unit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(units * units, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = line(batch)
                u, of = sent.value[x], x >= least
                pair = (u[:-1] * units + u[1:])[of[:-1] | of[1:]]
                table += np.bincount(pair, minlength=units * units)
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(table[code])], names=["code", "n"])

    rows = texts.select("ids").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros((units, units), np.float64)
    for batch in rows.toArrow().to_batches():  # at most units * units rows, whatever the corpus
        out.reshape(-1)[numbers(batch.column("code"))] = numbers(batch.column("n"))
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(table: np.ndarray, of: np.ndarray, total: int, fixed: int) -> int:
    """Moves each unit from ``fixed`` on to the class, of those after RARE, in which the bigram likelihood of classes is
    greatest, unit after unit, until none moves. of, the class of each unit, is changed. Returns how often a unit moved."""
    n, moves = table.sum(axis=1), 0
    onto = np.zeros((len(table), total))  # class of the next unit
    into = np.zeros((len(table), total))  # class of the unit before
    for c in range(total):
        onto[:, c] = table[:, of == c].sum(axis=1)
        into[:, c] = table[of == c].sum(axis=0)
    joint = by_class(table, of, total)
    size = np.bincount(of, n, total)
    choice = np.arange(RARE + 1, total)
    while True:
        moved = 0
        for u in range(fixed, len(table)):
            if not n[u]:
                continue
            a, own = of[u], table[u, u]
            nxt, prv = onto[u].copy(), into[u].copy()
            nxt[a] -= own  # the unit's other neighbours; own pairs move with it
            prv[a] -= own
            joint[a] -= nxt
            joint[:, a] -= prv
            joint[a, a] -= own
            size[a] -= n[u]
            rows, columns = joint[choice], joint[:, choice].T
            gain = (_phi(rows + nxt) - _phi(rows) + _phi(columns + prv) - _phi(columns)).sum(axis=1)
            corner = joint[choice, choice]
            gain += _phi(corner + nxt[choice] + prv[choice] + own) - _phi(corner + nxt[choice]) - _phi(corner + prv[choice]) + _phi(corner)
            gain -= 2 * (_phi(size[choice] + n[u]) - _phi(size[choice]))
            b = choice[int(np.argmax(gain))] if gain.max() > gain[a - choice[0]] + 1e-6 else a
            joint[b] += nxt
            joint[:, b] += prv
            joint[b, b] += own
            size[b] += n[u]
            if b != a:
                moved += 1
                of[u] = b
                onto[:, a] -= table[:, u]
                onto[:, b] += table[:, u]
                into[:, a] -= table[u]
                into[:, b] += table[u]
        moves += moved
        if not moved:
            return moves


def likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the classes' bigrams, a token."""
    n = max(1.0, joint.sum())
    return float(_phi(joint).sum() - _phi(joint.sum(axis=0)).sum() - _phi(joint.sum(axis=1)).sum()) / n


def best(nxt: np.ndarray, prv: np.ndarray, now: np.ndarray, joint: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class, after RARE, of greatest gain for words with nxt and prv neighbours of each class; now is theirs so far, or RARE.

    The class table is taken without the word itself.
    """
    n, held = nxt.sum(axis=1), np.log(joint + 0.5)
    gain = nxt @ held.T + prv @ held - 2 * n[:, None] * np.log(size + 1.0)
    at = np.arange(len(n))
    alone = (nxt * np.log(np.maximum(joint[now] - nxt, 0) + 0.5)).sum(axis=1) + (prv * np.log(np.maximum(joint.T[now] - prv, 0) + 0.5)).sum(axis=1)
    gain[at, now] = alone - 2 * n * np.log(np.maximum(size[now] - n, 0) + 1.0)
    gain[:, : RARE + 1] = -np.inf
    new = gain.argmax(axis=1)
    return np.where((now > RARE) & (gain[at, now] >= gain[at, new] - 1e-9), now, new)


def neighbours(texts: DataFrame, n: np.ndarray, least: int, word_rows: int = WORD_ROWS) -> DataFrame:
    """(words, many, codes) of frequent words from code ``least`` on, a row for a block of words: how many codes each has, and those
    of its neighbours, twice the code of each next word and one more for words before. Written.

    A word lies in one block, unless it has over word_rows.
    """
    flush_at, sent = 1_000_000, texts.sparkSession.sparkContext.broadcast(1 + n // word_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            word, code = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(word, kind="stable")
            word, code = word[order], code[order]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lists = packed(code, np.append(first, len(word)))
            salt = pa.array((task % sent.value[word[first]]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(word[first]), salt, lists], names=["word", "salt", "codes"])

        for batch in batches:
            x = line(batch).astype(np.int32)
            at = np.flatnonzero(x >= least)
            held.append((np.concatenate([x[at], x[at]]), np.concatenate([2 * x[at + 1], 2 * x[at - 1] + 1])))
            if sum(len(w) for w, _ in held) > flush_at:
                yield out()
                held = []
        if held:
            yield out()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, ["word"]):
            word, (codes, many) = numbers(batch.column("word")), unpacked(batch.column("codes"))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lists = [packed(x, np.array([0, len(x)])) for x in (word[first], np.add.reduceat(many, first), codes)]
            yield pa.RecordBatch.from_arrays(lists, names=["words", "many", "codes"])

    rows = texts.select("ids").mapInArrow(each, "word int, salt int, codes binary")
    rows = rows.repartition("word", "salt").sortWithinPartitions("word").drop("salt")
    return written(rows.mapInArrow(blocks, "words binary, many binary, codes binary"), "zstd")


def sweep(
    beside: DataFrame, of: np.ndarray, n: np.ndarray, least: int, joint: np.ndarray, turn: int, word_rows: int = WORD_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """(new class of each code, counts of neighbouring classes with a word from ``least`` on); every second word may move in a turn."""
    total, size = len(joint), joint.sum(axis=1)
    sent = beside.sparkSession.sparkContext.broadcast((of, n, joint, size))
    names = ["code", "value", "profile"]

    def blocks(column: pa.Array) -> list[np.ndarray]:
        flat, many = unpacked(column)
        return np.split(flat, np.cumsum(many)[:-1])

    def chosen(word: np.ndarray, profile: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        of, _, joint, size = sent.value
        nxt, first, second = profile[:, 0], profile[:, 1], profile[:, 2]
        new = np.where(((word + turn) % 2 == 1) & (of[word] > RARE), of[word], best(nxt, first + second, of[word], joint, size))
        np.add.at(table, new, nxt)
        np.add.at(table.T, new, first)
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(new.astype(np.float64)), pa.nulls(len(word), pa.list_(pa.float32()))], names=names)

    def counted(table: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(table.reshape(-1)[at]), pa.nulls(len(at), pa.list_(pa.float32()))], names=names)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, table = sent.value[0], sent.value[1], np.zeros((total, total))
        # next ones, then those before that are frequent only as neighbours, then others
        part = np.stack([of, of + np.where(np.arange(len(of)) >= least, 2, 1) * total], axis=1).reshape(-1)
        for word, many, codes in (x for batch in batches for x in zip(*(blocks(batch.column(c)) for c in ("words", "many", "codes")))):
            at = np.repeat(np.arange(len(word)) * 3 * total, many)
            profile = np.bincount(at + part[codes], minlength=len(word) * 3 * total).reshape(-1, 3, total)
            whole = n[word] < word_rows
            yield chosen(word[whole], profile[whole].astype(float), table)
            if not whole.all():  # other partitions have more of these
                word, profile = word[~whole].astype(np.int64), profile[~whole].astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1) * 3 * total, pa.int32()), pa.array(profile.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.nulls(len(word), pa.float64()), lists], names=names)
        yield counted(table)

    def move_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((total, total))
        for batch in runs(batches, ["code"]):
            word, at = np.unique(numbers(batch.column("code")), return_inverse=True)
            profile = np.zeros((len(word), 3, total))
            np.add.at(profile, at, numbers(batch.column("profile").flatten()).reshape(-1, 3, total))
            yield chosen(word, profile, table)
        yield counted(table)

    schema = "code long, value double, profile array<float>"
    rows = beside.mapInArrow(move, schema)
    if (n[least:] >= word_rows).any():
        rows = written(rows)
        hot = rows.where("profile is not null").repartition("code").sortWithinPartitions("code").mapInArrow(move_hot, schema)
        rows = rows.where("profile is null").union(hot)
    found = rows.groupBy("code").agg(F.sum("value").alias("value")).toArrow()  # as many rows as lookup and classes allow
    code, value = (numbers(found.column(c)) for c in ("code", "value"))
    new, table = of.copy(), np.zeros(total * total)
    new[code[code >= 0]] = value[code >= 0]
    table[-1 - code[code < 0]] = value[code < 0]
    return new, table.reshape(total, total)


def by_class(table: np.ndarray, of: np.ndarray, total: int) -> np.ndarray:
    """Counts of neighbouring classes from those of units."""
    member = np.zeros((len(of), total))
    member[np.arange(len(of)), of] = 1
    return member.T @ (table @ member)


def cluster(texts: DataFrame, n: np.ndarray, head: int, classes: int, settled: float = SETTLED, word_rows: int = WORD_ROWS) -> np.ndarray:
    """The class of every code; n has the count of each. Head words and the others take turns until both have settled."""
    total, least = RARE + 1 + classes, min(len(n), RARE + 1 + head)
    of = np.full(len(n), RARE)
    of[END] = END
    of[RARE + 1 : least] = RARE + 1 + np.arange(least - RARE - 1) % classes
    beside, reached = neighbours(texts, n, least, word_rows) if least < len(n) else None, -np.inf
    units, heads = total + least - RARE, None
    while True:
        # units: the end, rare words, later words of each class and those that have none yet; then each head word
        later = np.where(of[least:] > RARE, of[least:], total)
        unit = np.concatenate([[END, RARE], total + 1 + np.arange(least - RARE - 1), later])
        table = bigrams(texts, unit, units) if heads is None else heads + bigrams(texts, unit, units, least)
        own = np.concatenate([np.arange(total), of[RARE:least]])
        own[total] = RARE
        exchange(table, own, total, total + 1)
        of[RARE + 1 : least] = own[total + 1 :]
        joint = by_class(table, own, total)
        table[RARE + 1 : total + 1] = table[:, RARE + 1 : total + 1] = 0  # sweeps count the pairs with later words
        heads = table  # the same in all rounds
        fixed = by_class(heads, own, total)
        now = likelihood(joint)
        if beside is None or ((later < total).all() and now <= reached + settled):
            if beside is not None:
                discard(beside)
            return of
        reached, turn = now if (later < total).all() else -np.inf, 0
        while turn < 3 or now > before + settled:
            before = now
            of, pairs = sweep(beside, of, n, least, joint, turn, word_rows)
            joint, turn = fixed + pairs, turn + 1
            now = likelihood(joint)


def occurrences(texts: DataFrame, of: np.ndarray, total: int) -> DataFrame:
    """(word, row, at) of every rare word in the texts: its place in the text times total squared, and total times the class
    before and the class after it; RARE is that of rare words only."""
    sent = texts.sparkSession.sparkContext.broadcast(of)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = line(batch), unpacked(batch.column("ids"))[1]
            at, of = np.flatnonzero(x == RARE), sent.value[x]
            if len(at):
                text = np.repeat(np.arange(batch.num_rows), size)[at - 1]
                pos = at - 1 - (np.cumsum(size) - size)[text]
                place = (pos * total + of[at - 1]) * total + of[at + 1]
                yield pa.RecordBatch.from_arrays([rare_words(batch), pa.array(numbers(batch.column("row"))[text]), pa.array(place)], names=["word", "row", "at"])

    return texts.select("row", "ids", "rare").mapInArrow(each, "word string, row long, at long")


def place(found: DataFrame, joint: np.ndarray) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(word, n, class) of rare words, each in its best class; (row, at, n, class) of their occurrences; and counts of neighbouring
    classes, of which rare words are one; those in RARE's row and column are those of the words that occur once.

    A task holds the occurrences of one word: rare ones have fewer than LOOKUP others, or occur once.
    """
    total, size = len(joint), joint.sum(axis=1)
    sent = found.sparkSession.sparkContext.broadcast(joint)
    schema = "word string, n long, class int, row long, at long"
    kinds = {"word": pa.string(), "n": pa.int64(), "class": pa.int32(), "row": pa.int64(), "at": pa.int64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = np.zeros((total, total)), []

        def out(many: int, **columns) -> pa.RecordBatch:
            rows = [columns[c] if c in columns else pa.nulls(many, t) for c, t in kinds.items()]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds.values())], names=list(kinds))

        def placed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            new, at = differs(batch.column("word")), numbers(batch.column("at"))
            of, first, sides = np.cumsum(new) - 1, np.flatnonzero(new), at % (total * total)
            profile = np.bincount(np.concatenate([of * 2 * total + sides // total, (of * 2 + 1) * total + sides % total]), minlength=len(first) * 2 * total)
            profile = profile.reshape(-1, 2, total).astype(float)
            prv, nxt = profile[:, 0], profile[:, 1]
            n = np.diff(first, append=len(at))
            own = best(nxt, prv, np.full(len(n), RARE), sent.value, size)
            prv[:, RARE] = nxt[:, RARE] = 0  # rare on both sides: counted apart
            np.add.at(table, own, nxt)
            np.add.at(table.T, own, prv)
            table[RARE] += nxt[n == 1].sum(axis=0)
            table[:, RARE] += prv[n == 1].sum(axis=0)
            yield out(len(n), word=batch.column("word").take(pa.array(first)), n=n, **{"class": own})
            yield out(len(at), n=n[of], row=batch.column("row"), at=batch.column("at"), **{"class": own[of]})

        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word")
            if held and held[-1].column("word")[0] != word[0]:
                yield from placed(join(held))
                held = []
            cut = int(np.flatnonzero(differs(word))[-1])  # the last word may go on in the next batch
            if cut:
                yield from placed(join([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from placed(join(held))
        code = np.flatnonzero(table)
        yield out(len(code), n=table.reshape(-1)[code].astype(np.int64), **{"class": code})

    rows = written(found.repartition("word").sortWithinPartitions("word").mapInArrow(each, schema), "zstd")
    pairs = np.zeros(total * total)
    for r in rows.where("word is null and row is null").groupBy("class").agg(F.sum("n").alias("n")).collect():
        pairs[r["class"]] = r["n"]
    return rows.where("word is not null").select("word", "n", "class"), rows.where("row is not null").select("row", "at", "n", "class"), pairs.reshape(total, total)


def by_text(trained: DataFrame, others: DataFrame, total: int) -> DataFrame:
    """(row, held_out, sides, class, n) of each text with rare words, those in order: total times the class before and the class
    after each, its own, and its count. trained and others, held out, have (row, at, n, class) of rare words. Written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, ["row"]):
            first = np.flatnonzero(np.diff(numbers(batch.column("row")), prepend=-1))
            sides, ends = numbers(batch.column("at")) % (total * total), np.append(first, batch.num_rows)
            lists = [packed(x, ends) for x in (sides, numbers(batch.column("class")), numbers(batch.column("n")))]
            own = [batch.column(c).take(pa.array(first)) for c in ("row", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, *lists], names=["row", "held_out", "sides", "class", "n"])

    rows = trained.withColumn("held_out", F.lit(False)).union(others.withColumn("held_out", F.lit(True)))
    rows = rows.repartition("row").sortWithinPartitions("row", "at")
    return written(rows.mapInArrow(each, "row long, held_out boolean, sides binary, class binary, n binary"), "zstd")


def rare_pairs(rare: DataFrame, total: int) -> np.ndarray:
    """Counts of neighbouring classes of words that are both rare, in texts of by_text() that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total * total, np.int64)
        for batch in batches:
            k, at = unpacked(batch.column("class"))[0], np.flatnonzero(unpacked(batch.column("sides"))[0] % total == RARE)
            table += np.bincount(k[at] * total + k[at + 1], minlength=len(table))  # the rare word after one comes next
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(table[code])], names=["code", "n"])

    pairs = np.zeros(total * total)
    for r in rare.where("not held_out").select("sides", "class").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        pairs[r["code"]] = r["n"]
    return pairs.reshape(total, total)


@dataclass
class Model:
    """Counts and classes. of and n are those of each code; rare is (word, n, class); joint, held and kinds are by class."""

    index: dict[bytes, int]
    of: np.ndarray
    n: np.ndarray
    rare: DataFrame
    joint: np.ndarray
    held: np.ndarray
    kinds: np.ndarray
    tokens: int
    types: int


def train(rows: DataFrame, head: int = HEAD, classes: int = CLASSES, lookup: int = LOOKUP, word_rows: int = WORD_ROWS) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows of marked() that are not held out, all of them coded, and by_text() of all of them."""
    learn = rows.where("not held_out")
    counts, n_train = word_counts(learn), learn.count()
    n_words, n_types, n_once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(lookup).collect()  # bounded by lookup
    index = {r["word"].encode(): RARE + 1 + i for i, r in enumerate(top)}
    n = np.array([n_train, 0, *[r["n"] for r in top]], np.int64)
    n[RARE] = n_words - n[RARE + 1 :].sum()
    texts = coded(rows, index)
    learn = texts.where("not held_out")
    of, total = cluster(learn, n, head, classes, word_rows=word_rows), RARE + 1 + classes
    joint = bigrams(learn, of, total)
    rare, trained, pairs = place(occurrences(learn, of, total), joint)
    others = occurrences(texts.where("held_out"), of, total).join(rare, "word", "left")
    others = others.select("row", "at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(RARE)).alias("class"))
    beside = by_text(trained, others, total)
    pairs = pairs + rare_pairs(beside, total)
    joint[RARE] = joint[:, RARE] = 0
    held, kinds = np.bincount(of, n, total), np.bincount(of, minlength=total).astype(float)
    held[RARE], kinds[RARE] = n_once, 1
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        held[r["class"]] += r["n"]
        kinds[r["class"]] += r["kinds"]
    return Model(index, of, n, rare, joint + pairs, held, kinds, n_words + n_train, n_types + (n_train > 0)), texts, beside


def word_classes(docs: DataFrame, head: int = HEAD, classes: int = CLASSES, lookup: int = LOOKUP, word_rows: int = WORD_ROWS) -> DataFrame:
    """(word, n, class) of every word of the documents that are not held out."""
    model, _, _ = train(marked(docs), head, classes, lookup, word_rows)
    rows = [(w.decode(), int(model.n[i]), int(model.of[i])) for w, i in model.index.items()]  # bounded by lookup
    return docs.sparkSession.createDataFrame(rows, "word string, n long, class int").union(model.rare)


def score(docs: DataFrame, head: int = HEAD, classes: int = CLASSES, lookup: int = LOOKUP) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities; tokens are a text's words and its end. Null texts are empty; repeated rows count and score as
    often as they stand there. Without any training document all counts are 0 and scores are those of an empty model.
    Texts of any length are read whole; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    model, texts, beside = train(marked(docs), head, classes, lookup)
    joint, held, total = model.joint, model.held, len(model.held)
    prior = (held + ALPHA) / (held.sum() + ALPHA * total)
    step = np.log10((joint + BETA * prior[None, :]) / (joint.sum(axis=1, keepdims=True) + BETA))
    spare = np.log10(np.maximum(held + ALPHA * model.kinds, ALPHA))  # an emission is log10(count + ALPHA) less this
    base = float(np.log10(model.tokens + ALPHA * (model.types + 1)))
    log_n = np.log10(model.n + ALPHA)
    log_n[RARE] = 0.0
    sent = docs.sparkSession.sparkContext.broadcast((model.of, step, spare, log_n))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, step, spare, log_n = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = line(batch), unpacked(batch.column("ids"))[1]
            k, known, first = of[x], x != RARE, np.cumsum(size) - size
            part = np.where(known[1:] & known[:-1], step[k[:-1], k[1:]], 0.0) + np.where(known[1:], log_n[x[1:]] - spare[k[1:]], 0.0)
            sums = [np.add.reduceat(v, first) for v in ((x[1:] > RARE).astype(np.int64), log_n[x[1:]], part)]
            own = [batch.column(c) for c in ("row", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size), *map(pa.array, sums)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "part"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, step, spare, _ = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            (sides, many), k, n = unpacked(batch.column("sides")), unpacked(batch.column("class"))[0], unpacked(batch.column("n"))[0]
            left, right, counted = sides // total, sides % total, np.log10(n + ALPHA)
            left = np.where(left == RARE, np.roll(k, 1), left)  # a rare word after a rare one comes next
            part = step[left, k] + np.where(right == RARE, 0.0, step[k, right]) + np.where(n > 0, counted - spare[k], 0.0)
            sums = [np.add.reduceat(v, np.cumsum(many) - many) for v in ((n > 0).astype(np.int64), counted, part)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums)], names=["row", "rare_known", "rare_counted", "rare_part"])

    own = texts.select("row", "doc_id", "held_out", "ids")
    own = own.mapInArrow(each, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, part double")
    rare = beside.select("row", "sides", "class", "n").mapInArrow(finish, "row long, rare_known long, rare_counted double, rare_part double")
    both = own.join(rare, "row", "left")
    both = both.select("doc_id", "held_out", "n_tokens", *[(F.col(c) + F.coalesce(r, F.lit(0))).alias(c) for c, r in zip(("n_known", "counted", "part"), rare.columns[1:])])
    both = both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.lit(1 if model.n[END] else 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * base).alias("base_score"),
        F.col("part").alias("score"),
    )
    return both.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
