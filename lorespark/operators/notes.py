"""Block-structured notes: repair, text, versions, diffs and Markdown, inside each row where one row is enough."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.text import object_hash

#: A run of text in a block is an object with "insert" or a plain string; children of a table are cells, of a cell blocks.
BLOCK = "struct<type:string,data:struct<level:int,delta:array<variant>,rowsLen:int,colsLen:int,rowPosition:int,colPosition:int>,children:array<struct<type:string,data:struct<delta:array<variant>,rowPosition:int,colPosition:int>,children:array<struct<type:string,data:struct<delta:array<variant>>>>>>>"
DOCUMENT = f"struct<type:string,children:array<{BLOCK}>>"
EMPTY = '[{"type":"paragraph","data":{"delta":[{"insert":""}]}}]'


def parsed(document: Column) -> Column:
    """The document with at least one block; children that are missing or not a list become one empty paragraph, and a paragraph
    without runs gets an empty one. Other blocks stay as they are."""
    doc = F.from_json(document, DOCUMENT)
    children = F.coalesce(F.when(F.size(doc["children"]) > 0, doc["children"]), F.from_json(F.lit(EMPTY), f"array<{BLOCK}>"))
    plain = F.from_json(F.lit('{"data":{"delta":[{"insert":""}]}}'), BLOCK)["data"]

    def whole(b: Column) -> Column:
        bare = (b["type"] == "paragraph") & b["data"]["delta"].isNull()
        return F.when(bare, b.withField("data", plain)).otherwise(b)

    return F.struct(F.lit("page").alias("type"), F.transform(children, whole).alias("children"))


def run_text(run: Column) -> Column:
    return F.coalesce(F.try_variant_get(run, "$.insert", "string"), F.try_variant_get(run, "$", "string"), F.lit(""))


def block_text(delta: Column, mode: str = "all") -> Column:
    """The text of a block's runs, or of its first run only."""
    runs = F.coalesce(delta, F.array().cast("array<variant>"))
    runs = F.slice(runs, 1, 1) if mode == "first" else runs
    return F.array_join(F.transform(runs, run_text), "")


def total_text(doc: Column) -> Column:
    """All runs of the top-level blocks, without those of nested ones."""
    return F.array_join(F.transform(doc["children"], lambda b: block_text(b["data"]["delta"])), "")


# An edit of more characters or blocks than these adds so much to the version.
MAJOR_CHARS, MAJOR_BLOCKS, MAJOR = 125, 10, 1.0
MIDDLE_CHARS, MIDDLE_BLOCKS, MIDDLE = 75, 5, 0.1
SMALL = 0.01


def increment(chars: Column, blocks: Column) -> Column:
    """What an edit adds to the version, by characters added (may be negative) and blocks added (not below 0)."""
    added = F.greatest(F.lit(0), blocks)
    major, middle = (chars > MAJOR_CHARS) | (added > MAJOR_BLOCKS), (chars > MIDDLE_CHARS) | (added > MIDDLE_BLOCKS)
    return F.when(major, MAJOR).when(middle, MIDDLE).when(chars > 0, SMALL).otherwise(0.0)


def versions(edits: DataFrame) -> DataFrame:
    """edits (note_id, seq, chars, blocks, hash) with increment, changed, version_before and version.

    A major step goes to the next whole version, others add up; only a change of content moves it. All of it are windows: an edit
    lies in the stretch after a note's latest major step, and the version is the whole number there and the sum of the smaller
    steps since. That number grows by one at each major step, and by the whole part of what the steps before it had added up to.
    """
    line = Window.partitionBy("note_id").orderBy("seq")
    rows = edits.withColumns({"old_chars": F.coalesce(F.lag("chars").over(line), F.lit(0)), "old_blocks": F.coalesce(F.lag("blocks").over(line), F.lit(0)), "changed": ~F.lag("hash").over(line).eqNullSafe(F.col("hash"))})
    rows = rows.withColumn("increment", F.when(F.col("changed"), increment(F.col("chars") - F.col("old_chars"), F.col("blocks") - F.col("old_blocks"))).otherwise(0.0))
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stretch", F.sum((F.col("increment") >= MAJOR).cast("int")).over(upto))
    # hundredths are whole numbers, so sums are exact
    minor = F.when(F.col("increment") >= MAJOR, 0).otherwise(F.round(F.col("increment") * 100).cast("long"))
    inside = Window.partitionBy("note_id", "stretch").orderBy("seq")
    rows = rows.withColumn("minor", F.sum(minor).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a stretch's own whole steps carry over to the next major step
    sums = rows.groupBy("note_id", "stretch").agg(F.max("minor").alias("all"))
    order = Window.partitionBy("note_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("note_id", "stretch", (F.coalesce(F.sum(F.floor(F.col("all") / 100)).over(order), F.lit(0)) + F.col("stretch")).alias("whole"))
    rows = rows.join(sums, ["note_id", "stretch"]).withColumn("version", (F.col("whole") * 100 + F.col("minor")) / 100)
    rows = rows.withColumn("version_before", F.coalesce(F.lag("version").over(line), F.lit(0.0)))
    return rows.select("note_id", "seq", "increment", "changed", "version_before", "version")


def common(old: list, new: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by the greedy method of furthest reaching paths (Myers, 1986), in time
    that grows with the lengths and the number of changes."""
    begin = 0
    while begin < min(len(old), len(new)) and old[begin] == new[begin]:
        begin += 1
    end = 0
    while end < min(len(old), len(new)) - begin and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[begin : len(old) - end], new[begin : len(new) - end]
    reach, trace = {1: 0}, []
    for changes in range(len(a) + len(b) + 1):
        trace.append(dict(reach))
        for k in range(-changes, changes + 1, 2):
            x = reach[k + 1] if k == -changes or (k != changes and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    x, y, found = len(a), len(b), []
    for changes in range(len(trace) - 1, -1, -1):
        reach, k = trace[changes], x - y
        before = k + 1 if k == -changes or (k != changes and reach[k - 1] < reach[k + 1]) else k - 1
        px = reach[before]
        py = px - before
        while x > max(px, 0) and y > max(py, 0):
            x, y = x - 1, y - 1
            found.append((begin + x, begin + y))
        x, y = px, py
    ends = [(len(old) - i, len(new) - i) for i in range(end, 0, -1)]
    return [(i, i) for i in range(begin)] + found[::-1] + ends


def patch(old: list, new: list) -> list[tuple[str, int, object]]:
    """(op, place, value): what turns old into new, one after the other; between kept blocks others are replaced as far as both
    have some, then removed or added."""
    out, done = [], (0, 0)
    for i, j in [*common(old, new), (len(old), len(new))]:
        gone, come = i - done[0], new[done[1] : j]
        for n, value in enumerate(come):
            out.append(("replace" if n < gone else "add", done[1] + n, value))
        out += [("remove", j, None)] * (gone - len(come))
        done = i + 1, j + 1
    return out


def diff_ops(edits: DataFrame) -> DataFrame:
    """(note_id, seq, step, op, path, value): the steps that turn a note's document into its next edit, few and in their order.

    edits: (note_id, seq, children array<string>); a first edit starts from nothing. Blocks that stay, wherever others come or
    go before them, have no step: a longest common subsequence is kept. Each pair of edits is compared on its own.
    """
    line = Window.partitionBy("note_id").orderBy("seq")
    none = F.array().cast("array<string>")
    rows = edits.select("note_id", "seq", F.coalesce("children", none).alias("new"), F.coalesce(F.lag("children").over(line), none).alias("old"))

    @F.pandas_udf("array<struct<op:string,place:int,value:string>>")
    def steps(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "place": p, "value": v} for o, p, v in patch(list(a), list(b))] for a, b in zip(old, new)], dtype=object)

    rows = rows.select("note_id", "seq", F.posexplode(steps("old", "new")).alias("step", "x"))
    path = F.concat(F.lit("/document/children/"), F.col("x.place"))
    return rows.select("note_id", "seq", "step", F.col("x.op").alias("op"), path.alias("path"), F.col("x.value").alias("value"))


def collapse(diffs: DataFrame) -> DataFrame:
    """The last entry of each version of (note_id, seq, version, ...), with the place of the version's first one."""
    one = Window.partitionBy("note_id", "version")
    rows = diffs.withColumns({"first_seq": F.min("seq").over(one), "back": F.row_number().over(one.orderBy(F.desc("seq")))})
    return rows.where("back = 1").drop("back")


def table_markdown(block: Column) -> Column:
    """A table block as Markdown; of cells on one position the last counts, cells outside are skipped."""
    rows, columns = F.coalesce(block["data"]["rowsLen"], F.lit(0)), F.coalesce(block["data"]["colsLen"], F.lit(0))
    cells = block["children"]

    def text(cell: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(cell["children"], lambda b: block_text(b["data"]["delta"])), ""), F.lit(""))

    def cell(r: Column, c: Column) -> Column:
        here = F.filter(cells, lambda x: (x["data"]["rowPosition"] == r) & (x["data"]["colPosition"] == c))
        return F.coalesce(F.try_element_at(F.transform(here, text), F.lit(-1)), F.lit(""))

    def row(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), columns - 1), lambda c: cell(r, c)), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), columns), " | "), F.lit(" |"))
    body = F.when(rows > 1, F.transform(F.sequence(F.lit(1), F.greatest(rows - 1, F.lit(1))), row)).otherwise(F.array().cast("array<string>"))
    return F.when((rows > 0) & (columns > 0), F.array_join(F.concat(F.array(row(F.lit(0)), rule), body), "\n")).otherwise(F.lit(""))


def markdown(doc: Column, tables: bool = True, mode: str = "all") -> Column:
    """Blocks as Markdown, each followed by an empty line; unknown types leave only that line. Space around the whole goes."""

    def one(b: Column) -> Column:
        text = block_text(b["data"]["delta"], mode)
        return (
            F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(b["data"]["level"], F.lit(1))), F.lit(" "), text))
            .when(b["type"] == "paragraph", F.trim(text))
            .when(b["type"] == "divider", F.lit("---"))
            .when(b["type"] == "table", table_markdown(b) if tables else F.lit("[TABLE OMITTED]"))
            .otherwise(F.lit(""))
        )

    lines = F.transform(doc["children"], lambda b: F.when(one(b) != "", F.concat(one(b), F.lit("\n"))).otherwise(F.lit("")))
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \n\t"))


def rename(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """notes with the titles of (note_id, title) where there is one."""
    new = titles.select("note_id", F.col("title").alias("_title")).dropDuplicates(["note_id"])
    return notes.join(new, "note_id", "left").withColumn("title", F.coalesce("_title", "title")).select(*notes.columns)


def new_notes(notes: DataFrame) -> DataFrame:
    """Notes (note_id, bubble_id, title, document, ink) as first stored: hashes of content and ink, whatever the order of their
    keys, and version 0."""
    return notes.select("note_id", "bubble_id", "title", object_hash(F.col("document")).alias("content_hash"), object_hash(F.coalesce("ink", F.lit("[]"))).alias("ink_hash"), F.lit(0.0).alias("content_version"), F.lit(0.0).alias("ink_version"))
