"""The same work on streams: progress feeds, continuous ingestion, note versions and what they ask to be analysed.

State is kept for each source or note, and forgotten after a time without an event only if one is given. Rows of a micro-batch
are taken in the order of seq, so wherever micro-batches end, a stream gives what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators import analysis
from lorespark.operators.notes import MAJOR, MAJOR_BLOCKS, MAJOR_CHARS, MIDDLE, MIDDLE_BLOCKS, MIDDLE_CHARS, SMALL


def _stateful(rows: DataFrame, keys: list[str], start: tuple, fold: Callable, out: str, state: str, ttl_ms: int) -> DataFrame:
    """fold(state, row) gives the next state, and a row of the result or None; rows come in the order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, given = held.get if held.exists else start, []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            now, row = fold(now, r)
            if row is not None:
                given.append((*key, *row))
        held.update(now)
        if ttl_ms:
            held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(given, columns=[c.strip().split(" ")[0] for c in out.split(",")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(step, out, state, "append", timeout)


def progress_feed(events: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """The feed of operators.stats.progress_feed over a stream of (source_id, seq, added, embedded).

    State of a source: total, completed and last percentage. It outlives completion, so a source that comes back goes on counting.
    """

    def fold(state: tuple, r) -> tuple:
        total, completed = int(state[0] + r.added), int(state[1] + r.embedded)
        pct, left = completed * 100 // total if total > 0 else 0, total - completed
        row = (r.seq, total, completed, pct, "completed" if left <= 0 else "processing", left <= 0 and total > 0)
        return (total, completed, pct), row if pct != state[2] else None

    out = f"source_id {dict(events.dtypes)['source_id']}, seq long, total long, completed long, progress_pct long, status string, done boolean"
    return _stateful(events, ["source_id"], (0, 0, -1), fold, out, "total long, completed long, last long", ttl_ms)


def note_versions(edits: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Versions of operators.notes.versions over a stream of ([bubble_id,] note_id, seq, chars, blocks, hash).

    State of a note: characters, blocks, hash and version of its last edit.
    """

    def fold(state: tuple, r) -> tuple:
        chars, blocks, known, version = state
        changed, before, inc = r.hash != known, version, 0.0
        if changed:
            more, added = r.chars - chars, max(0, r.blocks - blocks)
            major, middle = more > MAJOR_CHARS or added > MAJOR_BLOCKS, more > MIDDLE_CHARS or added > MIDDLE_BLOCKS
            inc = MAJOR if major else MIDDLE if middle else SMALL if more > 0 else 0.0
            version = float(int(version)) + 1 if inc >= MAJOR else round(version + inc, 2)
        return (int(r.chars), int(r.blocks), r.hash, version), (r.seq, inc, changed, before, version)

    keys = [c for c in ("bubble_id", "note_id") if c in edits.columns]
    out = ", ".join([*(f"{c} string" for c in keys), "seq long, increment double, changed boolean, version_before double, version double"])
    return _stateful(edits, keys, (0, 0, None, 0.0), fold, out, "chars long, blocks long, last string, version double", ttl_ms)


def due_analyses(edits: DataFrame, cache: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """The edits of a stream of (bubble_id, note_id, seq, chars, blocks, hash) that ask for an analysis, as operators.analysis.triggered
    finds them: a major step, or the first of a note, unless the cache (bubble_id, note_id, content_version), a table that
    every micro-batch reads as it then is, has the version they lead to."""
    return analysis.triggered(note_versions(edits, ttl_ms), cache)


def ingest_continuously(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls the batch ingestion with every micro-batch of a file stream and its number until there is nothing new.

    After a failure the same micro-batch comes again under the same number, which plans.jobs.ingest_batch() makes good.
    """
    return files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
