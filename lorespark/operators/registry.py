"""Keyed tables kept up to date: every change is a function of the old table and a table of changes.

Nulls in key columns match nulls. Of several changes to one key the last in the given order counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores before it as no column of the tables begins with."""
    while any(c.lower().startswith(name) for t in tables for c in t.columns):
        name = f"_{name}"
    return name


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first in the given order (give it newest first)."""
    line, at = Window.partitionBy(*keys).orderBy(*order), free("_at", changes)
    return changes.withColumn(at, F.row_number().over(line)).where(F.col(at) == 1).drop(at)


def matched(table: DataFrame, changes: DataFrame, keys: Sequence[str], how: str, null_keys: bool = True) -> tuple[DataFrame, Callable[[str], Column]]:
    """table joined with changes, and what gives a column of changes by its name.

    Null keys match, unless no key is ever null: a plain equality lets a table that is bucketed by its keys stay where it is.
    """
    prefix = free("_new_", table)
    new = changes.withColumnsRenamed({c: f"{prefix}{c}" for c in changes.columns})
    same = [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) if null_keys else F.col(k) == F.col(f"{prefix}{k}") for k in keys]
    return table.join(new, same, how), lambda c: F.col(f"{prefix}{c}")


def last_of(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One change a key: the first in the order (newest first); what that leaves open goes by the other columns, greatest first."""
    rest = [F.col(f.name).desc_nulls_last() for f in changes.schema.fields if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    return latest(changes, keys, [*order, *rest] or [F.lit(1)])


def register(table: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str, order: Sequence[Column | str] = (), null_keys: bool = True) -> DataFrame:
    """New keys are inserted with defaults; of known ones only the stamp is moved. Of a key's rows in new the last in order counts."""
    new, (old, fresh) = last_of(new, keys, order), (free("_old", table), free("_fresh", new))
    both, of_new = matched(table.withColumn(old, F.lit(True)), new.withColumn(fresh, F.lit(True)), keys, "full", null_keys)
    columns = []
    for c in table.columns:
        given = of_new(c) if c in new.columns else F.lit(None)
        kept = F.when(of_new(fresh).isNotNull(), F.coalesce(given, F.col(c))).otherwise(F.col(c)) if c == stamp else F.col(c)
        columns.append(F.when(F.col(old).isNotNull(), kept).otherwise(given).alias(c))
    return both.select(*columns)


def upsert(
    table: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: Sequence[Column | str] = (), prune: Sequence[str] = (), null_keys: bool = True
) -> DataFrame:
    """New keys are inserted, known ones overwritten but for the columns to keep. Of a key's rows in new the last in order counts.

    prune names columns of a source: old rows of a source that new has rows of go if new does not have their key.
    """
    once, (old, there) = last_of(new, keys, order), (free("_old", table), free("_is", new))
    both, of_new = matched(table.withColumn(old, F.lit(True)), once.withColumn(there, F.lit(True)), keys, "full", null_keys)
    columns = []
    for c in table.columns:
        value = F.when(of_new(there).isNotNull(), of_new(c)).otherwise(F.col(c))
        columns.append((F.when(F.col(old).isNotNull(), F.col(c)).otherwise(of_new(c)) if c in keep else value).alias(c))
    if not prune:
        return both.select(*columns)
    stale = free("_stale", table)
    rows = both.select(*columns, of_new(there).isNull().alias(stale))
    left, again = matched(rows, new.select(*prune).distinct().withColumn(there, F.lit(True)), prune, "left")
    return left.where(~(F.col(stale) & again(there).isNotNull())).select(*table.columns)


def mark(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], flags: Mapping[str, Column], fill: Sequence[str] = (), order: Sequence[Column | str] = (),
    null_keys: bool = True,
) -> DataFrame:
    """Rows whose key is among the changes get the flags, and the changes' values of ``fill`` unless null or empty.

    Of several changes to a key the last in order counts.
    """
    extra, there = [c for c in changes.columns if c not in keys and c not in fill], free("_is", changes)
    one = last_of(changes.select(*keys, *fill, *extra), keys, order).select(*keys, *fill).withColumn(there, F.lit(True))
    both, of_new = matched(table, one, keys, "left", null_keys)
    out = {c: F.when(of_new(there).isNotNull(), v).otherwise(F.col(c)) for c, v in flags.items()}
    out |= {c: F.coalesce(F.nullif(of_new(c), F.lit("")), F.col(c)) for c in fill}
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in table.columns])


def remove(table: DataFrame, gone: DataFrame, keys: Sequence[str], null_keys: bool = True) -> DataFrame:
    return matched(table, gone.select(*keys).distinct(), keys, "left_anti", null_keys)[0]


def missing(table: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys asked for that the table does not have."""
    return matched(asked.select(*keys).distinct(), table.select(*keys).distinct(), keys, "left_anti")[0]


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of deleted rows); a condition that is null deletes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.agg(F.count(F.when(hit, 1)).alias("deleted"))


def reset_count(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: how many rows a reset matches, changed or not."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return table.agg(F.count(F.when(hit, 1)).alias("matched"))


def queue(table: DataFrame, done: str, after: Sequence[str] = ()) -> DataFrame:
    """Rows whose flag ``done`` is 0 and whose flags ``after`` are all 1."""
    rows = table.where(F.col(done) == 0)
    for flag in after:
        rows = rows.where(F.col(flag) == 1)
    return rows


def cache_info(cache: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """One row: entries, and the oldest and newest stamp."""
    return cache.select(*keys, stamp).agg(F.count("*").alias("entries"), F.min(stamp).alias("oldest"), F.max(stamp).alias("newest"))


def reset_flag(table: DataFrame, flag: str, allowed: Sequence[str], condition: Column | None = None) -> DataFrame:
    """The flag is 0 where the condition holds, everywhere without one. Only allowed flags can be reset."""
    if flag not in allowed:
        raise ValueError(f"{flag} cannot be reset; {', '.join(allowed)} can")
    return table.withColumn(flag, F.when(F.lit(True) if condition is None else condition, F.lit(0)).otherwise(F.col(flag)))


def flag_set(probes: DataFrame, table: DataFrame, keys: Sequence[str], flag: str, allowed: Sequence[str]) -> DataFrame:
    """probes with ``is_set``: the row exists and its flag is 1."""
    if flag not in allowed:
        raise ValueError(f"no flag {flag}; {', '.join(allowed)}")
    both, of_table = matched(probes, table.select(*keys, flag), keys, "left")
    return both.select(*probes.columns, (F.coalesce(of_table(flag), F.lit(0)) == 1).alias("is_set"))


def put_latest(table: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """One row a key, the newest by stamp of both tables; on equal stamps the new one."""
    side = free("_new", table, new)
    both = table.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)))
    return latest(both, keys, [F.col(stamp).desc_nulls_last(), F.desc(side)]).drop(side)


def append_stamped(table: DataFrame, new: DataFrame, stamp: str, as_of: Column) -> DataFrame:
    return table.unionByName(new.withColumn(stamp, as_of))


def cascade(tables: Mapping[str, DataFrame], gone: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: remove(t, gone, keys) for name, t in tables.items()}
