"""MERGE as a DataFrame function: one shuffle join of target and source, keys compared null-safe.

The store keeps tables as immutable versions, so a merge yields the next version as a plan; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AmbiguousSource(ValueError):
    """Several source rows match one target row."""


def duplicate_keys(rows: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(keys..., n) of the keys with more than one row."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """`rows`, once it is certain that no key repeats (one action on the keys only)."""
    if not duplicate_keys(rows, on).isEmpty():
        raise AmbiguousSource(f"several source rows share a key of {', '.join(on)}")
    return rows


def merge(
    target: DataFrame, source: DataFrame, on: tuple[str, ...], *, when: Column | None = None, update: bool = True, insert: bool = True, delete_unmatched: bool = False, set_columns: dict[str, Column] | None = None, remove: Column | None = None,
) -> DataFrame:
    """The target after `source` is merged into it, in the target's columns.

    * Keys are equal null-safe, so a NULL key matches itself and a second run of the same merge changes nothing.
    * Matched rows are replaced by the source row (only the columns of `set_columns`, if given) where `when` is true;
      false and NULL keep the target row. In `when` and `set_columns`, columns are named `t.x` and `s.x`.
    * Source rows for which `remove` is true (in columns `s.x`) delete the row that they would replace and insert nothing.
    * Unmatched source rows are inserted unless insert is false; unmatched target rows stay unless delete_unmatched.
    * Columns are matched by name; one that the source lacks is NULL on insert and kept on update.
    """
    columns = target.columns
    t = target.select(F.struct(*columns).alias("t"), *(F.col(c).alias(f"__t_{i}") for i, c in enumerate(on)), F.lit(True).alias("__in_t"))
    s = source.select(F.struct(*source.columns).alias("s"), *(F.col(c).alias(f"__s_{i}") for i, c in enumerate(on)), F.lit(True).alias("__in_s"))
    match = reduce(lambda a, b: a & b, (F.col(f"__t_{i}").eqNullSafe(F.col(f"__s_{i}")) for i in range(len(on))))
    joined = t.join(s, match, "full_outer")
    both = F.col("__in_t").isNotNull() & F.col("__in_s").isNotNull()
    if delete_unmatched:
        joined = joined.filter("__in_s is not null")
    if not insert:
        joined = joined.filter("__in_t is not null")
    replaced = both & F.coalesce(F.lit(True) if when is None else when, F.lit(False)) & F.lit(update)
    inserted = F.col("__in_t").isNull()
    if remove is not None:
        joined = joined.filter(~(F.coalesce(remove, F.lit(False)) & (inserted | replaced)))

    def value(c: str) -> Column:
        old = F.col(f"t.`{c}`")
        new = F.col(f"s.`{c}`") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        changed = (set_columns[c] if c in set_columns else old) if set_columns is not None else new if c in source.columns else old
        return F.when(inserted, new).when(replaced, changed).otherwise(old).alias(c)

    return joined.select(*(value(c) for c in columns))


def insert_missing(target: DataFrame, source: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The target and those source rows whose key it lacks (insert, on conflict do nothing). Keys are equal null-safe."""
    keys = target.select(*(F.col(c).alias(f"__k_{i}") for i, c in enumerate(on))).distinct()
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k_{i}")) for i, c in enumerate(on)))
    return target.unionByName(source.join(keys, match, "left_anti").select(*target.columns))


def merge_lines(existing: DataFrame, incoming: DataFrame, line: str = "value") -> DataFrame:
    """The set of lines: all existing ones and each new one once."""
    fresh = incoming.select(line).dropDuplicates([line]).join(existing.select(line), line, "left_anti")
    return existing.select(line).unionByName(fresh)
