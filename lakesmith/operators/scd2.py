"""Type 2 dimensions: single-run application, rebuild from a change log, and joins as of an event's time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.operators.history import TRACKED, history


def apply_latest(dimension: DataFrame, incoming: DataFrame, key: str = "customer_id", tracked: tuple[str, ...] = TRACKED, loaded_at: Column | None = None) -> DataFrame:
    """The dimension after one run: `incoming` holds at most one row per key.

    * An unknown key, or one without current row, opens a version: after its greatest version number, or 1.
    * A tracked attribute that differs (NULL being a value) in a row newer than the current one closes the current
      version at the row's updated_at and opens the next one there.
    * Anything else (older rows, equal tracked attributes, changes of other attributes only) changes nothing.

    One join: the incoming row meets all versions of its key, closes the current one and is opened beside them.
    """
    now = F.current_timestamp() if loaded_at is None else loaded_at
    inc = incoming.filter(F.col(key).isNotNull()).select(F.col(key), F.struct(*incoming.columns).alias("s"))
    known = dimension.groupBy(key).agg(F.max("_record_version").alias("top"), F.max_by(F.struct("updated_at", *tracked), F.when(F.col("is_current"), F.col("valid_from"))).alias("cur"))
    differs = reduce(lambda a, b: a | b, (~F.col(f"s.{c}").eqNullSafe(F.col(f"cur.{c}")) for c in tracked))
    opens = F.col("cur").isNull() | (differs & (F.col("s.updated_at") > F.col("cur.updated_at")))
    opening = inc.join(known, key, "left").filter(F.coalesce(opens, F.lit(False)))
    have = set(incoming.columns)
    made = {
        "valid_from": F.col("s.updated_at"), "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True), "_record_version": (F.coalesce("top", F.lit(0)) + 1).cast("int"), "_silver_loaded_at": now,
    }
    opened = opening.select(*(made[c].alias(c) if c in made else F.col(f"s.{c}").alias(c) if c in have else F.lit(None).cast(dimension.schema[c].dataType).alias(c) for c in dimension.columns))
    ends = opening.select(key, F.col("s.updated_at").alias("__end"))
    joined = dimension.join(ends, key, "left")
    closes = F.col("is_current") & F.col("__end").isNotNull()
    kept = joined.select(*(F.when(closes, F.col("__end")).otherwise(F.col(c)).alias(c) if c == "valid_to" else (F.col(c) & ~closes).alias(c) if c == "is_current" else F.col(c) for c in dimension.columns))
    return kept.unionByName(opened)


def rebuild(changes: DataFrame) -> DataFrame:
    """Every version that the change log knows, numbered per key; no change between two runs is lost."""
    rows = history(changes)
    number = F.row_number().over(Window.partitionBy("id").orderBy("valid_from_us")).cast("int")
    return rows.select(F.col("id").alias("customer_id"), *TRACKED, "valid_from_us", "valid_to_us", "is_current", number.alias("_record_version"))


def as_of(events: DataFrame, dimension: DataFrame, attributes: tuple[str, ...], at: str = "occurred_at", key: str = "customer_id", how: str = "left") -> DataFrame:
    """Events with the attributes of the version in force: valid_from <= at < valid_to (open where NULL).

    An equality join with a range residual. The dimension is cut to key, interval and attributes before the shuffle; a
    hot key's events are split by adaptive execution. With `left`, events without version keep NULLs. Columns of the
    dimension are renamed on the way, so equal names on both sides do not clash.
    """
    dim = dimension.select(F.col(key).alias("__k"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), *(F.col(a).alias(f"__a_{a}") for a in attributes))
    inside = (F.col("__from") <= F.col(at)) & (F.col("__to").isNull() | (F.col("__to") > F.col(at)))
    joined = events.join(dim, (F.col(key) == F.col("__k")) & inside, how)
    return joined.select(*(F.col(c) for c in events.columns if c not in attributes), *(F.col(f"__a_{a}").alias(a) for a in attributes))
