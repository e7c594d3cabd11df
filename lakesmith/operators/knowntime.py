"""Attributes as they were known at an event's time (point-in-time join without leakage).

Events and attribute changes are united, sorted by entity and availability time, and the last known attributes carried
forward. A change is available once it is both valid and loaded. At the same instant a change comes before an event.
Time is cut into periods, so an entity that makes up a third of all events is spread over many tasks: what enters a
period is one line per entity, the best change of all earlier periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.functions.canon import DAY_US, canonical_id, micros

#: Length of the periods that one entity's timeline is cut into.
PERIOD_US = DAY_US

#: Order of lines at one instant: what earlier periods carried over, then changes, then events.
CARRIED, CHANGE, EVENT = 0, 1, 2


def as_known(events: DataFrame, versions: DataFrame, attributes: tuple[str, ...] = ("plan",), key: str = "customer_id", at: str = "occurred_at", valid: str = "valid_from", loaded: str = "_silver_loaded_at", period_us: int = PERIOD_US) -> DataFrame:
    """(row, known, latest): every row of `events` as a struct with the attributes known at its time and the newest ones.

    known holds (valid_us, attributes...) of the known version with the greatest valid_from, latest those of the
    entity's version with the greatest valid_from at all; both are NULL where there is none. Versions of one entity that
    share valid_from are ordered by their attributes, the greatest stands. Versions without entity, valid_from or load
    time are never known; without valid_from they are never the latest either. Rows without entity or time keep NULLs.
    Columns of the events cannot clash with anything, as they stay inside `row`.
    """
    changes = versions.select(canonical_id(key).alias("id"), micros(valid).alias("valid_us"), micros(loaded).alias("loaded_us"), F.struct(micros(valid).alias("valid_us"), *(F.col(a) for a in attributes)).alias("v"))
    changes = changes.filter("id is not null and valid_us is not null").select("id", F.when(F.col("loaded_us").isNotNull(), F.greatest("valid_us", "loaded_us")).alias("us"), "v")
    rows = events.select(F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("row"), canonical_id(key).alias("id"), micros(at).alias("us"))
    timed, untimed = rows.filter("id is not null and us is not null"), rows.filter("id is null or us is null")
    period = F.floor(F.col("us") / F.lit(period_us)).alias("period")

    # One line per entity and period: its best change. Their running maximum enters the later periods.
    best = changes.groupBy("id", period).agg(F.max("v").alias("v"))
    periods = timed.select("id", period).distinct()
    merged = best.select("id", "period", "v").unionByName(periods, allowMissingColumns=True).groupBy("id", "period").agg(F.max("v").alias("v"))
    by_time = Window.partitionBy("id").orderBy(F.asc_nulls_last("period"))
    entering = F.max("v").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    carried = merged.select("id", "period", entering.alias("v"), F.max("v").over(Window.partitionBy("id")).alias("latest")).filter("period is not null")

    lines = (
        timed.select("id", period, "us", F.lit(EVENT).alias("kind"), "row")
        .unionByName(changes.filter("us is not null").select("id", period, "us", F.lit(CHANGE).alias("kind"), "v"), allowMissingColumns=True)
        .unionByName(carried.select("id", "period", F.lit(CARRIED).alias("kind"), "v", "latest"), allowMissingColumns=True)
    )
    order = Window.partitionBy("id", "period").orderBy(F.asc_nulls_first("us"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = lines.select("row", "kind", F.max("v").over(order).alias("known"), F.max("latest").over(order).alias("latest")).filter(F.col("kind") == EVENT).drop("kind")
    return known.unionByName(untimed.select("row"), allowMissingColumns=True)
