"""Full history of changing attributes from updates and snapshots (checkpoint-delta storage).

The lines of an entity are stored by period: a checkpoint with the full version in force where the period begins (where
the entity begins, in its first period), and a patch with the changed attributes for every line that changed any. Validity
rows come back by folding the patches forward from the checkpoint of their period and comparing the folded versions: one
begins where a folded version differs from the one before. No fold is longer than a period, so an entity with very many
lines is spread over its periods; what crosses a period is one line per entity and period.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.functions.canon import DAY_US, canonical_id, canonical_text, micros

TRACKED = ("plan", "segment", "is_active", "country")

#: The distance of checkpoints; what one task folds of a hot entity at a time.
PERIOD_US = 7 * DAY_US


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def attribute_lines(rows: DataFrame, key: str = "customer_id", at: str = "updated_at", tracked: tuple[str, ...] = TRACKED, canonical: tuple[str, ...] = ("plan",), arrival: str = "_ingested_at") -> DataFrame:
    """(id, us, attrs): one line per entity and instant. Repeated lines collapse on the map side; where lines of one
    instant disagree, the one that arrived last stands (then the greatest attributes). Lines without entity or instant are left out."""
    attrs = F.struct(*((canonical_text(c) if c in canonical else _text(c)).alias(c) for c in tracked))
    lines = rows.select(canonical_id(key).alias("id"), micros(at).alias("us"), F.struct(micros(arrival).alias("seen"), attrs.alias("attrs")).alias("line"))
    return lines.filter("id is not null and us is not null").groupBy("id", "us").agg(F.max("line").alias("line")).select("id", "us", F.col("line.attrs").alias("attrs"))


def _differs(a: Column, b: Column, tracked: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (~a[c].eqNullSafe(b[c]) for c in tracked))


def store_versions(lines: DataFrame, tracked: tuple[str, ...] = TRACKED, period_us: int = PERIOD_US) -> DataFrame:
    """The checkpoint-delta store: (id, period, us, is_checkpoint, opens, patch), patch being a map of attribute to value (NULL is a value).

    A checkpoint holds all tracked attributes as of us: the entity's first line, which opens its history, or the beginning
    of a later period that has lines of its own. All other entries are patches against the line before.
    """
    lines = lines.withColumn("period", F.floor(F.col("us") / F.lit(period_us)))
    tails = lines.groupBy("id", "period").agg(F.max(F.struct("us", "attrs")).alias("tail"))
    carried = tails.select("id", "period", F.lag("tail").over(Window.partitionBy("id").orderBy("period")).alias("tail")).filter("tail is not null")
    # The last line of an earlier period leads the period's own lines. A line of the very first instant of a period stays behind it.
    both = lines.select("id", "period", "us", "attrs", F.lit(1).alias("own")).unionByName(carried.select("id", "period", (F.col("period") * F.lit(period_us)).alias("us"), F.col("tail.attrs").alias("attrs"), F.lit(0).alias("own")))
    order = Window.partitionBy("id", "period").orderBy("us", "own")
    both = both.withColumn("before", F.lag("attrs").over(order)).withColumn("is_checkpoint", F.col("before").isNull())
    keeps = lambda c: F.col("is_checkpoint") | ~F.col("attrs")[c].eqNullSafe(F.col("before")[c])
    entries = F.array_compact(F.array(*(F.when(keeps(c), F.struct(F.lit(c).alias("key"), F.col("attrs")[c].alias("value"))) for c in tracked)))
    return both.withColumn("entries", entries).filter(F.size("entries") > 0).select("id", "period", "us", "is_checkpoint", (F.col("is_checkpoint") & (F.col("own") == 1)).alias("opens"), F.map_from_entries("entries").alias("patch"))


def fold_versions(store: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """(id, valid_from_us, valid_to_us, is_current, versions, tracked...): validity rows out of the store.

    valid_to_us is where the next version begins, NULL for the current one; versions is how many the entity has.
    """
    # After the checkpoint of its period an attribute has the value of the last patch that holds it.
    ordered = Window.partitionBy("id", "period").orderBy("us", F.desc("is_checkpoint"))
    fold = ordered.rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(F.map_contains_key("patch", F.lit(c)), F.struct(F.try_element_at("patch", F.lit(c)).alias("v"))), ignorenulls=True).over(fold)["v"]
    folded = store.select("id", "period", "us", "is_checkpoint", "opens", F.struct(*(held(c).alias(c) for c in tracked)).alias("attrs"))
    folded = folded.withColumn("before", F.lag("attrs").over(ordered))
    # Checkpoints after the first one repeat what was in force.
    rows = folded.filter(F.when(F.col("is_checkpoint"), F.col("opens")).otherwise(_differs(F.col("attrs"), F.col("before"), tracked)))
    rows = rows.select("id", "period", "us", F.lead("us").over(Window.partitionBy("id", "period").orderBy("us")).alias("next_us"), *(F.col("attrs")[c].alias(c) for c in tracked))
    spans = rows.groupBy("id", "period").agg(F.min("us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("id")
    spans = spans.select("id", "period", F.lead("first_us").over(whole.orderBy("period")).alias("after_us"), F.sum("n").over(whole).alias("versions"))
    end = F.coalesce("next_us", "after_us")
    return rows.join(spans, ["id", "period"]).select("id", F.col("us").alias("valid_from_us"), end.alias("valid_to_us"), end.isNull().alias("is_current"), "versions", *tracked)


def history(rows: DataFrame, key: str = "customer_id", at: str = "updated_at", tracked: tuple[str, ...] = TRACKED, canonical: tuple[str, ...] = ("plan",), arrival: str = "_ingested_at", period_us: int = PERIOD_US, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The complete history of every entity in `rows`; tracked attributes come as text. Empty in, empty out; extra columns are never read.

    keep writes the store, which two plans read.
    """
    return fold_versions(keep(store_versions(attribute_lines(rows, key, at, tracked, canonical, arrival), tracked, period_us)), tracked)
