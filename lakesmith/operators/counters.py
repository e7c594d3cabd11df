"""Per-period counts by event time that late, repeated and reordered records correct (conflict-free counters).

Two lattices, both merged by a maximum, so that retries and reordering change nothing:

* an *event cell* per event (first and last change, whether the last one deletes, the event's own time and attributes);
* a *counter* per (period, attributes, source), holding (sequence, count). A source is a shard of the event identifiers
  and the only one that ever counts its events; it emits the cumulative count of a key whenever a batch of arrivals moved
  that count, under the sequence of the batch: one more for an event that entered the key, one less for an event that was
  deleted, came too late or went to another key, down to 0 for a key that no event is left in. Emissions of one source
  merge by the greatest sequence; the value of a key is the sum over its sources.

Arrivals of one sequence are one emission, so no two emissions of a source and key ever share a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id, micros, utc_date
from lakesmith.functions.payload import is_delete, markers

#: Shards of the event identifiers that count on their own.
SOURCES = 64

#: An event counts when its first change became visible at most this long after it occurred.
CUT_OFF_US = 72 * 3_600_000_000

KEY = ("event_date", "customer_id", "event_type")

_GREATEST = ("last", "occurred_us", "customer_id", "event_type")


def arrivals(changes: DataFrame, sequence: Column | None = None) -> DataFrame:
    """(event_id, sequence, first_us, last, occurred_us, customer_id, event_type): a cell of each event's changes in each batch of arrivals.

    The sequence is the arrival time, or the change's own time where that is NULL, unless one is given for all rows.
    `last` is 2 * updated_at + deleted. Repeated changes collapse on the map side already. Rows without event_id or
    updated_at are left out; where changes of an event disagree on an attribute, the greatest value stands.
    """
    marked = changes.select(
        canonical_id("event_id").alias("event_id"), micros("updated_at").alias("us"), (F.coalesce(micros("_ingested_at"), micros("updated_at")) if sequence is None else sequence).alias("sequence"),
        micros("occurred_at").alias("occurred_us"), canonical_id("customer_id").alias("customer_id"), canonical_id("event_type").alias("event_type"), markers(F.col("_raw_payload")).alias("m"),
    ).filter("event_id is not null and us is not null")
    return merge_cells(marked.select("*", (F.col("us") * 2 + is_delete(F.col("m")).cast("int")).alias("last"), F.col("us").alias("first_us")), "sequence")


def merge_cells(cells: DataFrame, *by: str) -> DataFrame:
    """The least upper bound of each event's cells from any number of batches, in any order and however often."""
    return cells.groupBy("event_id", *by).agg(F.min("first_us").alias("first_us"), *(F.max(c).alias(c) for c in _GREATEST))


def _counted(cell: Column, cut_off_us: int) -> Column:
    """The key under which a cell counts, NULL where it does not: deleted, after the cut-off (inclusive), or without time, customer or type."""
    right = (cell["last"].bitwiseAND(1) == 0) & (cell["first_us"] - cell["occurred_us"] <= cut_off_us) & cell["customer_id"].isNotNull() & cell["event_type"].isNotNull()
    return F.when(right, F.struct(utc_date(cell["occurred_us"]).alias("event_date"), cell["customer_id"].alias("customer_id"), cell["event_type"].alias("event_type")))


def movements(cells: DataFrame, cut_off_us: int = CUT_OFF_US, sources: int = SOURCES) -> DataFrame:
    """(event_date, customer_id, event_type, source, sequence, n): by how much each batch of arrivals moved each count.

    cells: one per event and sequence. An event's cells are joined in order of their sequence; where the key it counts
    under changes thereby, the old key loses it and the new one gets it.
    """
    so_far = Window.partitionBy("event_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    joined = cells.select("event_id", "sequence", F.struct(F.min("first_us").over(so_far).alias("first_us"), *(F.max(c).over(so_far).alias(c) for c in _GREATEST)).alias("cell"))
    now = joined.select("event_id", "sequence", _counted(F.col("cell"), cut_off_us).alias("now"))
    both = now.withColumn("was", F.lag("now").over(Window.partitionBy("event_id").orderBy("sequence"))).filter(~F.col("now").eqNullSafe(F.col("was")))
    source = F.pmod(F.xxhash64("event_id"), F.lit(sources)).cast("int")
    steps = both.select(source.alias("source"), "sequence", F.explode(F.array(F.struct(F.col("was").alias("key"), F.lit(-1).alias("n")), F.struct(F.col("now").alias("key"), F.lit(1).alias("n")))).alias("step"))
    steps = steps.filter("step.key is not null").select("step.key.*", "source", "sequence", F.col("step.n").alias("n"))
    return steps.groupBy(*KEY, "source", "sequence").agg(F.sum("n").alias("n"))


def emissions(moved: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(event_date, customer_id, event_type, source, sequence, n): the cumulative counts that each source emits, one per sequence that moved them.

    held: the merged counters of all earlier sequences, on which these go on; they are not emitted again.
    """
    steps = moved.select(*KEY, "source", "sequence", "n", F.lit(True).alias("new"))
    if held is not None:
        touched = moved.select(*KEY, "source").distinct()
        steps = steps.unionByName(held.join(touched, [*KEY, "source"], "left_semi").select(*KEY, "source", "sequence", "n", F.lit(False).alias("new")))
    so_far = Window.partitionBy(*KEY, "source").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*KEY, "source", "sequence", F.sum("n").over(so_far).alias("n"), "new").filter("new").drop("new")


def merge_counters(states: DataFrame) -> DataFrame:
    """Per key and source the count of the greatest sequence, of any emissions in any order and however often."""
    return states.groupBy(*KEY, "source").agg(F.max("sequence").alias("sequence"), F.max_by("n", "sequence").alias("n"))


def totals(states: DataFrame) -> DataFrame:
    """(event_date, customer_id, event_type, event_count): the sum over the sources of merged counters; keys that count 0 are kept."""
    return states.groupBy(*KEY).agg(F.sum("n").alias("event_count"))


def right_counts(changes: DataFrame, cut_off_us: int = CUT_OFF_US) -> DataFrame:
    """The counts that the changes give: every emission of every source, merged and added up. An empty input gives an empty table."""
    return totals(merge_counters(emissions(movements(arrivals(changes), cut_off_us))))


def advance(cells: DataFrame, held: DataFrame, changes: DataFrame, sequence: int, cut_off_us: int = CUT_OFF_US) -> tuple[DataFrame, DataFrame]:
    """(cells, emissions) that one batch of changes adds to the state of all batches before it; both only get longer.

    cells: one per event and earlier batch at most, held: all emissions so far. The batch's sequence must exceed theirs.
    A batch that was applied in part is applied again to the state before it and emits the same.
    """
    new = arrivals(changes, F.lit(sequence).cast("long"))
    before = merge_cells(cells.filter(F.col("sequence") < sequence).join(new.select("event_id"), "event_id", "left_semi")).withColumn("sequence", F.lit(sequence - 1).cast("long"))
    moved = movements(before.unionByName(new), cut_off_us).filter(F.col("sequence") == sequence)
    return new, emissions(moved, merge_counters(held.filter(F.col("sequence") < sequence)))


def corrections(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """(event_date, customer_id, event_type, was, event_count): the keys whose stored count differs; 0 stands for no row.

    Rows of the summary whose key holds a NULL are left out; several rows of one key add up.
    """
    stored = (
        summary.select("event_date", canonical_id("customer_id").alias("customer_id"), canonical_id("event_type").alias("event_type"), F.col("event_count").alias("n"))
        .filter("event_date is not null and customer_id is not null and event_type is not null")
        .groupBy(*KEY).agg(F.sum("n").alias("was"))
    )
    both = counts.join(stored, list(KEY), "full_outer")
    return both.select(*KEY, F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("event_count", F.lit(0)).alias("event_count")).filter("was <> event_count")
