"""The registered queries of the general training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id
from lakesmith.operators import changefeed, counters, dedup, drift, history, knowntime, orphans
from lakesmith.plans.durable import durable
from lakesmith.tables import table


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_changes(durable(drift.field_statistics(table(spark, folder, "bronze_events"))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select(F.col("file").alias("source_file"), "field", "change")


def _aliases(spark: SparkSession, folder: str, paths: list[str]) -> list[tuple[str, str, str]]:
    return drift.field_aliases(_changes(spark, folder), paths)


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All records in one table with the fields of the catalogue."""
    rows = table(spark, folder, "field_catalog").select("event_type", "field_path", "json_type").distinct().orderBy("field_path", "json_type").collect()
    kinds: dict[str, set[str]] = {}
    for r in rows:
        kinds.setdefault(r["field_path"], set()).add(r["event_type"].lower())
    catalog = sorted({(r["field_path"], r["json_type"]) for r in rows})
    return drift.unify(table(spark, folder, "bronze_events"), catalog, _aliases(spark, folder, sorted(kinds)), kinds=kinds)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = counters.right_counts(table(spark, folder, "bronze_events"))
    wrong = counters.corrections(table(spark, folder, "gold_events_daily_summary"), counts)
    return wrong.select(F.col("event_date").cast("string").alias("event_date"), "customer_id", "event_type")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The right count of every key that has any."""
    return counters.right_counts(table(spark, folder, "bronze_events")).filter("event_count > 0")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    repeated = dedup.repeated(dedup.resolve(table(spark, folder, "bronze_events")))
    return repeated.select(F.col("id").alias("event_id"), F.col("us").alias("updated_us"))


def p3_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The events with every message once; times in microseconds."""
    rows = table(spark, folder, "bronze_events")
    # The accepted lines come from two plans over the same ranges, which are written once.
    once = dedup.single_copies(rows, dedup.accepted(dedup.resolve(rows, keep=durable)))
    times = ("occurred_at", "updated_at", "_ingested_at")
    return once.select(*(F.unix_micros(c).alias(f"{c.strip('_')}_us") if c in times else F.col(c) for c in once.columns))


def p3_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """What has been seen of each producer, as disjoint ranges of numbers within blocks."""
    return dedup.resolve(table(spark, folder, "bronze_events")).ranges


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = history.history(table(spark, folder, "bronze_customers"), keep=durable).filter("versions >= 2")
    return rows.select(F.col("id").alias("customer_id"), "valid_from_us", F.coalesce("valid_to_us", F.lit(0)).alias("valid_to_us"))


def p4_history(spark: SparkSession, folder: str) -> DataFrame:
    """The complete history of every customer."""
    rows = history.history(table(spark, folder, "bronze_customers"), keep=durable)
    return rows.select(F.col("id").alias("customer_id"), *history.TRACKED, "valid_from_us", "valid_to_us", "is_current")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(table(spark, folder, "silver_events"), table(spark, folder, "silver_customers"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("event_id", "reason")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.orphan_report(_orphans(spark, folder), "silver_events")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return knowntime.as_known(table(spark, folder, "silver_events"), table(spark, folder, "silver_customers"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    changed = _known(spark, folder).filter(F.col("known").isNotNull() & ~F.col("known.plan").eqNullSafe(F.col("latest.plan")))
    return changed.select(canonical_id("row.event_id").alias("event_id"), F.col("known.plan").alias("plan"))


def p6_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the plan known at its time."""
    return _known(spark, folder).select(
        canonical_id("row.event_id").alias("event_id"), canonical_id("row.customer_id").alias("customer_id"), F.unix_micros("row.occurred_at").alias("occurred_us"), F.col("known.plan").alias("plan")
    )


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.current_state(table(spark, folder, "bronze_events"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _state(spark, folder).filter("first_us <> updated_us").select("event_id", "updated_us", "state")


def p7_state(spark: SparkSession, folder: str) -> DataFrame:
    """The event table after all changes, each field under the name that the bronze job knew."""
    return _live(_state(spark, folder))


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The event table after all changes, each field under all names that it had."""
    names = [r["field_path"] for r in table(spark, folder, "field_catalog").select("field_path").distinct().collect()]
    aliases = _aliases(spark, folder, sorted({*names, *changefeed.FIELDS}))
    own = {f: tuple(sorted({name for _, name, to in aliases if to == f})) for f in changefeed.FIELDS}
    return _live(changefeed.current_state(table(spark, folder, "bronze_events"), aliases=own))


def _live(state: DataFrame) -> DataFrame:
    return state.filter("state = 'live'").drop("first_us", "state").withColumn("occurred_at", F.unix_micros("occurred_at"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_unified, p2_found, p2_counts, p3_found, p3_messages, p3_ranges, p4_found, p4_history, p5_found, p5_report, p6_found, p6_plans, p7_found, p7_state, p7_unified)
}
