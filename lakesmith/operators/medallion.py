"""The pure transformations of the pipeline: raw lines to bronze, bronze to silver, silver to gold. No input or output here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id
from lakesmith.functions.payload import is_delete, json_type, markers

#: The event types and plans of the domain, and those event types that belong to a ticket.
EVENT_TYPES = ("ticket_opened", "ticket_replied", "ticket_closed", "login", "feature_used", "export_generated", "report_viewed", "subscription_changed")
PLANS = ("free", "pro", "enterprise")
TICKET_TYPES = ("ticket_opened", "ticket_replied", "ticket_closed")
#: The fields of raw events and customer lines, and those that an event must have.
EVENT_FIELDS = ("event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties")
CUSTOMER_FIELDS = ("customer_id", "company_name", "plan", "segment", "signup_date", "country", "is_active", "updated_at")
REQUIRED = ("event_id", "event_type", "occurred_at", "updated_at")

#: The two spellings of an instant in raw records.
INSTANTS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")


def instant(text: Column) -> Column:
    """The TIMESTAMP of an ISO text in either spelling; NULL for anything else."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in INSTANTS))


def not_blank(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _fields(payload: Column, names: tuple[str, ...]) -> list[Column]:
    # A broken line yields nothing, not the fields before the break.
    whole = F.when(F.get_json_object(payload, "$").isNotNull(), payload)
    return [F.get_json_object(whole, f"$.{n}").alias(n) for n in names]


def raw_events(lines: DataFrame, payload: str = "_raw_payload") -> DataFrame:
    """Each raw line with the text of the seven known event fields; unknown fields stay in the payload."""
    return lines.select("*", *_fields(F.col(payload), EVENT_FIELDS))


def bronze_events(lines: DataFrame) -> DataFrame:
    """Raw lines (with their control columns) as bronze events: one row per line, unreadable values NULL."""
    parsed = raw_events(lines.select("_raw_payload", "_source_file", "_ingested_at", "_batch_id"))
    return parsed.select(
        "event_id", "customer_id", "event_type", instant(F.col("occurred_at")).alias("occurred_at"), instant(F.col("updated_at")).alias("updated_at"), "channel", "properties",
        "_raw_payload", "_source_file", "_ingested_at", "_batch_id",
    )


def bronze_customers(lines: DataFrame) -> DataFrame:
    """Raw lines as bronze customers: one row per line, unreadable values NULL."""
    parsed = lines.select("_raw_payload", "_source_file", "_ingested_at", "_batch_id", *_fields(F.col("_raw_payload"), CUSTOMER_FIELDS))
    return parsed.select(
        "customer_id", "company_name", "plan", "segment", F.try_to_date("signup_date", "yyyy-MM-dd").alias("signup_date"), "country", F.col("is_active").try_cast("boolean").alias("is_active"),
        instant(F.col("updated_at")).alias("updated_at"), "_raw_payload", "_source_file", "_ingested_at", "_batch_id",
    )


def record_is_valid(columns: tuple[str, ...] = REQUIRED) -> Column:
    """Whether all required fields are there; a warning only, records are never filtered by it."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def latest(rows: DataFrame, key: str, order: tuple[str, ...] = ("updated_at", "_ingested_at", "_batch_id"), canonical: bool = True) -> DataFrame:
    """One row per key: the greatest by `order`, NULL counting as smallest; then the greatest remaining columns.

    An aggregate, so the copies of a key collapse before the shuffle and a hot key is no hot task. Rows without key are
    dropped here; the pipeline sets them aside first. With `canonical`, spellings of one key are one, and it comes out canonical.
    """
    k = canonical_id(key) if canonical else F.col(key)
    rest = [c for c in rows.columns if c not in order and c != key]
    best = F.max(F.struct(*order, *rest)).alias("__best")
    return rows.withColumn(key, k).filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(*(F.col(key) if c == key else F.col(f"__best.`{c}`") for c in rows.columns))


def newest_changes(bronze: DataFrame) -> DataFrame:
    """The newest change of every event as bronze columns without the payload, and whether it deletes (`gone`).

    The payload is read for its marker before the shuffle and stays behind. Rows without event_id are dropped here.
    """
    own = ("event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties", "_ingested_at", "_batch_id")
    return latest(bronze.select(*own, is_delete(markers(F.col("_raw_payload"))).alias("gone")), "event_id")


def versions_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All stored versions of one record, oldest first; an unknown key gives no rows. The identifier may be in any spelling."""
    return rows.filter(canonical_id(key) == canonical_id(F.lit(value))).orderBy("updated_at", "_ingested_at")


def page_after(rows: DataFrame, order: tuple[str, ...], last: tuple, size: int) -> DataFrame:
    """The next `size` rows in an order behind the row whose values are `last`, NULL being smallest; no depth is sorted through.

    The bound on the first column alone is a filter that the scan can use.
    """
    first, *rest = order
    behind = F.lit(False)
    for i in reversed(range(len(order))):
        c, v = F.col(order[i]), F.lit(last[i])
        behind = (c > v) | ((c == v) & behind)
    return rows.filter((F.col(first) >= F.lit(last[0])) & behind).orderBy(*(F.asc_nulls_first(c) for c in (first, *rest))).limit(size)


def public_fields(rows: DataFrame) -> DataFrame:
    """The rows without the columns whose names begin with an underscore, which are nobody's business outside."""
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")))


def reconciled(source: DataFrame, target: DataFrame, key: str, compared: tuple[str, ...]) -> DataFrame:
    """(key, in_source, in_target, differing): the keys that two catalogues do not agree on, and the columns in which they differ.

    Both sides hold a key once. NULL equals NULL; keys that are NULL are left out.
    """
    side = lambda df, name: df.filter(F.col(key).isNotNull()).select(F.col(key), F.struct(*compared).alias(name))
    both = side(source, "s").join(side(target, "t"), key, "full_outer")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), c) for c in compared)))
    there = F.col("s").isNotNull() & F.col("t").isNotNull()
    return both.select(key, F.col("s").isNotNull().alias("in_source"), F.col("t").isNotNull().alias("in_target"), F.when(there, F.array_join(differing, ",")).alias("differing")).filter("not in_source or not in_target or differing <> ''")


def properties_schema(events: DataFrame) -> DataFrame:
    """(event_type, property, json_type, n): which properties the events of each type carry, and as what.

    Counted over all rows; broken or missing properties have none. A report only, so it never fails a run.
    """
    entries = events.select("event_type", F.explode(F.expr("try_variant_get(try_parse_json(properties), '$', 'map<string,variant>')")).alias("property", "value"))
    return entries.groupBy("event_type", "property", json_type(F.to_json("value")).alias("json_type")).agg(F.count(F.lit(1)).alias("n"))


def valid_json(text: Column) -> Column:
    """NULL is valid (nothing was said), '' and broken texts are not; scalars are."""
    return text.isNull() | F.get_json_object(text, "$").isNotNull()


def normalized_events(bronze: DataFrame, loaded_at: Column | None = None, *more: str) -> DataFrame:
    """Bronze events (one per key already) in the columns of silver, and some more. Events without or with unknown customers are kept."""
    return bronze.select(
        "event_id", "customer_id", F.col("customer_id").isNotNull().alias("has_customer_id"), F.lower("event_type").alias("event_type"), "occurred_at", "updated_at", "channel", "properties",
        valid_json(F.col("properties")).alias("properties_valid_json"), (F.current_timestamp() if loaded_at is None else loaded_at).alias("_silver_loaded_at"), *more,
    )


def daily_summary(events: DataFrame) -> DataFrame:
    """Events per (date, customer, type), NULLs being keys like any other."""
    return events.groupBy(F.to_date("occurred_at").alias("event_date"), "customer_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.max("occurred_at").alias("last_occurred_at"))


def ticket_events(events: DataFrame) -> DataFrame:
    """The ticket events with ticket_id and agent_id out of their properties."""
    return events.filter(F.col("event_type").isin(*TICKET_TYPES)).select(
        "event_id", "customer_id", F.get_json_object("properties", "$.ticket_id").alias("ticket_id"), "event_type", "occurred_at", F.get_json_object("properties", "$.agent_id").alias("agent_id"), "channel"
    )


def monthly_activity(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Events per (month, customer) with the customer's signup month; events without customer are left out, unknown customers have a NULL signup month.

    The events are aggregated first, so the join sees one row per month and customer and knows no hot key.
    """
    active = events.filter("customer_id is not null").groupBy(F.trunc("occurred_at", "month").alias("activity_month"), "customer_id").agg(F.count(F.lit(1)).alias("event_count"))
    signups = customers.filter("is_current").groupBy("customer_id").agg(F.min(F.trunc("signup_date", "month")).alias("signup_month"))
    return active.join(signups, "customer_id", "left").select("activity_month", "customer_id", (F.col("event_count") > 0).alias("has_activity"), "event_count", "signup_month")
