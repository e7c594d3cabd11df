"""The registered queries of the pipeline's own operators over the bronze, silver and gold tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id, canonical_text, micros
from lakesmith.operators import analytics, medallion, merge, quality, scd2
from lakesmith.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The instant that checks of freshness are held against, and the range of an incremental read.
REFERENCE = "2026-05-13 00:00:00"
SINCE, UNTIL = "2026-03-20 00:00:00", "2026-04-20 00:00:00"
#: The page that is read, its size and how much it repeats of the one before.
PAGE, PAGE_SIZE, OVERLAP = 3, 500, 2
#: An event to look up, in a spelling that is not the stored one, and the month from which activity is counted again.
LOOKED_UP, MONTH = " E_00000001\n", "2026-04-01 00:00:00"
#: The day from which raw files count as newly arrived.
ARRIVED = "ingestion_date=2026-04"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _us(*names: str) -> list:
    return [micros(n).alias(f"{n.lstrip('_')}_us") for n in names]


def _bronze(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bronze_events")


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    """Silver events under their canonical keys."""
    events = table(spark, folder, "silver_events")
    return events.withColumns({"event_id": canonical_id("event_id"), "customer_id": canonical_id("customer_id"), "event_type": F.lower("event_type")})


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "silver_customers").withColumn("customer_id", canonical_id("customer_id"))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_events_daily_summary")


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """The newest change of each event in the columns of silver, and whether it deletes (`gone`)."""
    newest = medallion.newest_changes(_bronze(spark, folder))
    return medallion.normalized_events(newest, F.lit(REFERENCE).cast("timestamp"), "gone").withColumn("customer_id", canonical_id("customer_id"))


def _newest_customers(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "bronze_customers").withColumn("plan", canonical_text("plan")).drop("_raw_payload")
    return medallion.latest(lines, "customer_id")


@query
def json_extract_project(spark: SparkSession, folder: str) -> DataFrame:
    """The seven known fields of every raw line."""
    lines = _bronze(spark, folder).select("_raw_payload")
    return medallion.raw_events(lines).withColumn("line", F.md5("_raw_payload")).drop("_raw_payload")


@query
def iso_timestamp_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Both time fields of every raw line as instants."""
    raw = medallion.raw_events(_bronze(spark, folder).select("_raw_payload"))
    return raw.select(F.md5("_raw_payload").alias("line"), micros(medallion.instant(F.col("occurred_at"))).alias("occurred_us"), micros(medallion.instant(F.col("updated_at"))).alias("updated_us"))


@query
def record_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records per file, and how many have all required fields."""
    raw = medallion.raw_events(_bronze(spark, folder).select("_raw_payload", "_source_file"))
    return raw.groupBy(F.col("_source_file").alias("source_file")).agg(F.count(F.lit(1)).alias("records"), F.count_if(medallion.record_is_valid()).alias("valid"))


@query
def blank_line_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold more than blanks."""
    return table(spark, folder, "documents").filter(medallion.not_blank(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("length"))


@query
def incremental_since(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of a half-open range of update times."""
    rows = _bronze(spark, folder).filter((F.col("updated_at") >= F.lit(SINCE).cast("timestamp")) & (F.col("updated_at") < F.lit(UNTIL).cast("timestamp")))
    return rows.select("event_id", *_us("updated_at"), F.col("_batch_id").alias("batch_id"))


@query
def page_with_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """One page of the change log in its order, which repeats the end of the page before."""
    start = max(0, (PAGE - 1) * PAGE_SIZE - (OVERLAP if PAGE > 1 else 0))
    log = _bronze(spark, folder).select("event_id", *_us("updated_at", "_ingested_at"), F.md5("_raw_payload").alias("line"))
    ordered = log.orderBy(*(F.asc_nulls_first(c) for c in ("updated_at_us", "event_id", "ingested_at_us", "line")))
    return ordered.offset(start).limit(PAGE * PAGE_SIZE - start)


@query
def page_after_key(spark: SparkSession, folder: str) -> DataFrame:
    """The changes that follow a known one in the order of the change log, without going through those before it."""
    log = _bronze(spark, folder).select("event_id", "updated_at", F.md5("_raw_payload").alias("line")).filter("updated_at is not null")
    last = (F.lit(SINCE).cast("timestamp"), F.lit("e_0"), F.lit(""))
    return medallion.page_after(log, ("updated_at", "event_id", "line"), last, PAGE_SIZE).select("event_id", *_us("updated_at"), "line")


@query
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """All stored versions of one event, whatever its spelling."""
    return medallion.versions_of(_bronze(spark, folder), "event_id", LOOKED_UP).select("event_id", *_us("updated_at", "_ingested_at"), F.md5("_raw_payload").alias("line"))


@query
def public_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze events as the outside may see them."""
    rows = medallion.public_fields(_bronze(spark, folder))
    return rows.select(*(micros(c).alias(f"{c}_us") if c in ("occurred_at", "updated_at") else F.col(c) for c in rows.columns))


@query
def watermarks(spark: SparkSession, folder: str) -> DataFrame:
    """How far each source has been read: its greatest time of change."""
    newest = lambda name: table(spark, folder, f"bronze_{name}").agg(F.max(micros("updated_at")).alias("watermark_us")).select(F.lit(name).alias("source"), "watermark_us")
    return newest("events").unionByName(newest("customers"))


@query
def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and batches of both sources together, added up from the summaries of their batches."""
    parts = [table(spark, folder, f"bronze_{name}").groupBy("_batch_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("batches")) for name in ("events", "customers")]
    return parts[0].unionByName(parts[1]).agg(F.sum("records").alias("records"), F.sum("batches").alias("batches"))


@query
def literal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The checks and their severities as a table of literal rows."""
    return spark.sql("SELECT * FROM VALUES ('CHECK_UNIQUENESS', 'critical'), ('CHECK_REFERENTIAL_INTEGRITY', CAST(NULL AS STRING)), ('CHECK_VOLUMETRY', 'warning'), ('CHECK_DOMAIN_VALUES', 'critical'), ('CHECK_FRESHNESS', 'warning') AS t(check_name, severity)")


@query
def reconcile_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers on whom the newest CRM lines and the current dimension do not agree."""
    current = medallion.latest(_customers(spark, folder).filter("is_current").select("customer_id", "valid_from", "plan", "segment", "country", "is_active"), "customer_id", ("valid_from",))
    return medallion.reconciled(_newest_customers(spark, folder), current, "customer_id", ("plan", "segment", "country", "is_active"))


@query
def raw_line_set_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The set of raw lines after the newly arrived files are merged into the existing ones."""
    lines = _bronze(spark, folder).select(F.md5("_raw_payload").alias("line"), F.contains("_source_file", F.lit(ARRIVED)).alias("new"))
    old, new = lines.filter("not new"), lines.filter("new")
    return merge.merge_lines(old.select("line").distinct(), new, "line")


@query
def source_state(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last change of every ingestion batch."""
    return _bronze(spark, folder).groupBy(F.col("_batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("visible"), F.min(micros("updated_at")).alias("first_us"), F.max(micros("updated_at")).alias("last_us"))


@query
def bronze_customer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw customer lines as bronze rows."""
    rows = medallion.bronze_customers(table(spark, folder, "bronze_customers"))
    return rows.select(F.md5("_raw_payload").alias("line"), "customer_id", "plan", "segment", "signup_date", "country", "is_active", *_us("updated_at"))


@query
def dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest change of every event."""
    newest = medallion.latest(_bronze(spark, folder).select("event_id", "updated_at", "_ingested_at", "_batch_id"), "event_id")
    return newest.select("event_id", *_us("updated_at", "_ingested_at"), F.col("_batch_id").alias("batch_id"))


@query
def normalize_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of every event that is not deleted, in the columns of silver."""
    return _incoming(spark, folder).filter("not gone").select("event_id", "customer_id", "has_customer_id", "event_type", *_us("updated_at"), "properties_valid_json")


@query
def events_daily_summary(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.daily_summary(_silver(spark, folder)).select("event_date", "customer_id", "event_type", "event_count", *_us("last_occurred_at"))


@query
def ticket_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of tickets with what their properties say."""
    return medallion.ticket_events(_silver(spark, folder)).select("event_id", "customer_id", "ticket_id", "event_type", *_us("occurred_at"), "agent_id")


@query
def customer_monthly_activity(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.monthly_activity(_silver(spark, folder), _customers(spark, folder))


@query
def merge_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Silver after newer bronze rows have replaced older silver rows of the same event, and deletes have removed them."""
    merged = merge.merge(_silver(spark, folder), _incoming(spark, folder), ("event_id",), when=F.col("s.updated_at") > F.col("t.updated_at"), remove=F.col("s.gone"))
    return merged.select("event_id", "customer_id", "event_type", *_us("updated_at"))


def _fresh_summary(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.daily_summary(_silver(spark, folder))


@query
def merge_null_safe(spark: SparkSession, folder: str) -> DataFrame:
    """The daily summary after a recomputed one is merged into it; keys with NULL match themselves."""
    merged = merge.merge(_summary(spark, folder), _fresh_summary(spark, folder), ("event_date", "customer_id", "event_type"))
    return merged.select("event_date", "customer_id", "event_type", "event_count")


@query
def merge_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The same merge, with keys that the recomputed summary no longer holds removed."""
    merged = merge.merge(_summary(spark, folder), _fresh_summary(spark, folder), ("event_date", "customer_id", "event_type"), delete_unmatched=True)
    return merged.select("event_date", "customer_id", "event_type", "event_count")


@query
def merge_ticket_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ticket events of an earlier state of silver after those of the present one are merged into them, whatever their times."""
    events = _silver(spark, folder)
    earlier = medallion.ticket_events(events.filter(F.col("updated_at") < F.lit(SINCE).cast("timestamp")).withColumn("channel", F.lit("stale")))
    return merge.merge(earlier, medallion.ticket_events(events), ("event_id",)).select("event_id", "customer_id", "ticket_id", "event_type", *_us("occurred_at"), "agent_id", "channel")


@query
def merge_monthly_activity(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly activity of an earlier state of silver after that of later months is merged into it."""
    events, customers = _silver(spark, folder), _customers(spark, folder)
    until, since = (F.col("occurred_at") < F.lit(UNTIL).cast("timestamp")), (F.col("occurred_at") >= F.lit(MONTH).cast("timestamp"))
    return merge.merge(medallion.monthly_activity(events.filter(until), customers), medallion.monthly_activity(events.filter(since), customers), ("activity_month", "customer_id"))


@query
def merge_volume_history(spark: SparkSession, folder: str) -> DataFrame:
    """The volume history recorded earlier after a new count of the days since; days counted again are replaced."""
    events = _silver(spark, folder)
    recorded = quality.volume_history(events.filter(F.col("updated_at") < F.lit(UNTIL).cast("timestamp")), "silver.events", "occurred_at")
    counted = quality.volume_history(events.filter(F.col("occurred_at") >= F.lit(SINCE).cast("timestamp")), "silver.events", "occurred_at")
    return merge.merge(recorded, counted, ("table_name", "metric_date"))


@query
def merge_insert_only(spark: SparkSession, folder: str) -> DataFrame:
    """Current customers, and those of the CRM that are missing among them."""
    current = _customers(spark, folder).filter("is_current").select("customer_id", "plan", "segment", "country")
    return merge.insert_missing(current, _newest_customers(spark, folder), ("customer_id",))


@query
def merge_update_only(spark: SparkSession, folder: str) -> DataFrame:
    """Current customers with their plan corrected from the newest CRM line; nothing is inserted."""
    current = _customers(spark, folder).filter("is_current").select("customer_id", "plan", "segment", "updated_at")
    merged = merge.merge(current, _newest_customers(spark, folder), ("customer_id",), when=F.col("s.updated_at") > F.col("t.updated_at"), insert=False, set_columns={"plan": F.col("s.plan")})
    return merged.select("customer_id", "plan", "segment", *_us("updated_at"))


@query
def scd2_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions that the CRM lines know."""
    return scd2.rebuild(table(spark, folder, "bronze_customers"))


@query
def scd2_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension after one run with the newest CRM line of every customer."""
    rows = scd2.apply_latest(_customers(spark, folder), _newest_customers(spark, folder), loaded_at=F.lit(REFERENCE).cast("timestamp"))
    return rows.select("customer_id", "plan", "segment", "country", "is_active", *_us("valid_from", "valid_to"), "is_current", F.col("_record_version").alias("record_version"))


@query
def scd2_current(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder).filter("is_current").select("customer_id", "plan", "segment", "country", *_us("valid_from"))


@query
def asof_join_inner(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the plan in force; events without a version drop out."""
    return scd2.as_of(_silver(spark, folder), _customers(spark, folder), ("plan",), how="inner").select("event_id", "customer_id", *_us("occurred_at"), "plan")


@query
def asof_join_left(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the plan in force, NULL where there is none."""
    return scd2.as_of(_silver(spark, folder), _customers(spark, folder), ("plan",)).select("event_id", "customer_id", *_us("occurred_at"), "plan")


@query
def top_customers_30d(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_customers(_summary(spark, folder), _customers(spark, folder))


@query
def first_response_by_plan_month(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.first_response(medallion.ticket_events(_silver(spark, folder)), _customers(spark, folder))


@query
def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    customers = _customers(spark, folder)
    return analytics.cohort_retention(medallion.monthly_activity(_silver(spark, folder), customers), customers)


@query
def volume_history(spark: SparkSession, folder: str) -> DataFrame:
    return quality.volume_history(_silver(spark, folder), "silver.events", "occurred_at")


def _check(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(_silver(spark, folder), _customers(spark, folder))

    run.__name__ = name
    query(run)


_reference = lambda: F.lit(REFERENCE).cast("timestamp")
_check("check_uniqueness", lambda e, c: quality.uniqueness(e, ("event_id",), "silver.events").unionByName(quality.uniqueness(c, ("customer_id", "valid_from"), "silver.customers")))
_check("check_referential_integrity", lambda e, c: quality.referential_integrity(e, c))
_check("check_volumetry", lambda e, c: quality.volumetry(quality.volume_history(e, "silver.events", "occurred_at"), "silver.events"))
_check("check_domain_values", lambda e, c: quality.domain_values(e, "event_type", medallion.EVENT_TYPES, "silver.events").unionByName(quality.domain_values(c, "plan", medallion.PLANS, "silver.customers")))
_check("check_freshness", lambda e, c: quality.freshness(e, _reference()))
_check("check_ticket_uniqueness", lambda e, c: quality.uniqueness(medallion.ticket_events(e).filter("event_type = 'ticket_opened' and ticket_id is not null"), ("ticket_id",), "gold.ticket_events"))
_check("check_details", lambda e, c: quality.details(e, c, _reference()))
_check("quality_report", lambda e, c: quality.report(e, c, _reference()))


@query
def properties_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Which properties the events of each type carry."""
    return medallion.properties_schema(_silver(spark, folder))


@query
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The declared constraints of the customers at the source, held against their lines as delivered."""
    lines = table(spark, folder, "bronze_customers")
    return quality.violations(lines, "customers", ("customer_id", "company_name", "plan", "country", "updated_at"), ("customer_id", "updated_at"), {"plan": medallion.PLANS})
