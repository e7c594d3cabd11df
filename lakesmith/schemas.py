"""The fixed schemas of the medallion tables, and the keys and partition columns of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

CONTROL = "_raw_payload string, _source_file string, _ingested_at timestamp, _batch_id string"


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...] = ()
    partition: str | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


#: partition is a derived column: the day or month of the named timestamp, as identity partitioning needs a stored value.
TABLES = {
    "bronze.events": Table(f"event_id string, customer_id string, event_type string, occurred_at timestamp, updated_at timestamp, channel string, properties string, {CONTROL}", (), "day:occurred_at"),
    "bronze.customers": Table(f"customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp, {CONTROL}", (), "day:updated_at"),
    "silver.events": Table(
        "event_id string, customer_id string, has_customer_id boolean, event_type string, occurred_at timestamp, updated_at timestamp, channel string, properties string, properties_valid_json boolean, _silver_loaded_at timestamp",
        ("event_id",), "month:occurred_at"),
    "silver.customers": Table(
        "customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp, valid_from timestamp, valid_to timestamp, is_current boolean, _record_version int, _silver_loaded_at timestamp",
        ("customer_id", "valid_from"), "month:valid_from"),
    "gold.events_daily_summary": Table("event_date date, customer_id string, event_type string, event_count bigint, last_occurred_at timestamp, updated_at timestamp", ("event_date", "customer_id", "event_type"), "month:event_date"),
    "gold.ticket_events": Table("event_id string, customer_id string, ticket_id string, event_type string, occurred_at timestamp, agent_id string, channel string", ("event_id",), "month:occurred_at"),
    "gold.customer_monthly_activity": Table("activity_month date, customer_id string, has_activity boolean, event_count bigint, signup_month date", ("activity_month", "customer_id"), "month:activity_month"),
    "quality.volume_history": Table("table_name string, metric_date date, record_count bigint, recorded_at timestamp", ("table_name", "metric_date"), None),
    "quality.check_results": Table(
        "check_id string, check_name string, check_description string, severity string, status string, layer string, table_name string, records_checked bigint, records_failed bigint, failure_rate double, details string, executed_at timestamp, pipeline_run_id string, duration_seconds double",
        ("check_id",), "day:executed_at"),
    "control.watermarks": Table("source string, watermark string", ("source",), None),
}

#: Tables that belong to another table and change with it in one commit.
SIDES = {
    "loaded_files": "source_file string, version string",
    "deleted_keys": "event_id string, deleted_at timestamp",
    "rejected_rows": "table_name string, reason string, row_json string, _batch_id string",
}
