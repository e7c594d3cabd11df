"""Data quality checks. Each is one lazy DataFrame with a row per result, so a run is a single plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.operators.medallion import EVENT_TYPES, PLANS

#: The limits of the checks.
ORPHANS_WARN, ORPHANS_FAIL = 0.05, 0.20
VOLUME_DROP, VOLUME_RISE, VOLUME_DAYS = -0.30, 2.0, 7
FRESH_HOURS = 48

RESULT = ("check_name", "severity", "status", "layer", "table_name", "records_checked", "records_failed", "failure_rate")


def _row(name: str, severity: Column, status: Column, table_name: str, checked: Column, failed: Column) -> Column:
    """One result as a struct."""
    rate = F.when(checked > 0, failed.cast("double") / checked).otherwise(F.lit(0.0))
    return F.struct(
        F.lit(name).alias("check_name"), severity.alias("severity"), status.alias("status"), F.lit(table_name.split(".")[0]).alias("layer"), F.lit(table_name).alias("table_name"),
        checked.cast("long").alias("records_checked"), failed.cast("long").alias("records_failed"), rate.alias("failure_rate"),
    )


def _result(df: DataFrame, name: str, severity: Column, status: Column, table_name: str) -> DataFrame:
    """df holds one row with checked and failed."""
    return df.select(_row(name, severity, status, table_name, F.col("checked"), F.col("failed")).alias("r")).select("r.*")


def _passes(failed: Column | None = None) -> Column:
    return F.when((F.col("failed") if failed is None else failed) == 0, "passed").otherwise("failed")


def uniqueness(rows: DataFrame, key: tuple[str, ...], table_name: str) -> DataFrame:
    """Critical. records_failed counts the repeated keys, not their rows."""
    per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return _result(per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.count_if(F.col("n") > 1).alias("failed")), "CHECK_UNIQUENESS", F.lit("critical"), _passes(), table_name)


def referential_integrity(events: DataFrame, customers: DataFrame, key: str = "customer_id", table_name: str = "silver.events") -> DataFrame:
    """Rows whose reference has no version of the parent; NULL references count on neither side. Both limits are strict.

    The rows are counted per reference before the join, so a hot parent is one row of it.
    """
    ids = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    parents = customers.select(F.col(key).alias("__p")).distinct().withColumn("__known", F.lit(True))
    counts = ids.join(parents, F.col(key) == F.col("__p"), "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("__known").isNull(), F.col("n"))), F.lit(0)).alias("failed"))
    rate = F.col("failed").cast("double") / F.greatest("checked", F.lit(1))
    severity = F.when(rate > ORPHANS_FAIL, "critical").otherwise("warning")
    status = F.when(rate > ORPHANS_FAIL, "failed").when(rate > ORPHANS_WARN, "warning").otherwise("passed")
    return _result(counts, "CHECK_REFERENTIAL_INTEGRITY", severity, status, table_name)


def volume_history(rows: DataFrame, table_name: str, at: str) -> DataFrame:
    """(table_name, metric_date, record_count) per day; rows without time belong to no day."""
    days = rows.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("metric_date")).agg(F.count(F.lit(1)).alias("record_count"))
    return days.select(F.lit(table_name).alias("table_name"), "metric_date", "record_count")


def _volumes(volumes: DataFrame, table_name: str) -> tuple[DataFrame, Column, Column]:
    """One row with the newest day's rows (`checked`), the mean of the recorded days of the week before it, and the change; NULL without a base."""
    own = volumes.filter(F.col("table_name") == table_name)
    newest = own.agg(F.max("metric_date").alias("d")).select("d").scalar()
    in_week = (F.col("metric_date") >= F.date_sub(newest, VOLUME_DAYS)) & (F.col("metric_date") < newest)
    one = own.agg(F.coalesce(F.max(F.when(F.col("metric_date") == newest, F.col("record_count"))), F.lit(0)).alias("checked"), F.avg(F.when(in_week, F.col("record_count"))).alias("base"))
    return one, F.col("base"), F.when(F.col("base") > 0, (F.col("checked") - F.col("base")) / F.col("base"))


def volumetry(volumes: DataFrame, table_name: str) -> DataFrame:
    """Warning. The newest day against the mean of the recorded days of the week before it; passed without a base."""
    one, _, change = _volumes(volumes, table_name)
    warned = one.withColumn("warn", F.coalesce((change <= VOLUME_DROP) | (change >= VOLUME_RISE), F.lit(False)))
    counted = warned.withColumn("failed", F.when(F.col("warn"), F.col("checked")).otherwise(F.lit(0)))
    return _result(counted, "CHECK_VOLUMETRY", F.lit("warning"), F.when(F.col("warn"), "warning").otherwise("passed"), table_name)


def _counted() -> Column:
    return F.count(F.lit(1)).alias("rows")


def _invalid(column: str, allowed: tuple[str, ...]) -> Column:
    return F.count_if(~F.col(column).isin(*allowed)).alias("invalid")


def _domain_row(table_name: str) -> Column:
    return _row("CHECK_DOMAIN_VALUES", F.lit("critical"), _passes(F.col("invalid")), table_name, F.col("rows"), F.col("invalid"))


def _freshness_row(reference: Column, table_name: str) -> Column:
    stale = F.coalesce((F.unix_micros(reference) - F.unix_micros("newest")) > F.lit(FRESH_HOURS * 3_600_000_000), F.lit(True))
    return _row("CHECK_FRESHNESS", F.lit("warning"), F.when(stale, "warning").otherwise("passed"), table_name, F.lit(1), stale.cast("int"))


def domain_values(rows: DataFrame, column: str, allowed: tuple[str, ...], table_name: str) -> DataFrame:
    """Critical. Values outside the list; NULL is not reported."""
    return rows.agg(_counted(), _invalid(column, allowed)).select(_domain_row(table_name).alias("r")).select("r.*")


def freshness(rows: DataFrame, reference: Column, at: str = "occurred_at", table_name: str = "silver.events") -> DataFrame:
    """Warning. Time between the newest row and `reference`, at most FRESH_HOURS (inclusive); an empty table warns. One thing is checked: the table."""
    return rows.agg(F.max(at).alias("newest")).select(_freshness_row(reference, table_name).alias("r")).select("r.*")


def values_and_freshness(rows: DataFrame, column: str, allowed: tuple[str, ...], reference: Column, at: str = "occurred_at", table_name: str = "silver.events") -> DataFrame:
    """Both results of one table from one pass over it."""
    return rows.agg(_counted(), _invalid(column, allowed), F.max(at).alias("newest")).select(F.inline(F.array(_domain_row(table_name), _freshness_row(reference, table_name))))


def violations(rows: DataFrame, table_name: str, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (), domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(table_name, rule, violations): the declared constraints of a source table, one row each, in two passes whatever their number.

    NULL breaks not_null only; a repeated key counts once for every row beyond its first.
    """
    rules = {f"{c} is not null": F.count_if(F.col(c).isNull()) for c in not_null}
    rules |= {f"{c} in its domain": F.count_if(~F.col(c).isin(*allowed)) for c, allowed in (domains or {}).items()}
    parts = []
    if rules:
        named = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(rules)))
        parts.append(rows.agg(*(c.alias(f"r{i}") for i, c in enumerate(rules.values()))).select(F.inline(named)))
    if unique:
        extra = rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        parts.append(extra.select(F.lit(f"{', '.join(unique)} is unique").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(table_name).alias("table_name"), "rule", "violations")


def samples(rows: DataFrame, key: tuple[str, ...], n: int = 10) -> DataFrame:
    """The first n repeated keys in order, for the details of a result."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(*key).limit(n)


DETAIL = ("check_name", "table_name", "item", "key", "number")


def details(events: DataFrame, customers: DataFrame, reference: Column, volumes: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(check_name, table_name, item, key, number): what lies behind the results, in one plan.

    * uniqueness: the first n repeated keys in order, and how often each is there
    * referential integrity: the n most frequent unknown references (of equally frequent ones the first), and both limits
    * volumetry: the newest day's rows, the mean of the week before it, and the change, NULL without a base
    * domain values: the n most frequent invalid values
    * freshness: the age of the newest row in hours and the limit
    """
    if volumes is None:
        volumes = volume_history(events, "silver.events", "occurred_at")

    def made(df: DataFrame, check: str, table: str, item: str | Column, key: Column, number: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), (F.lit(item) if isinstance(item, str) else item).alias("item"), key.cast("string").alias("key"), number.cast("double").alias("number"))

    def frequent(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)

    def facts(df: DataFrame, check: str, table: str, **numbers: Column) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(item).alias("item"), c.cast("double").alias("n")) for item, c in numbers.items())))
        return made(df.select(pairs.alias("x")), check, table, F.col("x.item"), F.lit(None), F.col("x.n"))

    parts = [made(samples(rows, key, n), "CHECK_UNIQUENESS", table, "repeated", F.concat_ws("|", *key), F.col("n")) for rows, key, table in ((events, ("event_id",), "silver.events"), (customers, ("customer_id", "valid_from"), "silver.customers"))]
    parents = customers.select(F.col("customer_id").alias("__p")).distinct()
    unknown = events.filter("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(parents, F.col("customer_id") == F.col("__p"), "left_anti").orderBy(F.desc("n"), "customer_id").limit(n)
    parts.append(made(unknown, "CHECK_REFERENTIAL_INTEGRITY", "silver.events", "unknown", F.col("customer_id"), F.col("n")))
    one = events.sparkSession.range(1)
    parts.append(facts(one, "CHECK_REFERENTIAL_INTEGRITY", "silver.events", warn_above=F.lit(ORPHANS_WARN), fail_above=F.lit(ORPHANS_FAIL)))
    newest, base, change = _volumes(volumes, "silver.events")
    parts.append(facts(newest, "CHECK_VOLUMETRY", "silver.events", newest=F.col("checked"), base=base, change=change))
    for rows, column, allowed, table in ((events, "event_type", EVENT_TYPES, "silver.events"), (customers, "plan", PLANS, "silver.customers")):
        parts.append(made(frequent(rows.filter(~F.col(column).isin(*allowed)), column), "CHECK_DOMAIN_VALUES", table, "invalid", F.col(column), F.col("n")))
    age = (F.unix_micros(reference) - F.unix_micros("newest")) / F.lit(3_600_000_000)
    parts.append(facts(events.agg(F.max("occurred_at").alias("newest")), "CHECK_FRESHNESS", "silver.events", age_hours=age, limit_hours=F.lit(FRESH_HOURS)))
    return reduce(DataFrame.unionByName, parts)


def report(events: DataFrame, customers: DataFrame, reference: Column, volumes: DataFrame | None = None) -> DataFrame:
    """The seven results of a run, in one plan. `volumes` is the recorded history; without one it is rebuilt from the events."""
    if volumes is None:
        volumes = volume_history(events, "silver.events", "occurred_at")
    checks = (
        uniqueness(events, ("event_id",), "silver.events"), uniqueness(customers, ("customer_id", "valid_from"), "silver.customers"), referential_integrity(events, customers), volumetry(volumes, "silver.events"),
        values_and_freshness(events, "event_type", EVENT_TYPES, reference), domain_values(customers, "plan", PLANS, "silver.customers"),
    )
    return reduce(DataFrame.unionByName, checks)
