"""The three published reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.operators.scd2 import as_of

#: Fixed value: how a missing company or plan is shown.
UNKNOWN = "desconhecido"


def top_customers(summary: DataFrame, customers: DataFrame, days: int = 30, n: int = 10) -> DataFrame:
    """The n customers with the most events in the last `days` days of data (not of the calendar).

    Events without customer do not count; unknown customers stay in, with company UNKNOWN and NULL plan and segment. The
    last day is a scalar subquery, so its filter needs no join; the dimension joins n rows only.
    """
    last = summary.select(F.max("event_date")).scalar()
    counts = summary.filter(F.col("customer_id").isNotNull() & (F.col("event_date") > F.date_sub(last, days))).groupBy("customer_id").agg(F.sum("event_count").alias("event_count"))
    top = counts.orderBy(F.desc("event_count"), "customer_id").limit(n)
    current = customers.filter("is_current").select("customer_id", "company_name", "plan", "segment")
    return top.join(current, "customer_id", "left").select("customer_id", F.coalesce("company_name", F.lit(UNKNOWN)).alias("company_name"), "plan", "segment", "event_count").orderBy(F.desc("event_count"), "customer_id")


def first_response(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Hours from opening to the first later reply, by the plan in force at opening and the month of opening.

    Tickets without opening do not count; unanswered ones count but have no hours. A reply at the instant of opening is
    none. Hours are whole minutes / 60, averaged in double and rounded to two places.
    """
    named = tickets.filter("ticket_id is not null")
    opened = named.groupBy("ticket_id", "customer_id").agg(F.min(F.when(F.col("event_type") == "ticket_opened", F.col("occurred_at"))).alias("opened_at")).filter("opened_at is not null")
    replies = named.filter("event_type = 'ticket_replied'").select(F.col("ticket_id").alias("r"), F.col("occurred_at").alias("replied_at"))
    first = opened.join(replies, (F.col("ticket_id") == F.col("r")) & (F.col("replied_at") > F.col("opened_at"))).groupBy("ticket_id").agg(F.min("replied_at").alias("first_reply_at"))
    resolved = opened.join(first, "ticket_id", "left").withColumn("minutes", F.timestamp_diff("MINUTE", F.col("opened_at"), F.col("first_reply_at")))
    planned = as_of(resolved, customers, ("plan",), at="opened_at")
    answered, total = F.count("minutes"), F.count(F.lit(1))
    # Whole minutes are added up as integers, so the average does not depend on the order of rows.
    return planned.groupBy(F.coalesce("plan", F.lit(UNKNOWN)).alias("plan"), F.trunc("opened_at", "month").alias("response_month")).agg(
        total.alias("total_tickets"), answered.alias("tickets_with_response"), F.round(F.sum("minutes").cast("double") / 60 / answered, 2).alias("avg_hours_to_first_response"),
        F.round((total - answered).cast("double") * 100 / total, 1).alias("pct_no_response"),
    )


def cohort_retention(activity: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of each signup cohort that was active in each month since, months without activity included as 0.

    The spine is cohorts x months, both at most a few hundred rows however large the tables are.
    """
    cohorts = customers.filter("is_current").groupBy(F.trunc("signup_date", "month").alias("signup_month")).agg(F.countDistinct("customer_id").alias("cohort_size"))
    months = activity.select("activity_month").union(cohorts.select("signup_month")).distinct()
    spine = cohorts.join(F.broadcast(months), F.col("activity_month") >= F.col("signup_month"))
    active = activity.filter("signup_month is not null").groupBy("signup_month", "activity_month").agg(F.countDistinct("customer_id").alias("active_customers"))
    joined = spine.join(active, ["signup_month", "activity_month"], "left").withColumn("active_customers", F.coalesce("active_customers", F.lit(0)))
    return joined.select("signup_month", "activity_month", "cohort_size", "active_customers", F.round(F.col("active_customers").cast("double") * 100 / F.col("cohort_size"), 1).alias("retention_rate"))
