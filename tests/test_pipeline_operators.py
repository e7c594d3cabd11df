"""Medallion transformations, merges, type 2 dimensions, checks and reports on small tables."""

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import analytics, medallion, merge, quality, scd2

from tests.conftest import rows_of

LINES = "_raw_payload string, _source_file string, _ingested_at timestamp, _batch_id string"
EVENT = "event_id string, customer_id string, event_type string, occurred_at timestamp, updated_at timestamp, channel string, properties string, _ingested_at timestamp, _batch_id string"
SILVER = "event_id string, customer_id string, event_type string, occurred_at timestamp, updated_at timestamp, properties string, channel string"
DIM = "customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp, valid_from timestamp, valid_to timestamp, is_current boolean, _record_version int, _silver_loaded_at timestamp"
CRM = "customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp"
T0, T1, T2, T3 = "2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-03 00:00:00", "2026-01-04 00:00:00"


def silver(e, c="c_1", t="login", o=T0, u=T0, p=None):
    return (e, c, t, o, u, p, "chat")


def dim(c, plan="free", start=T0, end=None, current=True, version=1, updated=None, country="DE"):
    return (c, "Co", plan, "SMB", "2025-12-05", country, True, updated or start, start, end, current, version, start)


def test_both_time_formats_parse_and_garbage_is_null(table):
    texts = table("t string", [("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00.123456Z",), ("x",), (None,), ("31.02.2026 10:00",), ("0000-00-00T00:00:00Z",)])
    assert [r[0] for r in texts.select(F.unix_micros(medallion.instant(F.col("t")))).collect()] == [1767225600000000, 1767225600123456, None, None, None, None]


def test_bronze_keeps_every_line_and_nulls_what_it_cannot_read(table):
    lines = table(LINES, [('{"event_id": "e", "occurred_at": "2026-01-01T00:00:00Z", "properties": {"a": 1}, "new_field": 1}', "f", T0, "b"), ('{"event_id": "e", "cut', "f", T0, "b"), (None, "f", T0, "b"), ("", "f", T0, "b")])
    assert rows_of(medallion.bronze_events(lines), "event_id", "properties") == [("e", '{"a":1}'), (None, None), (None, None), (None, None)]
    crm = table(LINES, [('{"customer_id": "c", "signup_date": "2025-02-30", "is_active": "maybe", "updated_at": "2026-01-01T00:00:00.000001Z"}', "f", T0, "b")])
    row = medallion.bronze_customers(crm).first()
    assert (row["signup_date"], row["is_active"]) == (None, None) and row["updated_at"] is not None


def test_latest_wins_with_tie_break_and_null_times_lose(table):
    rows = table(EVENT, [("e_1", "c", "login", T0, T0, "web", None, T0, "a"), (" E_1", "c", "login", T0, T1, "mobile", None, T0, "a"), ("e_2", "c", "login", T0, None, "x", None, T3, "z"), ("e_2", "c", "login", T0, T0, "y", None, T0, "a"), ("e_3", "c", "login", T0, T0, "p", None, T0, "a"), ("e_3", "c", "login", T0, T0, "q", None, T0, "b"), (None, "c", "login", T0, T0, "n", None, T0, "a")])
    newest = medallion.latest(rows, "event_id")
    assert newest.columns == rows.columns
    assert rows_of(newest, "event_id", "channel") == [("e_1", "mobile"), ("e_2", "y"), ("e_3", "q")]


def test_json_validity_flags(table):
    texts = table("p string", [("not json",), ("",), ("{}",), (None,), ("5",), ('"s"',)])
    assert [r[0] for r in texts.select(medallion.valid_json(F.col("p"))).collect()] == [False, False, True, True, True, True]


def test_daily_and_monthly_aggregates_treat_null_customers_differently(table):
    events = table(SILVER, [silver("e_1"), silver("e_2"), silver("e_3", c=None), silver("e_4", c="c_9", o=T1)])
    assert rows_of(medallion.daily_summary(events), "customer_id", "event_count") == [("c_1", 2), ("c_9", 1), (None, 1)]
    activity = medallion.monthly_activity(events, table(DIM, [dim("c_1")]))
    assert rows_of(activity.select("customer_id", "event_count", "has_activity", F.col("signup_month").cast("string"))) == [("c_1", 2, True, "2025-12-01"), ("c_9", 1, True, None)]


def test_point_lookup_and_properties(table):
    rows = table(EVENT, [("e_1", "c", "login", T0, T1, "b", None, T0, "a"), (" E_1", "c", "login", T0, T0, "a", None, T0, "a"), ("e_2", "c", "login", T0, T0, "c", None, T0, "a")])
    assert [r["channel"] for r in medallion.versions_of(rows, "event_id", "E_1 ").collect()] == ["a", "b"] and medallion.versions_of(rows, "event_id", "e_9").count() == 0
    events = table(SILVER, [silver("e_1", p='{"a": 1, "b": null}'), silver("e_2", p='{"a": "x", "c": {"d": 1}}'), silver("e_3", p="broken"), silver("e_4")])
    assert rows_of(medallion.properties_schema(events), "property", "json_type", "n") == [("a", "number", 1), ("a", "string", 1), ("b", "null", 1), ("c", "object", 1)]


def test_declared_constraints(table):
    rows = table("k string, plan string", [("a", "free"), ("a", "odd"), (None, None)])
    assert rows_of(quality.violations(rows, "t", ("k", "plan"), ("k",), {"plan": medallion.PLANS}), "rule", "violations") == [("k is not null", 1), ("k is unique", 1), ("plan in its domain", 1), ("plan is not null", 1)]


# Merge

PAIR = "k string, v int, w int"


def test_merge_updates_conditionally_inserts_and_is_idempotent(table):
    target, source = table(PAIR, [("a", 1, 1), ("b", 2, 2), (None, 3, 3)]), table(PAIR, [("a", 5, 5), ("b", 1, 9), (None, 4, 4), ("c", 7, 7)])
    newer = F.col("s.v") > F.col("t.v")
    once = merge.merge(target, source, ("k",), when=newer)
    assert rows_of(once) == [("a", 5, 5), ("b", 2, 2), ("c", 7, 7), (None, 4, 4)]
    assert rows_of(merge.merge(once, source, ("k",), when=newer)) == rows_of(once)


def test_merge_options(table):
    target, source = table(PAIR, [("a", 1, 1), ("b", 2, 2)]), table(PAIR, [("a", 5, 5), ("c", 7, 7)])
    assert rows_of(merge.merge(target, source, ("k",), delete_unmatched=True)) == [("a", 5, 5), ("c", 7, 7)]
    assert rows_of(merge.merge(target, source, ("k",), insert=False)) == [("a", 5, 5), ("b", 2, 2)]
    assert rows_of(merge.merge(target, source, ("k",), update=False)) == [("a", 1, 1), ("b", 2, 2), ("c", 7, 7)]
    assert rows_of(merge.merge(target, source.select("k", "v"), ("k",))) == [("a", 5, 1), ("b", 2, 2), ("c", 7, None)]
    assert rows_of(merge.merge(target, source, ("k",), set_columns={"w": F.col("s.v") + F.col("t.w")}, insert=False)) == [("a", 1, 6), ("b", 2, 2)]
    assert rows_of(merge.merge(target, source, ("k",), when=F.lit(None).cast("boolean"), insert=False)) == rows_of(target)
    assert rows_of(merge.insert_missing(target, source, ("k",))) == [("a", 1, 1), ("b", 2, 2), ("c", 7, 7)]


def test_repeated_source_keys_are_an_error(table):
    with pytest.raises(merge.AmbiguousSource):
        merge.require_unique(table(PAIR, [("a", 1, 1), ("a", 2, 2)]), ("k",))
    with pytest.raises(merge.AmbiguousSource):
        merge.require_unique(table(PAIR, [(None, 1, 1), (None, 2, 2)]), ("k",))


def test_lines_are_a_set(table):
    old, new = table("value string", [("a",), ("b",)]), table("value string", [("b",), ("c",), ("c",)])
    assert rows_of(merge.merge_lines(old, new)) == [("a",), ("b",), ("c",)]


# Type 2 dimension


def crm(c, plan="free", updated=T1, company="Co", country="DE"):
    return (c, company, plan, "SMB", "2025-12-05", country, True, updated)


@pytest.mark.parametrize(("before", "incoming", "versions"), [
    ([], crm("c_1"), [("free", True, 1)]),
    ([dim("c_1")], crm("c_1", "pro"), [("free", False, 1), ("pro", True, 2)]),
    ([dim("c_1")], crm("c_1"), [("free", True, 1)]),
    ([dim("c_1", start=T2)], crm("c_1", "pro", T1), [("free", True, 1)]),
    ([dim("c_1")], crm("c_1", company="Other"), [("free", True, 1)]),
    ([dim("c_1", country=None)], crm("c_1", country=None), [("free", True, 1)]),
    ([dim("c_1", country=None)], crm("c_1", country="FR"), [("free", False, 1), ("free", True, 2)]),
    ([dim("c_1", end=T1, current=False, version=4)], crm("c_1", "pro", T2), [("free", False, 4), ("pro", True, 5)]),
])
def test_one_run_of_a_dimension(table, before, incoming, versions):
    after = scd2.apply_latest(table(DIM, before), table(CRM, [incoming]))
    assert rows_of(after, "plan", "is_current", "_record_version") == versions
    again = scd2.apply_latest(after, table(CRM, [incoming]))
    assert rows_of(again.drop("_silver_loaded_at")) == rows_of(after.drop("_silver_loaded_at"))
    closed = [r for r in after.collect() if not r["is_current"]]
    opened = [r for r in after.collect() if r["is_current"]]
    if len(versions) == 2 and versions[0][2] == 1:
        assert closed[0]["valid_to"] == opened[0]["valid_from"]


def test_as_of_edges(table):
    versions = table(DIM, [dim("c_1", "free", T1, T2, False), dim("c_1", "pro", T2)])
    events = table(SILVER, [silver("e_0", o=T0), silver("e_1", o=T1), silver("e_2", o=T2), silver("e_3", c="c_9"), silver("e_4", c=None), silver("e_5", o=None)])
    assert rows_of(scd2.as_of(events, versions, ("plan",)), "event_id", "plan") == [("e_0", None), ("e_1", "free"), ("e_2", "pro"), ("e_3", None), ("e_4", None), ("e_5", None)]
    assert rows_of(scd2.as_of(events, versions, ("plan",), how="inner"), "event_id", "plan") == [("e_1", "free"), ("e_2", "pro")]
    assert scd2.as_of(events, versions, ("updated_at", "plan")).columns == ["event_id", "customer_id", "event_type", "occurred_at", "properties", "channel", "updated_at", "plan"]


# Checks


def only(df):
    (row,) = df.collect()
    return row["severity"], row["status"], row["records_checked"], row["records_failed"]


def test_uniqueness_counts_keys(table):
    assert only(quality.uniqueness(table(SILVER, [silver("e_1"), silver("e_1"), silver("e_1"), silver(None), silver(None), silver("e_2")]), ("event_id",), "silver.events")) == ("critical", "failed", 6, 2)
    assert only(quality.uniqueness(table(SILVER, []), ("event_id",), "silver.events")) == ("critical", "passed", 0, 0)


@pytest.mark.parametrize(("orphans", "expected"), [(1, ("warning", "passed")), (2, ("warning", "warning")), (4, ("warning", "warning")), (5, ("critical", "failed"))])
def test_referential_limits_are_strict(table, orphans, expected):
    events = table(SILVER, [silver(f"e_{i}", c="c_9" if i < orphans else "c_1") for i in range(20)] + [silver("e_n", c=None)])
    assert only(quality.referential_integrity(events, table(DIM, [dim("c_1")])))[:2] == expected


@pytest.mark.parametrize(("today", "status"), [(70, "warning"), (71, "passed"), (299, "passed"), (300, "warning")])
def test_volumetry_limits_are_inclusive(table, today, status):
    volumes = table("table_name string, metric_date date, record_count bigint", [("t", "2026-01-01", 5), ("t", "2026-01-03", 100), ("t", "2026-01-09", 100), ("t", "2026-01-10", today), ("u", "2026-01-11", 1)])
    assert only(quality.volumetry(volumes, "t"))[1] == status


def test_volumetry_without_base_passes(table):
    assert only(quality.volumetry(table("table_name string, metric_date date, record_count bigint", [("t", "2026-01-10", 5)]), "t")) == ("warning", "passed", 5, 0)
    assert only(quality.volumetry(table("table_name string, metric_date date, record_count bigint", []), "t")) == ("warning", "passed", 0, 0)


def test_domain_ignores_null(table):
    assert only(quality.domain_values(table(SILVER, [silver("e_1"), silver("e_2", t=None), silver("e_3", t="other")]), "event_type", medallion.EVENT_TYPES, "silver.events")) == ("critical", "failed", 3, 1)


@pytest.mark.parametrize(("reference", "status"), [("2026-01-03 00:00:00", "passed"), ("2026-01-03 00:00:01", "warning")])
def test_freshness_is_inclusive(table, reference, status):
    assert only(quality.freshness(table(SILVER, [silver("e_1")]), F.lit(reference).cast("timestamp")))[1] == status
    assert only(quality.freshness(table(SILVER, []), F.lit(reference).cast("timestamp")))[1] == "warning"


def test_report_has_seven_results(table):
    report = quality.report(table(SILVER, [silver("e_1")]), table(DIM, [dim("c_1")]), F.lit(T1).cast("timestamp"))
    assert len(report.collect()) == 7 and {r["status"] for r in report.collect()} == {"passed"}


# Reports


def test_top_customers_keep_orphans_and_drop_null(table):
    summary = table("event_date date, customer_id string, event_type string, event_count bigint", [("2026-01-31", "c_1", "a", 2), ("2026-01-02", "c_1", "a", 1), ("2026-01-01", "c_1", "a", 100), ("2026-01-31", "c_9", "a", 3), ("2026-01-31", None, "a", 50), ("2026-01-31", "c_0", "a", 3)])
    top = analytics.top_customers(summary, table(DIM, [dim("c_1"), dim("c_0", current=False, end=T1)]))
    assert [tuple(r) for r in top.collect()] == [("c_0", "desconhecido", None, None, 3), ("c_1", "Co", "free", "SMB", 3), ("c_9", "desconhecido", None, None, 3)]


def test_first_response_counts_unanswered_and_ignores_equal_instants(table):
    ddl = "event_id string, customer_id string, ticket_id string, event_type string, occurred_at timestamp"
    tickets = table(ddl, [
        ("1", "c_1", "t1", "ticket_opened", "2026-01-05 00:00:00"), ("2", "c_1", "t1", "ticket_replied", "2026-01-05 00:00:00"), ("3", "c_1", "t1", "ticket_replied", "2026-01-05 01:30:59"),
        ("4", "c_1", "t2", "ticket_opened", "2026-01-06 00:00:00"), ("5", "c_9", "t3", "ticket_opened", "2026-01-06 00:00:30"), ("6", "c_9", "t3", "ticket_replied", "2026-01-06 00:01:29"), ("7", "c_9", None, "ticket_opened", T0), ("8", "c_9", "t4", "ticket_replied", T0),
    ])
    assert rows_of(analytics.first_response(tickets, table(DIM, [dim("c_1", "pro")])).drop("response_month")) == [("desconhecido", 1, 1, 0.0, 0.0), ("pro", 2, 1, 1.5, 50.0)]


def test_cohorts_without_activity_show_zero(table):
    activity = table("activity_month date, customer_id string, has_activity boolean, event_count bigint, signup_month date", [("2026-01-01", "c_1", True, 1, "2025-12-01"), ("2026-02-01", "c_9", True, 1, None)])
    got = analytics.cohort_retention(activity, table(DIM, [dim("c_1"), dim("c_2")]))
    assert rows_of(got.select(F.col("activity_month").cast("string"), "cohort_size", "active_customers", "retention_rate")) == [("2025-12-01", 2, 0, 0.0), ("2026-01-01", 2, 1, 50.0), ("2026-02-01", 2, 0, 0.0)]
