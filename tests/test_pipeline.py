"""Store, raw zone, paged source, pipeline and streaming end to end."""

import gzip
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lakesmith.plans.pipeline import Pipeline, QualityGateError, execution_date, notification
from lakesmith.schemas import Table
from lakesmith.sources import database, paged_files, pager, rawlines, replay
from lakesmith.store import Store, StoreError
from lakesmith.streaming import live

from tests.conftest import rows_of

NOW = datetime(2026, 3, 5, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"t": Table("k string, v int, at timestamp", ("k",), "day:at"), "u": Table("k string")})


def test_versions_time_travel_and_tags(store, spark):
    assert store.current("t") is None and store.read("t").count() == 0 and store.tables() == []
    store.create("t")
    store.create("t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int").withColumn("at", F.lit("2026-01-01 05:00:00").cast("timestamp"))
    assert store.append("t", row("a", 1)) == 1
    assert store.append("t", row("b", 2)) == 2
    assert rows_of(store.added("t", 1), "k") == [("b",)] and store.added("t", None).count() == 2 and store.added("t", 2).count() == 0
    store.tag("t", "before")
    store.replace("t", store.read("t").withColumn("v", F.col("v") + 1), "merge")
    assert rows_of(store.read("t"), "k", "v") == [("a", 2), ("b", 3)]
    assert rows_of(store.read("t", 1), "k", "v") == [("a", 1)]
    assert rows_of(store.read("t", "before"), "k", "v") == [("a", 1), ("b", 2)]
    assert [(v.operation, len(v.parts), v.tags) for v in store.history("t")] == [("create", 0, ()), ("append", 1, ()), ("append", 2, ("before",)), ("merge", 1, ())]
    assert rows_of(store.snapshots("t"), "version", "operation", "parts") == [(0, "create", 0), (1, "append", 1), (2, "append", 2), (3, "merge", 1)]
    assert rows_of(store.columns(), "table_schema", "table_name", "column_name", "data_type") == [("", "t", "at", "timestamp"), ("", "t", "k", "string"), ("", "t", "v", "int")]
    assert rows_of(store.partitions("t"), "part", "rows") == [("2026-01-01", 2)]
    assert store.read("t", period=("2026-01-02", "2026-01-09")).count() == 0 and store.read("t", period=("2026-01-01", "2026-01-01")).count() == 2
    assert store.added("t", 2).count() == 2
    assert store.compact("t") == 4
    merged = store.version("t", 3).parts[0]
    assert store.vacuum("t", keep=1) == [merged.split("/_part")[0]] and store.vacuum("t", keep=1) == []
    assert store.read("t", "before").count() == 2 and store.tables() == ["t"]
    with pytest.raises(StoreError):
        store.version("t", 99)
    with pytest.raises(StoreError):
        store.read("nothing")
    store.drop("t")
    assert store.current("t") is None


def test_added_columns_read_as_null_and_damaged_entries_are_errors(store, spark, tmp_path):
    store.append("u", spark.createDataFrame([("a",)], "k string"))
    wider = Store(spark, str(tmp_path / "store"), {"u": Table("k string, extra int")})
    assert rows_of(wider.read("u")) == [("a", None)]
    (tmp_path / "store/u/_log/1.json").write_text("{}")
    with pytest.raises(StoreError):
        store.read("u")


def letters(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def test_interleaved_writers_lose_no_committed_row(store, spark, tmp_path):
    store.append("u", letters(spark, "a"))
    other = Store(spark, str(tmp_path / "store"), {"u": Table("k string")})
    # Each writer has written its rows when the other one commits first.
    write = Store._write

    def meanwhile(self, *args):
        made = write(self, *args)
        Store._write = write
        other.append("u", letters(spark, "b"))
        return made

    Store._write = meanwhile
    store.append("u", letters(spark, "c"))
    assert rows_of(store.read("u")) == [("a",), ("b",), ("c",)]
    Store._write = meanwhile
    with pytest.raises(StoreError):
        store.replace("u", letters(spark, "z"))
    assert rows_of(other.read("u")) == [("a",), ("b",), ("b",), ("c",)]
    # Made from a version that is no longer the newest.
    with pytest.raises(StoreError):
        store.replace("u", letters(spark, "z"), base=1)
    store.replace("u", letters(spark, "d"))
    assert rows_of(other.read("u")) == [("d",)]


@pytest.mark.parametrize("operation", ["append", "replace", "sides"])
def test_a_crash_after_any_step_leaves_the_table_as_it_was_or_as_it_shall_be(store, spark, operation):
    store.append("u", letters(spark, "a"))

    def act(k):
        if operation == "append":
            store.append("u", letters(spark, k))
        elif operation == "replace":
            store.replace("u", store.read("u").unionByName(letters(spark, k)))
        else:
            store.append("u", letters(spark, k), sides={"loaded_files": spark.createDataFrame([(k, "1")], "source_file string, version string")}, notes={"n": k})

    class Crash(BaseException):
        pass

    steps = (("_write", Store), ("write", type(store._files)), ("place", type(store._files)))
    for n, (name, owner) in enumerate(steps):
        done = getattr(owner, name)

        def crash(self, *args, done=done):
            done(self, *args)
            raise Crash

        setattr(owner, name, crash)
        try:
            with pytest.raises(Crash):
                act(f"x{n}")
        finally:
            setattr(owner, name, done)
        committed = [("a",)] + ([("x2",)] if name == "place" else [])
        assert rows_of(store.read("u")) == committed
        if operation == "sides":
            assert rows_of(store.side("u", "loaded_files"), "source_file") == committed[1:] and store.note("u", "n") == ("x2" if name == "place" else "")
    act("y")
    assert rows_of(store.read("u")) == [("a",), ("x2",), ("y",)]
    assert len(store.vacuum("u", keep=9, abandoned_after=-1)) >= 2 and rows_of(store.read("u")) == [("a",), ("x2",), ("y",)]


def test_raw_zone_keeps_each_line_once(spark, tmp_path):
    root, lines = str(tmp_path), spark.createDataFrame([("a",), ("b",), ("b",), (" ",)], "value string")
    empty = rawlines.read_lines(spark, root, "events", "2026-03-01", "b")
    assert empty.count() == 0 and "_raw_payload" in empty.columns
    assert rawlines.write_lines(lines, root, "events", "2026-03-01")
    assert not rawlines.write_lines(lines, root, "events", "2026-03-01")
    assert rawlines.write_lines(spark.createDataFrame([("c",), ("a",)], "value string"), root, "events", "2026-03-01", files=1)
    back = rawlines.read_lines(spark, root, "events", "2026-03-01", "b")
    assert rows_of(back, "_raw_payload") == [("a",), ("b",), ("c",)]
    assert all(r[0].endswith(".json.gz") for r in back.select("_source_file").collect())


def test_reports_as_quoted_csv_and_views_over_json(spark, tmp_path):
    rawlines.write_csv(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text() == '"k","v"\n"a","1"\n"","2"\n'
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": 2}\n')
    rawlines.json_view(spark, str(tmp_path / "x.json"), "some_json")
    assert spark.sql("SELECT sum(a) FROM some_json").first()[0] == 3


def test_source_rows_become_uniform_json(spark):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS u, date'2026-01-02' AS d, cast(1.50 AS decimal(5,2)) AS n, cast(NULL AS string) AS x, true AS b")
    assert json.loads(rawlines.normalized_json(rows).first()[0]) == {"u": "2026-01-01T00:00:00.000000Z", "d": "2026-01-02", "n": 1.5, "x": None, "b": True}


def test_changed_since_is_inclusive(table):
    rows = table("customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp, secret string", [(c, "", "", "", None, "", True, u, "s") for c, u in (("a", "2026-01-01 00:00:00"), ("b", "2026-01-02 00:00:00"))])
    assert rows_of(database.changed_since(rows, "2026-01-02T00:00:00Z"), "customer_id") == [("b",)]


def test_a_database_is_read_in_even_parts_from_the_bound_on(spark, table, tmp_path):
    url = f"jdbc:derby:{tmp_path}/crm;create=true"
    days = [f"2026-01-{d:02d} 00:00:00" for d in range(1, 21)]
    rows = table("customer_id string, company_name string, plan string, segment string, signup_date date, country string, is_active boolean, updated_at timestamp", [(f"c_{i}", "Co", "free", "SMB", "2026-01-01", "DE", True, d) for i, d in enumerate(days)])
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="customers", **options).mode("overwrite").save()
    for since, wanted in (("1970-01-01T00:00:00Z", 20), ("2026-01-13T00:00:00Z", 8), ("2027-01-01T00:00:00Z", 0)):
        got = database.read_customers(spark, url, "customers", since, partitions=4, **options)
        assert got.count() == wanted
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        assert max((r["count"] for r in sizes), default=0) <= max(1, wanted // 4 + 1)
        assert database.read_customers(spark, url, "customers", since, **options).count() == wanted
    lines = [json.loads(r[0]) for r in rawlines.normalized_json(got.limit(0).unionByName(database.read_customers(spark, url, "customers", "2026-01-20T00:00:00Z", **options))).collect()]
    assert [(x["customer_id"], x["updated_at"], x["is_active"]) for x in lines] == [("c_19", "2026-01-20T00:00:00.000000Z", True)]


# The paged source


def make_pager(answers, **options):
    asked, slept, clock = [], [], [0.0]

    def transport(params):
        asked.append(params["page"])
        answer = answers.pop(0) if len(answers) > 1 else answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    return pager.Pager(transport, sleep=sleep, clock=lambda: clock[0], jitter=lambda: 0.0, per_second=1e9, **options), asked, slept


OK = pager.Response(200, {"data": [{"event_id": "1", "unknown": {"x": 1}}], "total_pages": 1})


def test_failures_are_retried_within_their_budget():
    source, asked, slept = make_pager([pager.Response(503), pager.Unreachable(), OK])
    assert list(source.records("")) == OK.body["data"] and len(asked) == 3 and slept == [1.0, 2.0]
    source, asked, _ = make_pager([pager.Response(503)], failures=3)
    with pytest.raises(pager.SourceError):
        list(source.records(""))
    assert len(asked) == 4


def test_throttling_honours_retry_after():
    source, _, slept = make_pager([pager.Response(429, headers={"Retry-After": "2"}), pager.Response(429), pager.Response(429, headers={"Retry-After": "0"}), pager.Response(429, headers={"Retry-After": "soon"}), OK])
    list(source.records(""))
    assert slept == [2.0, 2.0, 4.0, 8.0]


def test_other_errors_end_the_run_and_pages_keep_their_order():
    source, asked, _ = make_pager([pager.Response(404)])
    with pytest.raises(pager.SourceError):
        list(source.records(""))
    pages = [pager.Response(200, {"data": [n], "total_pages": 3}) for n in (1, 2, 3)]
    source, asked, _ = make_pager(pages + [OK])
    assert list(source.records("")) == [1, 2, 3] and asked == [1, 2, 3]


def test_rate_and_bounds():
    slept = []
    source = pager.Pager(lambda p: OK, per_second=10, sleep=slept.append, clock=lambda: 0.0)
    source.page(1, "")
    source.page(2, "")
    assert slept == [pytest.approx(0.1)]
    assert pager.Pager(lambda p: OK, jitter=lambda: 1.0).backoff(9) == 37.5
    assert [pager.page_bounds(n, 500, 2) for n in (1, 2, 3)] == [(0, 500), (498, 1000), (998, 1500)]
    assert [pager.pages_of(n, 500) for n in (0, 500, 501)] == [1, 1, 2]


def test_a_replayed_source_throttles_fails_and_still_gives_every_record():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    batches = [[{"event_id": f"e_{b}{i}", "updated_at": f"2026-01-0{b}T00:00:0{i}Z", "_batch": b} for i in range(9)] for b in (1, 2)]
    source = replay.Replay(batches, per_second=2, flaky=0.3, overlap=1, seed=3, clock=lambda: now[0])
    client = pager.Pager(source, page_size=3, per_second=50, sleep=sleep, clock=lambda: now[0], jitter=lambda: 0.0)
    read = lambda since: {r["event_id"] for r in client.records(since)}
    assert read("") == {f"e_1{i}" for i in range(9)} and 1.0 in slept
    assert source.state() == {"batch": 1, "visible": 9} and source.advance() == {"batch": 2, "visible": 18} == source.advance()
    assert read("2026-01-01T00:00:08Z") == {"e_18", *(f"e_2{i}" for i in range(9))}
    assert source.health() == {"status": "ok", "batch": 2, "visible": 18, "records": 18} and source.reset()["visible"] == 9
    quiet = replay.Replay(batches, per_second=1, clock=lambda: 0.0)
    first, second = (quiet({"since": "", "page": 1, "page_size": 2}) for _ in range(2))
    assert [set(r) for r in first.body["data"]] == [{"event_id", "updated_at"}] * 2 and (second.status, second.headers) == (429, {"Retry-After": "1"})


def test_paged_files_are_a_data_source(spark, tmp_path):
    paged_files.register(spark)
    for n, us in enumerate((["2026-01-01", "2026-01-02"], ["2026-01-02", "2026-01-03"])):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"data": [{"updated_at": u} for u in us]}))
    rows = spark.read.format("paged_files").option("path", str(tmp_path)).option("since", "2026-01-02").load()
    assert rows_of(rows) == [('{"updated_at":"2026-01-02"}',), ('{"updated_at":"2026-01-02"}',), ('{"updated_at":"2026-01-03"}',)]


# The pipeline


def raw_event(e, u="2026-03-04T00:00:00Z", o="2026-03-04T00:00:00Z", t="login", c="c_1", **more):
    return {"event_id": e, "customer_id": c, "event_type": t, "occurred_at": o, "updated_at": u, "channel": "chat", "properties": {"ticket_id": "t_1"}, **more}


def raw_customer(c, plan="free", u="2026-03-01T00:00:00.000000Z"):
    return {"customer_id": c, "company_name": "Co", "plan": plan, "segment": "SMB", "signup_date": "2026-01-15", "country": "DE", "is_active": True, "updated_at": u}


def snapshot(p):
    names = ("silver.events", "silver.customers", "gold.events_daily_summary", "gold.ticket_events", "gold.customer_monthly_activity")
    return {n: rows_of(p.store.read(n).drop("_silver_loaded_at", "updated_at" if n.startswith("gold") else "_")) for n in names}


def test_pipeline_twice_then_a_second_batch(spark, tmp_path):
    done, late = [], []
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW, on_success=done.append, on_late=lambda stage, seconds: late.append(stage), sla_seconds=0)
    events = [raw_event("e_1"), raw_event("e_1"), raw_event("e_2", t="Ticket_Opened"), raw_event(None), raw_event("e_3", c=None)]
    fetch = {"events": lambda since: [r for r in events if r["updated_at"] >= since], "customers": lambda since: [raw_customer("c_1")]}
    p.run("2026-03-04", fetch)
    first = snapshot(p)
    assert [len(first[n]) for n in first] == [3, 1, 3, 1, 1]
    assert p.store.side("silver.events", "rejected_rows").count() == 1
    assert p.watermark("events") == "2026-03-04T00:00:00Z"
    assert p.store.read("quality.check_results").count() == 7
    p.run("2026-03-04", fetch)
    assert snapshot(p) == first and p.store.read("bronze.events").count() == 4 and len(done) == 2 and "gold" in late
    assert p.store.read("quality.check_results").count() == 14
    # The next day brings a correction, an older change, a new event and a changed plan.
    events += [raw_event("e_1", u="2026-03-05T00:00:00Z", t="report_viewed", source_app="web"), raw_event("e_2", u="2026-03-03T00:00:00Z", t="login"), raw_event("e_4", u="2026-03-05T00:00:00Z")]
    fetch["customers"] = lambda since: [raw_customer("c_1", "pro", "2026-03-04T00:00:00.000000Z")]
    p.run("2026-03-05", fetch, rebuild=True)
    assert rows_of(p.store.read("silver.events"), "event_id", "event_type") == [("e_1", "report_viewed"), ("e_2", "ticket_opened"), ("e_3", "login"), ("e_4", "login")]
    assert rows_of(p.store.read("silver.customers"), "plan", "is_current") == [("free", False), ("pro", True)]
    assert ("c_1", "login", 1) in rows_of(p.store.read("gold.events_daily_summary"), "customer_id", "event_type", "event_count")
    before = snapshot(p)
    p.silver_events(full=True)
    assert snapshot(p)["silver.events"] == before["silver.events"]


def test_a_small_batch_rewrites_its_month_only_and_deletes_remove(spark, tmp_path):
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW)
    write = lambda day, *records: rawlines.write_lines(spark.createDataFrame([(json.dumps(r),) for r in records], "value string"), p.raw_root, "events", day)
    months = {m: raw_event(f"e_{m}", u=f"2026-0{m}-20T00:00:00Z", o=f"2026-0{m}-20T00:00:00Z", t="ticket_opened") for m in (1, 2, 3)}
    write("2026-03-04", *months.values())

    def step(day):
        p.bronze("events", day)
        p.silver_events()
        p.gold()
        return {n: dict((x.partition("/_part=")[2], x) for x in p.store.newest(n).parts) for n in ("silver.events", "gold.events_daily_summary", "gold.ticket_events", "gold.customer_monthly_activity")}

    first = step("2026-03-04")
    assert all(sorted(parts) == ["2026-01", "2026-02", "2026-03"] for parts in first.values())
    write("2026-03-05", {**months[2], "updated_at": "2026-03-01T00:00:00Z", "channel": "mail"})
    second = step("2026-03-05")
    for n, parts in second.items():
        assert {m for m in parts if parts[m] != first[n][m]} == {"2026-02"}, n
    # A delete says little more than whom it deletes; an older change that comes after it does not bring the event back.
    write("2026-03-06", {"event_id": "E_1 ", "updated_at": "2026-03-02T00:00:00Z", "op": "delete"}, {"event_id": "e_9", "updated_at": "2026-03-02T00:00:00Z", "op": "delete"})
    third = step("2026-03-06")
    assert {m for m in second["silver.events"] if third["silver.events"].get(m) != second["silver.events"][m]} == {"2026-01"}
    write("2026-03-07", {**months[1], "updated_at": "2026-03-01T00:00:00Z"})
    step("2026-03-07")
    for n in third:
        assert p.store.read(n).count() == 2, n
    assert rows_of(p.store.read("silver.events"), "event_id", "channel") == [("e_2", "mail"), ("e_3", "chat")]
    before = snapshot(p)
    p.silver_events(full=True)
    p.gold(rebuild=True)
    assert snapshot(p) == before


def test_a_failed_gate_stops_gold_but_keeps_its_results(spark, tmp_path):
    failed = []
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW, on_failure=lambda stage, error: failed.append(stage))
    with pytest.raises(QualityGateError):
        p.run("2026-03-04", {"events": lambda since: [raw_event("e_1", t="odd")], "customers": lambda since: [raw_customer("c_1")]})
    assert failed == ["quality"] and p.store.current("gold.ticket_events") is None
    results = [r.asDict() for r in p.store.read("quality.check_results").collect()]
    assert len(results) == 7 and "CHECK_DOMAIN_VALUES" in str(notification(results, "r"))
    found = {(r["check_name"], r["table_name"]): json.loads(r["details"]) for r in results}
    assert found[("CHECK_DOMAIN_VALUES", "silver.events")] == {"invalid": {"odd": 1}} and found[("CHECK_FRESHNESS", "silver.events")] == {"age_hours": 24.0, "limit_hours": 48.0}
    assert found[("CHECK_VOLUMETRY", "silver.events")] == {"newest": 1.0, "base": None, "change": None} and found[("CHECK_REFERENTIAL_INTEGRITY", "silver.events")] == {"warn_above": 0.05, "fail_above": 0.2}


def test_nothing_to_do_is_no_error(spark, tmp_path):
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW)
    p.run("2026-03-04", only=("events",))
    assert p.store.read("silver.events").count() == 0


def test_lines_added_to_a_loaded_file_reach_bronze(spark, tmp_path):
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW)
    folder = tmp_path / "r/raw/events/ingestion_date=2026-03-04"
    folder.mkdir(parents=True)
    lines = [json.dumps(raw_event(e)) for e in ("e_1", "e_1", "e_2", "e_3", "e_3")]
    for upto, new in ((3, 3), (3, 0), (5, 2), (5, 0)):
        (folder / "part-000.json.gz").write_bytes(gzip.compress("\n".join(lines[:upto]).encode(), mtime=0))
        assert p.bronze("events", "2026-03-04")["records_written"] == new
    assert rows_of(p.store.read("bronze.events"), "event_id") == [("e_1",), ("e_1",), ("e_2",), ("e_3",), ("e_3",)]


def test_ingest_holds_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lakesmith.plans.pipeline.INGEST_RECORDS", 2, raising=False)
    p = Pipeline(spark, Store(spark, str(tmp_path / "s")), str(tmp_path / "r"), reference=lambda: NOW)
    files = lambda: len(list((tmp_path / "r").rglob("*.json.gz")))
    seen = []

    def fetch(since, fails):
        for n in (1, 3, 2, 2, 0):
            seen.append(files() > 0)
            yield raw_event(f"e_{n}", u=f"2026-03-04T0{n}:00:00Z")
        if fails:
            raise OSError

    with pytest.raises(OSError):
        p.ingest("events", lambda since: fetch(since, True), "2026-03-04")
    assert seen == [False, False, True, True, True] and p.watermark("events") == "1970-01-01T00:00:00Z"
    got = p.ingest("events", lambda since: fetch(since, False), "2026-03-04")
    assert (got["records_fetched"], got["written"], got["watermark"]) == (5, True, "2026-03-04T03:00:00Z")
    assert rawlines.read_lines(spark, p.raw_root, "events", "2026-03-04", "b").count() == 4


def test_execution_date_precedence():
    assert execution_date("a", "b") == "a" and execution_date(None, "b") == "b" and execution_date(now=NOW) == "2026-03-05"


def test_streams_end_where_the_batch_does(spark, tmp_path):
    raw, store = str(tmp_path / "r"), Store(spark, str(tmp_path / "s"))
    write = lambda day, records: rawlines.write_lines(spark.createDataFrame([(json.dumps(r),) for r in records], "value string"), raw, "events", day)
    write("2026-03-04", [raw_event("e_1"), raw_event("e_2"), raw_event("e_1")])
    silver, counts = live.silver_sink(store), live.counter_sink(store)
    for day, records in (("2026-03-04", []), ("2026-03-05", [raw_event("e_1", u="2026-03-04T05:00:00Z", op="delete"), raw_event("e_3", u="2026-03-09T00:00:00Z")])):
        if records:
            write(day, records)
        for name, sink in (("silver", silver), ("counts", counts)):
            live.start(live.stream_raw(spark, raw, "events"), sink, str(tmp_path / f"c_{name}")).awaitTermination()
    assert rows_of(store.read("silver.events"), "event_id") == [("e_2",), ("e_3",)]
    assert rows_of(live.live_counts(store), "customer_id", "event_count") == [("c_1", 1)]
    live.compact_counters(store)
    assert store.read("state.event_cells").count() == 3 and rows_of(live.live_counts(store), "customer_id", "event_count") == [("c_1", 1)]
    write("2026-03-06", [raw_event("e_2", u="2026-03-06T00:00:00Z", op="delete"), raw_event("e_4", o="2026-03-04T00:00:00Z", u="2026-03-06T00:00:00Z"), raw_event("e_5", o="2026-03-04T00:00:00Z", u="2026-03-06T00:00:00Z")])
    live.start(live.stream_raw(spark, raw, "events"), counts, str(tmp_path / "c_counts")).awaitTermination()
    assert rows_of(live.live_counts(store), "customer_id", "event_count") == [("c_1", 2)]
    windowed = live.windowed_counts(live.stream_raw(spark, raw, "events"))
    query = windowed.writeStream.format("memory").queryName("windowed").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed").agg(F.max("event_count")).first()[0] == 5


def test_a_stream_sets_rows_without_key_aside(spark, tmp_path):
    raw, store = str(tmp_path / "r"), Store(spark, str(tmp_path / "s"))
    rawlines.write_lines(spark.createDataFrame([(json.dumps(raw_event(e)),) for e in ("e_1", None, "  ")], "value string"), raw, "events", "2026-03-04")
    live.start(live.stream_raw(spark, raw, "events"), live.silver_sink(store), str(tmp_path / "c")).awaitTermination()
    assert rows_of(store.read("silver.events"), "event_id") == [("e_1",)]
    assert rows_of(store.side("silver.events", "rejected_rows"), "table_name", "reason") == [("bronze.events", "no event_id")] * 2
