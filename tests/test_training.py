"""The general training-data operators: edge cases, and brute force on made-up histories."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import changefeed, counters, dedup, drift, history, knowntime, orphans

from tests.conftest import rows_of

EVENTS = "event_id string, customer_id string, event_type string, occurred_at timestamp, updated_at timestamp, channel string, properties string, _raw_payload string, _source_file string, _ingested_at timestamp, _batch_id string"
BASE = datetime(2026, 3, 1, tzinfo=timezone.utc)


def at(minutes):
    return (BASE + timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")


def us(minutes):
    return int((BASE + timedelta(minutes=minutes)).timestamp() * 1_000_000)


def event(e, u, op="insert", c="c_1", t="login", o=0, channel="chat", ingested=0, batch="b", payload=None, file="raw/events/ingestion_date=2026-03-01/part-000.json.gz"):
    return (e, c, t, None if o is None else at(o), None if u is None else at(u), channel, None, f'{{"op": "{op}"}}' if payload is None else payload, file, at(ingested), batch)


# Change feed


def test_last_writer_wins_by_column_and_deletes_forget(table):
    feed = table(EVENTS, [
        event("e_1", 1, channel="chat"), event("e_1", 3, "update", channel=None, t=None, c=None), event("e_1", 2, "update", channel="mail"),
        event("e_2", 1), event("e_2", 2, "delete", c=None, t=None, channel=None),
        event("e_3", 2, "D", c=None, t=None, channel=None), event("e_3", 3, "I", channel="phone"), event("e_3", 1, channel="old"),
        event(" E_4\t", 1, payload='{"is_deleted": true}'), event(None, 1), event("  ", 1), event("e_5", None),
    ])
    state = changefeed.current_state(feed)
    assert rows_of(state, "event_id", "state", "channel", "event_type") == [("e_1", "live", "mail", "login"), ("e_2", "deleted", None, None), ("e_3", "live", "phone", "login"), ("e_4", "deleted", None, None)]


def test_explicit_null_sets_a_field_and_broken_payloads_do_not(table):
    feed = table(EVENTS, [event("e_1", 1), event("e_1", 2, channel=None, payload='{"op": "update", "channel": null}'), event("e_2", 1), event("e_2", 2, channel=None, payload='{"op": "update", "channel": nul')])
    assert rows_of(changefeed.current_state(feed), "event_id", "channel") == [("e_1", None), ("e_2", "chat")]


def test_an_insert_replaces_what_is_older(table):
    feed = table(EVENTS, [event("e_1", 1, channel="chat"), event("e_1", 2, "insert", channel=None)])
    assert rows_of(changefeed.current_state(feed), "channel") == [(None,)]


def test_a_field_is_read_under_all_its_names(table):
    new = lambda e, u, body: event(e, u, channel=None, payload=f'{{"op": "update", {body}}}')
    feed = table(EVENTS, [
        event("e_1", 1, channel="chat"), new("e_1", 2, '"via": "mail"'), event("e_2", 1, channel="chat"), new("e_2", 2, '"contact_channel": {"id": "phone"}'), event("e_3", 1, channel="chat"), new("e_3", 2, '"via": null'),
        event("e_4", 1, channel='{"id":"chat"}', payload='{"op": "insert", "channel": {"id": "chat"}}'), new("e_5", 1, '"channel": null, "via": ["in_app"]'), event("e_6", 1, channel="chat"), new("e_6", 2, '"other": 1'),
        event("e_7", 1, channel="chat", payload="{broken"), event("e_8", 1, o=None, channel="chat", payload='{"op": "insert", "when": "2026-03-01T00:05:00Z"}'), new("e_9", 1, '"wei\'rd {x}": "mail"'),
    ])
    state = changefeed.current_state(feed, aliases={"channel": ("contact_channel", "via", "wei'rd {x}"), "occurred_at": ("when",), "properties": ()})
    assert rows_of(state, "event_id", "channel") == [("e_1", "mail"), ("e_2", "phone"), ("e_3", None), ("e_4", "chat"), ("e_5", "in_app"), ("e_6", "chat"), ("e_7", "chat"), ("e_8", "chat"), ("e_9", "mail")]
    assert rows_of(state.filter("event_id = 'e_8'").select(F.unix_micros("occurred_at"))) == [(us(5),)]


def test_feed_order_and_repeats_do_not_matter(table):
    rng = random.Random(5)
    rows = [event(f"e_{rng.randrange(8)}", rng.randrange(30), rng.choice(("insert", "update", "delete")), channel=rng.choice(("a", "b", None))) for _ in range(120)]
    once = rows_of(changefeed.current_state(table(EVENTS, rows)))
    rng.shuffle(rows)
    assert rows_of(changefeed.current_state(table(EVENTS, rows + rows[:40]))) == once


def test_empty_tables_give_empty_results(table):
    nothing = table(EVENTS, [])
    versions = table("customer_id string, plan string, valid_from timestamp, valid_to timestamp, _silver_loaded_at timestamp", [])
    lines = table("customer_id string, plan string, segment string, country string, is_active boolean, updated_at timestamp, _ingested_at timestamp", [])
    gold = table("event_date date, customer_id string, event_type string, event_count bigint", [])
    for df in (
        changefeed.current_state(nothing), counters.right_counts(nothing), counters.corrections(gold, counters.right_counts(nothing)), dedup.single_copies(nothing, dedup.accepted(dedup.resolve(nothing))), dedup.repeated(dedup.resolve(nothing)), dedup.resolve(nothing).ranges, history.history(lines),
        orphans.orphans(nothing, versions), knowntime.as_known(nothing, versions), drift.field_changes(drift.field_statistics(nothing)), drift.unify(nothing, [("event_id", "string")], []),
    ):
        assert df.count() == 0


# Late events


def test_cut_off_is_inclusive_and_takes_the_first_change(table):
    day = 24 * 60
    changes = table(EVENTS, [
        event("e_1", 3 * day, o=0), event("e_2", 3 * day + 1, o=0), event("e_3", 10, o=0), event("e_3", 9 * day, "update", o=0),
        event("e_4", 5, o=0), event("e_4", 6, "delete", c=None, t=None, o=None), event("e_5", 5, o=None), event("e_6", 5, c=None), event(None, 5), event("e_7", 5, t="LOGIN ", c=" C_1"),
    ])
    assert rows_of(counters.right_counts(changes).filter("event_count > 0"), "customer_id", "event_type", "event_count") == [("c_1", "login", 3)]


def brute_counts(rows):
    """The counts of some raw changes, event by event."""
    counts = {}
    for e in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == e]
        first, last = min(r[4] for r in own), max(own, key=lambda r: (r[4], "delete" in r[7]))
        attributes = [max((r[i] for r in own if r[i] is not None), default=None) for i in (1, 2, 3)]
        if "delete" in last[7] or None in attributes or datetime.fromisoformat(first) - datetime.fromisoformat(attributes[2]) > timedelta(hours=72):
            continue
        k = (attributes[2][:10], *attributes[:2])
        counts[k] = counts.get(k, 0) + 1
    return counts


def made_up_changes(rng, n):
    rows = []
    for _ in range(n):
        e, gone = rng.randrange(15), rng.random() < 0.2
        # Customers are corrected at times, deletes say little, and some changes come long after the event.
        rows.append(event(f"e_{e}", rng.randrange(200) if rng.random() < 0.8 else 6000, "delete" if gone else "update", c=None if gone else f"c_{rng.randrange(3)}", o=None if gone else e * 30, t=None if gone else "login", ingested=rng.randrange(6), batch=""))
    return rows


def test_counts_equal_brute_force(table):
    rows = made_up_changes(random.Random(4), 90)
    got = counters.right_counts(table(EVENTS, rows)).filter("event_count > 0")
    assert {(str(d), c, t): n for d, c, t, n in got.collect()} == brute_counts(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_counters_merge_to_the_truth_for_any_order_repetition_and_partition(table, seed):
    rng = random.Random(seed)
    rows = made_up_changes(rng, 60)
    batches = [rows[i::3] for i in range(3)] if seed == 1 else [rows[:5], rows[5:40], rows[30:]]
    order = [*range(3), rng.randrange(3), rng.randrange(3)]
    rng.shuffle(order)
    spark = table(EVENTS, []).sparkSession
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    empty_cells, empty = counters.arrivals(table(EVENTS, []), F.lit(0).cast("long")), counters.emissions(counters.movements(counters.arrivals(table(EVENTS, []))))
    cells, states = fixed(empty_cells), fixed(empty)
    for n, b in enumerate([*order, *set(range(3)) - set(order)]):
        new, emitted = map(fixed, counters.advance(cells, states, table(EVENTS, batches[b]), n + 1))
        if n == 1:  # emitted, then lost before the cells were written: the same batch again
            states = states.unionByName(emitted)
            new, emitted = map(fixed, counters.advance(cells, states, table(EVENTS, batches[b]), n + 1))
        cells, states = cells.unionByName(new), states.unionByName(emitted)
    merged = counters.merge_counters(states)
    got = {(str(d), c, t): n for d, c, t, n in counters.totals(merged).filter("event_count > 0").collect()}
    assert got == brute_counts(rows)
    shuffled = spark.createDataFrame(rng.sample(states.collect(), states.count()) + states.collect(), states.schema)
    assert rows_of(counters.merge_counters(merged.unionByName(shuffled))) == rows_of(merged)
    assert states.count() > merged.count()


def test_corrections_name_missing_superfluous_and_wrong_keys(table):
    gold = table("event_date date, customer_id string, event_type string, event_count bigint, extra string", [("2026-03-01", "c_1", "login", 1, ""), ("2026-03-01", "c_9", "login", 2, ""), ("2026-03-01", None, "login", 5, "")])
    changes = table(EVENTS, [event("e_1", 1), event("e_2", 1), event("e_3", 1, t="report_viewed")])
    assert rows_of(counters.corrections(gold, counters.right_counts(changes)), "customer_id", "event_type", "was", "event_count") == [("c_1", "login", 1, 2), ("c_1", "report_viewed", 0, 1), ("c_9", "login", 2, 0)]


# Repeated messages


def test_each_message_once_within_and_across_batches(table):
    rows = table(EVENTS, [
        event("e_00000001", 1, ingested=5, batch="b2"), event(" E_00000001", 1, ingested=3, batch="b1", channel="first"), event("e_00000001", 2, ingested=9), event("e_00000001", 1, ingested=3, batch="b1", channel="first"),
        event("e_00000002", 1), event("odd id", 1, ingested=1), event("odd id", 1, ingested=2), event(None, 1), event(None, 1), event("e_00000003", None), event("e_00000003", None),
    ])
    resolved = dedup.resolve(rows)
    assert rows_of(dedup.repeated(resolved)) == [("e_00000001", us(1)), ("odd id", us(1))]
    kept = dedup.single_copies(rows, dedup.accepted(resolved))
    assert kept.columns == rows.columns and kept.count() == 8
    assert rows_of(kept.filter(F.col("event_id").contains("1") & F.col("channel").eqNullSafe("first")), "_batch_id") == [("b1",)]
    # Only the first message of each number is settled by the ranges; the malformed identifier goes to the lookup.
    assert rows_of(resolved.lines.filter("by_range"), "id", "us") == [("e_00000001", us(1)), ("e_00000002", us(1))]
    assert rows_of(dedup.lookup(resolved), "id", "us", "copies") == [("e_00000001", us(2), 1), ("odd id", us(1), 2)]


def test_ranges_are_disjoint_and_later_batches_meet_them(table, spark):
    first = table(EVENTS, [event(f"e_{n:08d}", 1) for n in (1, 2, 3, 7, 8, 70000)] + [event("x-1", 1)])
    resolved = dedup.resolve(first)
    seen = dedup.advance(resolved, dedup.accepted(resolved))
    assert rows_of(seen.ranges, "producer", "lo", "hi") == [("e", 1, 3), ("e", 7, 8), ("e", 70000, 70000)]
    # 2 is a repeat, 3 a later version, 4 and 5 fill the gap, x-1 repeats a malformed identifier.
    rows = table(EVENTS, [event(i, v, batch="n") for i, v in (("e_00000002", 1), ("e_00000003", 2), ("e_00000004", 1), ("e_00000005", 1), ("x-1", 1), ("x-2", 1))])
    second = dedup.resolve(rows, seen=seen)
    assert rows_of(second.lines, "id", "by_range") == [("e_00000002", False), ("e_00000003", False), ("e_00000004", True), ("e_00000005", True), ("x-1", False), ("x-2", False)]
    kept = dedup.accepted(second)
    assert rows_of(kept, "id") == [("e_00000003",), ("e_00000004",), ("e_00000005",), ("x-2",)]
    assert rows_of(dedup.repeated(second), "id") == [("e_00000002",), ("x-1",)] and dedup.single_copies(rows, kept).count() == 4
    after = dedup.advance(second, kept)
    assert rows_of(after.ranges, "producer", "lo", "hi") == [("e", 1, 5), ("e", 7, 8), ("e", 70000, 70000)]
    assert after.messages.count() == 7 + 4


def test_ranges_equal_a_set_of_numbers():
    import numpy as np

    rng = random.Random(8)
    for spread in (50, 3000, 10**9):
        ranges, known = dedup.Ranges(), set()
        for _ in range(4):
            numbers = [rng.randrange(spread) for _ in range(6000)]
            wanted = []
            for i, n in enumerate(numbers):
                if n not in known:
                    known.add(n)
                    wanted.append(i)
            assert ranges.take(np.array(numbers, dtype=np.int64)).tolist() == wanted
        assert sorted(known) == [n for lo, hi in zip(ranges.lo, ranges.hi, strict=True) for n in range(lo, hi + 1)]
        assert (ranges.lo[1:] > ranges.hi[:-1] + 1).all()


def test_numbers_of_eighteen_digits_keep_their_last_one(table):
    ids = [f"e_9007199254740993{n:02d}" for n in (1, 2, 3, 5)]
    first = dedup.resolve(table(EVENTS, [event(i, 1) for i in ids]))
    seen = dedup.advance(first, dedup.accepted(first))
    second = dedup.resolve(table(EVENTS, [event(i, 1, batch="n") for i in (*ids, "e_900719925474099304")]), seen=seen)
    assert rows_of(dedup.accepted(second), "id") == [("e_900719925474099304",)]
    assert rows_of(second.ranges, "lo", "hi") == [(900719925474099301, 900719925474099305)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_messages_equal_brute_force_however_they_are_batched(table, batches, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_BITS", 3)
    monkeypatch.setattr(dedup, "STEP", 4)
    rng = random.Random(batches)
    ids = [f"e_{n:08d}" for n in range(20)] + [f"z_{n}" for n in range(5)] + ["odd", "e_x"]
    rows = [event(rng.choice(ids), rng.choice((1, 1, 2)), ingested=i // 10, batch=f"b{i // 10}") for i in range(100)]
    rows += [event("e_00000007", 3 + i, ingested=4, batch="b4") for i in range(40)]  # one number in very many versions
    seen, kept, repeats = None, [], set()
    for b in range(batches):
        own = [r for r in rows if int(r[-1][1:]) % batches == b] if batches > 1 else rows
        resolved = dedup.resolve(table(EVENTS, own), seen=seen)
        taken = dedup.accepted(resolved)
        kept += rows_of(taken, "id", "us")
        repeats |= set(rows_of(dedup.repeated(resolved)))
        seen = dedup.advance(resolved, taken)
        seen = dedup.Seen(*(df.sparkSession.createDataFrame(df.collect(), df.schema) for df in (seen.ranges, seen.messages)))
    messages = [(r[0], us(int((datetime.fromisoformat(r[4]).replace(tzinfo=timezone.utc) - BASE).total_seconds() // 60))) for r in rows]
    assert sorted(kept) == sorted(set(messages)) and repeats == {m for m in messages if messages.count(m) > 1}


def test_dedup_keeps_clashing_and_map_columns(spark, table):
    rows = table(EVENTS, [event("e_1", 1), event("e_1", 1)]).withColumns({"seq": F.lit("s"), "id": F.lit(1), "row": F.create_map(F.lit("a"), F.lit(1)), "batch": F.lit(None).cast("string"), "copies": F.lit(0), "__order": F.lit(1)})
    kept = dedup.single_copies(rows, dedup.accepted(dedup.resolve(rows)))
    assert kept.columns == rows.columns and kept.count() == 1 and kept.first()["row"] == {"a": 1}


# History

LINES = "customer_id string, plan string, segment string, country string, is_active boolean, updated_at timestamp, _ingested_at timestamp, company_name string"


def brute_history(lines):
    out = []
    for c in {r[0] for r in lines}:
        versions, before = [], None
        for r in sorted((r for r in lines if r[0] == c), key=lambda r: r[5]):
            now = (r[1].strip().lower(), *r[2:5])
            if before is None or now != before:
                versions.append((r[5], now))
            before = now
        for i, (start, now) in enumerate(versions):
            out.append((c, start, versions[i + 1][0] if i + 1 < len(versions) else None, *now[:3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("period_days", [1, 3, 400])
def test_history_equals_brute_force_for_any_period(table, period_days):
    rng = random.Random(period_days)
    lines = []
    for c in ("c_1", "c_2", "c_3"):
        for minute in rng.sample(range(20000), 60):
            lines.append((c, rng.choice(("free", " Free", "pro")), rng.choice(("SMB", None)), rng.choice(("DE", None)), True, at(minute), at(0), rng.choice("xyz")))
    got = history.history(table(LINES, lines + lines[:30]), period_us=period_days * 86_400_000_000)
    text = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    assert rows_of(got.select("id", text("valid_from_us"), text("valid_to_us"), "plan", "segment", "country")) == brute_history(lines)
    assert got.filter("is_current").count() == 3


def test_store_holds_checkpoints_and_patches(table):
    lines = table(LINES, [("c_1", "free", "SMB", "DE", True, at(0), at(0), ""), ("c_1", "pro", "SMB", "DE", True, at(10), at(0), ""), ("c_1", "pro", "SMB", None, True, at(20), at(0), ""), (None, "pro", "SMB", None, True, at(20), at(0), ""), ("c_2", "pro", None, None, None, None, None, "")])
    store = history.store_versions(history.attribute_lines(lines))
    assert [(r["is_checkpoint"], r["patch"]) for r in store.orderBy("us").collect()] == [(True, {"plan": "free", "segment": "SMB", "is_active": "true", "country": "DE"}), (False, {"plan": "pro"}), (False, {"country": None})]
    assert rows_of(history.fold_versions(store), "plan", "country", "is_current", "versions") == [("free", "DE", False, 3), ("pro", "DE", False, 3), ("pro", None, True, 3)]


def test_lines_of_one_instant_take_the_last_arrival(table):
    lines = table(LINES, [("c_1", "free", "SMB", "DE", True, at(0), at(1), ""), ("C_1 ", "pro", "SMB", "DE", True, at(0), at(2), "")])
    assert rows_of(history.history(lines), "id", "plan", "versions") == [("c_1", "pro", 1)]


# Orphans

VERSIONS = "customer_id string, plan string, valid_from timestamp, valid_to timestamp, _silver_loaded_at timestamp, occurred_at string, row string"


def version(c, plan, start, end=None, loaded=None):
    return (c, plan, None if start is None else at(start), None if end is None else at(end), at(start if loaded is None else loaded) if start is not None else None, "", "")


def test_orphan_reasons(table):
    parents = table(VERSIONS, [version("c_1", "free", 10, 20), version("c_1", "pro", 20), version("c_2", "free", 10, 20), version(None, "x", 1), version("c_4", "free", 10, 20), version("c_4", "free", None)])
    events = table(EVENTS, [event("e_1", 1, c="C_1 ", o=10), event("e_2", 1, c="c_1", o=9), event("e_3", 1, c="c_2", o=20), event("e_4", 1, c="c_2", o=19), event("e_5", 1, c="c_3", o=1), event("e_5", 1, c="c_3", o=1), event("e_6", 1, c=None), event("e_7", 1, o=None), event(None, 1, c="c_3")])
    found = orphans.orphans(events, parents)
    assert rows_of(found, "event_id", "reason") == [("e_2", "late"), ("e_3", "deleted"), ("e_5", "missing"), ("e_5", "missing"), (None, "missing")]
    assert rows_of(orphans.orphan_report(found, "t")) == [("t", "2026-03", "deleted", 1, 1), ("t", "2026-03", "late", 1, 1), ("t", "2026-03", "missing", 3, 1)]


def test_no_parents_and_saturated_filters_change_nothing(table, monkeypatch):
    events = table(EVENTS, [event(f"e_{i}", 1, c=f"c_{i}", o=5) for i in range(50)])
    assert orphans.orphans(events, table(VERSIONS, [])).count() == 50
    parents = table(VERSIONS, [version(f"c_{i}", "free", 0) for i in range(0, 50, 2)])
    monkeypatch.setattr(orphans, "may_contain", lambda words, key: F.lit(True))
    assert rows_of(orphans.orphans(events, parents), "reason") == [("missing",)] * 25


def test_a_filter_too_large_to_broadcast_is_joined_by_segment(table, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(orphans, "segments", lambda n: 3)
    events = table(EVENTS, [event(f"e_{i}", 1, c=f"c_{i}", o=5) for i in range(50)])
    found = orphans.orphans(events, table(VERSIONS, [version(f"c_{i}", "free", 0) for i in range(0, 50, 2)]))
    assert rows_of(found, "reason") == [("missing",)] * 25 and rows_of(found, "event_id") == sorted((f"e_{i}",) for i in range(1, 50, 2))


def test_bloom_filter_never_denies_a_parent_and_seldom_admits_others(spark):
    keys = spark.range(50000).select(F.concat(F.lit("c_"), "id").alias("k"))
    count = orphans.segments(50000)
    bloom = orphans.bloom_filter(keys, "k", count)
    assert count == 2 and [len(r["words"]) for r in bloom.collect()] == [orphans.SEGMENT_BITS // 64] * 2
    asked = orphans.tested(spark.range(100000).select("id", F.concat(F.lit("c_"), "id").alias("k")), "k", bloom, count)
    assert asked.filter("id < 50000 and not maybe").count() == 0
    assert asked.filter("id >= 50000 and maybe").count() < 1500
    assert orphans.segments(0) == 1 and orphans.segments(10**8) * orphans.SEGMENT_BITS >= 12 * 10**8


# Known at event time


def brute_known(events, versions):
    out = []
    for e in events:
        own = [v for v in versions if v[0] == e[1] and v[1] <= e[2] and v[3] <= e[2]]
        out.append((e[0], max(own, key=lambda v: (v[1], v[2]))[2] if own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("period_minutes", [7, 100, 100000])
def test_known_attributes_equal_brute_force_for_any_period(table, period_minutes):
    rng = random.Random(period_minutes)
    versions = [(f"c_{c}", f, rng.choice("abc"), f + rng.choice((0, 0, 30, 200))) for c in range(3) for f in rng.sample(range(300), 12)]
    events = [(f"e_{i}", f"c_{rng.randrange(4)}", rng.randrange(400)) for i in range(150)]
    got = knowntime.as_known(
        table(EVENTS, [event(e, 0, c=c, o=o) for e, c, o in events]), table(VERSIONS, [version(c, p, f, loaded=l) for c, f, p, l in versions]), period_us=period_minutes * 60_000_000
    )
    assert rows_of(got, "row.event_id", "known.plan") == brute_known(events, versions)


def test_a_change_at_the_event_time_is_known_and_an_older_version_loaded_later_loses(table):
    versions = table(VERSIONS, [version("c_1", "new", 10, loaded=10), version("c_1", "old", 5, loaded=20), version("c_1", "next", 50)])
    events = table(EVENTS, [event("e_1", 0, o=10), event("e_2", 0, o=9), event("e_3", 0, o=25), event("e_4", 0, o=None), event("e_5", 0, c=None, o=10), event("e_6", 0, c="c_9", o=10), event("e_6", 0, c="c_9", o=10)])
    got = knowntime.as_known(events, versions)
    assert rows_of(got, "row.event_id", "known.plan", "latest.plan") == [("e_1", "new", "next"), ("e_2", None, "next"), ("e_3", "new", "next"), ("e_4", None, None), ("e_5", None, None), ("e_6", None, None), ("e_6", None, None)]


# Drift


def payload(day, part, text):
    return event("e", 1, payload=text, file=f"raw/events/ingestion_date=2026-03-{day:02d}/part-{part:03d}.json.gz")


def test_each_kind_of_change_is_reported_once(table):
    first = [payload(1, 0, f'{{"event_type": "login", "channel": "{c}", "n": {i}, "gone": true, "op": "I", "properties": {{"a": "x", "corrected": true}}}}') for i, c in enumerate(("chat", "mail", "chat"))]
    second = [payload(2, 0, f'{{"event_type": "login", "via": "{c}", "n": "{i}", "fresh": 1.5, "is_deleted": true, "properties": "{{\\"a\\": \\"x\\"}}"}}') for i, c in enumerate(("mail", "chat", "chat"))]
    other = [payload(2, 1, '{"only": "first file of its stream"}'), payload(2, 0, '{"broken": 1,,'), payload(2, 0, "[1]"), payload(2, 0, "null"), (*payload(2, 0, "{}")[:7], None, *payload(2, 0, "{}")[8:]), (*payload(2, 0, "{}")[:8], None, *payload(2, 0, "{}")[9:])]
    changes = drift.field_changes(drift.field_statistics(table(EVENTS, first + second + other)))
    assert rows_of(changes, "field", "change", "new_field", "old_type", "new_type") == [
        ("channel", "renamed", "via", "string", None), ("fresh", "added", None, None, "number"), ("gone", "removed", None, "boolean", None), ("n", "retyped", None, "number", "string"), ("properties", "retyped", None, "object", "string"),
    ]


def test_null_values_are_no_fields_and_an_unreadable_file_has_none(table):
    rows = [payload(1, 0, '{"a": 1, "b": null}'), payload(2, 0, '{"a": null, "b": null}'), payload(3, 0, "broken")]
    assert rows_of(drift.field_changes(drift.field_statistics(table(EVENTS, rows))), "field", "change") == [("a", "removed")]


def test_unrelated_fields_are_no_rename(table):
    rows = [payload(1, 0, '{"event_type": "export", "rows": 120}'), payload(1, 0, '{"event_type": "login"}'), payload(2, 0, '{"event_type": "export"}'), payload(2, 0, '{"event_type": "login", "took": 130}')]
    assert rows_of(drift.field_changes(drift.field_statistics(table(EVENTS, rows))), "field", "change") == [("rows", "removed"), ("took", "added")]


def test_unify_casts_and_reports_what_cannot_be_cast(table):
    rows = [payload(1, 0, '{"via": {"id": "mail"}, "properties": {"rows": "12", "ok": "no idea"}}'), payload(1, 0, '{"channel": ["chat"], "properties": "{\\"rows\\": 3, \\"ok\\": true}"}'), payload(1, 0, "broken")]
    catalog = [("channel", "string"), ("properties.rows", "number"), ("properties.ok", "boolean")]
    out = drift.unify(table(EVENTS, rows), catalog, [("part-000.json.gz", "via", "channel")])
    assert rows_of(out, "is_valid", "channel", "properties_rows", "properties_ok", "failed_casts") == [(False, None, None, None, []), (True, "chat", 3.0, True, []), (True, "mail", 12.0, None, ["properties.ok"])]


def test_an_alias_holds_in_its_stream_and_for_the_kinds_that_have_the_field(table):
    rows = [payload(1, part, f'{{"via": "mail", "event_type": "{kind}"}}') for part, kind in ((0, "login"), (0, "export"), (1, "login"))] + [payload(1, 0, '{"via": "none"}')]
    out = drift.unify(table(EVENTS, rows), [("channel", "string"), ("event_type", "string")], [("part-000.json.gz", "via", "channel")], kinds={"channel": {"login"}})
    assert rows_of(out, "event_type", "channel") == [("export", None), ("login", "mail"), ("login", None), (None, "none")]
    for catalog in ([("a.b", "string"), ("a_b", "string")], [("a", "string"), ("a", "number")]):
        with pytest.raises(ValueError):
            drift.unify(table(EVENTS, rows), catalog, [])


def test_aliases_follow_chains_of_renames_within_their_stream(spark):
    changes = spark.createDataFrame([("d/s", "renamed", "channel", "via"), ("e/s", "renamed", "via", "contact"), ("d/t", "renamed", "sid", "session_id"), ("d/t", "added", "x", None), ("d/u", "renamed", "other", "via")], "file string, change string, field string, new_field string")
    assert drift.field_aliases(changes, ["channel", "session_id"]) == [("s", "contact", "channel"), ("s", "via", "channel"), ("t", "sid", "session_id")]


def test_values_of_any_length_carry_a_rename(table):
    long = [f"{'word ' * 30}{i % 7}x{chr(97 + i % 5)}" for i in range(40)]
    rows = [payload(1, 0, f'{{"event_type": "login", "note": "{v}"}}') for v in long] + [payload(2, 0, f'{{"event_type": "login", "remark": "{v}", "other": "{v[::-1]}"}}') for v in long]
    assert rows_of(drift.field_changes(drift.field_statistics(table(EVENTS, rows))), "field", "change", "new_field") == [("note", "renamed", "remark"), ("other", "added", None)]
