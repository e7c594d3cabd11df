"""The pipeline over a store: ingest, bronze, silver, quality gate, gold. Every stage can be run again without changing its result.

State passes between stages through tables only. A stage that fails leaves the last complete version of each table.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import islice
from time import monotonic
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesmith.logs import log
from lakesmith.operators import medallion, merge, quality, scd2
from lakesmith.plans import incremental
from lakesmith.plans.durable import durable
from lakesmith.sources import rawlines
from lakesmith.store import Store, label

EPOCH = "1970-01-01T00:00:00Z"
SOURCES = ("events", "customers")

#: Records that are fetched before they are written.
INGEST_RECORDS = 50_000


class QualityGateError(RuntimeError):
    """A critical check failed; the results are in the store."""


def execution_date(argument: str | None = None, environment: str | None = None, now: datetime | None = None) -> str:
    """The day of a run: the argument, else the environment's, else today in UTC."""
    return argument or environment or (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d")


def notification(results: Iterable[dict[str, Any]], run_id: str) -> dict[str, Any]:
    """A chat message about the results that did not pass."""
    bad = [r for r in results if r["status"] != "passed"]
    lines = [f"[{r['severity']}] {r['check_name']} on {r['table_name']}: {r['status']}, {r['records_failed']} of {r['records_checked']}" for r in bad]
    return {"text": f"Run {run_id}: {len(bad)} checks did not pass" if bad else f"Run {run_id}: all checks passed", "blocks": [{"type": "section", "text": {"type": "mrkdwn", "text": line}} for line in lines]}


@dataclass
class Pipeline:
    spark: SparkSession
    store: Store
    raw_root: str
    reference: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    on_failure: Callable[[str, BaseException], None] = lambda stage, error: None
    on_success: Callable[[dict[str, Any]], None] = lambda summary: None
    on_late: Callable[[str, float], None] = lambda stage, seconds: None
    sla_seconds: float = 2 * 3600

    def _now(self) -> Column:
        return F.timestamp_micros(F.lit(int(self.reference().timestamp() * 1_000_000)))

    # Watermarks: what was ingested of a source, as the text that its own records carry.

    def watermark(self, source: str, default: str = EPOCH) -> str:
        row = self.store.read("control.watermarks").filter(F.col("source") == source).first()
        return row["watermark"] if row else default

    def set_watermark(self, source: str, value: str) -> None:
        base = self.store.newest("control.watermarks").number
        table = self.store.read("control.watermarks")
        new = self.spark.createDataFrame([(source, value)], table.schema)
        self.store.replace("control.watermarks", merge.merge(table, new, ("source",)), "watermark", base)

    def ingest(self, source: str, fetch: Callable[[str], Iterable[dict[str, Any]]], day: str) -> dict[str, Any]:
        """Fetches what changed since the watermark into the raw zone; the watermark moves only after all lines are written.

        At most INGEST_RECORDS are held at a time, if `fetch` gives them one by one.

        The bound is inclusive, so records at the watermark come again; the raw zone and silver keep each once.
        """
        since = self.watermark(source)
        records, fetched, written, newest = iter(fetch(since)), 0, False, since
        while some := list(islice(records, INGEST_RECORDS)):
            lines = self.spark.createDataFrame([(json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")),) for r in some], "value string")
            written = rawlines.write_lines(lines, self.raw_root, source, day) or written
            newest = max([newest, *(r["updated_at"] for r in some if isinstance(r.get("updated_at"), str))])
            fetched += len(some)
        if newest != since:
            self.set_watermark(source, newest)
        return {"source": source, "since": since, "records_fetched": fetched, "written": written, "watermark": self.watermark(source)}

    def bronze(self, source: str, day: str) -> dict[str, Any]:
        """Appends the raw files of a day that are not in bronze yet, one row per line; of files changed since, the lines that bronze lacks."""
        name, batch = f"bronze.{source}", str(uuid.uuid4())
        base = self.store.newest(name).number
        lines = rawlines.read_lines(self.spark, self.raw_root, source, day, batch, self._now())
        known = self.store.side(name, "loaded_files").select(F.col("source_file").alias("_source_file"), "version")
        files = durable(rawlines.file_versions(self.spark, self.raw_root, source, day).join(known, ["_source_file", "version"], "left_anti"))
        changed = files.join(known, "_source_file", "left_semi").select("_source_file")
        # Equal lines of a file are told apart by number, so each comes as often as the file has it.
        line = ["_source_file", "_raw_payload", "__n"]
        number = F.row_number().over(Window.partitionBy(*line[:2]).orderBy("_source_file"))
        held = self.store.read(name).join(changed, "_source_file", "left_semi").withColumn("__n", number).select(*line)
        added = lines.join(changed, "_source_file", "left_semi").withColumn("__n", number).join(held, line, "left_anti").select(*lines.columns)
        fresh = lines.join(files, "_source_file", "left_semi").join(known, "_source_file", "left_anti").unionByName(added)
        rows = durable((medallion.bronze_events if source == "events" else medallion.bronze_customers)(fresh))
        count = rows.count()
        if not files.isEmpty():
            # Rows and the files that they came from are one commit, and a run that another one overtook fails.
            loaded = files.select(F.col("_source_file").alias("source_file"), "version")
            self.store.write(name, "append", rows if count else None, base=base, sides={"loaded_files": loaded})
        return {"table": name, "ingestion_date": day, "batch_id": batch, "records_read": count, "records_written": count}

    def _unprocessed(self, source: str, target: str) -> tuple[DataFrame, str | None]:
        """The bronze rows appended since the target was last brought up to date, and the version that it will then have seen; None if there is nothing new."""
        name, seen = f"bronze.{source}", self.store.note(target, "bronze")
        newest = self.store.current(name)
        if newest is None or str(newest) == seen:
            return self.store.read(name), None
        return self.store.added(name, int(seen) if seen else None), str(newest)

    def silver_events(self, full: bool = False) -> dict[str, Any]:
        """The newest change of each event, merged where it is newer than what silver holds; deletes remove their event."""
        name = "silver.events"
        if full:
            incremental.merge_events(self.store, self.store.read("bronze.events"), self._now(), {}, "merge", aside=False)
            return {"table": name, "merged": True, "rows": self.store.read(name).count()}
        fresh, seen = self._unprocessed("events", name)
        if seen is not None:
            incremental.merge_events(self.store, fresh, self._now(), {"bronze": seen})
        return {"table": name, "merged": seen is not None, "rows": self.store.read(name).count()}

    def silver_customers(self) -> dict[str, Any]:
        name = "silver.customers"
        fresh, seen = self._unprocessed("customers", name)
        if seen is not None:
            incremental.merge_customers(self.store, fresh, lambda dimension, incoming: scd2.apply_latest(dimension, incoming, loaded_at=self._now()), {"bronze": seen})
        return {"table": name, "merged": seen is not None, "rows": self.store.read(name).count()}

    def quality(self) -> list[dict[str, Any]]:
        """Runs the seven checks, keeps their results, and raises if a critical one failed. The results are kept first."""
        began = monotonic()
        events, customers = self.store.read("silver.events"), self.store.read("silver.customers")
        volumes = quality.volume_history(events, "silver.events", "occurred_at").withColumn("recorded_at", self._now())
        incremental.merge_into(self.store, "quality.volume_history", volumes, ("table_name", "metric_date"), delete_unmatched=True)
        report = quality.report(events, customers, self._now(), self.store.read("quality.volume_history"))
        results = [r.asDict() for r in report.collect()]
        details: dict[tuple[str, str], dict[str, Any]] = {}
        for d in quality.details(events, customers, self._now(), self.store.read("quality.volume_history")).collect():
            own = details.setdefault((d["check_name"], d["table_name"]), {})
            if d["key"] is None:
                own[d["item"]] = d["number"]
            else:
                own.setdefault(d["item"], {})[d["key"]] = int(d["number"])
        took = monotonic() - began
        rows = [
            {**r, "check_id": str(uuid.uuid4()), "check_description": r["check_name"], "details": json.dumps(details.get((r["check_name"], r["table_name"]), {})), "executed_at": self.reference(), "pipeline_run_id": self.run_id, "duration_seconds": took}
            for r in results
        ]
        table = self.store.definition("quality.check_results").schema
        self.store.append("quality.check_results", self.spark.createDataFrame([tuple(r[n] for n in table.fieldNames()) for r in rows], table))
        if failed := [r["check_name"] for r in results if r["severity"] == "critical" and r["status"] == "failed"]:
            raise QualityGateError(f"critical checks failed: {', '.join(failed)}")
        return results

    def gold(self, rebuild: bool = False) -> list[dict[str, Any]]:
        """The three gold tables for the months of silver that changed since they were last made; `rebuild` makes all months anew.

        A month is made whole, so keys that silver no longer gives go with it. The signup months of a changed customer may
        concern any month of the activity, which is then made anew as well.
        """
        store, events, customers = self.store, "silver.events", "silver.customers"
        seen = {t: str(store.newest(t).number) for t in (events, customers)}
        out = []
        for name in ("gold.events_daily_summary", "gold.ticket_events", "gold.customer_monthly_activity"):
            since = store.note(name, events)
            whole = rebuild or not since or (name == "gold.customer_monthly_activity" and store.note(name, customers) != seen[customers])
            months = store.changed_partitions(events, int(since) if since and int(since) >= 0 else None)
            if whole:
                months = {label(p) for t in (events, name) for p in store.newest(t).parts}
            rows = store.read(events, partitions=months)
            made = {
                "gold.events_daily_summary": lambda rows: medallion.daily_summary(rows).withColumn("updated_at", self._now()), "gold.ticket_events": medallion.ticket_events,
                "gold.customer_monthly_activity": lambda rows: medallion.monthly_activity(rows, store.read(customers)),
            }[name](rows)
            if months or not since:
                incremental.merge_into(store, name, made, store.definition(name).key, delete_unmatched=True, touched=months, notes=seen)
            out.append({"table": name, "months": len(months), "rows": store.read(name).count()})
        return out

    def run(self, day: str, fetch: dict[str, Callable[[str], Iterable[dict[str, Any]]]] | None = None, only: tuple[str, ...] = SOURCES, rebuild: bool = False) -> dict[str, Any]:
        """All stages in order. A failed gate stops gold. `only` limits ingestion, bronze and silver to some sources."""
        stages: list[tuple[str, Callable[[], Any]]] = []
        for s in only:
            if fetch and s in fetch:
                stages.append((f"ingest.{s}", lambda s=s: self.ingest(s, fetch[s], day)))
        stages += [(f"bronze.{s}", lambda s=s: self.bronze(s, day)) for s in only]
        stages += [(f"silver.{s}", getattr(self, f"silver_{s}")) for s in only]
        stages += [("quality", self.quality), ("gold", lambda: self.gold(rebuild))]
        summary: dict[str, Any] = {"run_id": self.run_id, "day": day}
        for name, stage in stages:
            began = monotonic()
            try:
                summary[name] = stage()
            except BaseException as error:
                log("stage_failed", logging.ERROR, stage=name, error=str(error)[:500])
                self.on_failure(name, error)
                raise
            took = monotonic() - began
            log("stage_done", stage=name, duration_seconds=round(took, 3))
            if took > self.sla_seconds:
                log("stage_late", logging.WARNING, stage=name, duration_seconds=round(took, 3), sla_seconds=self.sla_seconds)
                self.on_late(name, took)
        summary["records_fetched"] = sum(summary[f"ingest.{s}"]["records_fetched"] for s in only if f"ingest.{s}" in summary)
        self.on_success(summary)
        return summary
