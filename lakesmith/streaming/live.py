"""Structured Streaming over the same operators: raw files into bronze, changes into silver, late events into counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesmith.operators import counters, medallion
from lakesmith.operators.medallion import not_blank
from lakesmith.plans import incremental
from lakesmith.schemas import Table
from lakesmith.store import Store

#: The state of the late-event counters: cells of the events by micro-batch, and what the sources emitted.
CELLS = Table("event_id string, sequence bigint, first_us bigint, last bigint, occurred_us bigint, customer_id string, event_type string", ("event_id",))
EMISSIONS = Table("event_date date, customer_id string, event_type string, source int, sequence bigint, n bigint", (*counters.KEY, "source", "sequence"))


def stream_raw(spark: SparkSession, raw_root: str, source: str) -> DataFrame:
    """The raw lines of a source as a stream of bronze rows; new files are picked up as they appear."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").load(f"{raw_root}/raw/{source}")
    lines = lines.select(F.col("value").alias("_raw_payload"), F.col("_metadata.file_path").alias("_source_file")).filter(not_blank(F.col("_raw_payload")))
    rows = lines.withColumns({"_ingested_at": F.current_timestamp(), "_batch_id": F.lit("stream")})
    return (medallion.bronze_events if source == "events" else medallion.bronze_customers)(rows)


def once_per_batch(store: Store, table: str, apply: Callable[[DataFrame, int, dict[str, str]], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips a micro-batch that the table holds already.

    apply(rows, batch, notes) must commit the notes with the last of its writes to the table.
    """

    def run(rows: DataFrame, batch: int) -> None:
        if int(store.note(table, "stream", "-1")) < batch:
            apply(rows, batch, {"stream": str(batch)})

    return run


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes everything that is there and stops; call it again, or use a processing-time trigger, to go on."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silver_sink(store: Store) -> Callable[[DataFrame, int], None]:
    """Merges each micro-batch of bronze events into silver as the pipeline does, in one commit that only rewrites the months it touches."""

    def apply(rows: DataFrame, batch: int, notes: dict[str, str]) -> None:
        incremental.merge_events(store, rows, F.current_timestamp(), notes, "stream")

    return once_per_batch(store, "silver.events", apply)


def counter_sink(store: Store, cut_off_us: int = counters.CUT_OFF_US) -> Callable[[DataFrame, int], None]:
    """Adds each micro-batch's cells and the emissions that follow from them to the state, which is never rewritten.

    The emissions are written first. A micro-batch that failed in between finds the same cells as before and emits the
    same once more, which merging by the greatest sequence undoes.
    """
    store.create("state.event_cells", CELLS)
    store.create("state.event_counters", EMISSIONS)

    def apply(rows: DataFrame, batch: int, notes: dict[str, str]) -> None:
        cells, emitted = counters.advance(store.read("state.event_cells"), store.read("state.event_counters"), rows, batch + 1, cut_off_us)
        store.append("state.event_counters", emitted)
        store.append("state.event_cells", cells, notes=notes)

    return once_per_batch(store, "state.event_cells", apply)


def compact_counters(store: Store) -> None:
    """Joins the state's cells to one per event and its emissions to one per key and source; what they say stays the same."""
    for name, joined in (
        ("state.event_cells", lambda rows: counters.merge_cells(rows).join(rows.groupBy("event_id").agg(F.max("sequence").alias("sequence")), "event_id")),
        ("state.event_counters", counters.merge_counters),
    ):
        base = store.newest(name).number
        store.replace(name, joined(store.read(name, base)), "compact", base)


def live_counts(store: Store) -> DataFrame:
    """The counts as the stream knows them now."""
    return counters.totals(counters.merge_counters(store.read("state.event_counters"))).filter("event_count > 0")


def windowed_counts(stream: DataFrame, delay: str = "72 hours") -> DataFrame:
    """Events per day, customer and type that came within `delay` of the stream's own event-time watermark, each event once."""
    return (
        stream.filter("event_id is not null and occurred_at is not null").withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("occurred_at", "1 day"), "customer_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    )
