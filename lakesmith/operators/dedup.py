"""Exactly one copy of every message that was delivered at least once.

A message is an identifier at a version. Identifiers of the form producer_number come from a producer's sequence; what
has been seen of a producer is kept as disjoint ranges of numbers, through which the deliveries go in order of arrival. A
number outside all ranges cannot have been seen: its message is accepted there and then, and the ranges take the number
in. A later delivery of that same message is a repeat without further search. What remains, other versions of a number
that is covered and identifiers that are no sequence numbers, is resolved by an exact keyed lookup.

Ranges are kept in blocks of numbers, so one producer never becomes one task. Copies collapse on the map side to a line
per message and batch, and a block's ranges see one line per number and batch, however often or in however many versions
an identifier was delivered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id, micros
from lakesmith.plans.shipping import ship

#: A producer's numbers are worked on in blocks of 2 ** BLOCK_BITS, which is also the greatest length of a range.
BLOCK_BITS = 14

#: Tasks' worth of blocks for identifiers that are no sequence numbers.
MALFORMED_BLOCKS = 4096

#: Deliveries that are held against the ranges at a time.
STEP = 4096

#: An arrival time that is not known comes last.
_NEVER = 2**62
_NUMBER = ("producer", "block", "seq")
_SWEPT = "producer string, block bigint, seq bigint, hi bigint, us bigint, batch string"


class Ranges:
    """Disjoint ranges of whole numbers in order, adjoining ones merged."""

    def __init__(self, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> None:
        self.lo = np.array([], dtype=np.int64) if lo is None else np.asarray(lo, dtype=np.int64)
        self.hi = np.array([], dtype=np.int64) if hi is None else np.asarray(hi, dtype=np.int64)
        self._merge()

    def _merge(self) -> None:
        order = np.argsort(self.lo, kind="stable")
        lo, hi = self.lo[order], self.hi[order]
        if len(lo):
            reach = np.maximum.accumulate(hi)
            starts = np.concatenate([[True], lo[1:] > reach[:-1] + 1])
            lo, hi = lo[starts], reach[np.concatenate([starts[1:], [True]])]
        self.lo, self.hi = lo, hi

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lo, numbers, side="right") - 1
        return (at >= 0) & (numbers <= self.hi[at]) if len(self.lo) else np.zeros(len(numbers), dtype=bool)

    def add(self, numbers: np.ndarray) -> None:
        self.lo, self.hi = np.concatenate([self.lo, numbers]), np.concatenate([self.hi, numbers])
        self._merge()

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The positions of the numbers that were uncovered when their turn came, each once; the ranges then hold them."""
        accepted = []
        for begin in range(0, len(numbers), STEP):
            distinct, first = np.unique(numbers[begin : begin + STEP], return_index=True)
            fresh = ~self.covers(distinct)
            if fresh.any():
                accepted.append(begin + np.sort(first[fresh]))
                self.add(distinct[fresh])
        return np.concatenate(accepted) if accepted else np.array([], dtype=np.int64)


@dataclass
class Seen:
    """ranges: (producer, block, lo, hi), disjoint; messages: (id, us), each accepted message once."""

    ranges: DataFrame
    messages: DataFrame


@dataclass
class Resolved:
    """lines: (id, us, batch, seen_us, copies, by_range, repeats), a line per message and batch.

    by_range: the ranges accepted the message in this batch. repeats: they accepted it in an earlier one. Neither: the
    exact lookup decides. ranges: what the ranges hold afterwards.
    """

    lines: DataFrame
    ranges: DataFrame
    seen: Seen | None


def identify(rows: DataFrame, key: str = "event_id", version: str = "updated_at") -> DataFrame:
    """Adds __m: (producer, block, seq, id, us). NULL or blank keys give a NULL id; malformed ones a NULL producer and seq."""
    parts = rows.select("*", canonical_id(key).alias("__id"), micros(version).alias("__us"))
    well = F.col("__id").rlike("^[a-z]+_[0-9]{1,18}$")
    seq = F.when(well, F.split_part("__id", F.lit("_"), F.lit(2)).cast("long"))
    parts = parts.withColumn("__seq", seq)
    block = F.coalesce(F.shiftright("__seq", BLOCK_BITS), -1 - F.pmod(F.xxhash64("__id"), F.lit(MALFORMED_BLOCKS)))
    producer = F.when(well, F.split_part("__id", F.lit("_"), F.lit(1)))
    return parts.withColumn("__m", F.struct(producer.alias("producer"), block.alias("block"), F.col("__seq").alias("seq"), F.col("__id").alias("id"), F.col("__us").alias("us"))).drop("__id", "__us", "__seq")


def message_lines(rows: DataFrame, key: str = "event_id", version: str = "updated_at", batch: str = "_batch_id", arrival: str = "_ingested_at") -> DataFrame:
    """(producer, block, seq, id, us, batch, seen_us, copies): one line per message and batch; only the four columns are read.

    Rows without key or version are no messages and left out. A NULL batch is a batch like any other.
    """
    narrow = rows.select(F.col(key).alias("k"), F.col(version).alias("v"), F.coalesce(F.col(batch), F.lit("")).alias("batch"), F.coalesce(micros(arrival), F.lit(_NEVER)).alias("seen_us"))
    marked = identify(narrow, "k", "v").select("__m.*", "batch", "seen_us").filter("id is not null and us is not null")
    return marked.groupBy(*_NUMBER, "id", "us", "batch").agg(F.min("seen_us").alias("seen_us"), F.count(F.lit(1)).alias("copies"))


def sweep(lines: DataFrame, seen: Seen | None = None) -> DataFrame:
    """(producer, block, seq, hi, us, batch): what the ranges accept (hi NULL), and the ranges afterwards (seq to hi, us NULL).

    A block's deliveries come in order of arrival (then batch, then version) and one line per number and batch, so a
    block holds at most 2 ** BLOCK_BITS numbers times the batches.
    """
    first = F.min(F.struct("seen_us", "us")).alias("f")
    numbers = lines.filter("seq is not null").groupBy(*_NUMBER, "batch").agg(first).select(*_NUMBER, F.lit(None).cast("int").alias("length"), F.col("f.seen_us").alias("at"), "f.us", "batch")
    if seen is not None:
        # NULLs turn numbers into floats on the way to Python, which short lengths survive and large numbers do not.
        numbers = numbers.unionByName(seen.ranges.select("producer", "block", F.col("lo").alias("seq"), (F.col("hi") - F.col("lo")).cast("int").alias("length")), allowMissingColumns=True)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        known = block["length"].notna()
        lo = block.loc[known, "seq"].to_numpy(dtype=np.int64)
        ranges = Ranges(lo, lo + block.loc[known, "length"].to_numpy(dtype=np.int64))
        arrivals = block[~known].sort_values(["at", "batch", "us", "seq"], kind="stable")
        accepted = arrivals.iloc[ranges.take(arrivals["seq"].to_numpy(dtype=np.int64))]
        taken, held = len(accepted), len(ranges.lo)
        blank = np.zeros(held, dtype=np.int64)
        is_range = np.concatenate([np.zeros(taken, dtype=bool), np.ones(held, dtype=bool)])
        return pd.DataFrame({
            "producer": block["producer"].iloc[0], "block": block["block"].iloc[0], "seq": np.concatenate([accepted["seq"].to_numpy(), ranges.lo]),
            "hi": pd.arrays.IntegerArray(np.concatenate([np.zeros(taken, dtype=np.int64), ranges.hi]), ~is_range),
            "us": pd.arrays.IntegerArray(np.concatenate([accepted["us"].to_numpy(dtype=np.int64), blank]), is_range), "batch": [*accepted["batch"], *[None] * held],
        })

    ship(lines.sparkSession)
    return numbers.groupBy("producer", "block").applyInPandas(run, _SWEPT)


def resolve(rows: DataFrame, key: str = "event_id", version: str = "updated_at", batch: str = "_batch_id", arrival: str = "_ingested_at", seen: Seen | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Resolved:
    """Every message's lines with what the ranges say about them. keep: writes what several plans read, such as the swept ranges."""
    lines = message_lines(rows, key, version, batch, arrival)
    swept = keep(sweep(lines, seen))
    taken = swept.filter("hi is null").select(*(F.col(c).alias(f"n_{c}") for c in (*_NUMBER, "us", "batch")))
    # Identifiers that are no numbers keep their block, so they spread over the join and match nothing.
    match = (F.col("block") == F.col("n_block")) & F.col("seq").eqNullSafe(F.col("n_seq")) & F.col("producer").eqNullSafe(F.col("n_producer"))
    same = F.coalesce(F.col("us") == F.col("n_us"), F.lit(False))
    here = F.col("batch") == F.col("n_batch")
    marked = lines.join(taken, match, "left").select("id", "us", "batch", "seen_us", "copies", (same & here).alias("by_range"), (same & ~here).alias("repeats"))
    return Resolved(marked, swept.filter("hi is not null").select("producer", "block", F.col("seq").alias("lo"), "hi"), seen)


def lookup(resolved: Resolved) -> DataFrame:
    """(id, us, batch, copies, held): the messages that no range settled, each once; held ones were accepted before this input.

    The exact keyed lookup: batch is the one of the earliest arrival (then the smallest), copies those of all batches.
    """
    rest = resolved.lines.filter("not by_range and not repeats").groupBy("id", "us").agg(F.min(F.struct("seen_us", "batch")).alias("first"), F.sum("copies").alias("copies"))
    rest = rest.select("id", "us", F.col("first.batch").alias("batch"), "copies")
    if resolved.seen is None:
        return rest.withColumn("held", F.lit(False))
    known = resolved.seen.messages.select("id", "us", F.lit(True).alias("held"))
    return rest.join(known, ["id", "us"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def accepted(resolved: Resolved) -> DataFrame:
    """(id, us, batch): the messages to keep, and the batch whose copy is kept; read the lines from a written table."""
    return resolved.lines.filter("by_range").select("id", "us", "batch").unionByName(lookup(resolved).filter("not held").select("id", "us", "batch"))


def repeated(resolved: Resolved) -> DataFrame:
    """(id, us) of the messages of which any copy is rejected. A message that the ranges accepted in its only copy is not looked at again."""
    told = resolved.lines.filter("repeats or copies > 1 or not by_range").groupBy("id", "us").agg(F.sum("copies").alias("copies"), F.max("repeats").alias("repeats"))
    if resolved.seen is None:
        return told.filter("repeats or copies > 1").select("id", "us")
    known = resolved.seen.messages.select("id", "us", F.lit(True).alias("held"))
    return told.join(known, ["id", "us"], "left").filter("repeats or copies > 1 or held").select("id", "us")


def advance(resolved: Resolved, kept: DataFrame) -> Seen:
    """What has been seen once `kept` (the result of `accepted`) is. Write both tables before the next batch reads them."""
    messages = kept.select("id", "us")
    return Seen(resolved.ranges, messages if resolved.seen is None else messages.unionByName(resolved.seen.messages.select("id", "us")))


def single_copies(rows: DataFrame, kept: DataFrame, key: str = "event_id", version: str = "updated_at", batch: str = "_batch_id", arrival: str = "_ingested_at") -> DataFrame:
    """The rows with every kept message once, in the input's columns: of a batch's copies the earliest, then the smallest by its columns.

    Rows without key or version cannot be told apart and all stay. Columns that have no order (maps, variants) do not
    take part in the choice. A row is shuffled once, after its copies have collapsed on the map side.
    """
    loose = [f.name for f in rows.schema if any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    # The columns that have an order are the order themselves, so a row is carried once.
    order = F.struct(F.coalesce(micros(arrival), F.lit(_NEVER)).alias("__seen"), *(F.col(f"`{c}`") for c in rows.columns if c not in loose))
    told = rows.select(canonical_id(key).alias("__id"), micros(version).alias("__us"), F.coalesce(F.col(batch), F.lit("")).alias("__batch"), order.alias("__order"), *([F.struct(*(F.col(f"`{c}`") for c in loose)).alias("__loose")] if loose else []))
    best = [F.min("__order").alias("__order"), *([F.min_by("__loose", "__order").alias("__loose")] if loose else [])]
    lines = told.filter("__id is not null and __us is not null").groupBy("__id", "__us", "__batch").agg(*best)
    which = kept.select(F.col("id").alias("__id"), F.col("us").alias("__us"), F.col("batch").alias("__batch"))
    once = lines.join(which, ["__id", "__us", "__batch"], "left_semi").select(*(F.col(f"{'__loose' if c in loose else '__order'}.`{c}`").alias(c) for c in rows.columns))
    return once.unionByName(rows.filter(canonical_id(key).isNull() | F.col(version).isNull()))
