"""References to records that do not exist: Bloom filter first, exact join for what passes it.

The filter over the parent keys has a fixed number of bits for every parent and is cut into segments of equal size; a key
belongs to one segment, by its hash, and all its bits lie there. Segments are built by an aggregation (one `bit_or` per
64-bit word) and joined to the references by their number: as a broadcast where the whole filter, whose size is known
before it is built, stays below BROADCAST_BYTES, and as a shuffle of references and segments beyond. A reference that the
filter rejects is a proven orphan: it matches no parent and only travels along, spread by its event. The exact join
decides on the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id, micros

#: Bits per parent key, how many of them a key sets, and the bits of a segment.
BITS_PER_KEY = 12
PROBES = 4
SEGMENT_BITS = 1 << 19

#: The greatest filter that is broadcast, which at 12 bits a key is that of 89 million parents.
BROADCAST_BYTES = 1 << 27

#: Parts that proven orphans of one key are spread over.
SPREAD = 4096

_WORDS = SEGMENT_BITS // 64


def segments(parents: int) -> int:
    """How many segments give BITS_PER_KEY bits to each parent."""
    return max(1, -(-parents * BITS_PER_KEY // SEGMENT_BITS))


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1))


def segment_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _positions(key: Column) -> list[Column]:
    # Double hashing: position i is h1 + i * h2, h2 odd, both of 31 bits so that the sum stays in a long.
    h1, h2 = _hash(key, 1), _hash(key, 2).bitwiseOR(F.lit(1))
    return [(h1 + h2 * F.lit(i)).bitwiseAND(F.lit(SEGMENT_BITS - 1)) for i in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str, count: int) -> DataFrame:
    """(segment, words): each of `count` segments as an array of longs. Words are combined on the map side; no keys give zeros."""
    masks = keys.select(segment_of(F.col(key), count).alias("segment"), F.explode(F.array(*_positions(F.col(key)))).alias("p")).select(
        "segment", F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, int(p & 63))").alias("mask")
    )
    every = keys.sparkSession.range(count * _WORDS).select(F.floor(F.col("id") / _WORDS).cast("int").alias("segment"), (F.col("id") % _WORDS).cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = masks.unionByName(every).groupBy("segment", "word").agg(F.bit_or("mask").alias("mask"))
    return words.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words"))


def may_contain(words: Column, key: Column) -> Column:
    """False proves that the key, whose segment these words are, is no parent."""
    result = F.lit(True)
    for p in _positions(key):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        result = result & (F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return result


def tested(references: DataFrame, key: str, bloom: DataFrame, count: int) -> DataFrame:
    """`references` with `maybe`: whether the filter lets the key pass. A NULL key has no segment and never passes."""
    parts = F.broadcast(bloom) if count * SEGMENT_BITS // 8 <= BROADCAST_BYTES else bloom
    parts = parts.select(F.col("segment").alias("__segment"), F.col("words").alias("__words"))
    joined = references.join(parts, segment_of(F.col(key), count) == F.col("__segment"), "left")
    return joined.withColumn("maybe", F.coalesce(may_contain(F.col("__words"), F.col(key)), F.lit(False))).drop("__segment", "__words")


def parent_spans(versions: DataFrame, key: str = "customer_id") -> DataFrame:
    """(parent, first_us, end_us): per parent the smallest valid_from and, where every version is closed, the greatest valid_to."""
    spans = versions.select(canonical_id(key).alias("parent"), micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us")).filter("parent is not null")
    closed = F.when(F.count_if(F.col("to_us").isNull()) == 0, F.max("to_us"))
    return spans.groupBy("parent").agg(F.min("from_us").alias("first_us"), closed.alias("end_us"))


def orphans(events: DataFrame, versions: DataFrame, key: str = "customer_id", event_key: str = "event_id", at: str = "occurred_at") -> DataFrame:
    """(event_id, customer_id, occurred_us, reason): the references that hold no valid parent at their time.

    reason is `missing` (no parent row), `late` (before the parent's first version; a parent whose versions all lack
    valid_from is never late) or `deleted` (all versions closed, at or after the last end). Events without reference or
    time are left out. Every row of `events` counts, repeated ones too; with no parents at all every reference is missing.
    """
    spans = parent_spans(versions, key)
    count = segments(versions.select(F.approx_count_distinct(canonical_id(key), 0.02)).first()[0])
    refs = events.select(canonical_id(event_key).alias("event_id"), canonical_id(key).alias("customer_id"), micros(at).alias("occurred_us")).filter("customer_id is not null and occurred_us is not null")
    # Proven orphans carry a key that no parent has (canonical identifiers hold no blanks around them), and not all the same one.
    nobody = F.concat(F.lit(" "), F.pmod(F.xxhash64("event_id", "occurred_us"), F.lit(SPREAD)).cast("string"))
    asked = tested(refs, "customer_id", bloom_filter(spans, "parent", count), count).select("event_id", "customer_id", "occurred_us", F.when(F.col("maybe"), F.col("customer_id")).otherwise(nobody).alias("verify"))
    # A hot parent's references are split by adaptive execution: both sides are plain shuffles of this one join.
    joined = asked.join(spans, F.col("verify") == F.col("parent"), "left")
    reason = F.when(F.col("parent").isNull(), "missing").when(F.col("occurred_us") < F.col("first_us"), "late").when(F.col("occurred_us") >= F.col("end_us"), "deleted")
    return joined.select("event_id", "customer_id", "occurred_us", reason.alias("reason")).filter("reason is not null")


def orphan_report(found: DataFrame, child_table: str) -> DataFrame:
    """(child_table, month, reason, orphans, parents): orphan references per table and month of the event, pre-aggregated by parent."""
    month = F.date_format(F.timestamp_micros("occurred_us"), "yyyy-MM")
    per_parent = found.groupBy(month.alias("month"), "reason", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per_parent.groupBy("month", "reason").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("parents")).select(F.lit(child_table).alias("child_table"), "month", "reason", "orphans", "parents")
