"""Merges into stored tables that rewrite only the partitions that the source touches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.canon import canonical_id
from lakesmith.operators import medallion, merge
from lakesmith.plans.durable import durable
from lakesmith.store import Store


def touched_partitions(store: Store, name: str, base: int, source: DataFrame, on: tuple[str, ...]) -> set[str]:
    """The partitions that the source's rows belong to, and those that hold rows of its keys.

    The table is read for its keys only. What is collected is a day or month each.
    """
    part = store.partition_of(name)
    if part is None:
        return {""}
    lacking = [c for c in (store.definition(name).partition.split(":")[1],) if c not in source.columns]
    own = source.select(part.alias("p")) if not lacking else source.select(F.lit(None).cast("string").alias("p")).limit(0)
    keys = source.select(*(F.col(c).alias(f"__k_{i}") for i, c in enumerate(on)))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k_{i}")) for i, c in enumerate(on)))
    held = store.read(name, base).join(keys, match, "left_semi").select(part.alias("p")) if base >= 0 else own.limit(0)
    return {r["p"] for r in own.unionByName(held).distinct().collect()}


def merge_into(
    store: Store, name: str, source: DataFrame, on: tuple[str, ...], *, when: Column | None = None, remove: Column | None = None, delete_unmatched: bool = False, touched: set[str] | None = None, operation: str = "merge",
    notes: Mapping[str, str] | None = None, sides: Mapping[str, DataFrame] | None = None,
) -> int:
    """Merges `source`, whose keys must be unique, into a table; gives the new version.

    Only touched partitions are read whole and written: those found by `touched_partitions`, unless they are given, as
    where `source` is all that these partitions should hold (delete_unmatched then applies to them alone). All that was
    committed belongs to one version of the table: a writer that comes in between makes this one fail.
    """
    base = store.newest(name).number
    source = merge.require_unique(durable(source), on)
    touched = touched_partitions(store, name, base, source, on) if touched is None else touched
    if delete_unmatched and when is None and remove is None and set(store.definition(name).schema.fieldNames()) <= set(source.columns):
        # The source is all that the partitions shall hold, so what they held is not read.
        merged = source
    else:
        target = store.read(name, base, partitions=touched) if base >= 0 else store.spark.createDataFrame([], store.definition(name).schema)
        merged = merge.merge(target, source, on, when=when, remove=remove, delete_unmatched=delete_unmatched)
    return store.replace_partitions(name, merged if touched else None, touched, base, operation, notes=notes, sides=sides)


def keyless(rows: DataFrame, key: str, table: str) -> DataFrame:
    """The rows without key as the side table rejected_rows has them."""
    return rows.filter(canonical_id(key).isNull()).select(F.lit(table).alias("table_name"), F.lit(f"no {key}").alias("reason"), F.to_json(F.struct("*")).alias("row_json"), "_batch_id")


def _some(**sides: DataFrame) -> dict[str, DataFrame]:
    return {name: df for name, df in sides.items() if not df.isEmpty()}


def merge_events(store: Store, bronze: DataFrame, loaded_at: Column, notes: Mapping[str, str], operation: str = "merge", aside: bool = True) -> int:
    """Brings bronze rows into silver.events: per event the newest change, where it is newer than the stored row.

    A delete removes the row and is remembered with its time, so that an older change that arrives later does not bring
    the event back. Rows without event_id are set aside. All of it is one commit.
    """
    changes = durable(medallion.newest_changes(bronze))
    deleted = store.side("silver.events", "deleted_keys").groupBy("event_id").agg(F.max("deleted_at").alias("deleted_at"))
    known = changes.join(deleted, "event_id", "left").filter(F.col("deleted_at").isNull() | (F.col("updated_at") > F.col("deleted_at"))).drop("deleted_at")
    source = medallion.normalized_events(known, loaded_at, "gone")
    gone = known.filter("gone").select("event_id", F.col("updated_at").alias("deleted_at"))
    sides = _some(deleted_keys=gone, **({"rejected_rows": keyless(bronze, "event_id", "bronze.events")} if aside else {}))
    return merge_into(store, "silver.events", source, ("event_id",), when=F.col("s.updated_at") > F.col("t.updated_at"), remove=F.col("s.gone"), operation=operation, notes=notes, sides=sides)


def merge_customers(store: Store, bronze: DataFrame, apply, notes: Mapping[str, str]) -> int:
    """Brings bronze rows into silver.customers through `apply(dimension, incoming)`; only the months that hold a version of an incoming customer, or get one, are written."""
    name, key = "silver.customers", "customer_id"
    base = store.newest(name).number
    incoming = durable(medallion.latest(bronze.drop("_raw_payload", "_source_file"), key))
    dimension = store.read(name, base) if base >= 0 else store.spark.createDataFrame([], store.definition(name).schema)
    # All versions of the incoming customers, wherever they lie; a new version may open another month.
    made = durable(apply(dimension.join(incoming.select(key), key, "left_semi"), incoming))
    touched = touched_partitions(store, name, base, made, (key,))
    others = store.read(name, base, partitions=touched).join(incoming.select(key), key, "left_anti") if base >= 0 else dimension
    return store.replace_partitions(name, others.unionByName(made.select(*others.columns)), touched, base, "scd2", notes=notes, sides=_some(rejected_rows=keyless(bronze, key, "bronze.customers")))
