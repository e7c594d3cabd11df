"""One consistent table out of files whose fields drift, and a report of every change.

Rows are loaded as path -> value entries with the raw JSON type of each value. One aggregation by file, path and type
(combined on the map side) yields the statistics from which everything else follows: the fields of each file, the changes
against the preceding file of the same stream, and the renames. The typed table is then a narrow projection without a
shuffle. Only the statistics are ever compared, never the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.functions.payload import json_type, unwrapped

#: Change markers that say something about a record and are no fields of it.
NOT_FIELDS = ("op", "is_deleted", "properties.corrected")

#: Values are described by at most this many classes per field, file and record kind.
SHAPES = 512

#: Two fields carry the same values when their distributions over record kind and value class share at least this much.
RENAME_OVERLAP = 0.3

#: The JSON types that a field can have, in alphabetical order.
TYPES = ("array", "boolean", "number", "object", "string")

_DIGITS = "0123456789"


def record_maps(records: DataFrame, payload: str = "_raw_payload", file: str = "_source_file", nested: str = "properties") -> DataFrame:
    """(file, r, n): each record's top-level keys and those inside `nested`, as maps of key to variant.

    `nested` may arrive as an object or as text that holds one. A payload that is NULL or no JSON object gives NULLs, so
    its file is still known. Records without a file name are left out. Other columns are never read.
    """
    record = F.expr(f"try_variant_get(try_parse_json(`{payload}`), '$', 'map<string,variant>')")
    inner = F.try_element_at(F.col("r"), F.lit(nested))
    parsed = F.coalesce(
        F.try_variant_get(inner, "$", "map<string,variant>"),
        F.try_variant_get(F.try_parse_json(F.try_variant_get(inner, "$", "string")), "$", "map<string,variant>"),
    )
    return records.select(F.col(file).alias("file"), record.alias("r")).filter(F.col("file").isNotNull()).select("file", "r", parsed.alias("n"))


def path_values(records: DataFrame, payload: str = "_raw_payload", file: str = "_source_file", kind: str = "event_type", nested: str = "properties") -> DataFrame:
    """(file, kind, path, json): each record as path-value entries with the raw JSON text of each value.

    Paths are the top-level keys and `nested.key`; kind is the record's own `kind` field. Entries that are no fields, and
    records without any, have a NULL path, so that every file keeps at least one row.
    """
    own = F.lower(unwrapped(F.try_element_at(F.col("r"), F.lit(kind))))
    maps = F.array(F.struct(F.lit("").alias("prefix"), F.col("r").alias("m")), F.struct(F.lit(f"{nested}.").alias("prefix"), F.col("n").alias("m")))
    levels = record_maps(records, payload, file, nested).select("file", own.alias("kind"), F.explode(maps).alias("level"))
    entries = levels.select("file", "kind", F.col("level.prefix").alias("prefix"), F.explode_outer("level.m").alias("key", "value"))
    json = entries.select("file", "kind", F.concat("prefix", "key").alias("path"), F.to_json("value").alias("json"))
    is_field = ~F.col("path").isin(*NOT_FIELDS) & (F.col("json") != "null")
    return json.select("file", "kind", F.when(is_field, F.col("path")).alias("path"), "json")


def value_shape(json: Column) -> Column:
    """A class of values out of SHAPES, by a hash of the whole text with every digit alike. `{"id": x}` and `[x]` count as x."""
    bare = F.when(F.left(json, F.lit(1)).isin("{", "["), F.regexp_replace(json, r'^\{"id":|^\[|[\]}]$', "")).otherwise(json)
    return F.pmod(F.xxhash64(F.translate(bare, _DIGITS + '"', "0" * 10)), F.lit(SHAPES)).cast("int")


def field_statistics(records: DataFrame, payload: str = "_raw_payload", file: str = "_source_file", kind: str = "event_type") -> DataFrame:
    """(file, path, type, kind, shape, n): how often each field of each file holds a value of this type and class.

    Fields whose value is null do not count. A file without any field has rows with NULL path only.
    """
    found = F.col("path").isNotNull()
    return (
        path_values(records, payload, file, kind)
        .select("file", "path", F.when(found, F.col("kind")).alias("kind"), F.when(found, json_type(F.col("json"))).alias("type"), F.when(found, value_shape(F.col("json"))).alias("shape"))
        .groupBy("file", "path", "type", "kind", "shape")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stream_of(file: Column | str) -> Column:
    """The stream of a file: its name without the folder."""
    return F.regexp_extract(file, r"([^/]*)$", 1)


def _overlap(a: Column, b: Column) -> Column:
    """How much the distributions of two fields over (kind, shape) share."""
    least = F.map_zip_with(a["spread"], b["spread"], lambda k, x, y: F.least(F.coalesce(x, F.lit(0)) / a["n"], F.coalesce(y, F.lit(0)) / b["n"]))
    return F.aggregate(F.map_values(least), F.lit(0.0), lambda total, x: total + x)


def field_changes(statistics: DataFrame) -> DataFrame:
    """(file, before, field, change, new_field, old_type, new_type) between each file and the preceding one of its stream.

    A stream is the files of one name in order of their folder.

    * added / removed: the field holds a value in only one of the two. retyped: its most frequent JSON type differs (of
      equally frequent ones the alphabetically first).
    * renamed: a removed field whose values go on under an added one. The two distributions over (record kind, value
      class) must share RENAME_OVERLAP, and each must be the other's best partner; ties go to the alphabetically first.
      new_field is then the new name, and neither added nor removed is reported for the pair.
    * The first file of a stream has no changes. A file without a valid payload has no fields: everything is removed.

    The statistics are shuffled once, by stream; a file becomes one row of its fields, which holds at most SHAPES classes
    per field and record kind however many records the file has, and meets the row before it in a window.
    """
    told = statistics.withColumn("stream", stream_of("file")).repartition("stream")
    cell = F.concat_ws("|", F.coalesce("kind", F.lit("")), "shape")
    cells = told.groupBy("stream", "file", "path", cell.alias("cell")).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("type") == t, F.col("n"))).alias(t) for t in TYPES))
    # The most frequent type; of equally frequent ones the first.
    counts = F.array(*(F.struct(F.coalesce(F.sum(t), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)))
    fields = cells.groupBy("stream", "file", "path").agg(F.array_max(counts)["type"].alias("type"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("spread"))
    files = fields.groupBy("stream", "file").agg(F.map_from_entries(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", F.struct("path", "type", "n", "spread"))))).alias("now"))
    order = Window.partitionBy("stream").orderBy(F.regexp_replace("file", r"[^/]*$", ""), "file")
    pairs = files.select("file", "now", F.lag("file").over(order).alias("before"), F.lag("now").over(order).alias("was")).filter("before is not null")

    missing = lambda of, other: F.filter(F.map_values(of), lambda f: ~F.map_contains_key(other, f["path"]))
    pairs = pairs.withColumns({"added": missing(F.col("now"), F.col("was")), "removed": missing(F.col("was"), F.col("now"))})
    links = F.flatten(F.transform("removed", lambda r: F.transform("added", lambda a: F.struct(r["path"].alias("old"), a["path"].alias("new"), _overlap(r, a).alias("overlap")))))
    pairs = pairs.withColumn("links", F.filter(links, lambda x: x["overlap"] >= RENAME_OVERLAP))
    beats = lambda q, p, own, other: (q[own] == p[own]) & ((q["overlap"] > p["overlap"]) | ((q["overlap"] == p["overlap"]) & (q[other] < p[other])))
    renames = F.filter("links", lambda p: ~F.exists("links", lambda q: beats(q, p, "old", "new") | beats(q, p, "new", "old")))
    pairs = pairs.withColumn("renames", F.map_from_entries(F.transform(renames, lambda x: F.struct(x["old"], x["new"]))))

    both = pairs.select("file", "before", "renames", F.explode(F.map_zip_with("was", "now", lambda k, w, n: F.struct(w["type"].alias("old_type"), n["type"].alias("new_type")))).alias("field", "t"))
    is_new_name = F.col("t.old_type").isNull() & F.array_contains(F.map_values("renames"), F.col("field"))
    new_field = F.when(F.col("t.new_type").isNull(), F.try_element_at("renames", F.col("field")))
    change = (
        F.when(new_field.isNotNull(), "renamed").when(F.col("t.old_type").isNull(), "added").when(F.col("t.new_type").isNull(), "removed")
        .when(F.col("t.old_type") != F.col("t.new_type"), "retyped")
    )
    return both.filter(~is_new_name).select("file", "before", "field", change.alias("change"), new_field.alias("new_field"), "t.old_type", "t.new_type").filter("change is not null")


def field_aliases(changes: DataFrame, catalog: list[str]) -> list[tuple[str, str, str]]:
    """(stream, other name, catalogue name), from the renames of each stream; one inferred in a stream says nothing about others.

    What is collected is one row per stream and pair of field names, however many files and records there are.
    """
    known, found = set(catalog), []
    links: dict[str, list[tuple[str, str]]] = {}
    for r in changes.filter("change = 'renamed'").select(stream_of("file").alias("stream"), "field", "new_field").distinct().orderBy("stream", "field", "new_field").collect():
        links.setdefault(r["stream"], []).append((r["field"], r["new_field"]))
    for stream, pairs in links.items():
        alias: dict[str, str] = {}
        grown = True
        while grown:
            grown = False
            for a, b in pairs:
                for x, y in ((a, b), (b, a)):
                    if y not in known and y not in alias and (x in known or x in alias):
                        alias[y], grown = alias.get(x, x), True
        found += [(stream, name, to) for name, to in sorted(alias.items())]
    return found


def column_name(path: str) -> str:
    return re.sub(r"\W", "_", path)


def unify(
    records: DataFrame, catalog: list[tuple[str, str]], aliases: list[tuple[str, str, str]], payload: str = "_raw_payload", file: str = "_source_file", kinds: dict[str, set[str]] | None = None, kind: str = "event_type",
) -> DataFrame:
    """Every record as one row with one typed column per field of the catalogue (dots become underscores).

    catalog: (path, json type); a path that several record kinds agree on is one column. Two types for a path, or two
    paths for a column name, are an error. aliases: (stream, other name, path); in the files of that stream the other
    name is read after the path itself, in records of the kinds that have the path (`kinds`, all if None; a record that
    names no kind is of any). number becomes double, boolean boolean, anything else text; `{"id": x}` and `[x]` count
    as x. A value that cannot be cast leaves its column NULL and its path in `failed_casts`; is_valid is false, and all
    columns are NULL, where the payload is no JSON object. source_file is the record's file, NULL where it has none.
    """
    types: dict[str, str] = {}
    columns: dict[str, str] = {}
    for path, kind_of_value in catalog:
        if types.setdefault(path, kind_of_value) != kind_of_value:
            raise ValueError(f"{path} has two types in the catalogue: {types[path]} and {kind_of_value}")
        if columns.setdefault(column_name(path), path) != path:
            raise ValueError(f"{path} and {columns[column_name(path)]} have one column name")
    others: dict[str, dict[str, list[str]]] = {}
    for stream, name, path in aliases:
        others.setdefault(path, {}).setdefault(name, []).append(stream)
    cast = {"number": "double", "boolean": "boolean"}
    nested = "properties"
    flat = record_maps(records.withColumn("__file", F.struct(F.col(file).alias("f"))), payload, "__file", nested).select(F.col("file.f").alias("source_file"), F.col("r").isNotNull().alias("is_valid"), "r", "n")

    def raw(path: str) -> Column:
        level, key = ("n", path[len(nested) + 1 :]) if path.startswith(f"{nested}.") else ("r", path)
        return F.try_element_at(F.col(level), F.lit(key))

    flat = flat.withColumns({"__stream": stream_of("source_file"), "__kind": F.lower(unwrapped(raw(kind)))})

    def under(path: str, name: str, streams: list[str]) -> Column:
        own = F.col("__stream").isin(*sorted(streams))
        if kinds is not None:
            own = own & (F.col("__kind").isNull() | F.col("__kind").isin(*sorted(kinds.get(path, ()))))
        return F.when(own, unwrapped(raw(name)))

    # A JSON null under one name does not hide a value under another.
    texts = {path: F.coalesce(unwrapped(raw(path)), *(under(path, name, streams) for name, streams in sorted(others.get(path, {}).items()))) for path in types}
    flat = flat.select("source_file", "is_valid", *(t.alias(column_name(p)) for p, t in texts.items()))
    typed = {p: F.col(column_name(p)).try_cast(cast[types[p]]) if types[p] in cast else F.col(column_name(p)) for p in texts}
    failed = F.array_compact(F.array(*(F.when(F.col(column_name(p)).isNotNull() & c.isNull(), p) for p, c in typed.items())))
    return flat.select("source_file", "is_valid", *(c.alias(column_name(p)) for p, c in typed.items()), failed.alias("failed_casts"))
