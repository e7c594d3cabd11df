"""The raw zone: gzip JSON Lines under raw/<source>/ingestion_date=<day>/part-NNN.json.gz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.operators.medallion import not_blank
from lakesmith.operators.merge import merge_lines

_LINES = "_raw_payload string, _source_file string, _ingested_at timestamp, _batch_id string"


def raw_path(root: str, source: str, day: str) -> str:
    return f"{root.rstrip('/')}/raw/{source}/ingestion_date={day}"


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob matches anything."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, root: str, source: str, day: str, batch_id: str, ingested_at: Column | None = None) -> DataFrame:
    """The day's lines with their control columns, blank lines left out; no files give an empty table of the same schema."""
    pattern = f"{raw_path(root, source, day)}/*.json.gz"
    if not has_files(spark, pattern):
        return spark.createDataFrame([], _LINES)
    lines = spark.read.text(pattern).select(F.col("value").alias("_raw_payload"), F.col("_metadata.file_path").alias("_source_file"))
    return lines.filter(not_blank(F.col("_raw_payload"))).withColumns({"_ingested_at": F.current_timestamp() if ingested_at is None else ingested_at, "_batch_id": F.lit(batch_id)})


def file_versions(spark: SparkSession, root: str, source: str, day: str) -> DataFrame:
    """(_source_file, version) of the day's files; the version is made of length and modification time. Contents are not read."""
    pattern = f"{raw_path(root, source, day)}/*.json.gz"
    if not has_files(spark, pattern):
        return spark.createDataFrame([], "_source_file string, version string")
    version = F.concat_ws("-", F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time"))
    return spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("_source_file"), version.alias("version"))


def write_lines(lines: DataFrame, root: str, source: str, day: str, files: int | None = None) -> bool:
    """Adds the lines (column `value`) that the day lacks; what is there is never rewritten. False if there was nothing to add.

    Unlike one large file per day, the added lines come in as many files as they have partitions, so they can be read in
    parallel. A repeated write of the same lines adds nothing.
    """
    spark = lines.sparkSession
    folder = raw_path(root, source, day)
    there = spark.read.text(f"{folder}/*.gz") if has_files(spark, f"{folder}/*.gz") else spark.createDataFrame([], "value string")
    fresh = merge_lines(there, lines, "value").join(there, "value", "left_anti")
    if fresh.isEmpty():
        return False
    _write_text(fresh, folder, files)
    return True


def _write_text(rows: DataFrame, folder: str, files: int | None) -> None:
    # Spark names text files *.txt.gz; the raw zone's readers take *.json.gz, so lines are written as they are and renamed.
    spark = rows.sparkSession
    staging = f"{folder}/_staging"
    (rows if files is None else rows.repartition(files)).write.mode("overwrite").option("compression", "gzip").text(staging)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = len(fs.globStatus(hadoop.Path(f"{folder}/part-*.json.gz")) or [])
    for n, status in enumerate(sorted((s for s in fs.globStatus(hadoop.Path(f"{staging}/part-*.gz"))), key=lambda s: s.getPath().getName())):
        fs.rename(status.getPath(), hadoop.Path(f"{folder}/part-{taken + n:03d}.json.gz"))
    fs.delete(hadoop.Path(staging), True)


def normalized_json(rows: DataFrame) -> DataFrame:
    """Source rows as JSON lines (column `value`): instants as UTC ISO text with six fractional digits and Z, dates as ISO text, decimals as numbers."""
    made = []
    for f in rows.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(F.to_utc_timestamp(c, F.current_timezone()) if kind == "timestamp" else c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "decimal":
            c = c.cast("double")
        made.append(c.alias(f.name))
    return rows.select(F.to_json(F.struct(*made), {"ignoreNullFields": "false"}).alias("value"))


def json_view(spark: SparkSession, path: str, name: str) -> None:
    """A temporary SQL view over JSON files."""
    escaped = path.replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING json OPTIONS (path '{escaped}')")


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header, every value quoted and NULL empty. One file: reports are small by their nature."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(path)
