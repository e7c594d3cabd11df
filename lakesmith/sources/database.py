"""An incremental table source over JDBC; the range filter and the columns reach the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the customers table at the source.
CUSTOMER_COLUMNS = ("customer_id", "company_name", "plan", "segment", "signup_date", "country", "is_active", "updated_at")


def changed_since(rows: DataFrame, since: str, columns: tuple[str, ...] = CUSTOMER_COLUMNS) -> DataFrame:
    """The rows changed at or after `since` (an ISO instant), without an order: the raw zone is a set of lines."""
    return rows.filter(F.col("updated_at") >= F.lit(since).cast("timestamp")).select(*columns)


def read_customers(spark: SparkSession, url: str, table: str, since: str, partitions: int = 1, **options: str) -> DataFrame:
    """Customers changed since an instant. With several partitions the read is split evenly over the times of change that there are.

    The bounds of the split are asked of the database first; an empty table is read as one partition.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partitions > 1:
        span = spark.read.format("jdbc").options(url=url, dbtable=f'(SELECT min("updated_at") AS lo, max("updated_at") AS hi FROM {table}) span', **options).load().toDF("lo", "hi")
        text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        lo, hi = span.select(text(F.greatest("lo", F.lit(since).cast("timestamp"))), text(F.col("hi") + F.expr("interval 1 second"))).first()
        if hi is not None and lo < hi:
            reader = reader.options(partitionColumn="updated_at", lowerBound=lo, upperBound=hi, numPartitions=str(partitions))
    return changed_since(reader.load(), since)
