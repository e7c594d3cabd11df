"""A Spark data source (format `paged_files`) with the contract of the paginated service: JSON documents of pages, read in parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._folder, self._since = options["path"], options.get("since", "")

    def partitions(self) -> list[InputPartition]:
        return [_Page(str(p)) for p in sorted(Path(self._folder).glob("page-*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for record in json.loads(Path(partition.path).read_text())["data"]:
            # Instants of one format compare as texts; the bound itself belongs to the range.
            if str(record.get("updated_at") or "") >= self._since:
                yield (json.dumps(record, separators=(",", ":"), sort_keys=True, ensure_ascii=False),)


class PagedFiles(DataSource):
    """Options: path, a shared folder with page-*.json ({"data": [...]}); since, an inclusive lower bound of updated_at."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFiles)
