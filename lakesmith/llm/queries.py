"""The registered queries of the text operators, each over all documents and their whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesmith.llm import bpe, packing, residue
from lakesmith.plans.durable import durable
from lakesmith.tables import table

#: Capacity of a container in tokens.
CAPACITY = 2048


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """(container_id, doc_id, piece, first, tokens): the documents in containers of CAPACITY tokens."""
    # The counts are a few bytes a document and are read three times; the texts are encoded once.
    counts = durable(bpe.token_counts(table(spark, folder, "documents")))
    return packing.pack(counts, CAPACITY, packing.piece_count(counts, CAPACITY))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.measure(table(spark, folder, "documents")).filter("is_residue").select("doc_id")


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without template residue."""
    return residue.clean_corpus(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_containers, p10_found, p10_clean)}
