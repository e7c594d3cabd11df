"""The registered text queries over the smallest test tables: their schema, and that no document gets lost."""

import os

import pytest

from lakesmith.llm.registry import QUERIES

from tests.conftest import rows_of

FOLDER = os.environ.get("LAKESMITH_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

SCHEMAS = {
    "p8_ids": "doc_id bigint, ids array<int>",
    "p9_containers": "container_id bigint, doc_id bigint, piece int, first bigint, tokens int",
    "p10_found": "doc_id bigint",
}


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema(spark, documents, name):
    types = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    assert types(QUERIES[name](spark, FOLDER)) == SCHEMAS.get(name, types(documents))


def test_every_document_is_encoded(spark, documents):
    ids = QUERIES["p8_ids"](spark, FOLDER)
    assert rows_of(ids, "doc_id") == rows_of(documents, "doc_id") and ids.filter("ids is null").isEmpty()


def test_containers_hold_every_token_once_and_are_as_few_as_can_be(spark):
    packed = QUERIES["p9_containers"](spark, FOLDER)
    sizes = QUERIES["p8_ids"](spark, FOLDER).selectExpr("doc_id", "size(ids) AS tokens").filter("tokens > 0")
    assert rows_of(packed.groupBy("doc_id").sum("tokens")) == rows_of(sizes)
    per_container = [r[0] for r in packed.groupBy("container_id").sum("tokens").select("sum(tokens)").collect()]
    assert max(per_container) <= 2048 and len(per_container) <= -(-sum(per_container) // 2048) + 1
    assert packed.groupBy("doc_id").count().join(sizes, "doc_id").filter("tokens <= 2048 and count > 1").isEmpty()


def test_the_corpus_is_what_is_not_found(spark, documents):
    found, clean = (rows_of(QUERIES[n](spark, FOLDER), "doc_id") for n in ("p10_found", "p10_clean"))
    assert found and sorted(found + clean, key=str) == rows_of(documents, "doc_id")
