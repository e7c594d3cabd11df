"""All registered queries outside the llm subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lakesmith.plans import medallion, oracle, oracle_training, training

QUERIES = {**medallion.QUERIES, **training.QUERIES}
SQL: dict[str, str] = {**oracle.SQL, **oracle_training.SQL}
