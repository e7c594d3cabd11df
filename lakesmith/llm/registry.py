"""What the driver adds when this subpackage can be imported. SQL cannot express these operators; tests/llm holds their checks."""

from __future__ import annotations

from lakesmith.llm import queries

QUERIES = {**queries.QUERIES}
SQL: dict[str, str] = {}
