"""Column expressions shared by the operators; all of them stay inside the JVM."""

from lakesmith.functions.canon import canonical_id, canonical_text, micros, utc_date
from lakesmith.functions.payload import is_delete, json_type, unwrapped

__all__ = ["canonical_id", "canonical_text", "is_delete", "json_type", "micros", "unwrapped", "utc_date"]
