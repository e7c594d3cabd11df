"""What a raw change record says about itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of a delete in the field `op`, and of true in `is_deleted`.
DELETE_OPS = ("d", "del", "delete", "deleted", "remove", "removed")
INSERT_OPS = ("i", "c", "r", "ins", "insert", "inserted", "create", "created", "replace", "snapshot")
TRUE_WORDS = ("true", "t", "1", "yes", "y")

#: The change markers of a payload, read in one pass over its text.
MARKERS = "op string, is_deleted string"


def markers(payload: Column) -> Column:
    return F.from_json(payload, MARKERS)


def is_delete(marked: Column) -> Column:
    """Whether `markers(payload)` marks a delete; never NULL, an unreadable payload is not a delete."""
    op = F.lower(F.trim(marked["op"])).isin(*DELETE_OPS)
    flag = F.lower(F.trim(marked["is_deleted"])).isin(*TRUE_WORDS)
    return F.coalesce(op, F.lit(False)) | F.coalesce(flag, F.lit(False))


def unwrapped(value: Column, path: str = "$") -> Column:
    """The text of a variant at a path; `{"id": x}` and `[x]` count as x, other objects and arrays as their JSON text.

    Only texts that begin like an object or array are looked into again.
    """
    text = F.try_variant_get(value, path, "string")
    inner = F.coalesce(F.try_variant_get(value, f"{path}.id", "string"), F.try_variant_get(value, f"{path}[0]", "string"), text)
    return F.when(F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("[")), inner).otherwise(text)


def json_type(json: Column) -> Column:
    """string, number, boolean, object, array or null of a value's JSON text; its first sign tells."""
    sign = F.left(json, F.lit(1))
    return (
        F.when(sign == '"', "string").when(sign == "{", "object").when(sign == "[", "array").when(sign.isin("t", "f"), "boolean")
        .when(sign == "n", "null").when(json.isNotNull(), "number")
    )
