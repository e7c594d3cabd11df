"""Current state from a feed of inserts, updates and deletes (column-wise last writer wins, SQL only).

One aggregation per key, combined on the map side, rebuilds the state: for every field the change with the greatest
sequence that set it is kept as (sequence, value), together with the greatest delete and the greatest replacement. Whether
the record is gone is a field that every change sets. A field's value counts only when its sequence lies after the latest
delete and not before the latest replacement, so no change has to be joined back to its key and no group is ever gathered
in memory. The record's last change is the greatest of its winners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakesmith.functions.canon import BLANKS
from lakesmith.functions.payload import DELETE_OPS, INSERT_OPS, TRUE_WORDS

FIELDS = ("customer_id", "event_type", "occurred_at", "channel", "properties")

#: Fields that are objects themselves, so `{"id": x}` is their value and no wrapping.
OBJECTS = ("properties",)


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _literal(text: str) -> str:
    """The inside of a string literal; signs are escaped, since braces mean tables here."""
    return "".join(c if c.isalnum() or ord(c) > 0xFFFF else f"\\u{ord(c):04x}" for c in text)


def _read_sql(field: str, names: tuple[str, ...], kind: str, record: str) -> tuple[str, str]:
    """(value, whether it is set) of a field that a record may carry under several names; a JSON null under one does not hide a value under another."""
    paths = [_literal(f'$["{n}"]') for n in (field, *names)]
    texts = []
    for path in paths:
        text = f"try_variant_get({record}, '{path}', 'string')"
        inner = f"coalesce(try_variant_get({record}, '{path}{_literal('.id')}', 'string'), try_variant_get({record}, '{path}{_literal('[0]')}', 'string'), {text})"
        texts.append(text if field in OBJECTS else f"if(left({text}, 1) IN ('{_literal('{')}', '{_literal('[')}'), {inner}, {text})")
    typed = [t if kind == "string" else f"try_cast({t} AS {kind})" for t in texts]
    # Objects and other types stay as their column has them; a text column may hold the value wrapped, so the payload goes first.
    value = ", ".join([typed[0], field, *typed[1:]] if kind == "string" and field not in OBJECTS else [field, *typed])
    named = " OR ".join(f"try_variant_get({record}, '{path}') IS NOT NULL" for path in paths)
    return f"coalesce({value})", f"({field} IS NOT NULL OR {named})"


def _feed_sql(fields: tuple[str, ...], key: str, sequence: str, payload: str, aliases: dict[str, tuple[str, ...]], types: dict[str, str]) -> str:
    record = f"try_parse_json({payload})"
    read = {f: (f, f"({f} IS NOT NULL OR try_variant_get({record}, '$.{f}') IS NOT NULL)") for f in fields}
    read |= {f: _read_sql(f, aliases[f], types.get(f, "string"), record) for f in fields if f in aliases}
    blanks = "".join(f"\\u{ord(c):04x}" for c in BLANKS)
    return f"""
    SELECT nullif(lower(btrim({key}, '{blanks}')), '') AS k,
           unix_micros({sequence}) AS seq,
           coalesce(lower(trim(m.op)) IN ({_words(DELETE_OPS)}), false)
             OR coalesce(lower(trim(m.is_deleted)) IN ({_words(TRUE_WORDS)}), false) AS gone,
           coalesce(lower(trim(m.op)) IN ({_words(INSERT_OPS)}), false) AS fresh,
           {", ".join(f"f_{f}, sets_{f}" for f in fields)}
    FROM (
      SELECT {key}, {sequence}, from_json({payload}, 'op string, is_deleted string') AS m,
             {", ".join(f"{read[f][0]} AS f_{f}" for f in fields)},
             {", ".join(f"{read[f][1]} AS sets_{f}" for f in fields)}
      FROM {{feed}}
    )
    """


def current_state_sql(fields: tuple[str, ...] = FIELDS, key: str = "event_id", sequence: str = "updated_at", payload: str = "_raw_payload", aliases: dict[str, tuple[str, ...]] | None = None, types: dict[str, str] | None = None) -> str:
    """The statement behind `current_state`; `{feed}` stands for the table of changes. types: those of the aliased fields that are no texts."""
    return f"""
    WITH feed AS ({_feed_sql(fields, key, sequence, payload, aliases or {}, types or {})}),
    folded AS (
      SELECT k, min(seq) AS first_us, max(2 * seq + int(gone)) AS w_gone, -- sequence and value in one long
             max(seq) FILTER (WHERE gone) AS gone_us,
             max(seq) FILTER (WHERE fresh) AS fresh_us,
             {", ".join(f"max(struct(seq, f_{f} AS value)) FILTER (WHERE sets_{f} AND NOT gone) AS w_{f}" for f in fields)}
      FROM feed WHERE k IS NOT NULL AND seq IS NOT NULL
      GROUP BY k
    )
    SELECT k AS {key}, first_us, greatest(shiftright(w_gone, 1), {", ".join(f"w_{f}.seq" for f in fields)}) AS updated_us, if(w_gone & 1 = 1, 'deleted', 'live') AS state,
           {", ".join(f"CASE WHEN w_gone & 1 = 0 AND w_{f}.seq > coalesce(gone_us, w_{f}.seq - 1) AND w_{f}.seq >= coalesce(fresh_us, w_{f}.seq) THEN w_{f}.value END AS {f}" for f in fields)}
    FROM folded
    """


def current_state(feed: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "event_id", sequence: str = "updated_at", payload: str = "_raw_payload", aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The state of every key after all changes: (key, first_us, updated_us, state, fields...).

    * A field is set by a change that carries a value for it or names it with an explicit JSON null; a payload that is no
      JSON can only set what its parsed columns hold.
    * aliases: other names of a field. A field listed there (with no other name, too) is read from the payload under all of
      its names, and `{"id": x}` and `[x]` count as x. A field that is not listed is its parsed column.
    * state is `deleted` when the last change is a delete (all fields are then NULL), else `live`. A delete forgets every
      earlier value; an insert replaces the record, so values older than the last insert do not survive it.
    * Repeated and out-of-order deliveries change nothing: the result is a maximum over sequences. Should two different
      changes of a key share a sequence, a delete wins over a non-delete, and of two values of a field the greater one
      (a value over NULL).
    * Changes without key (NULL or blank) or without sequence belong to no record and are left out. An empty feed gives
      an empty table. Columns of the feed that are not named here are never read.
    """
    types = {f: feed.schema[f].dataType.simpleString() for f in aliases or {}}
    return feed.sparkSession.sql(current_state_sql(fields, key, sequence, payload, aliases, types), feed=feed)
