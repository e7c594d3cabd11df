"""The training-data queries in plain SQL, straight from their statements."""

from __future__ import annotations

import re

from lakesmith.operators.counters import CUT_OFF_US
from lakesmith.operators.dedup import BLOCK_BITS
from lakesmith.operators.drift import NOT_FIELDS, RENAME_OVERLAP
from lakesmith.plans.oracle import _DELETE, _day, _id

_FEED = f"""feed AS (
  SELECT {_id("event_id")} AS event_id, epoch_us(updated_at) AS us, epoch_us(occurred_at) AS o, {_id("customer_id")} AS customer_id, {_id("event_type")} AS event_type, {_DELETE} AS gone FROM bronze_events),
last AS (SELECT event_id, min(us) AS first_us, max(us) AS us, arg_max(gone, us) AS gone, max(o) AS o, max(customer_id) AS customer_id, max(event_type) AS event_type
  FROM feed WHERE event_id IS NOT NULL AND us IS NOT NULL GROUP BY event_id)"""
_COUNTS = f"""counts AS (SELECT {_day("o")} AS event_date, customer_id, event_type, count(*) AS event_count FROM last
  WHERE NOT gone AND o IS NOT NULL AND customer_id IS NOT NULL AND event_type IS NOT NULL AND first_us - o <= {CUT_OFF_US} GROUP BY ALL)"""
_VERSIONS = f"""lines AS (SELECT DISTINCT {_id("customer_id")} AS customer_id, epoch_us(updated_at) AS us, lower(trim(plan)) AS plan, segment, CAST(is_active AS VARCHAR) AS is_active, country FROM bronze_customers),
marked AS (SELECT *, row_number() OVER w AS n, lag(plan) OVER w AS p1, lag(segment) OVER w AS p2, lag(is_active) OVER w AS p3, lag(country) OVER w AS p4 FROM lines WINDOW w AS (PARTITION BY customer_id ORDER BY us)),
versions AS (SELECT customer_id, plan, segment, is_active, country, us AS valid_from_us, lead(us) OVER (PARTITION BY customer_id ORDER BY us) AS valid_to_us, count(*) OVER (PARTITION BY customer_id) AS versions FROM marked
  WHERE n = 1 OR plan IS DISTINCT FROM p1 OR segment IS DISTINCT FROM p2 OR is_active IS DISTINCT FROM p3 OR country IS DISTINCT FROM p4)"""
_EVENTS = f"e AS (SELECT {_id('event_id')} AS event_id, {_id('customer_id')} AS customer_id, epoch_us(occurred_at) AS o FROM silver_events)"
_ORPHANS = f"""{_EVENTS},
p AS (SELECT {_id("customer_id")} AS customer_id, min(epoch_us(valid_from)) AS first_us, CASE WHEN bool_and(valid_to IS NOT NULL) THEN max(epoch_us(valid_to)) END AS end_us FROM silver_customers GROUP BY ALL),
found AS (SELECT event_id, e.customer_id, o, CASE WHEN p.customer_id IS NULL THEN 'missing' WHEN o < first_us THEN 'late' WHEN o >= end_us THEN 'deleted' END AS reason
  FROM e LEFT JOIN p ON p.customer_id = e.customer_id WHERE e.customer_id IS NOT NULL AND o IS NOT NULL)"""
_KNOWN = f"""{_EVENTS},
c AS (SELECT {_id("customer_id")} AS customer_id, plan, epoch_us(valid_from) AS f, greatest(epoch_us(valid_from), epoch_us(_silver_loaded_at)) AS a FROM silver_customers),
newest AS (SELECT customer_id, arg_max(plan, f) AS plan FROM c GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER () AS i FROM e),
known AS (SELECT i, any_value(n.event_id) AS event_id, any_value(n.customer_id) AS customer_id, any_value(o) AS o, arg_max(plan, f) AS plan, count(f) AS n FROM numbered n LEFT JOIN c ON c.customer_id = n.customer_id AND a <= o GROUP BY i)"""
def _unwrap(j: str) -> str:
    """The text of a JSON value; an object with an id and an array with an element count as that."""
    return f"CASE json_type({j}) WHEN 'OBJECT' THEN coalesce({j}->>'$.id', {j}->>'$') WHEN 'ARRAY' THEN coalesce({j}->>'$[0]', {j}->>'$') ELSE {j}->>'$' END"


# Every key of a record and of its properties (which may be a text), with the kind of the record and the JSON of the value.
_ENTRIES = f"""parsed AS (SELECT row_number() OVER () AS i, _source_file AS file, CASE WHEN json_valid(_raw_payload) AND json_type(_raw_payload) = 'OBJECT' THEN CAST(_raw_payload AS JSON) END AS j FROM bronze_events),
nested AS (SELECT *, regexp_extract(file, '[^/]*$') AS stream, lower({_unwrap("(j->'$.event_type')")}) AS kind,
  CASE json_type(j->'$.properties') WHEN 'OBJECT' THEN j->'$.properties' WHEN 'VARCHAR' THEN CASE WHEN json_valid(j->>'$.properties') AND json_type(j->>'$.properties') = 'OBJECT' THEN CAST(j->>'$.properties' AS JSON) END END AS p FROM parsed),
entries AS (SELECT i, file, stream, kind, '' AS prefix, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM nested WHERE j IS NOT NULL)
  UNION ALL SELECT i, file, stream, kind, 'properties.', k, json_extract(p, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(p)) AS k FROM nested WHERE p IS NOT NULL))"""
_CHANGES = f"""{_ENTRIES},
cells AS (SELECT file, prefix || k AS path, coalesce(kind, '') AS kind, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type,
  translate(CASE WHEN left(CAST(v AS VARCHAR), 1) IN ('{{', '[') THEN regexp_replace(CAST(v AS VARCHAR), '^\\{{"id":|^\\[|[\\]}}]$', '', 'g') ELSE CAST(v AS VARCHAR) END, '0123456789"', '0000000000') AS shape
  FROM entries WHERE file IS NOT NULL AND json_type(v) <> 'NULL' AND prefix || k NOT IN ({", ".join(f"'{f}'" for f in NOT_FIELDS)})),
fields AS (SELECT file, path, first(type ORDER BY n DESC, type) AS type, sum(n) AS n FROM (SELECT file, path, type, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
files AS (SELECT file, lag(file) OVER (PARTITION BY regexp_extract(file, '[^/]*$') ORDER BY regexp_replace(file, '[^/]*$', ''), file) AS before FROM (SELECT DISTINCT _source_file AS file FROM bronze_events WHERE _source_file IS NOT NULL)),
steps AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.before, b.before) AS before, coalesce(a.path, b.path) AS path, a.type AS new_type, a.n AS new_n, b.type AS old_type, b.n AS old_n
  FROM (SELECT f.*, before FROM fields f JOIN files USING (file) WHERE before IS NOT NULL) a FULL JOIN (SELECT s.file, s.before, path, type, n FROM fields f JOIN files s ON s.before = f.file) b ON a.file = b.file AND a.path = b.path),
spread AS (SELECT file, path, kind, shape, count(*) AS n FROM cells GROUP BY ALL),
links AS (SELECT o.file, o.path AS old, a.path AS new, sum(least(x.n / o.old_n, y.n / a.new_n)) AS overlap
  FROM steps o JOIN spread x ON x.file = o.before AND x.path = o.path JOIN steps a ON a.file = o.file AND a.old_type IS NULL JOIN spread y ON y.file = a.file AND y.path = a.path AND y.kind = x.kind AND y.shape = x.shape
  WHERE o.new_type IS NULL GROUP BY ALL HAVING sum(least(x.n / o.old_n, y.n / a.new_n)) >= {RENAME_OVERLAP}),
renames AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY file, old ORDER BY overlap DESC, new) = 1 AND row_number() OVER (PARTITION BY file, new ORDER BY overlap DESC, old) = 1),
changes AS (SELECT s.file, s.path, CASE WHEN r.new IS NOT NULL THEN 'renamed' WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' WHEN old_type <> new_type THEN 'retyped' END AS change, r.new AS new_name
  FROM steps s LEFT JOIN renames r ON r.file = s.file AND r.old = s.path AND s.new_type IS NULL WHERE NOT EXISTS (SELECT 1 FROM renames q WHERE q.file = s.file AND q.new = s.path AND s.old_type IS NULL))"""

_BRONZE = ("event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties", "_raw_payload", "_source_file", "_ingested_at", "_batch_id")
#: The fields of the catalogue with their types.
CATALOG = {
    "event_id": "string", "customer_id": "string", "event_type": "string", "occurred_at": "string", "updated_at": "string", "channel": "string", "source_app": "string", "properties.subject_len": "number", "properties.priority": "string",
    "properties.sla_minutes": "number", "properties.ticket_id": "string", "properties.agent_id": "string", "properties.is_first_response": "boolean", "properties.resolution": "string", "properties.session_id": "string", "properties.feature": "string",
    "properties.rows": "number", "properties.format": "string",
}
_FIELDS = ("customer_id", "event_type", "occurred_at", "channel", "properties")


def _state_sql() -> str:
    sets = ", ".join(f"({f} IS NOT NULL OR coalesce(CASE WHEN json_valid(_raw_payload) THEN json_exists(_raw_payload, '$.{f}') END, false)) AS s_{f}" for f in _FIELDS)
    fresh = "CASE WHEN json_valid(_raw_payload) THEN coalesce(lower(json_extract_string(_raw_payload, '$.op')) IN ('i', 'insert'), false) ELSE false END"
    value = {f: f"epoch_us({f})" if f == "occurred_at" else f for f in _FIELDS}
    picked = ", ".join(f"(SELECT x.{f} FROM rows x WHERE x.event_id = k.event_id AND x.s_{f} AND x.us > d AND x.us >= r ORDER BY x.us DESC, x.{f} DESC NULLS LAST LIMIT 1) AS {f}" for f in _FIELDS)
    return f"""WITH rows AS (SELECT DISTINCT {_id("event_id")} AS event_id, epoch_us(updated_at) AS us, {_DELETE} AS gone, {fresh} AS fresh, {", ".join(f"{value[f]} AS {f}" for f in _FIELDS)}, {sets} FROM bronze_events),
      k AS (SELECT event_id, max(us) AS updated_us, arg_max(gone, us) AS last_gone, coalesce(max(us) FILTER (WHERE gone), -1) AS d, coalesce(max(us) FILTER (WHERE fresh), -1) AS r FROM rows WHERE event_id IS NOT NULL AND us IS NOT NULL GROUP BY ALL)
      SELECT event_id, updated_us, {picked} FROM k WHERE NOT last_gone"""


def _unified_sql() -> str:
    types = {"number": "DOUBLE", "boolean": "BOOLEAN"}
    raw = {p: f"max(CASE WHEN path = '{p}' THEN text END)" for p in CATALOG}
    typed = {p: f"TRY_CAST({raw[p]} AS {types[t]})" if t in types else raw[p] for p, t in CATALOG.items()}
    failed = ", ".join(f"CASE WHEN {raw[p]} IS NOT NULL AND {typed[p]} IS NULL THEN '{p}' END" for p, t in sorted(CATALOG.items()) if t in types)
    return f"""WITH RECURSIVE {_CHANGES},
      linked AS (SELECT DISTINCT regexp_extract(file, '[^/]*$') AS stream, path AS a, new_name AS b FROM changes WHERE change = 'renamed'),
      either AS (SELECT stream, a, b FROM linked UNION SELECT stream, b, a FROM linked),
      names AS (SELECT DISTINCT '' AS stream, field_path AS path, field_path AS name FROM field_catalog UNION SELECT b.stream, n.path, b.b FROM names n JOIN either b ON b.a = n.name AND n.stream IN ('', b.stream) WHERE b.b NOT IN (SELECT field_path FROM field_catalog)),
      read AS (SELECT e.i, n.path, first({_unwrap("e.v")} ORDER BY n.stream <> '', n.name) AS text FROM entries e JOIN names n ON n.name = e.prefix || e.k AND (n.stream = '' OR
          (n.stream = e.stream AND (e.kind IS NULL OR EXISTS (SELECT 1 FROM field_catalog c WHERE c.field_path = n.path AND lower(c.event_type) = e.kind)))) WHERE json_type(e.v) <> 'NULL' GROUP BY ALL)
      SELECT r.file AS source_file, r.j IS NOT NULL AS is_valid, {", ".join(f'{x} AS {re.sub(chr(92) + "W", "_", p)}' for p, x in typed.items())}, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_casts
      FROM nested r LEFT JOIN read USING (i) GROUP BY r.i, r.file, r.j IS NOT NULL"""


SQL: dict[str, str] = {
    "p1_found": f"WITH {_CHANGES} SELECT file AS source_file, path AS field, change FROM changes WHERE change IS NOT NULL",
    "p1_unified": _unified_sql(),
    "p2_found": f"""WITH {_FEED}, {_COUNTS}, gold AS (SELECT event_date, {_id("customer_id")} AS customer_id, lower(event_type) AS event_type, sum(event_count) AS n FROM gold_events_daily_summary WHERE customer_id IS NOT NULL GROUP BY ALL)
      SELECT CAST(event_date AS VARCHAR) AS event_date, customer_id, event_type FROM counts c FULL JOIN gold g USING (event_date, customer_id, event_type) WHERE coalesce(c.event_count, 0) <> coalesce(g.n, 0)""",
    "p2_counts": f"WITH {_FEED}, {_COUNTS} SELECT * FROM counts",
    "p3_found": f"WITH {_FEED} SELECT event_id, us AS updated_us FROM feed WHERE event_id IS NOT NULL AND us IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "p3_messages": f"""WITH told AS (SELECT *, {_id("event_id")} AS k FROM bronze_events),
      once AS (SELECT *, row_number() OVER (PARTITION BY k, updated_at ORDER BY _ingested_at NULLS LAST, coalesce(_batch_id, ''), {", ".join(f"{c} NULLS FIRST" for c in _BRONZE)}) AS n FROM told)
      SELECT event_id, customer_id, event_type, epoch_us(occurred_at) AS occurred_at_us, epoch_us(updated_at) AS updated_at_us, channel, properties, _raw_payload, _source_file, epoch_us(_ingested_at) AS ingested_at_us, _batch_id
      FROM once WHERE n = 1 OR k IS NULL OR updated_at IS NULL""",
    "p3_ranges": f"""WITH numbers AS (SELECT DISTINCT split_part({_id("event_id")}, '_', 1) AS producer, CAST(split_part({_id("event_id")}, '_', 2) AS BIGINT) AS n FROM bronze_events
        WHERE regexp_full_match({_id("event_id")}, '[a-z]+_[0-9]{{1,18}}') AND updated_at IS NOT NULL),
      placed AS (SELECT producer, n // {1 << BLOCK_BITS} AS block, n, n - row_number() OVER (PARTITION BY producer, n // {1 << BLOCK_BITS} ORDER BY n) AS island FROM numbers)
      SELECT producer, block, min(n) AS lo, max(n) AS hi FROM placed GROUP BY producer, block, island""",
    "p4_found": f"WITH {_VERSIONS} SELECT customer_id, valid_from_us, coalesce(valid_to_us, 0) AS valid_to_us FROM versions WHERE versions > 1",
    "p4_history": f"WITH {_VERSIONS} SELECT customer_id, plan, segment, is_active, country, valid_from_us, valid_to_us, valid_to_us IS NULL AS is_current FROM versions",
    "p5_found": f"WITH {_ORPHANS} SELECT event_id, reason FROM found WHERE reason IS NOT NULL",
    "p5_report": f"WITH {_ORPHANS} SELECT 'silver_events' AS child_table, strftime({_day('o')}, '%Y-%m') AS month, reason, count(*) AS orphans, count(DISTINCT customer_id) AS parents FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": f"WITH {_KNOWN} SELECT event_id, k.plan FROM known k JOIN newest w ON w.customer_id = k.customer_id WHERE n > 0 AND k.plan IS DISTINCT FROM w.plan",
    "p6_plans": f"WITH {_KNOWN} SELECT event_id, customer_id, o AS occurred_us, plan FROM known",
    "p7_found": f"WITH {_FEED} SELECT event_id, us AS updated_us, CASE WHEN gone THEN 'deleted' ELSE 'live' END AS state FROM last WHERE first_us <> us",
    "p7_state": _state_sql(),
}
