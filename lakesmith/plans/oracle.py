"""The same queries in plain SQL, written independently of the operators. They run on the Parquet tables as views."""

from __future__ import annotations

from lakesmith.operators.medallion import EVENT_TYPES, PLANS
from lakesmith.plans.medallion import ARRIVED, LOOKED_UP, MONTH, OVERLAP, PAGE, PAGE_SIZE, REFERENCE, SINCE, UNTIL


def _id(c: str) -> str:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"nullif(lower(trim({c}, {blanks})), '')"


def _day(us: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor({us} / 86400000000.0) AS INTEGER))"


def _month(day: str) -> str:
    return f"CAST(date_trunc('month', {day}) AS DATE)"


def _us(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


_WHOLE = "CASE WHEN json_valid(_raw_payload) THEN _raw_payload END"
_RAW = ", ".join(f"json_extract_string({_WHOLE}, '$.{n}') AS {n}" for n in ("event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties"))
_INSTANT = "epoch_us(CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{6}})?Z') THEN try_cast(replace({0}, 'Z', '') AS TIMESTAMP) END)"

_SILVER = f"""silver AS (
  SELECT {_id("event_id")} AS event_id, {_id("customer_id")} AS customer_id, lower(event_type) AS event_type, epoch_us(occurred_at) AS occurred_us, epoch_us(updated_at) AS updated_us, properties, channel
  FROM silver_events)"""
_DIM = f"""dim AS (
  SELECT {_id("customer_id")} AS customer_id, company_name, plan, segment, signup_date, country, is_active, epoch_us(updated_at) AS updated_us, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, is_current, _record_version
  FROM silver_customers)"""
_DELETE = (
    "CASE WHEN json_valid(_raw_payload) THEN coalesce(lower(json_extract_string(_raw_payload, '$.op')) IN ('d', 'delete'), false) OR coalesce(lower(json_extract_string(_raw_payload, '$.is_deleted')) = 'true', false) ELSE false END"
)
_NEWEST = f"""ranked AS (
  SELECT *, {_id("event_id")} AS k, row_number() OVER (PARTITION BY {_id("event_id")} ORDER BY updated_at DESC NULLS LAST, _ingested_at DESC NULLS LAST, _batch_id DESC NULLS LAST, customer_id DESC NULLS LAST,
    event_type DESC NULLS LAST, occurred_at DESC NULLS LAST, channel DESC NULLS LAST, properties DESC NULLS LAST, {_DELETE} DESC) AS rn, {_DELETE} AS gone
  FROM bronze_events {{where}}),
newest AS (SELECT * FROM ranked WHERE rn = 1 AND k IS NOT NULL)"""
_INCOMING = (
    _NEWEST.format(where="")
    + f""",
incoming AS (
  SELECT k AS event_id, {_id("customer_id")} AS customer_id, customer_id IS NOT NULL AS has_customer_id, lower(event_type) AS event_type, epoch_us(updated_at) AS updated_us,
    properties IS NULL OR json_valid(properties) AS properties_valid_json, gone
  FROM newest)"""
)
_CRM = f"""crm AS (
  SELECT * FROM (
    SELECT {_id("customer_id")} AS customer_id, lower(trim(plan)) AS plan, segment, country, is_active, epoch_us(updated_at) AS updated_us,
      row_number() OVER (PARTITION BY {_id("customer_id")} ORDER BY updated_at DESC NULLS LAST, _ingested_at DESC NULLS LAST, _batch_id DESC NULLS LAST, company_name DESC NULLS LAST, lower(trim(plan)) DESC NULLS LAST) AS rn
    FROM bronze_customers) WHERE rn = 1 AND customer_id IS NOT NULL)"""
_SUMMARY = f"""fresh AS (
  SELECT {_day("occurred_us")} AS event_date, customer_id, event_type, count(*) AS event_count, max(occurred_us) AS last_occurred_at_us FROM silver GROUP BY ALL)"""
_ACTIVITY = f"""active AS (
  SELECT {_month(_day("occurred_us"))} AS activity_month, customer_id, count(*) AS event_count FROM silver WHERE customer_id IS NOT NULL GROUP BY ALL),
signups AS (SELECT customer_id, min({_month("signup_date")}) AS signup_month FROM dim WHERE is_current GROUP BY ALL),
activity AS (SELECT activity_month, customer_id, event_count > 0 AS has_activity, event_count, signup_month FROM active LEFT JOIN signups USING (customer_id))"""
_TICKETS = """tickets AS (
  SELECT event_id, customer_id, CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.ticket_id') END AS ticket_id, event_type, occurred_us,
    CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.agent_id') END AS agent_id
  FROM silver WHERE event_type IN ('ticket_opened', 'ticket_replied', 'ticket_closed'))"""
_SAME_KEY = "f.event_date IS NOT DISTINCT FROM g.event_date AND f.customer_id IS NOT DISTINCT FROM g.customer_id AND f.event_type IS NOT DISTINCT FROM g.event_type"


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _check(name: str, severity: str, status: str, table: str, checked: str, failed: str, source: str) -> str:
    return f"""SELECT '{name}' AS check_name, {severity} AS severity, {status} AS status, 'silver' AS layer, '{table}' AS table_name, CAST({checked} AS BIGINT) AS records_checked, CAST({failed} AS BIGINT) AS records_failed,
      CASE WHEN {checked} > 0 THEN CAST({failed} AS DOUBLE) / {checked} ELSE 0.0 END AS failure_rate FROM ({source})"""


def _unique(table: str, key: str, rows: str) -> str:
    source = f"SELECT coalesce(sum(n), 0) AS c, coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS f FROM (SELECT count(*) AS n FROM {rows} GROUP BY {key})"
    return _check("CHECK_UNIQUENESS", "'critical'", "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", table, "c", "f", source)


def _domain(table: str, column: str, words: tuple[str, ...], rows: str) -> str:
    source = f"SELECT count(*) AS c, coalesce(sum(CASE WHEN {column} NOT IN ({_list(words)}) THEN 1 ELSE 0 END), 0) AS f FROM {rows}"
    return _check("CHECK_DOMAIN_VALUES", "'critical'", "CASE WHEN f = 0 THEN 'passed' ELSE 'failed' END", table, "c", "f", source)


_UNIQUENESS = f"{_unique('silver.events', 'event_id', 'silver')} UNION ALL {_unique('silver.customers', 'customer_id, from_us', 'dim')}"
_REFERENTIAL = _check(
    "CHECK_REFERENTIAL_INTEGRITY", "CASE WHEN f > 0.20 * c THEN 'critical' ELSE 'warning' END", "CASE WHEN f > 0.20 * c THEN 'failed' WHEN f > 0.05 * c THEN 'warning' ELSE 'passed' END", "silver.events", "c", "f",
    "SELECT count(*) AS c, count(*) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM dim WHERE customer_id IS NOT NULL)) AS f FROM silver WHERE customer_id IS NOT NULL",
)
_VOLUMES = f"volumes AS (SELECT {_day('occurred_us')} AS metric_date, count(*) AS record_count FROM silver WHERE occurred_us IS NOT NULL GROUP BY ALL)"
_VOLUMETRY = _check(
    "CHECK_VOLUMETRY", "'warning'", "CASE WHEN w THEN 'warning' ELSE 'passed' END", "silver.events", "c", "CASE WHEN w THEN c ELSE 0 END",
    """SELECT c, coalesce(b > 0 AND ((c - b) / b <= -0.30 OR (c - b) / b >= 2.0), false) AS w FROM (
      SELECT coalesce(max(CASE WHEN metric_date = d THEN record_count END), 0) AS c, avg(CASE WHEN metric_date >= d - 7 AND metric_date < d THEN record_count END) AS b FROM volumes, (SELECT max(metric_date) AS d FROM volumes))""",
)
_DOMAINS = f"{_domain('silver.events', 'event_type', EVENT_TYPES, 'silver')} UNION ALL {_domain('silver.customers', 'plan', PLANS, 'dim')}"
_FRESHNESS = _check(
    "CHECK_FRESHNESS", "'warning'", "CASE WHEN f = 0 THEN 'passed' ELSE 'warning' END", "silver.events", "1", "f",
    f"SELECT CASE WHEN {_us(REFERENCE)} - max(occurred_us) <= 48 * 3600000000 THEN 0 ELSE 1 END AS f FROM silver",
)
_START = max(0, (PAGE - 1) * PAGE_SIZE - (OVERLAP if PAGE > 1 else 0))

SQL: dict[str, str] = {
    "json_extract_project": f"SELECT md5(_raw_payload) AS line, {_RAW} FROM bronze_events",
    "iso_timestamp_parse": f"SELECT line, {_INSTANT.format('occurred_at')} AS occurred_us, {_INSTANT.format('updated_at')} AS updated_us FROM (SELECT md5(_raw_payload) AS line, {_RAW} FROM bronze_events)",
    "record_validation": f"SELECT f AS source_file, count(*) AS records, count(*) FILTER (WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND occurred_at IS NOT NULL AND updated_at IS NOT NULL) AS valid "
    f"FROM (SELECT _source_file AS f, {_RAW} FROM bronze_events) GROUP BY f",
    "blank_line_filter": "SELECT doc_id, CAST(length(text) AS BIGINT) AS length FROM documents WHERE length(trim(text, ' ')) > 0",
    "incremental_since": f"SELECT event_id, epoch_us(updated_at) AS updated_at_us, _batch_id AS batch_id FROM bronze_events WHERE epoch_us(updated_at) >= {_us(SINCE)} AND epoch_us(updated_at) < {_us(UNTIL)}",
    "page_with_overlap": f"SELECT event_id, epoch_us(updated_at) AS updated_at_us, epoch_us(_ingested_at) AS ingested_at_us, md5(_raw_payload) AS line FROM bronze_events "
    f"ORDER BY 2 NULLS FIRST, 1 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT {PAGE * PAGE_SIZE - _START} OFFSET {_START}",
    "page_after_key": f"""SELECT event_id, epoch_us(updated_at) AS updated_at_us, md5(_raw_payload) AS line FROM bronze_events
      WHERE epoch_us(updated_at) > {_us(SINCE)} OR (epoch_us(updated_at) = {_us(SINCE)} AND (event_id > 'e_0' OR (event_id = 'e_0' AND md5(_raw_payload) > ''))) ORDER BY 2, 1 NULLS FIRST, 3 LIMIT {PAGE_SIZE}""",
    "point_lookup": f"SELECT event_id, epoch_us(updated_at) AS updated_at_us, epoch_us(_ingested_at) AS ingested_at_us, md5(_raw_payload) AS line FROM bronze_events WHERE {_id('event_id')} = '{LOOKED_UP.strip().lower()}'",
    "public_fields": "SELECT event_id, customer_id, event_type, epoch_us(occurred_at) AS occurred_at_us, epoch_us(updated_at) AS updated_at_us, channel, properties FROM bronze_events",
    "watermarks": "SELECT 'events' AS source, max(epoch_us(updated_at)) AS watermark_us FROM bronze_events UNION ALL SELECT 'customers', max(epoch_us(updated_at)) FROM bronze_customers",
    "source_totals": "SELECT CAST((SELECT count(*) FROM bronze_events) + (SELECT count(*) FROM bronze_customers) AS BIGINT) AS records, CAST((SELECT count(*) FROM (SELECT DISTINCT _batch_id FROM bronze_events)) + (SELECT count(*) FROM (SELECT DISTINCT _batch_id FROM bronze_customers)) AS BIGINT) AS batches",
    "literal_rows": "SELECT * FROM (VALUES ('CHECK_UNIQUENESS', 'critical'), ('CHECK_REFERENTIAL_INTEGRITY', NULL), ('CHECK_VOLUMETRY', 'warning'), ('CHECK_DOMAIN_VALUES', 'critical'), ('CHECK_FRESHNESS', 'warning')) AS t(check_name, severity)",
    "reconcile_customers": f"""WITH {_DIM}, {_CRM}, cur AS (SELECT * FROM dim WHERE is_current AND customer_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY from_us DESC NULLS LAST) = 1),
      j AS (SELECT coalesce(c.customer_id, d.customer_id) AS customer_id, c.customer_id IS NOT NULL AS in_source, d.customer_id IS NOT NULL AS in_target,
        concat_ws(',', CASE WHEN c.plan IS DISTINCT FROM d.plan THEN 'plan' END, CASE WHEN c.segment IS DISTINCT FROM d.segment THEN 'segment' END, CASE WHEN c.country IS DISTINCT FROM d.country THEN 'country' END, CASE WHEN c.is_active IS DISTINCT FROM d.is_active THEN 'is_active' END) AS x
        FROM crm c FULL JOIN cur d ON c.customer_id = d.customer_id)
      SELECT customer_id, in_source, in_target, CASE WHEN in_source AND in_target THEN x END AS differing FROM j WHERE NOT in_source OR NOT in_target OR x <> ''""",
    "raw_line_set_merge": f"SELECT DISTINCT md5(_raw_payload) AS line FROM bronze_events WHERE _source_file IS NOT NULL AND contains(_source_file, '{ARRIVED}') IN (true, false)",
    "source_state": "SELECT _batch_id AS batch_id, count(*) AS visible, min(epoch_us(updated_at)) AS first_us, max(epoch_us(updated_at)) AS last_us FROM bronze_events GROUP BY _batch_id",
    "bronze_customer_lines": "SELECT md5(_raw_payload) AS line, j->>'$.customer_id' AS customer_id, j->>'$.plan' AS plan, j->>'$.segment' AS segment, try_cast(j->>'$.signup_date' AS DATE) AS signup_date, j->>'$.country' AS country, "
    f"try_cast(j->>'$.is_active' AS BOOLEAN) AS is_active, {_INSTANT.format('(j->>$$$.updated_at$$)')} AS updated_at_us FROM (SELECT _raw_payload, CAST({_WHOLE} AS JSON) AS j FROM bronze_customers)",
    "dedup_latest": f"WITH {_NEWEST.format(where='')} SELECT k AS event_id, epoch_us(updated_at) AS updated_at_us, epoch_us(_ingested_at) AS ingested_at_us, _batch_id AS batch_id FROM newest",
    "normalize_flags": f"WITH {_INCOMING} SELECT event_id, customer_id, has_customer_id, event_type, updated_us AS updated_at_us, properties_valid_json FROM incoming WHERE NOT gone",
    "events_daily_summary": f"WITH {_SILVER}, {_SUMMARY} SELECT * FROM fresh",
    "ticket_events": f"WITH {_SILVER}, {_TICKETS} SELECT event_id, customer_id, ticket_id, event_type, occurred_us AS occurred_at_us, agent_id FROM tickets",
    "customer_monthly_activity": f"WITH {_SILVER}, {_DIM}, {_ACTIVITY} SELECT * FROM activity",
    "merge_latest_wins": f"""WITH {_SILVER}, {_INCOMING}
      SELECT coalesce(t.event_id, s.event_id) AS event_id, CASE WHEN n THEN s.customer_id ELSE t.customer_id END AS customer_id, CASE WHEN n THEN s.event_type ELSE t.event_type END AS event_type, CASE WHEN n THEN s.updated_us ELSE t.updated_us END AS updated_at_us
      FROM (SELECT *, 1 AS it FROM silver) t FULL JOIN (SELECT *, 1 AS i FROM incoming) s ON t.event_id = s.event_id, LATERAL (SELECT it IS NULL OR coalesce(s.updated_us > t.updated_us, false) AS n)
      WHERE NOT (n AND coalesce(gone, false))""",
    "merge_null_safe": f"""WITH {_SILVER}, {_SUMMARY} SELECT event_date, customer_id, event_type, event_count FROM fresh
      UNION ALL SELECT event_date, customer_id, event_type, event_count FROM gold_events_daily_summary g WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE {_SAME_KEY})""",
    "merge_rebuild": f"WITH {_SILVER}, {_SUMMARY} SELECT event_date, customer_id, event_type, event_count FROM fresh",
    "merge_ticket_events": f"WITH {_SILVER}, {_TICKETS.replace('agent_id' + chr(10), 'agent_id, channel' + chr(10))} SELECT event_id, customer_id, ticket_id, event_type, occurred_us AS occurred_at_us, agent_id, channel FROM tickets",
    "merge_monthly_activity": f"""WITH {_SILVER}, {_DIM}, {_ACTIVITY}, old AS (SELECT {_month(_day("occurred_us"))} AS activity_month, customer_id, count(*) AS n FROM silver WHERE customer_id IS NOT NULL AND occurred_us < {_us(UNTIL)} GROUP BY ALL)
      SELECT a.activity_month, a.customer_id, true AS has_activity, CASE WHEN a.activity_month >= DATE '{MONTH[:10]}' THEN a.event_count ELSE n END AS event_count, signup_month FROM activity a
      LEFT JOIN old o ON o.activity_month = a.activity_month AND o.customer_id = a.customer_id WHERE a.activity_month >= DATE '{MONTH[:10]}' OR n IS NOT NULL""",
    "merge_volume_history": f"""WITH {_SILVER}, old AS (SELECT {_day("occurred_us")} AS d, count(*) AS n FROM silver WHERE occurred_us IS NOT NULL AND updated_us < {_us(UNTIL)} GROUP BY ALL),
      new AS (SELECT {_day("occurred_us")} AS d, count(*) AS n FROM silver WHERE occurred_us >= {_us(SINCE)} GROUP BY ALL)
      SELECT 'silver.events' AS table_name, d AS metric_date, coalesce(new.n, old.n) AS record_count FROM old FULL JOIN new USING (d)""",
    "merge_insert_only": f"""WITH {_DIM}, {_CRM}, cur AS (SELECT customer_id, plan, segment, country FROM dim WHERE is_current)
      SELECT * FROM cur UNION ALL SELECT customer_id, plan, segment, country FROM crm WHERE customer_id NOT IN (SELECT customer_id FROM cur)""",
    "merge_update_only": f"""WITH {_DIM}, {_CRM} SELECT d.customer_id, CASE WHEN c.updated_us > d.updated_us THEN c.plan ELSE d.plan END AS plan, d.segment, d.updated_us AS updated_at_us
      FROM dim d LEFT JOIN crm c ON c.customer_id = d.customer_id WHERE d.is_current""",
    "scd2_history": f"""WITH lines AS (SELECT DISTINCT {_id("customer_id")} AS customer_id, epoch_us(updated_at) AS us, lower(trim(plan)) AS plan, segment, CAST(is_active AS VARCHAR) AS is_active, country FROM bronze_customers),
      marked AS (SELECT *, row_number() OVER w AS n, lag(plan) OVER w AS p1, lag(segment) OVER w AS p2, lag(is_active) OVER w AS p3, lag(country) OVER w AS p4 FROM lines WINDOW w AS (PARTITION BY customer_id ORDER BY us)),
      v AS (SELECT * FROM marked WHERE n = 1 OR plan IS DISTINCT FROM p1 OR segment IS DISTINCT FROM p2 OR is_active IS DISTINCT FROM p3 OR country IS DISTINCT FROM p4)
      SELECT customer_id, plan, segment, is_active, country, us AS valid_from_us, lead(us) OVER w AS valid_to_us, lead(us) OVER w IS NULL AS is_current, CAST(row_number() OVER w AS INTEGER) AS _record_version
      FROM v WINDOW w AS (PARTITION BY customer_id ORDER BY us)""",
    "scd2_apply": f"""WITH {_DIM}, {_CRM}, top AS (SELECT customer_id, max(_record_version) AS top FROM dim GROUP BY ALL), cur AS (SELECT * FROM dim WHERE is_current QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY from_us DESC) = 1),
      opening AS (SELECT c.*, coalesce(top, 0) + 1 AS version FROM crm c LEFT JOIN cur d USING (customer_id) LEFT JOIN top USING (customer_id)
        WHERE d.customer_id IS NULL OR (c.updated_us > d.updated_us AND (c.plan IS DISTINCT FROM d.plan OR c.segment IS DISTINCT FROM d.segment OR c.is_active IS DISTINCT FROM d.is_active OR c.country IS DISTINCT FROM d.country)))
      SELECT customer_id, plan, segment, country, is_active, updated_us AS valid_from_us, CAST(NULL AS BIGINT) AS valid_to_us, true AS is_current, CAST(version AS INTEGER) AS record_version FROM opening
      UNION ALL SELECT d.customer_id, d.plan, d.segment, d.country, d.is_active, from_us, CASE WHEN d.is_current AND o.customer_id IS NOT NULL THEN o.updated_us ELSE to_us END, d.is_current AND o.customer_id IS NULL, _record_version
      FROM dim d LEFT JOIN opening o ON o.customer_id = d.customer_id""",
    "scd2_current": f"WITH {_DIM} SELECT customer_id, plan, segment, country, from_us AS valid_from_us FROM dim WHERE is_current",
    "asof_join_inner": f"WITH {_SILVER}, {_DIM} SELECT e.event_id, e.customer_id, occurred_us AS occurred_at_us, plan FROM silver e JOIN dim d ON d.customer_id = e.customer_id AND from_us <= occurred_us AND (to_us > occurred_us OR to_us IS NULL)",
    "asof_join_left": f"WITH {_SILVER}, {_DIM} SELECT e.event_id, e.customer_id, occurred_us AS occurred_at_us, plan FROM silver e LEFT JOIN dim d ON d.customer_id = e.customer_id AND from_us <= occurred_us AND (to_us > occurred_us OR to_us IS NULL)",
    "top_customers_30d": f"""WITH {_DIM}, counts AS (SELECT customer_id, CAST(sum(event_count) AS BIGINT) AS event_count FROM gold_events_daily_summary
        WHERE customer_id IS NOT NULL AND event_date > (SELECT max(event_date) FROM gold_events_daily_summary) - 30 GROUP BY customer_id)
      SELECT c.customer_id, coalesce(company_name, 'desconhecido') AS company_name, plan, segment, event_count FROM counts c LEFT JOIN dim d ON d.customer_id = c.customer_id AND is_current
      WHERE c.customer_id IN (SELECT customer_id FROM counts ORDER BY event_count DESC, customer_id LIMIT 10)""",
    "first_response_by_plan_month": f"""WITH {_SILVER}, {_DIM}, {_TICKETS},
      opened AS (SELECT ticket_id, customer_id, min(occurred_us) FILTER (WHERE event_type = 'ticket_opened') AS o FROM tickets WHERE ticket_id IS NOT NULL GROUP BY ALL HAVING o IS NOT NULL),
      first AS (SELECT ticket_id, min(r.occurred_us) AS f FROM opened JOIN tickets r USING (ticket_id) WHERE r.event_type = 'ticket_replied' AND r.occurred_us > o GROUP BY ALL),
      done AS (SELECT customer_id, o, (f - o) // 60000000 AS minutes FROM opened LEFT JOIN first USING (ticket_id))
      SELECT coalesce(plan, 'desconhecido') AS plan, {_month(_day("o"))} AS response_month, count(*) AS total_tickets, count(minutes) AS tickets_with_response,
        round(CAST(sum(minutes) AS DOUBLE) / 60 / count(minutes), 2) AS avg_hours_to_first_response, round(CAST(count(*) - count(minutes) AS DOUBLE) * 100 / count(*), 1) AS pct_no_response
      FROM done x LEFT JOIN dim d ON d.customer_id = x.customer_id AND from_us <= o AND (to_us > o OR to_us IS NULL) GROUP BY ALL""",
    "cohort_retention": f"""WITH {_SILVER}, {_DIM}, {_ACTIVITY},
      cohorts AS (SELECT {_month("signup_date")} AS signup_month, count(DISTINCT customer_id) AS cohort_size FROM dim WHERE is_current GROUP BY ALL),
      months AS (SELECT activity_month FROM activity UNION SELECT signup_month FROM cohorts),
      a AS (SELECT signup_month, activity_month, count(DISTINCT customer_id) AS n FROM activity WHERE signup_month IS NOT NULL GROUP BY ALL)
      SELECT c.signup_month, m.activity_month, cohort_size, coalesce(n, 0) AS active_customers, round(CAST(coalesce(n, 0) AS DOUBLE) * 100 / cohort_size, 1) AS retention_rate
      FROM cohorts c JOIN months m ON m.activity_month >= c.signup_month LEFT JOIN a ON a.signup_month = c.signup_month AND a.activity_month = m.activity_month""",
    "volume_history": f"WITH {_SILVER}, {_VOLUMES} SELECT 'silver.events' AS table_name, metric_date, record_count FROM volumes",
    "check_uniqueness": f"WITH {_SILVER}, {_DIM} {_UNIQUENESS}",
    "check_referential_integrity": f"WITH {_SILVER}, {_DIM} {_REFERENTIAL}",
    "check_volumetry": f"WITH {_SILVER}, {_VOLUMES} {_VOLUMETRY}",
    "check_domain_values": f"WITH {_SILVER}, {_DIM} {_DOMAINS}",
    "check_freshness": f"WITH {_SILVER} {_FRESHNESS}",
    "check_ticket_uniqueness": f"WITH {_SILVER}, {_TICKETS}, opened AS (SELECT * FROM tickets WHERE event_type = 'ticket_opened' AND ticket_id IS NOT NULL) {_unique('gold.ticket_events', 'ticket_id', 'opened').replace(chr(39) + 'silver' + chr(39) + ' AS layer', chr(39) + 'gold' + chr(39) + ' AS layer')}",
    "check_details": f"""WITH {_SILVER}, {_DIM}, {_VOLUMES}, d AS (SELECT max(metric_date) AS d FROM volumes),
      v AS (SELECT coalesce(max(CASE WHEN metric_date = d THEN record_count END), 0) AS c, avg(CASE WHEN metric_date >= d - 7 AND metric_date < d THEN record_count END) AS b FROM volumes, d)
      SELECT 'CHECK_UNIQUENESS' AS check_name, 'silver.events' AS table_name, 'repeated' AS item, event_id AS key, CAST(n AS DOUBLE) AS number FROM (SELECT event_id, count(*) AS n FROM silver GROUP BY ALL HAVING count(*) > 1 ORDER BY 1 LIMIT 10)
      UNION ALL SELECT 'CHECK_REFERENTIAL_INTEGRITY', 'silver.events', 'unknown', customer_id, n FROM (SELECT customer_id, count(*) AS n FROM silver WHERE customer_id NOT IN (SELECT customer_id FROM dim WHERE customer_id IS NOT NULL) GROUP BY ALL ORDER BY n DESC, customer_id LIMIT 10)
      UNION ALL VALUES ('CHECK_REFERENTIAL_INTEGRITY', 'silver.events', 'warn_above', NULL, 0.05), ('CHECK_REFERENTIAL_INTEGRITY', 'silver.events', 'fail_above', NULL, 0.20), ('CHECK_FRESHNESS', 'silver.events', 'limit_hours', NULL, 48.0)
      UNION ALL SELECT 'CHECK_VOLUMETRY', 'silver.events', 'newest', NULL, c FROM v UNION ALL SELECT 'CHECK_VOLUMETRY', 'silver.events', 'base', NULL, b FROM v UNION ALL SELECT 'CHECK_VOLUMETRY', 'silver.events', 'change', NULL, CASE WHEN b > 0 THEN (c - b) / b END FROM v
      UNION ALL SELECT 'CHECK_DOMAIN_VALUES', 'silver.events', 'invalid', event_type, n FROM (SELECT event_type, count(*) AS n FROM silver WHERE event_type NOT IN ({_list(EVENT_TYPES)}) GROUP BY ALL ORDER BY n DESC, event_type LIMIT 10)
      UNION ALL SELECT 'CHECK_DOMAIN_VALUES', 'silver.customers', 'invalid', plan, n FROM (SELECT plan, count(*) AS n FROM dim WHERE plan NOT IN ({_list(PLANS)}) GROUP BY ALL ORDER BY n DESC, plan LIMIT 10)
      UNION ALL SELECT 'CHECK_FRESHNESS', 'silver.events', 'age_hours', NULL, ({_us(REFERENCE)} - max(occurred_us)) / 3600000000.0 FROM silver""",
    "quality_report": f"WITH {_SILVER}, {_DIM}, {_VOLUMES} {_UNIQUENESS} UNION ALL {_REFERENTIAL} UNION ALL {_VOLUMETRY} UNION ALL {_DOMAINS} UNION ALL {_FRESHNESS}",
    "properties_schema": f"""WITH {_SILVER}, e AS (SELECT event_type, unnest(json_keys(CAST(properties AS JSON))) AS property, CAST(properties AS JSON) AS j FROM silver WHERE json_valid(properties) AND json_type(properties) = 'OBJECT')
      SELECT event_type, property, CASE json_type(json_extract(j, '$."' || property || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS json_type, count(*) AS n
      FROM e GROUP BY ALL""",
    "constraint_violations": " UNION ALL ".join(
        f"SELECT 'customers' AS table_name, '{c} is not null' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM bronze_customers" for c in ("customer_id", "company_name", "plan", "country", "updated_at")
    )
    + f" UNION ALL SELECT 'customers', 'plan in its domain', count(*) FILTER (WHERE plan NOT IN ({_list(PLANS)})) FROM bronze_customers"
    + " UNION ALL SELECT 'customers', 'customer_id, updated_at is unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM bronze_customers GROUP BY customer_id, updated_at)",
}
