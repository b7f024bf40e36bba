"""DuckDB SQL of the named queries."""

from __future__ import annotations

#: Records as the adapter publishes them, with the rule each fails.
BASE = """
WITH raw AS (
  SELECT event_id, ts, user_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CASE event_type WHEN 'click' THEN 'contact_queued' WHEN 'view' THEN 'contact_connected' WHEN 'purchase' THEN 'contact_ended'
              WHEN 'signup' THEN 'agent_state_changed' ELSE event_type END AS kind
  FROM events),
rec AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS num, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, ts + to_seconds(k) AS due, user_id AS u, k, kind,
         CAST(value AS DECIMAL(18,3)) AS v, kind = 'agent_state_changed' AS agent,
         CASE WHEN kind = 'agent_state_changed' THEN 'a' ELSE 'c' END || user_id AS key, 'q' || (user_id % 4) AS queue,
         CASE k % 3 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'transferred' ELSE 'resolved' END AS disposition,
         ['logged_in', 'ready', 'busy', 'wrapup'][k % 4 + 1] AS to_state, ['logged_in', 'ready', 'busy', 'wrapup'][(k + 3) % 4 + 1] AS from_state,
         CASE WHEN k = 98 THEN 1 WHEN k = 95 THEN 2 WHEN k = 94 THEN 3 WHEN k = 90 THEN 4 WHEN kind = 'error' THEN 5 WHEN k = 99 THEN 6 WHEN k = 91 THEN 7 WHEN k = 97 THEN 8 WHEN k = 92 THEN 9
              WHEN k = 96 THEN 10 WHEN k = 93 AND kind <> 'agent_state_changed' THEN 11 WHEN k = 89 AND kind IN ('contact_connected', 'contact_ended') THEN 12 ELSE 0 END AS rule,
         unnest(CASE WHEN k < 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw),
ok AS (SELECT *, CASE WHEN agent THEN 'agent_state_counts' ELSE 'queue_metrics' END AS metric_type, CASE WHEN agent THEN to_state ELSE queue END AS dim FROM rec WHERE rule = 0),
"""

_METRICS = """
       count(*) FILTER (kind = 'contact_queued') AS offered, count(*) FILTER (kind = 'contact_connected') AS connected,
       count(*) FILTER (kind = 'contact_ended' AND disposition = 'abandoned') AS abandoned,
       count(*) FILTER (kind = 'contact_ended' AND disposition = 'transferred') AS transferred,
       count(*) FILTER (kind = 'contact_ended' AND disposition = 'resolved') AS resolved,
       count(*) FILTER (kind = 'contact_connected' AND v <= 20) AS answered_within_sl,
       coalesce(round(CAST(sum(CAST(v AS DECIMAL(28,9))) FILTER (kind = 'contact_ended') AS DOUBLE) / nullif(count(*) FILTER (kind = 'contact_ended'), 0), 3), 0.0) AS avg_wait_seconds,
       coalesce(round(CAST(quantile_disc(v, 0.9) FILTER (kind = 'contact_ended') AS DOUBLE), 3), 0.0) AS p90_wait_seconds,
       coalesce(round(CAST(max(v) FILTER (kind = 'contact_ended') AS DOUBLE), 3), 0.0) AS max_wait_seconds,
       coalesce(round(CAST(sum(CAST(v * 2 AS DECIMAL(28,9))) FILTER (kind = 'contact_ended' AND disposition <> 'abandoned') AS DOUBLE), 3), 0.0) AS total_talk_seconds,
       count(*) AS n
"""


def _windows(unit: str) -> str:
    return f"""
one AS (SELECT DISTINCT metric_type, dim, date_trunc('{unit}', ts) AS w, id, kind, disposition, v FROM ok),
m AS (SELECT metric_type, dim, w, {_METRICS} FROM one GROUP BY ALL),
r AS (SELECT *, strftime(w, '%Y-%m-%dT%H:%M:%SZ') AS ws, strftime(w + INTERVAL 1 {unit}, '%Y-%m-%dT%H:%M:%SZ') AS we,
        CASE WHEN connected > 0 THEN round(answered_within_sl / connected, 4) ELSE 0.0 END AS ns20,
        CASE WHEN connected + abandoned > 0 THEN round(abandoned / (connected + abandoned), 4) ELSE 0.0 END AS abandon_rate,
        metric_type = 'queue_metrics' AS is_queue FROM m)
"""


_NAMES = ["offered", "connected", "abandoned", "transferred", "resolved", "answered_within_sl", "ns20", "abandon_rate", "avg_wait_seconds", "p90_wait_seconds", "max_wait_seconds", "total_talk_seconds"]
_COLUMNS = ", ".join(_NAMES)
_NULLED = ", ".join(f"CASE WHEN is_queue THEN {c} END AS {c}" for c in _NAMES) + ", CASE WHEN NOT is_queue THEN n END AS transitions"
_ID = "metric_type || '|' || dim || '|' || ws AS aggregate_id"


def sql() -> dict[str, str]:
    day, hour = BASE + _windows("day"), BASE + _windows("hour")
    plain = BASE.rstrip().rstrip(",")
    missing = "CASE kind WHEN 'agent_state_changed' THEN '[''to_state'']' ELSE '[''queue_id'']' END"
    return {
        "queue_metrics_day": day + f"SELECT dim AS dimension_id, ws AS window_start, {_COLUMNS} FROM r WHERE is_queue",
        "queue_metrics_hour": hour + f"SELECT dim AS dimension_id, ws AS window_start, {_COLUMNS} FROM r WHERE is_queue",
        "agent_state_counts": hour + f"SELECT {_ID}, dim AS dimension_id, ws AS window_start, we AS window_end, n AS transitions FROM r WHERE NOT is_queue",
        "changelog_union": day
        + f"SELECT CAST(1 AS INTEGER) AS schema_version, {_ID}, metric_type, dim AS dimension_id, ws AS window_start, we AS window_end, CAST(0 AS INTEGER) AS pane_index, 'ON_TIME' AS pane_timing, true AS is_first, false AS is_last, {_NULLED} FROM r",
        "changelog_records": day + f"SELECT dim AS key, {_ID}, CASE WHEN is_queue THEN offered END AS offered, CASE WHEN is_queue THEN p90_wait_seconds END AS p90_wait_seconds, CASE WHEN NOT is_queue THEN n END AS transitions FROM r",
        "queue_window_report": day
        + f"SELECT dim || ':' || strftime(w, '%Y-%m-%dT%H:%M:%S.%gZ') AS aggregate_id, dim AS queue_id, strftime(w, '%Y-%m-%dT%H:%M:%S.%gZ') AS window_start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS window_end, CAST(86400 AS INTEGER) AS window_seconds, {_COLUMNS}, CAST(20 AS INTEGER) AS service_level_seconds, n AS events_counted FROM r WHERE is_queue",
        "contract_errors": plain + " SELECT rule, count(*) AS n FROM rec GROUP BY rule",
        "dlq_rows": plain
        + f""", bad AS (SELECT key AS kafka_key, CASE rule WHEN 1 THEN 'el payload no es UTF-8 válido' WHEN 6 THEN 'payload debe ser un objeto JSON' WHEN 12 THEN 'payload con campos no numéricos: [''wait_seconds'']' WHEN 2 THEN 'el payload no es JSON válido' WHEN 3 THEN 'el evento debe ser un objeto JSON'
          WHEN 4 THEN 'faltan campos obligatorios del sobre: [''schema_version'']' WHEN 5 THEN 'event_type no soportado: ''error''' WHEN 7 THEN kind || ' sin campos obligatorios en payload: ' || {missing}
          WHEN 8 THEN 'event_time debe ser un string ISO-8601' WHEN 9 THEN 'event_time no es ISO-8601 válido: ''' || strftime(ts, '%d/%m/%Y %H:%M') || '''' WHEN 10 THEN 'key debe ser un string no vacío'
          WHEN 11 THEN 'key (''' || key || ''') debe ser el contact_id (''other'') en los eventos de contacto' END AS error FROM rec WHERE rule > 0)
        SELECT error, kafka_key, count(*) AS n FROM bad GROUP BY ALL""",
        "topic_routing": plain + " SELECT CASE WHEN agent THEN 'cc.agent-state.raw.v1' ELSE 'cc.contacts.raw.v1' END AS topic, count(*) AS n FROM ok GROUP BY ALL",
        "dedup_stats": BASE + "g AS (SELECT metric_type, dim, date_trunc('hour', ts) AS w, id, count(*) AS n FROM ok GROUP BY ALL) SELECT count(*) AS accepted, CAST(sum(n) AS BIGINT) - count(*) AS duplicates, count(DISTINCT (metric_type, dim, w)) AS windows FROM g",
        "event_id_uuid5": """
WITH h AS (SELECT event_id, sha1(unhex('9f2c4b167d3a4e58b0c15a8e6d21f340') || encode(user_id || '|evento-' || event_id)) AS s FROM events)
SELECT event_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || '89ab89ab89ab89ab'[CAST(('0x' || s[17:17]) AS INTEGER) % 4 + 1] || s[18:20] || '-' || s[21:32] AS id FROM h""",
        "delivery_disorder": BASE + "o AS (SELECT ts, lag(ts) OVER (ORDER BY due, id) AS b FROM ok WHERE copy = 0) SELECT count(*) AS events, count(*) FILTER (ts < b) AS disordered FROM o",
        "late_split": BASE
        + """o AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS e, max(ts) OVER (ORDER BY due, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ok WHERE copy = 0)
        SELECT CASE WHEN top >= e + INTERVAL 1 MINUTE THEN 'dropped' WHEN top >= e THEN 'late' ELSE 'on_time' END AS outcome, count(*) AS n FROM o GROUP BY ALL""",
        "view_latest": BASE
        + """c AS (SELECT 'user|' || u AS aggregate_id, CASE WHEN k % 10 <> 9 THEN k END AS pane_index, num AS "offset" FROM ok WHERE copy = 0)
        SELECT aggregate_id, pane_index, "offset" FROM c QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY coalesce(pane_index, -1) DESC, "offset" DESC) = 1""",
        "view_counters": BASE
        + """c AS (SELECT 'user|' || u AS a, coalesce(CASE WHEN k % 10 <> 9 THEN k END, -1) AS p, num FROM ok WHERE copy = 0),
        t AS (SELECT p, max(p) OVER (PARTITION BY a ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c)
        SELECT count(*) AS messages_seen, count(*) FILTER (top IS NULL) AS aggregates, count(*) FILTER (p >= top) AS revisions_replaced, count(*) FILTER (p < top) AS out_of_order_ignored FROM t""",
        "lifecycle_gaps": BASE
        + """g AS (SELECT key, bool_or(kind = 'contact_queued') AS q, bool_or(kind = 'contact_connected') AS c, bool_or(kind = 'contact_ended') AS e FROM ok WHERE NOT agent GROUP BY key, date_trunc('day', ts)),
        x AS (SELECT 'queued_not_ended' AS gap FROM g WHERE q AND NOT e UNION ALL SELECT 'ended_not_queued' FROM g WHERE e AND NOT q UNION ALL SELECT 'connected_not_ended' FROM g WHERE c AND NOT e)
        SELECT gap, count(*) AS n FROM x GROUP BY gap""",
        "transition_breaks": BASE
        + """x AS (SELECT id, key, from_state, lag(to_state, 1, 'logged_out') OVER (PARTITION BY key ORDER BY ts, num) AS e FROM ok WHERE copy = 0 AND agent)
        SELECT id AS event_id, key AS agent_id, from_state, e AS expected_state FROM x WHERE from_state IS DISTINCT FROM e""",
        "causal_breaks": BASE
        + """g AS (SELECT key, min(num) FILTER (kind = 'contact_queued') AS q, min(num) FILTER (kind = 'contact_connected') AS c, min(num) FILTER (kind = 'contact_ended') AS e FROM ok GROUP BY key)
        SELECT key AS contact_id FROM g WHERE c < q OR e < c OR e < q""",
        "replay_duplicates": BASE + "g AS (SELECT metric_type, dim, date_trunc('hour', ts) AS w, id FROM ok WHERE copy = 0) SELECT count(*) AS accepted, count(*) AS duplicates, count(DISTINCT (metric_type, dim, w)) AS windows FROM g",
        "replay_shift": plain + " SELECT '2027-01-01T00:00:00.000Z' AS first_time, strftime(TIMESTAMP '2027-01-01' + (max(ts) - min(ts)), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_time, count(*) AS n FROM ok",
        "delivered_records": plain + " SELECT count(*) AS published, count(*) AS delivered, CAST(0 AS BIGINT) AS failed, count(*) AS stored, count(DISTINCT key) AS keys FROM rec",
        "topic_disorder": BASE + "o AS (SELECT agent, ts, lag(ts) OVER (PARTITION BY agent ORDER BY due, id) AS b FROM ok WHERE copy = 0) SELECT CASE WHEN agent THEN 'cc.agent-state.raw.v1' ELSE 'cc.contacts.raw.v1' END AS topic, count(*) AS events, count(*) FILTER (ts < b) AS disordered FROM o GROUP BY agent",
        "compare_reports": BASE
        + """f AS (SELECT dim AS dimension_id, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, id, kind, k FROM ok WHERE NOT agent),
        c AS (SELECT dimension_id, window_start, count(DISTINCT id) FILTER (kind = 'contact_queued') AS left_offered, count(DISTINCT id) FILTER (kind = 'contact_connected') AS left_connected,
          count(DISTINCT id) FILTER (kind = 'contact_queued' AND k < 50) AS right_offered, count(DISTINCT id) FILTER (kind = 'contact_connected' AND k < 50) AS right_connected, count(*) FILTER (k < 50) AS n FROM f GROUP BY ALL)
        SELECT dimension_id, window_start, left_offered, left_connected, CASE WHEN n > 0 THEN right_offered END AS right_offered, CASE WHEN n > 0 THEN right_connected END AS right_connected FROM c
        WHERE left_offered <> right_offered OR left_connected <> right_connected OR n = 0""",
        "simulated_day": "SELECT CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS transition_breaks, CAST(0 AS BIGINT) AS causal_breaks, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS repeated_ids",
        "stream_panes": day + f"SELECT {_ID}, {_NULLED}, 'ON_TIME' AS pane_timing, CAST(0 AS INTEGER) AS pane_index FROM r",
        "log_to_view": day + f"SELECT {_ID}, {_NULLED} FROM r",
        "replay_corrupt": plain
        + """ SELECT CAST(7 AS INTEGER) AS rule, kind || ' sin campos obligatorios en payload: ' || CASE WHEN agent THEN '[''agent_id'']' ELSE '[''queue_id'']' END AS error, count(*) AS n FROM ok WHERE copy = 0 GROUP BY ALL""",
        "summary_by_type": plain
        + """ SELECT kind AS name, count(*) AS n FROM ok GROUP BY kind UNION ALL SELECT 'contacts', count(DISTINCT key) FROM ok WHERE NOT agent UNION ALL SELECT 'total', count(*) FROM ok""",
        "dashboard_projection": day
        + """SELECT ws[12:19] AS "window", replace(metric_type, '_', ' ')[1:12] AS metric, dim[1:12] AS dimension, '0' AS pane,
        CASE WHEN is_queue THEN CAST(offered AS VARCHAR) ELSE '' END AS offered, CASE WHEN is_queue THEN CAST(connected AS VARCHAR) ELSE '' END AS connected,
        CASE WHEN is_queue THEN CAST(abandoned AS VARCHAR) ELSE '' END AS abandoned, CASE WHEN is_queue THEN '' ELSE CAST(n AS VARCHAR) END AS transitions,
        CASE WHEN is_queue THEN CAST(round(CAST(ns20 AS DECIMAL(18,4)), 2) AS VARCHAR) ELSE '' END AS ns20, CASE WHEN is_queue THEN CAST(round(CAST(avg_wait_seconds AS DECIMAL(18,3)), 1) AS VARCHAR) ELSE '' END AS avg_wait,
        CASE WHEN is_queue THEN CAST(round(CAST(p90_wait_seconds AS DECIMAL(18,3)), 1) AS VARCHAR) ELSE '' END AS p90_wait FROM r""",
        "stream_queue_metrics": day + f"SELECT {_ID}, {_NULLED} FROM r",
    }
