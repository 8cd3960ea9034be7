"""Registered queries for the dashboard aggregates (F1-F20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions import labels as L
from logvigil.operators import alerts as A
from logvigil.operators import dashboard as P
from logvigil.operators import triage as R
from logvigil.plans import bindings as B
from logvigil.plans import snippets as S
from logvigil.plans.detection_queries import _CATALOG, REPEATED
from logvigil.plans.function_queries import place_sql
from logvigil.plans.registry import query
from logvigil.sources import sinks

NOW = B.NOW_US
HOUR = 3_600_000_000
ACTIVE = "lower(status) NOT IN ('contained', 'resolved', 'closed', 'false positive')"
FINISHED = "status IN ('resolved', 'false positive')"
EVENT_TIME = ["ingested_at", "timestamp"]


@query("f01_filter_time_range", B.with_tables("ev", f"""
SELECT id FROM ev WHERE "timestamp" IS NULL OR epoch_us("timestamp") BETWEEN {NOW - 168 * HOUR} AND {NOW}"""))
def _(spark, folder):
    return P.filter_time_range(B.event_views(spark, folder), "7d", ["timestamp"], NOW).select("id")


def _bucket_sql(source: str, moment: str, counts: str, names: list[str], buckets: int, start: str, end: str) -> str:
    width = f"(greatest({end} - {start}, 1) / {buckets}.0)"
    return f"""
WITH t AS (SELECT *, epoch_us({moment}) AS us FROM {source} WHERE {moment} IS NOT NULL), b AS (SELECT min(us) AS lo, max(us) AS hi FROM t),
c AS (SELECT least(CAST(floor((us - {start}) / {width}) AS BIGINT), {buckets - 1}) AS bucket, {counts} FROM t, b WHERE us BETWEEN {start} AND {end} GROUP BY 1)
SELECT r.bucket, {', '.join(f'coalesce(c.{n}, 0) AS {n}' for n in names)} FROM (SELECT unnest(range({buckets})) AS bucket) r LEFT JOIN c ON c.bucket = r.bucket"""


@query("f02_time_buckets", B.with_tables("ev", _bucket_sql(
    "ev", 'coalesce(ingested_at, "timestamp")', "count(*) AS records", ["records"], 7, str(NOW - 168 * HOUR), str(NOW))))
def _(spark, folder):
    return P.time_buckets(B.event_views(spark, folder), "7d", EVENT_TIME, NOW)


@query("f02_time_buckets_all", B.with_tables("ev", _bucket_sql(
    "ev", 'coalesce(ingested_at, "timestamp")', "count(*) AS records", ["records"], 12, "b.lo", "b.hi").replace(" FROM t, b WHERE", " FROM t CROSS JOIN b WHERE")
    .replace("GROUP BY 1)", "GROUP BY 1)")))
def _(spark, folder):
    return P.time_buckets(B.event_views(spark, folder), "all", EVENT_TIME, NOW)


_SEVERITIES = ["low", "medium", "high", "critical"]
_PIVOT = ", ".join(f"count(*) FILTER (WHERE lower(trim(severity)) = '{s}') AS {s}" for s in _SEVERITIES)


@query("f03_severity_buckets", B.with_tables("av", _bucket_sql("av", "created_at", _PIVOT, _SEVERITIES, 10, str(NOW - 720 * HOUR), str(NOW))))
def _(spark, folder):
    return P.severity_buckets(B.alert_views(spark, folder), "30d", NOW)


@query("f04_hourly_alert_volume", B.with_tables("av", f"""
WITH c AS (SELECT hour(created_at) // 2 AS bucket, {_PIVOT} FROM av GROUP BY 1)
SELECT r.bucket, {', '.join(f'coalesce(c.{n}, 0) AS {n}' for n in _SEVERITIES)} FROM (SELECT unnest(range(12)) AS bucket) r LEFT JOIN c ON c.bucket = r.bucket"""))
def _(spark, folder):
    return P.hourly_alert_volume(B.alert_views(spark, folder))


@query("f05_severity_counts", B.with_tables("av", """
SELECT s.severity, count(av.id) AS alerts FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) AS s(severity) LEFT JOIN av ON av.severity = s.severity GROUP BY 1"""))
def _(spark, folder):
    return P.severity_counts(B.alert_views(spark, folder))


@query("f06_dashboard_stats", B.with_tables("ev iv", f"""
SELECT (SELECT count(*) FROM ev) AS events_ingested, (SELECT count(*) FROM av WHERE status <> 'resolved') AS active_alerts,
  (SELECT count(*) FROM av WHERE status = 'new') AS new_alerts, (SELECT count(DISTINCT nullif(rule_id, '')) FROM av) AS rules_triggered,
  (SELECT count(*) FROM iv WHERE NOT {FINISHED}) AS open_incidents, (SELECT count(*) FROM iv WHERE {FINISHED}) AS completed_incidents"""))
def _(spark, folder):
    return P.dashboard_stats(B.event_views(spark, folder), B.alert_views(spark, folder), B.incident_views(spark, folder))


def _grade_sql(alerts: str, incidents: str, events: str) -> str:
    return f"""
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN score >= 80 THEN 'success' WHEN score >= 60 THEN 'warning' ELSE 'critical' END AS tone
FROM (SELECT CAST(greatest(0, least(100, 100 - 12 * (SELECT count(*) FROM {alerts} WHERE severity = 'critical' AND status NOT IN ('contained', 'resolved', 'closed'))
  - 5 * (SELECT count(*) FROM {alerts} WHERE severity = 'high' AND status NOT IN ('contained', 'resolved', 'closed'))
  - 8 * (SELECT count(*) FROM {incidents} WHERE NOT {FINISHED}) - 2 * least(10, (SELECT count(*) FROM {events} WHERE status = 'failed')))) AS BIGINT) AS score)"""


@query("f07_security_grade", B.with_tables("ev iv", _grade_sql("av", "iv", "ev")))
def _(spark, folder):
    return P.security_grade(B.alert_views(spark, folder), B.incident_views(spark, folder), B.event_views(spark, folder))


@query("f08_ip_activity", B.with_tables("ev", """
SELECT count(*) AS unique_ips, count(*) FILTER (WHERE n > 1) AS recurring_ips FROM (
  SELECT trim(source_ip), count(*) AS n FROM ev WHERE trim(source_ip) <> '' AND lower(trim(source_ip)) <> 'unknown' GROUP BY 1)"""))
def _(spark, folder):
    return P.ip_activity(B.event_views(spark, folder))


@query("f09_top_sources", B.with_tables("ev", f"""
SELECT source_ip, count(*) AS events, arg_min(source, log_id) AS source,
  coalesce(arg_min(code, log_id) FILTER (WHERE type <> 'unknown'), '--') AS location_code,
  coalesce(arg_min(label, log_id) FILTER (WHERE type <> 'unknown'), 'Unknown location') AS location,
  coalesce(arg_min(type, log_id) FILTER (WHERE type <> 'unknown'), 'unknown') AS location_type
FROM {place_sql("(SELECT *, lower(source_ip) AS a FROM ev)")} GROUP BY source_ip ORDER BY events DESC, source_ip LIMIT 12"""))
def _(spark, folder):
    return P.top_sources(B.event_views(spark, folder), 12)


def _readiness_sql(now: int) -> str:
    return f"""
SELECT latest AS latest_us, age AS age_minutes, active_sources, failed_outcomes,
  CASE WHEN latest IS NULL THEN 'No telemetry' WHEN age > 60 THEN 'Stale' WHEN age > 15 THEN 'Delayed' ELSE 'Live' END AS state,
  CASE WHEN latest IS NULL THEN 'critical' WHEN age > 15 THEN 'warning' ELSE 'healthy' END AS tone
FROM (SELECT *, CAST(greatest(0, floor(({now} - latest) / 60000000.0)) AS BIGINT) AS age FROM (
  SELECT epoch_us(max(coalesce(ingested_at, "timestamp"))) AS latest, count(DISTINCT nullif(source, '')) AS active_sources,
    count(*) FILTER (WHERE status = 'failed') AS failed_outcomes FROM ev))"""


@query("f10_telemetry_readiness", B.with_tables("ev", _readiness_sql(NOW)))
def _(spark, folder):
    return P.telemetry_readiness(B.event_views(spark, folder), NOW)


def _assigned(df):
    n = F.col("backend_id")
    return df.withColumn("assignee", F.when(n % 3 == 0, " Unassigned ").when(n % 3 == 1, F.concat(F.lit("User "), n.cast("string"))))


@query("f11_analyst_workload", B.with_tables("iv", f"""
SELECT *, CASE WHEN critical_active_alerts > 0 THEN 'Critical attention' WHEN unassigned_alerts > 0 THEN 'Assignment gap' ELSE 'Balanced' END AS state,
  CASE WHEN critical_active_alerts > 0 THEN 'critical' WHEN unassigned_alerts > 0 THEN 'warning' ELSE 'healthy' END AS tone
FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical_active_alerts, count(*) FILTER (WHERE backend_id % 3 <> 1) AS unassigned_alerts,
    count(*) FILTER (WHERE status = 'escalated') AS escalated_alerts,
    (SELECT count(*) FROM iv WHERE status = 'investigating') AS investigating_incidents FROM av WHERE {ACTIVE})"""))
def _(spark, folder):
    active = _assigned(B.alert_views(spark, folder)).filter(L.is_active_alert(F.col("status")))
    waiting = B.incident_views(spark, folder).filter(~L.is_terminal_incident(F.col("status")))
    return P.analyst_workload(active, waiting)


_THREAT = """
SELECT 'detected' AS state, {category} AS category, {title} AS title, {description} AS description, severity, "user", source_ip, rule_id,
  {n} AS evidence_count, time_window_seconds || 's' AS window_label, id AS alert_id
FROM (SELECT *, CASE WHEN len(evidence_ids) > 0 THEN len(evidence_ids) ELSE coalesce(CAST(nullif(regexp_extract(reason, '(?i)\\b(\\d+)\\s+[^.]{{0,48}}\\b(?:failures?|attempts?)\\b', 1), '') AS BIGINT), 0) END AS n
  FROM av WHERE {active} AND {which} ORDER BY risk DESC, backend_id LIMIT 1)"""
_IS_SUDO = "regexp_matches(lower(title || ' ' || rule_name || ' ' || rule_id || ' ' || reason || ' ' || summary), 'sudo|privilege escalation')"


@query("f12_threat_analysis", B.with_tables("av", _THREAT.format(
    active=ACTIVE, which=_IS_SUDO, n="n", category="'Privilege escalation'",
    title="CASE WHEN n >= 3 AND \"user\" <> 'Unknown' THEN 'Repeated sudo failures for ''' || \"user\" || ''': ' || n || ' failures in ' || time_window_seconds || 's.' ELSE reason END",
    description="'Possible privilege escalation attempt. Correlate the account, source, and host activity before containment.'")))
def _(spark, folder):
    return P.threat_analysis(B.alert_views(spark, folder), B.event_views(spark, folder))


@query("f12_threat_by_risk", B.with_tables("av", _THREAT.format(
    active=ACTIVE, which=f"NOT {_IS_SUDO}", n="n", category="'Prioritized detection'", title="reason",
    description="'Review the matched evidence and confirm whether containment is required.'")))
def _(spark, folder):
    alerts = B.alert_views(spark, folder).filter(F.col("rule_id") != "R-103")
    return P.threat_analysis(alerts, B.event_views(spark, folder))


@query("f12_threat_from_events", B.with_tables("ev", f"""
WITH {REPEATED.strip()}, w AS (SELECT *, greatest(1, CAST(round((epoch_us(t1) - epoch_us(t0)) / 1000000) AS BIGINT)) || 's' AS span FROM rf)
SELECT 'detected' AS state, 'Behavioral correlation' AS category,
  'Repeated authentication failures for ''' || "user" || ''': ' || failures || ' failures in ' || span || '.' AS title,
  'Possible credential attack. Review the account, source, and recent successful authentication activity.' AS description,
  'high' AS severity, "user", source_ip, 'Behavioral correlation' AS rule_id, failures AS evidence_count, span AS window_label, CAST(NULL AS VARCHAR) AS alert_id FROM w"""))
def _(spark, folder):
    settled = B.alert_views(spark, folder).withColumn("status", F.lit("resolved"))
    return P.threat_analysis(settled, B.event_views(spark, folder))


@query("f13_rule_activity", B.with_tables("av", f"""
SELECT c.id, c.engine_key, c.name, count(av.id) AS total, count(av.id) FILTER (WHERE av.status NOT IN ('closed', 'resolved')) AS active,
  epoch_us(max(coalesce(av.observed_at, av.created_at))) AS latest FROM {_CATALOG} LEFT JOIN av ON av.rule_id = c.id GROUP BY ALL"""))
def _(spark, folder):
    return P.rule_activity(A.rule_catalog(spark), B.alert_views(spark, folder))


@query("f13_rule_totals", B.with_tables("av", f"""
SELECT sum(n) AS total_matches, sum(a) AS active_matches, count(*) FILTER (WHERE n > 0) AS triggered_rules FROM (
  SELECT c.id, count(av.id) AS n, count(av.id) FILTER (WHERE av.status NOT IN ('closed', 'resolved')) AS a FROM {_CATALOG} LEFT JOIN av ON av.rule_id = c.id GROUP BY ALL)"""))
def _(spark, folder):
    return P.rule_totals(P.rule_activity(A.rule_catalog(spark), B.alert_views(spark, folder)))


def _notification_inputs(spark, folder):
    """Incidents with two waiting states added, and a read / dismissed state per record."""
    n = F.col("backend_id")
    incidents = B.incident_views(spark, folder).withColumn(
        "status", F.when((F.col("status") == "open") & (n % 5 == 0), "escalated").when((F.col("status") == "open") & (n % 5 == 1), "awaiting approval")
        .otherwise(F.col("status")))
    alerts = B.alert_views(spark, folder)
    keys = alerts.select(F.concat(F.lit("notification-alert-"), "id").alias("notification_id"), "backend_id").unionByName(
        incidents.select(F.concat(F.lit("notification-incident-"), "id").alias("notification_id"), "backend_id"))
    return alerts, incidents, keys.select("notification_id", (n % 3 == 0).alias("read"), (n % 7 == 0).alias("dismissed"))


NOTIFY = """
iw AS (SELECT * REPLACE (CASE WHEN status = 'open' AND backend_id % 5 = 0 THEN 'escalated' WHEN status = 'open' AND backend_id % 5 = 1 THEN 'awaiting approval' ELSE status END AS status) FROM iv),
nt AS (
  SELECT notification_id, type, record_id, title, detail, route, n % 3 = 0 AS read FROM (
    (SELECT 'notification-alert-' || id AS notification_id, 'alert' AS type, id AS record_id,
      CASE WHEN severity = 'critical' THEN 'Critical' ELSE 'Active' END || ' alert · ' || id AS title, title AS detail, 'alerts' AS route, backend_id AS n
    FROM av WHERE status IN ('new', 'triaging', 'investigating') ORDER BY created_at DESC, backend_id DESC LIMIT 4)
    UNION ALL
    SELECT 'notification-incident-' || id, 'incident', id, CASE status WHEN 'escalated' THEN 'Incident escalated' ELSE 'Approval required' END,
      id || ' · ' || title, 'incidents', backend_id FROM iw WHERE status IN ('escalated', 'awaiting approval'))
  WHERE n % 7 <> 0)"""


@query("f14_notifications", B.with_tables("iv", f"WITH {NOTIFY.strip()} SELECT * FROM nt"))
def _(spark, folder):
    return P.notifications(*_notification_inputs(spark, folder))


@query("f15_workspace_counts", B.with_tables("iv", f"""
WITH {NOTIFY.strip()} SELECT (SELECT count(*) FROM av WHERE {ACTIVE}) AS active_alerts, (SELECT count(*) FROM iw WHERE NOT {FINISHED}) AS open_incidents,
  (SELECT count(*) FROM nt WHERE NOT read) AS unread_notifications"""))
def _(spark, folder):
    alerts, incidents, state = _notification_inputs(spark, folder)
    return P.workspace_counts(alerts, incidents, P.notifications(alerts, incidents, state))


@query("f16_connectors", B.with_tables("ev", """
SELECT source AS name, count(*) AS events, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(DISTINCT CASE WHEN lower(source_ip) <> 'unknown' THEN source_ip END) AS ips, epoch_us(max(coalesce("timestamp", ingested_at))) AS latest_us
FROM ev GROUP BY source"""))
def _(spark, folder):
    return P.connectors(B.event_views(spark, folder))


@query("f17_parser_health", B.with_tables("ev", """
SELECT CAST(floor((count(*) - u) / count(*) * 1000 + 0.5) / 10 AS DOUBLE) AS recognized_pct, u AS unrecognized, any_value(f) AS failed FROM ev,
  (SELECT count(*) FILTER (WHERE event = 'security_event' OR status = 'unknown') AS u, count(*) FILTER (WHERE status = 'failed') AS f FROM ev) GROUP BY u"""))
def _(spark, folder):
    return P.parser_health(B.event_views(spark, folder))


@query("f18_queue_kpis", B.with_tables("iv nv", f"""
SELECT (SELECT count(*) FROM av WHERE status NOT IN ('contained', 'resolved')) AS alerts_active, (SELECT count(*) FROM av WHERE status = 'new') AS alerts_new,
  (SELECT count(*) FROM av WHERE severity = 'critical' AND status <> 'resolved') AS alerts_critical,
  (SELECT count(*) FROM av WHERE status IN ('triaging', 'investigating')) AS alerts_investigating,
  (SELECT count(*) FROM av WHERE status IN ('contained', 'resolved')) AS alerts_contained,
  (SELECT count(*) FROM iv WHERE status = 'open') AS incidents_open, (SELECT count(*) FROM iv WHERE NOT {FINISHED} AND priority = 'critical') AS incidents_critical,
  (SELECT count(*) FROM iv WHERE status = 'investigating') AS incidents_investigating, (SELECT count(*) FROM iv WHERE {FINISHED}) AS incidents_history,
  (SELECT count(*) FROM nv) AS notes_linked, (SELECT count(*) FROM conversations) AS note_versions"""))
def _(spark, folder):
    versions = B.table(spark, folder, "conversations").select(F.col("conv_id").alias("note_id"))
    return P.queue_kpis(B.alert_views(spark, folder), B.incident_views(spark, folder), B.note_views(spark, folder), versions)


@query("f19_coverage", B.with_tables("av", """
SELECT n AS active, greatest(n, 1) AS planned FROM (SELECT count(DISTINCT nullif(rule_id, '')) AS n FROM av)"""))
def _(spark, folder):
    return P.coverage(B.alert_views(spark, folder))


def _report(name: str, key: str, source: str, columns: list[str]) -> None:
    line = " || ',' || ".join(S.csv_guard(c) for c in columns)

    @query(key, B.with_tables("ev iv", f"SELECT {line} AS line FROM {source}"))
    def _(spark, folder):
        table, exported = P.reports(name, B.event_views(spark, folder), B.alert_views(spark, folder), B.incident_views(spark, folder))
        text = table.select(*[
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if dict(table.dtypes)[c] == "timestamp" else F.col(c) for c in exported])
        return sinks.csv_lines(text, exported)


_z = S.ts_z
_report("Daily SOC operations", "f20_report_events", "ev",
        ["id", _z('"timestamp"'), "source", "source_ip", '"user"', "event", "severity", "status", "risk", "rule"])
_report("Weekly incident summary", "f20_report_incidents", "iv",
        ["id", "title", "owner", "priority", "status", _z("updated"), _z("completed_at"), "completed_by", "summary"])
_ALERT_CELLS = ["id", "rule_id", "rule_name", "severity", "status", "source_ip", '"user"', _z("first_seen"), _z("last_seen"), "summary"]
_report("Detection coverage", "f20_report_coverage", "av", _ALERT_CELLS)
_report("Executive risk overview", "f20_report_risk", "av", _ALERT_CELLS)
