"""Registered queries over the stored tables and dashboard lists (D1-D32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvigil.functions import fixed_values as V
from logvigil.operators import alerts as A
from logvigil.operators import browse as W
from logvigil.operators import dashboard as P
from logvigil.operators import evidence as E
from logvigil.operators import store as T
from logvigil.plans import bindings as B
from logvigil.plans import snippets as S
from logvigil.plans.detection_queries import _CATALOG
from logvigil.plans.registry import CHECKS, query


@query("d01_latest_upload", B.with_tables("logs", "SELECT upload_id FROM logs ORDER BY ingested_at DESC, id DESC LIMIT 1"))
def _(spark, folder):
    return T.latest_upload(B.logs(spark, folder))


@query("d02_upload_batch", B.with_tables("logs alerts", """
SELECT upload_id, arg_min(source_filename, line_number) AS filename, arg_min(source_format, line_number) AS format,
  epoch_us(max(ingested_at)) AS uploaded_at, count(*) AS stored_entries,
  (SELECT count(*) FROM alerts WHERE upload_id = 'u0') AS stored_alerts FROM logs WHERE upload_id = 'u0' GROUP BY upload_id"""))
def _(spark, folder):
    return T.upload_batch(B.logs(spark, folder), B.alerts(spark, folder), "u0")[0]


@query("d02_upload_batch_logs", B.with_tables("logs", """
SELECT id, line_number, event_type, status, raw_message FROM logs WHERE upload_id = 'u0' ORDER BY line_number"""))
def _(spark, folder):
    batch = T.upload_batch(B.logs(spark, folder), B.alerts(spark, folder), "u0")[1]
    return batch.select("id", "line_number", "event_type", "status", "raw_message")


@query("d02_upload_batch_alerts", B.with_tables("alerts", """
SELECT id, rule, severity, epoch_us(created_at) AS created_at FROM alerts WHERE upload_id = 'u0' ORDER BY created_at, id"""))
def _(spark, folder):
    batch = T.upload_batch(B.logs(spark, folder), B.alerts(spark, folder), "u0")[2]
    return batch.select("id", "rule", "severity", "created_at")


_HISTORY = """
SELECT l.upload_id, source_filename AS filename, source_format AS format, epoch_us(max(ingested_at)) AS uploaded_at, count(*) AS stored_entries,
  coalesce(any_value(c.n), 0) AS stored_alerts
FROM logs l LEFT JOIN (SELECT upload_id, count(*) AS n FROM alerts GROUP BY upload_id) c ON c.upload_id = l.upload_id
WHERE {where} GROUP BY l.upload_id, source_filename, source_format
ORDER BY uploaded_at DESC, upload_id DESC, filename, format LIMIT 25 OFFSET {offset}"""


@query("d03_upload_history", B.with_tables("logs alerts", _HISTORY.format(where="true", offset=25)))
def _(spark, folder):
    return T.upload_history(B.logs(spark, folder), B.alerts(spark, folder), page=2)


@query("d03_upload_history_search", B.with_tables("logs alerts", _HISTORY.format(
    where="source_filename ILIKE '%SRC3.%' ESCAPE '\\' OR source_format ILIKE '%SRC3.%' ESCAPE '\\'", offset=0)))
def _(spark, folder):
    return T.upload_history(B.logs(spark, folder), B.alerts(spark, folder), query=" SRC3. ")


@query("d04_count_uploads", B.with_tables("logs", """
SELECT count(DISTINCT upload_id) AS total, greatest(1, CAST(ceil(count(DISTINCT upload_id) / 3.0) AS BIGINT)) AS page_count
FROM logs WHERE source_format ILIKE '%APACHE\\_%' ESCAPE '\\' OR source_filename ILIKE '%APACHE\\_%' ESCAPE '\\'"""))
def _(spark, folder):
    return T.count_uploads(B.logs(spark, folder), "APACHE_", page_size=3)


@query("d05_ilike_literal", "SELECT page_id, url FROM pages WHERE url ILIKE '%PAGE=2&%' ESCAPE '\\' OR html ILIKE '%100\\%%' ESCAPE '\\'")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    return pages.filter(T.contains_literal(F.col("url"), "PAGE=2&") | T.contains_literal(F.col("html"), "100%")).select("page_id", "url")


@query("d06_list_alerts", B.with_tables("alerts", """
SELECT id, rule, severity, status, epoch_us(created_at) AS created_at FROM alerts WHERE severity = 'HIGH' AND status = 'NEW'
ORDER BY created_at DESC, id DESC LIMIT 100"""))
def _(spark, folder):
    found = T.list_alerts(B.alerts(spark, folder), severity="high", status="new")
    return found.select("id", "rule", "severity", "status", "created_at")


@query("d07_list_incidents", B.with_tables("incidents", """
SELECT id, priority, status, assigned_user_id, epoch_us(created_at) AS created_at FROM incidents
WHERE status = 'OPEN' AND priority = 'CRITICAL' ORDER BY created_at DESC, id DESC LIMIT 200"""))
def _(spark, folder):
    found = T.list_incidents(B.incidents(spark, folder), status="open", priority="critical", limit=200)
    return found.select("id", "priority", "status", "assigned_user_id", "created_at")


@query("d07_list_incidents_of_user", B.with_tables("incidents", """
SELECT id, priority, status FROM incidents WHERE assigned_user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 100"""))
def _(spark, folder):
    return T.list_incidents(B.incidents(spark, folder), assigned_user_id=7).select("id", "priority", "status")


@query("d08_incident_notes", B.with_tables("notes", """
SELECT id, title, body, array_to_string(tags, ',') AS tags FROM notes WHERE incident_id = 5 ORDER BY created_at, id LIMIT 100"""))
def _(spark, folder):
    return T.incident_notes(B.notes(spark, folder), 5).select("id", "title", "body", "tags")


@query("d09_recent_notes", B.with_tables("notes", """
SELECT id, incident_id, epoch_us(updated_at) AS updated_at FROM notes ORDER BY notes.updated_at DESC, id DESC LIMIT 50"""))
def _(spark, folder):
    return T.recent_notes(B.notes(spark, folder), 50).select("id", "incident_id", "updated_at")


@query("d10_user_directory", B.with_tables("users roles", """
SELECT u.id, username, email, full_name, is_active, r.name AS role FROM users u LEFT JOIN roles r ON r.id = u.role_id"""))
def _(spark, folder):
    return T.user_directory(B.users(spark, folder), B.roles(spark, folder))


@query("d11_assignable_users", B.with_tables("users roles", """
SELECT u.id, username, full_name, r.name AS role FROM users u LEFT JOIN roles r ON r.id = u.role_id WHERE is_active"""))
def _(spark, folder):
    return T.assignable_users(B.users(spark, folder), B.roles(spark, folder))


@query("d12_active_admin_count", B.with_tables("users roles", """
SELECT count(*) AS active_admins FROM users u JOIN roles r ON r.id = u.role_id WHERE r.name = 'Admin' AND is_active"""))
def _(spark, folder):
    return T.active_admin_count(B.users(spark, folder), B.roles(spark, folder))


@query("d13_role_counts", B.with_tables("users roles", """
SELECT r.name AS role, count(*) AS users, count(*) FILTER (WHERE is_active) AS active_users
FROM users u LEFT JOIN roles r ON r.id = u.role_id GROUP BY r.name"""))
def _(spark, folder):
    return T.role_counts(B.users(spark, folder), B.roles(spark, folder))


@query("d13_roles_by_name", B.with_tables("roles", "SELECT id, name, description FROM roles"))
def _(spark, folder):
    return T.roles_by_name(B.roles(spark, folder))


@query("d14_get_by_id", B.with_tables("incidents", "SELECT id, title, status FROM incidents WHERE id = 42"))
def _(spark, folder):
    return T.get_by_id(B.incidents(spark, folder), 42).select("id", "title", "status")


@query("d15_log_view", B.with_tables("logs", f"""
SELECT id, upload_id, line_number, source_filename, source_format,
  CASE WHEN id % 3 = 0 AND event_timestamp IS NOT NULL THEN {S.ts_z('event_timestamp')}
    ELSE coalesce(strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', '') END AS "timestamp",
  epoch_us(ingested_at) AS ingested_at, coalesce(ip_address, '') AS ip, coalesce(username, '') AS username, event_type AS event, status,
  coalesce(severity, 'INFO') AS severity, raw_message FROM logs"""))
def _(spark, folder):
    parsed = F.when(F.col("id") % 3 == 0, F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return T.log_view(B.logs(spark, folder), parsed, all_digits=True)


# ---- evidence -----------------------------------------------------------------------------

@query("d16_evidence_join", B.with_tables("ev", """
SELECT id, log_id, source_alert_id, epoch_us("timestamp") AS "timestamp", epoch_us(ingested_at) AS ingested_at, source, source_ip, "user", event,
  severity, status, risk, rule, message FROM ev"""))
def _(spark, folder):
    return B.event_views(spark, folder).drop("upload_id", "line_number", "country_code", "country")


_TIMES = ["created_at", "observed_at", "first_seen", "last_seen"]


@query("d17_alert_view", B.with_tables("av", f"""
SELECT * REPLACE ({', '.join(f'epoch_us({t}) AS {t}' for t in _TIMES)}, array_to_string(evidence_ids, ',') AS evidence_ids) FROM av"""))
def _(spark, folder):
    return B.alert_views(spark, folder)


@query("d18_incident_view", B.with_tables("iv", """
SELECT * REPLACE (epoch_us(updated) AS updated, epoch_us(completed_at) AS completed_at, array_to_string(event_ids, ',') AS event_ids) FROM iv"""))
def _(spark, folder):
    return B.incident_views(spark, folder)


def _unsourced(df, key):
    """Views in which part of the records came without an alert id."""
    return df.withColumn("source_alert_id", F.when(F.col("backend_id") % key != 0, F.col("source_alert_id")))


MATCH = """
iu AS (SELECT * REPLACE (CASE WHEN backend_id % 4 <> 0 THEN source_alert_id END AS source_alert_id) FROM iv),
au AS (SELECT * REPLACE (CASE WHEN backend_id % 5 <> 0 THEN source_alert_id END AS source_alert_id) FROM av),
ie AS (SELECT backend_id, source_alert_id, unnest(event_ids) AS e FROM iu),
ae AS (SELECT backend_id, source_alert_id, unnest(evidence_ids) AS e FROM au),
matches AS (
  SELECT au.backend_id AS alert_id, iu.backend_id AS incident_id FROM au JOIN iu ON iu.source_alert_id = au.source_alert_id
  UNION
  SELECT ae.backend_id, ie.backend_id FROM ae JOIN ie ON ie.e = ae.e WHERE ae.source_alert_id IS NULL OR ie.source_alert_id IS NULL),
linked AS (SELECT au.backend_id AS alert_id, min(incident_id) AS incident_id FROM au LEFT JOIN matches m ON m.alert_id = au.backend_id GROUP BY ALL)"""


@query("d19_match_incident", B.with_tables("iv", f"WITH {MATCH.strip()} SELECT alert_id, incident_id FROM linked"))
def _(spark, folder):
    return E.match_incident(_unsourced(B.incident_views(spark, folder), 4), _unsourced(B.alert_views(spark, folder), 5))


@query("d20_unlinked_alerts", B.with_tables("iv", """
SELECT backend_id, title, status FROM av WHERE source_alert_id NOT IN (SELECT source_alert_id FROM iv)"""))
def _(spark, folder):
    found = E.unlinked_alerts(B.alert_views(spark, folder), B.incident_views(spark, folder))
    return found.select("backend_id", "title", "status")


@query("d21_quick_resolvable", B.with_tables("iv", f"""
WITH {MATCH.strip()}
SELECT au.backend_id, au.status FROM au JOIN linked l ON l.alert_id = au.backend_id LEFT JOIN iu ON iu.backend_id = l.incident_id
WHERE au.status NOT IN ('contained', 'resolved', 'closed', 'false positive') AND (iu.status IS NULL OR iu.status NOT IN ('resolved', 'false positive'))"""))
def _(spark, folder):
    found = E.quick_resolvable(_unsourced(B.alert_views(spark, folder), 5), _unsourced(B.incident_views(spark, folder), 4))
    return found.select("backend_id", "status")


@query("d22_event_linked_incident", B.with_tables("ev iv", """
SELECT ev.id, ev.log_id, least(a.i, m.i) AS incident_id FROM ev
LEFT JOIN (SELECT source_alert_id, min(backend_id) AS i FROM iv GROUP BY 1) a ON a.source_alert_id = ev.source_alert_id
LEFT JOIN (SELECT e, min(backend_id) AS i FROM (SELECT backend_id, unnest(event_ids) AS e FROM iv) GROUP BY 1) m ON m.e = ev.id"""))
def _(spark, folder):
    return E.event_linked_incident(B.event_views(spark, folder), B.incident_views(spark, folder))


@query("d23_selected_rules", B.with_tables("ev iv", f"""
SELECT DISTINCT i.backend_id AS incident_id, c.id AS rule_id, c.name, c.severity
FROM (SELECT backend_id, unnest(event_ids) AS e FROM iv) i JOIN ev ON ev.id = i.e JOIN {_CATALOG} ON c.id = ev.rule"""))
def _(spark, folder):
    return E.selected_rules(B.incident_views(spark, folder), B.event_views(spark, folder), A.rule_catalog(spark))


@query("d24_linked_record_available", B.with_tables("ev iv nv", """
WITH links AS (
  SELECT backend_id, ['incident', 'alert', 'event', 'workspace'][1 + backend_id % 4] AS linked_type,
    CASE backend_id % 4 WHEN 0 THEN linked_id WHEN 1 THEN 'ALT-' || (backend_id * 9) WHEN 2 THEN 'EVT-' || (backend_id * 3) ELSE 'SOC-DAY' END AS linked_id FROM nv)
SELECT l.backend_id, l.linked_type, l.linked_id, CASE linked_type WHEN 'incident' THEN linked_id IN (SELECT id FROM iv)
  WHEN 'alert' THEN linked_id IN (SELECT id FROM av) WHEN 'event' THEN linked_id IN (SELECT id FROM ev) ELSE true END AS available FROM links l"""))
def _(spark, folder):
    n = F.col("backend_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("incident", "alert", "event", "workspace")]), (n % 4 + 1).cast("int"))
    number = lambda prefix, times: F.concat(F.lit(prefix), (n * times).cast("string"))
    target = F.when(n % 4 == 0, F.col("linked_id")).when(n % 4 == 1, number("ALT-", 9)).when(n % 4 == 2, number("EVT-", 3)).otherwise("SOC-DAY")
    notes = B.note_views(spark, folder).select("backend_id", kind.alias("linked_type"), target.alias("linked_id"))
    return E.linked_record_available(notes, B.incident_views(spark, folder), B.alert_views(spark, folder), B.event_views(spark, folder)).select(
        "backend_id", "linked_type", "linked_id", "available")


# ---- lists --------------------------------------------------------------------------------

def _haystack(kind: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), '')" for c in W.SEARCH_COLUMNS[kind]) + ")"


def _search(name, tables, kind, needle, build, columns, condition="true", source=None, **wanted):
    listed = ", ".join(f'"{c}"' for c in columns)

    @query(name, B.with_tables(tables, f"SELECT {listed} FROM {source or tables.split()[-1]} WHERE contains({_haystack(kind)}, '{needle.lower()}') AND {condition}"))
    def _(spark, folder):
        return W.search(build(spark, folder), W.SEARCH_COLUMNS[kind], needle, **wanted).select(*columns)


_search("d25_search_events", "ev", "events", "10.0.", B.event_views, ["id", "source_ip"], "status = 'failed' AND severity = 'high'",
        status="failed", severity="high")
_search("d25_search_alerts", "av", "alerts", "SPRAYING", B.alert_views, ["id", "rule_id"], "severity = 'critical'", severity="critical")
_search("d25_search_alert_picker", "av", "alert_picker", "user7 ", B.alert_views, ["id", "user"])
_search("d25_search_incidents", "iv", "incidents", "customer 12", B.incident_views, ["id", "owner"], "priority = 'high' AND status = 'open'",
        priority="high", status="open")
_search("d25_search_history", "iv", "incident_history", "user 1", lambda s, f: W.incident_history(B.incident_views(s, f)), ["id", "owner"],
        "status IN ('resolved', 'false positive')")
_search("d25_search_notes", "nv", "notes", "turn1", B.note_views, ["id", "author"], "NOT archived AND list_contains(tags, 'user')", archived=False, tags="user")
_search("d25_search_users", "users roles", "users", "C77", lambda s, f: T.user_directory(B.users(s, f), B.roles(s, f)), ["id", "username"],
        source="(SELECT u.*, r.name AS role FROM users u LEFT JOIN roles r ON r.id = u.role_id)")
_RULE_ACTIVITY = (f"(SELECT c.id, c.engine_key, c.name, c.technique, c.criteria, any_value(d.description) AS description, count(a.id) AS total "
                  f"FROM {_CATALOG} JOIN (VALUES " + ", ".join(f"({S._s(r[0])}, {S._s(r[3])})" for r in V.RULE_CATALOG)
                  + ") AS d(id, description) ON d.id = c.id LEFT JOIN alerts a ON a.rule = c.engine_key GROUP BY ALL)")
_search("d25_search_rules", "alerts", "rules", "Source IP within", lambda s, f: A.rule_catalog(s).join(
    B.alerts(s, f).groupBy(F.col("rule").alias("engine_key")).agg(F.count(F.lit(1)).alias("total")), "engine_key", "left").na.fill(0, ["total"]),
    ["id", "total"], source=_RULE_ACTIVITY)
_search("d25_search_connectors", "ev", "connectors", "SRC2", lambda s, f: P.connectors(B.event_views(s, f)), ["name", "events"],
        source="(SELECT source AS name, count(*) AS events FROM ev GROUP BY 1)")


@query("d26_facets", B.with_tables("ev", "SELECT DISTINCT source AS value FROM ev WHERE source <> ''"))
def _(spark, folder):
    return W.facets(B.event_views(spark, folder), "source")


@query("d26_facets_tags", B.with_tables("nv", "SELECT DISTINCT value FROM (SELECT unnest(tags) AS value FROM nv)"))
def _(spark, folder):
    return W.facets(B.note_views(spark, folder), "tags")


@query("d27_paginate", B.with_tables("av", """
SELECT id, 3 AS page, CAST(ceil(n / 50.0) AS BIGINT) AS page_count, 101 AS first, 150 AS last, n AS total
FROM (SELECT *, count(*) OVER () AS n FROM av) ORDER BY created_at DESC, backend_id LIMIT 50 OFFSET 100"""))
def _(spark, folder):
    page = W.paginate(B.alert_views(spark, folder), [F.desc("created_at"), "backend_id"], page=3, page_size=50)
    return page.items.select("id", *[F.lit(v).cast("bigint").alias(n) for n, v in (
        ("page", page.page), ("page_count", page.page_count), ("first", page.start), ("last", page.end), ("total", page.total))])


@query("d28_incident_history", B.with_tables("iv", """
SELECT backend_id, status, epoch_us(completed_at) AS completed_at FROM iv WHERE status IN ('resolved', 'false positive')"""))
def _(spark, folder):
    return W.incident_history(B.incident_views(spark, folder)).select("backend_id", "status", "completed_at")


@query("d29_notes_order", B.with_tables("nv", """
SELECT id, pinned, epoch_us(updated_at) AS updated_at FROM nv ORDER BY pinned DESC, nv.updated_at DESC, id"""))
def _(spark, folder):
    return W.notes_order(B.note_views(spark, folder)).select("id", "pinned", "updated_at")


@query("d30_recent_failed", B.with_tables("ev", """
SELECT id, source_ip FROM ev WHERE status = 'failed' ORDER BY "timestamp" DESC NULLS LAST, log_id LIMIT 5"""))
def _(spark, folder):
    return W.recent_failed(B.event_views(spark, folder)).select("id", "source_ip")


@query("d31_risk_ranked_alerts", B.with_tables("av", "SELECT backend_id, risk, rule_id FROM av ORDER BY risk DESC, backend_id"))
def _(spark, folder):
    return W.risk_ranked_alerts(B.alert_views(spark, folder)).select("backend_id", "risk", "rule_id")


@query("d32_next_sequential_id", B.with_tables("iv", """
SELECT 'INC-' || (greatest(coalesce(max(CAST(substr(id, 5) AS BIGINT)) FILTER (WHERE backend_id % 10 <> 0), 999), 999) + 1) AS next_id FROM iv"""))
def _(spark, folder):
    ids = B.incident_views(spark, folder).withColumn(
        "id", F.when(F.col("backend_id") % 10 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    return W.next_sequential_id(ids, "INC-", 1000, 4)


# ---- alerts whose lines are runs, and pages by their last key ------------------------------

@query("d16b_evidence_by_runs", CHECKS["d16_evidence_join"])
def _(spark, folder):
    alerts = B.alerts(spark, folder)
    runs = E.alert_runs(alerts)
    events = E.evidence_join(B.logs(spark, folder), alerts.drop("matched_line_numbers"), runs)
    return events.drop("upload_id", "line_number", "country_code", "country")


@query("d17b_alert_view_by_runs", CHECKS["d17_alert_view"])
def _(spark, folder):
    alerts = B.alerts(spark, folder)
    return E.alert_view(alerts.drop("matched_line_numbers"), B.logs(spark, folder), E.alert_runs(alerts))


@query("d03b_upload_history_by_key", CHECKS["d03_upload_history"])
def _(spark, folder):
    """Page two, found by the last key of page one."""
    found = W.pages(T.uploads(B.logs(spark, folder), B.alerts(spark, folder)), T.UPLOAD_ORDER, 25)
    next(found)
    return next(found)


@query("d27b_page_by_key", B.with_tables("av", """
SELECT id, source_ip, severity FROM av ORDER BY created_at DESC, backend_id LIMIT 50 OFFSET 100"""))
def _(spark, folder):
    """Page three of d27, by the last keys of pages one and two; nothing is counted."""
    found = W.pages(B.alert_views(spark, folder), [("created_at", True), ("backend_id", False)], 50)
    next(found), next(found)
    return next(found).select("id", "source_ip", "severity")
