"""Registered queries for the triage jobs (E1-E8). Change requests are derived from events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvigil.operators import triage as R
from logvigil.plans import bindings as B
from logvigil.plans.registry import query

NOW_SQL = "TIMESTAMP '2024-01-31'"


def now():
    return F.timestamp_micros(F.lit(B.NOW_US))


# ---- E1 -----------------------------------------------------------------------------------

def _promotion(spark, folder):
    n = F.col("event_id")
    requests = B.table(spark, folder, "events").select(
        n.alias("request_id"), F.when(n % 19 == 0, n + 1_000_000_000).otherwise(n - n % 4 + 1).alias("alert_id"),
        F.when(n % 13 == 0, -1).otherwise(F.col("user_id")).alias("created_by_user_id"),
        F.when(n % 8 == 1, 99_999_999).when(n % 3 != 0, F.col("user_id") + 1).cast("bigint").alias("assigned_user_id"),
        F.when(n % 2 == 0, F.concat(F.lit("Request "), n.cast("string"))).alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(n % 5 == 0, "critical").alias("priority"))
    return R.promote_alerts(B.alerts(spark, folder), B.incidents(spark, folder), B.users(spark, folder), requests, now())


_PROMOTE = """
WITH rq AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 19 = 0 THEN event_id + 1000000000 ELSE event_id - event_id % 4 + 1 END AS alert_id,
    CASE WHEN event_id % 13 = 0 THEN -1 ELSE user_id END AS creator,
    CASE WHEN event_id % 8 = 1 THEN 99999999 WHEN event_id % 3 <> 0 THEN user_id + 1 END AS assignee,
    CASE WHEN event_id % 2 = 0 THEN 'Request ' || event_id END AS title, CASE WHEN event_id % 5 = 0 THEN 'CRITICAL' END AS priority FROM events),
known AS (
  SELECT rq.*, a.id IS NULL AS no_alert, rq.alert_id IN (SELECT source_alert_id FROM incidents) AS had,
    (assignee IS NOT NULL AND assignee NOT IN (SELECT id FROM users)) OR creator NOT IN (SELECT id FROM users) AS no_user,
    a.title AS alert_title, a.description AS alert_description, a.severity AS alert_severity
  FROM rq LEFT JOIN alerts a ON a.id = rq.alert_id),
judged AS (
  SELECT *, CASE WHEN no_alert THEN 'ALERT_NOT_FOUND'
    WHEN had OR coalesce(sum(CASE WHEN NOT no_alert AND NOT had AND NOT no_user THEN 1 ELSE 0 END) OVER (PARTITION BY alert_id ORDER BY request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'INCIDENT_EXISTS'
    WHEN no_user THEN 'USER_NOT_FOUND' END AS reason FROM known)
"""


@query("e01_promote_created", B.with_tables("incidents users", _PROMOTE + """
SELECT (SELECT max(id) FROM incidents) + row_number() OVER (ORDER BY request_id) AS id, alert_id AS source_alert_id, assignee AS assigned_user_id,
  creator AS created_by_user_id, coalesce(title, alert_title) AS title, alert_description AS description, coalesce(priority, alert_severity) AS priority,
  'OPEN' AS status, 1706659200000000 AS opened_at FROM judged WHERE reason IS NULL"""))
def _(spark, folder):
    return _promotion(spark, folder).created.select(
        "id", "source_alert_id", "assigned_user_id", "created_by_user_id", "title", "description", "priority", "status", "opened_at")


@query("e01_promote_alerts", B.with_tables("incidents users", _PROMOTE + """
SELECT id, CASE WHEN id IN (SELECT alert_id FROM judged WHERE reason IS NULL) THEN 'ESCALATED' ELSE status END AS status FROM alerts"""))
def _(spark, folder):
    return _promotion(spark, folder).alerts.select("id", "status")


@query("e01_promote_rejected", B.with_tables("incidents users", _PROMOTE + """
SELECT request_id, alert_id, reason FROM judged WHERE reason IS NOT NULL"""))
def _(spark, folder):
    return _promotion(spark, folder).rejected


# ---- E2 -----------------------------------------------------------------------------------

def _incident_changes(spark, folder):
    n = F.col("event_id")
    statuses = F.array(*[F.lit(s) for s in ("RESOLVED", "false_positive", "open", "INVESTIGATING", "BAD")])
    changes = B.table(spark, folder, "events").select(
        n.alias("change_id"), F.when(n % 23 == 0, n + 1_000_000_000).otherwise(F.floor(n / 3) + 1).alias("incident_id"),
        F.when(n % 6 == 0, F.concat(F.lit("Title "), n.cast("string"))).alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(n % 7 == 0, "low").alias("priority"),
        F.when(n % 4 != 0, F.element_at(statuses, (F.col("user_id") % 5 + 1).cast("int"))).alias("status"),
        (n % 5 == 0).alias("set_assignee"), F.when(n % 10 == 0, F.col("user_id") + F.when(n % 30 == 0, 99_999_999).otherwise(0)).alias("assigned_user_id"),
        F.when(n % 11 == 0, -5).when(n % 2 == 0, F.col("user_id")).cast("bigint").alias("updated_by_user_id"))
    return R.apply_incident_changes(B.incidents(spark, folder), changes, B.users(spark, folder), now())


# The changes are replayed one after the other: step k applies the k-th accepted change of each incident.
_CHANGES = """
WITH ch AS (
  SELECT event_id AS change_id, CASE WHEN event_id % 23 = 0 THEN event_id + 1000000000 ELSE event_id // 3 + 1 END AS incident_id,
    CASE WHEN event_id % 6 = 0 THEN 'Title ' || event_id END AS title, CASE WHEN event_id % 7 = 0 THEN 'LOW' END AS priority,
    CASE WHEN event_id % 4 <> 0 THEN ['RESOLVED', 'FALSE_POSITIVE', 'OPEN', 'INVESTIGATING', 'BAD'][1 + user_id % 5] END AS status,
    event_id % 5 = 0 AS set_assignee, CASE WHEN event_id % 10 = 0 THEN user_id + CASE WHEN event_id % 30 = 0 THEN 99999999 ELSE 0 END END AS assignee,
    CASE WHEN event_id % 11 = 0 THEN -5 WHEN event_id % 2 = 0 THEN user_id END AS updater FROM events),
judged AS (
  SELECT *, CASE WHEN title IS NULL AND priority IS NULL AND status IS NULL AND NOT set_assignee THEN 'EMPTY_CHANGE' WHEN status = 'BAD' THEN 'INVALID_VALUE'
    WHEN incident_id NOT IN (SELECT id FROM incidents) THEN 'INCIDENT_NOT_FOUND'
    WHEN set_assignee AND assignee IS NOT NULL AND assignee NOT IN (SELECT id FROM users) THEN 'USER_NOT_FOUND'
    WHEN updater IS NOT NULL AND updater NOT IN (SELECT id FROM users) THEN 'USER_NOT_FOUND' END AS reason FROM ch),
steps AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY change_id) AS k FROM judged WHERE reason IS NULL)
"""


def _step(source: str, k: int) -> str:
    return f"""(SELECT i.id, coalesce(s.title, i.title) AS title, coalesce(s.priority, i.priority) AS priority, coalesce(s.status, i.status) AS status,
      CASE WHEN s.set_assignee THEN s.assignee ELSE i.assigned_user_id END AS assigned_user_id, coalesce(s.updater, i.updated_by_user_id) AS updated_by_user_id,
      CASE s.status WHEN 'RESOLVED' THEN {NOW_SQL} WHEN 'FALSE_POSITIVE' THEN coalesce(i.resolved_at, {NOW_SQL}) WHEN 'OPEN' THEN NULL WHEN 'INVESTIGATING' THEN NULL ELSE i.resolved_at END AS resolved_at,
      CASE s.status WHEN 'FALSE_POSITIVE' THEN {NOW_SQL} WHEN 'RESOLVED' THEN NULL WHEN 'OPEN' THEN NULL WHEN 'INVESTIGATING' THEN NULL ELSE i.closed_at END AS closed_at,
      CASE WHEN s.k IS NOT NULL THEN {NOW_SQL} ELSE i.updated_at END AS updated_at
    FROM {source} i LEFT JOIN steps s ON s.incident_id = i.id AND s.k = {k})"""


@query("e02_apply_incident_changes", B.with_tables("incidents users", _CHANGES + f"""
SELECT id, title, priority, status, assigned_user_id, updated_by_user_id, epoch_us(resolved_at) AS resolved_at, epoch_us(closed_at) AS closed_at,
  epoch_us(updated_at) AS updated_at FROM {_step(_step(_step('incidents', 1), 2), 3)}"""))
def _(spark, folder):
    return _incident_changes(spark, folder).table.select(
        "id", "title", "priority", "status", "assigned_user_id", "updated_by_user_id", "resolved_at", "closed_at", "updated_at")


@query("e02_incident_changes_rejected", B.with_tables("incidents users", _CHANGES + "SELECT change_id, incident_id, reason FROM judged WHERE reason IS NOT NULL"))
def _(spark, folder):
    return _incident_changes(spark, folder).rejected


# ---- E3 -----------------------------------------------------------------------------------

def _alert_changes(spark, folder):
    n = F.col("event_id")
    changes = B.table(spark, folder, "events").select(
        n.alias("change_id"), F.when(n % 29 == 0, -n).otherwise(F.floor(n / 2) + 1).alias("alert_id"),
        F.when(n % 3 == 0, F.when(n % 15 == 0, "severe").otherwise("high")).alias("severity"),
        F.when(n % 4 == 0, F.when(n % 8 == 0, "closed").otherwise("Reviewing")).alias("status"))
    return R.apply_alert_changes(B.alerts(spark, folder), changes, now())


_ALERT_CHANGES = """
WITH ch AS (
  SELECT event_id AS change_id, CASE WHEN event_id % 29 = 0 THEN -event_id ELSE event_id // 2 + 1 END AS alert_id,
    CASE WHEN event_id % 15 = 0 THEN 'SEVERE' WHEN event_id % 3 = 0 THEN 'HIGH' END AS severity,
    CASE WHEN event_id % 8 = 0 THEN 'CLOSED' WHEN event_id % 4 = 0 THEN 'REVIEWING' END AS status FROM events),
judged AS (SELECT *, CASE WHEN severity IS NULL AND status IS NULL THEN 'EMPTY_CHANGE' WHEN severity = 'SEVERE' THEN 'INVALID_VALUE'
  WHEN alert_id NOT IN (SELECT id FROM alerts) THEN 'ALERT_NOT_FOUND' END AS reason FROM ch),
last AS (SELECT alert_id, arg_max(severity, change_id) FILTER (WHERE severity IS NOT NULL) AS severity, arg_max(status, change_id) FILTER (WHERE status IS NOT NULL) AS status
  FROM judged WHERE reason IS NULL GROUP BY alert_id)
"""


@query("e03_apply_alert_changes", B.with_tables("alerts", _ALERT_CHANGES + f"""
SELECT id, coalesce(l.severity, a.severity) AS severity, coalesce(l.status, a.status) AS status,
  epoch_us(CASE WHEN l.alert_id IS NULL THEN updated_at ELSE {NOW_SQL} END) AS updated_at FROM alerts a LEFT JOIN last l ON l.alert_id = a.id"""))
def _(spark, folder):
    return _alert_changes(spark, folder).table.select("id", "severity", "status", "updated_at")


@query("e03_alert_changes_rejected", B.with_tables("alerts", _ALERT_CHANGES + "SELECT change_id, alert_id, reason FROM judged WHERE reason IS NOT NULL"))
def _(spark, folder):
    return _alert_changes(spark, folder).rejected


# ---- E4, E5 -------------------------------------------------------------------------------

def _new_notes(spark, folder):
    conv, turn = F.col("conv_id"), F.col("turn")
    existing = B.notes(spark, folder).filter((F.col("id") - 1) % 100 < (F.col("incident_id") - 1) % 4)
    requests = B.table(spark, folder, "conversations").filter(turn >= conv % 4).select(
        (conv * 100 + turn).alias("request_id"), F.when(conv % 17 == 0, conv + 1_000_000_000).otherwise(conv - conv % 2 + 1).alias("incident_id"),
        F.when(turn % 5 == 3, -1).otherwise(conv % 50).alias("author_user_id"), F.concat(F.lit("  "), "role").alias("title"),
        F.when((turn == 6) & (conv % 3 == 0), "   ").otherwise(F.col("text")).alias("body"),
        F.array(F.upper("role"), F.col("role")).alias("tags"))
    return R.admit_notes(existing, B.incidents(spark, folder), B.users(spark, folder), requests)


# Requests are taken one by one per incident, counting what has been admitted so far.
_NEW_NOTES = """
WITH existing AS (SELECT incident_id, count(*) AS n FROM notes WHERE (id - 1) % 100 < (incident_id - 1) % 4 GROUP BY 1),
rq AS (
  SELECT conv_id * 100 + turn AS request_id, CASE WHEN conv_id % 17 = 0 THEN conv_id + 1000000000 ELSE conv_id - conv_id % 2 + 1 END AS incident_id,
    CASE WHEN turn % 5 = 3 THEN -1 ELSE conv_id % 50 END AS author_user_id, role AS title, CASE WHEN turn = 6 AND conv_id % 3 = 0 THEN '' ELSE text END AS body
  FROM conversations WHERE turn >= conv_id % 4),
seq AS (
  SELECT rq.*, row_number() OVER (PARTITION BY rq.incident_id ORDER BY request_id) AS k, coalesce(n, 0) AS n,
    CASE WHEN length(body) > 5000 OR trim(body) = '' THEN 'INVALID_VALUE' WHEN rq.incident_id NOT IN (SELECT id FROM incidents) THEN 'INCIDENT_NOT_FOUND' END AS early,
    author_user_id NOT IN (SELECT id FROM users) AS no_user
  FROM rq LEFT JOIN existing e ON e.incident_id = rq.incident_id),
walk AS (
  SELECT incident_id, request_id, k, n AS held, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT incident_id, CAST(NULL AS BIGINT) AS request_id, 0 AS k, n FROM seq)
  UNION ALL
  SELECT s.incident_id, s.request_id, s.k, CASE WHEN s.early IS NULL AND w.held < 5 AND NOT s.no_user THEN w.held + 1 ELSE w.held END,
    CASE WHEN s.early IS NOT NULL THEN s.early WHEN w.held >= 5 THEN 'NOTE_LIMIT' WHEN s.no_user THEN 'USER_NOT_FOUND' END
  FROM walk w JOIN seq s ON s.incident_id = w.incident_id AND s.k = w.k + 1)
"""


@query("e04_admit_notes", B.with_tables("incidents users notes", _NEW_NOTES + """
SELECT rq.request_id, rq.incident_id, rq.author_user_id, rq.title, trim(rq.body, ' ' || chr(10)) AS body, lower(rq.title) AS tags
FROM walk w JOIN rq ON rq.request_id = w.request_id WHERE reason IS NULL""", recursive=True))
def _(spark, folder):
    return _new_notes(spark, folder).table


@query("e04_notes_rejected", B.with_tables("incidents users notes", _NEW_NOTES + """
SELECT request_id, incident_id, reason FROM walk WHERE reason IS NOT NULL""", recursive=True))
def _(spark, folder):
    return _new_notes(spark, folder).rejected


def _note_changes(spark, folder):
    n = F.col("conv_id") * 100 + F.col("turn") + 1
    turn = F.col("turn")
    changes = B.table(spark, folder, "conversations").select(
        n.alias("change_id"), F.when(n % 31 == 0, -n).otherwise(n - turn % 2).alias("note_id"),
        F.when(turn % 3 == 0, F.concat(F.lit(" New "), n.cast("string"))).alias("title"), F.lit(None).cast("string").alias("body"),
        F.when(turn % 4 == 1, F.array(F.lit(" Urgent"), F.lit("urgent"))).alias("tags"), F.when(turn == 2, True).alias("pinned"),
        F.lit(None).cast("boolean").alias("archived"))
    return R.apply_note_changes(B.notes(spark, folder), changes, now())


_NOTE_CHANGES = """
WITH ch AS (
  SELECT n AS change_id, CASE WHEN n % 31 = 0 THEN -n ELSE n - turn % 2 END AS note_id, CASE WHEN turn % 3 = 0 THEN 'New ' || n END AS title,
    CASE WHEN turn % 4 = 1 THEN 'urgent' END AS tags, CASE WHEN turn = 2 THEN true END AS pinned FROM (SELECT *, conv_id * 100 + turn + 1 AS n FROM conversations)),
judged AS (SELECT *, CASE WHEN title IS NULL AND tags IS NULL AND pinned IS NULL THEN 'EMPTY_CHANGE' WHEN note_id NOT IN (SELECT id FROM notes) THEN 'NOTE_NOT_FOUND' END AS reason FROM ch),
last AS (SELECT note_id, arg_max(title, change_id) FILTER (WHERE title IS NOT NULL) AS title, max(tags) AS tags, max(pinned) AS pinned FROM judged WHERE reason IS NULL GROUP BY note_id)
"""


@query("e05_apply_note_changes", B.with_tables("notes", _NOTE_CHANGES + f"""
SELECT id, coalesce(l.title, n.title) AS title, coalesce(l.tags, array_to_string(n.tags, ',')) AS tags, coalesce(l.pinned, n.pinned) AS pinned,
  epoch_us(CASE WHEN l.note_id IS NULL THEN updated_at ELSE {NOW_SQL} END) AS updated_at FROM notes n LEFT JOIN last l ON l.note_id = n.id"""))
def _(spark, folder):
    return _note_changes(spark, folder).table.select("id", "title", "tags", "pinned", "updated_at")


@query("e05_note_changes_rejected", B.with_tables("notes", _NOTE_CHANGES + "SELECT change_id, note_id, reason FROM judged WHERE reason IS NOT NULL"))
def _(spark, folder):
    return _note_changes(spark, folder).rejected


@query("e05_delete_notes", B.with_tables("notes", "SELECT id, incident_id FROM notes WHERE id % 5 <> 0"))
def _(spark, folder):
    notes = B.notes(spark, folder)
    wanted = notes.filter(F.col("id") % 5 == 0).select(F.col("id").alias("note_id"))
    return R.delete_notes(notes, wanted).table.select("id", "incident_id")


@query("e05_delete_rejected", B.with_tables("notes", """
SELECT DISTINCT w.note_id, 'NOTE_NOT_FOUND' AS reason FROM (SELECT id * 3 + 1 AS note_id FROM notes) w WHERE w.note_id NOT IN (SELECT id FROM notes)"""))
def _(spark, folder):
    notes = B.notes(spark, folder)
    return R.delete_notes(notes, notes.select((F.col("id") * 3 + 1).alias("note_id"))).rejected


# ---- E6-E8 --------------------------------------------------------------------------------

def _older_incidents(spark, folder):
    return B.incidents(spark, folder).withColumns({
        "status": F.when((F.col("status") == "FALSE_POSITIVE") & (F.col("id") % 2 == 0), "CLOSED").otherwise(F.col("status")),
        "resolved_at": F.when(F.col("id") % 3 != 0, F.col("resolved_at")),
    })


@query("e06_backfill_closed", B.with_tables("incidents", """
SELECT id, CASE WHEN old = 'CLOSED' THEN 'RESOLVED' ELSE old END AS status, CASE WHEN old = 'FALSE_POSITIVE' THEN 'CLOSED' WHEN old = 'CLOSED' THEN 'RESOLVED' ELSE old END AS reverted,
  epoch_us(CASE WHEN old = 'CLOSED' THEN coalesce(r, closed_at, updated_at) ELSE r END) AS resolved_at
FROM (SELECT *, CASE WHEN status = 'FALSE_POSITIVE' AND id % 2 = 0 THEN 'CLOSED' ELSE status END AS old, CASE WHEN id % 3 <> 0 THEN resolved_at END AS r FROM incidents)"""))
def _(spark, folder):
    after = R.backfill_closed(_older_incidents(spark, folder))
    reverted = R.revert_backfill(after.withColumn("kept", F.col("status")))
    return reverted.select("id", F.col("kept").alias("status"), F.col("status").alias("reverted"), "resolved_at")


@query("e07_check_constraints", B.with_tables("logs incidents notes users", """
WITH bad_alerts AS (SELECT * REPLACE (CASE WHEN id % 101 = 0 THEN 'SEVERE' ELSE severity END AS severity, CASE WHEN id % 103 = 0 THEN NULL ELSE status END AS status) FROM alerts WHERE id % 999 <> 0),
bad_incidents AS (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 'CLOSED' ELSE status END AS status, CASE WHEN id % 70 = 0 THEN 3 ELSE source_alert_id END AS source_alert_id,
  CASE WHEN id % 90 = 0 THEN -1 ELSE assigned_user_id END AS assigned_user_id, CASE WHEN id % 80 = 0 THEN repeat('x', 151) ELSE title END AS title) FROM incidents),
bad_notes AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN ' ' ELSE body END AS body, CASE WHEN id % 17 = 0 THEN -2 ELSE author_user_id END AS author_user_id) FROM notes),
bad_logs AS (SELECT upload_id, CASE WHEN line_number % 400 = 0 THEN 1 ELSE line_number END AS line_number FROM logs)
SELECT 'alerts' AS table_name, 'severity' AS "constraint", CAST(id AS VARCHAR) AS key FROM bad_alerts WHERE severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
UNION ALL SELECT 'alerts', 'status', CAST(id AS VARCHAR) FROM bad_alerts WHERE status IS NULL
UNION ALL SELECT 'incidents', 'status', CAST(id AS VARCHAR) FROM bad_incidents WHERE status NOT IN ('OPEN', 'INVESTIGATING', 'RESOLVED', 'FALSE_POSITIVE')
UNION ALL SELECT 'incidents', 'title_length', CAST(id AS VARCHAR) FROM bad_incidents WHERE length(title) > 150
UNION ALL SELECT 'notes', 'body_not_blank', CAST(id AS VARCHAR) FROM bad_notes WHERE trim(body) = ''
UNION ALL SELECT 'notes', 'body_length', CAST(id AS VARCHAR) FROM bad_notes WHERE length(body) > 5000
UNION ALL SELECT 'logs', 'unique_upload_line', upload_id || '/' || line_number FROM bad_logs GROUP BY upload_id, line_number HAVING count(*) > 1
UNION ALL SELECT 'incidents', 'unique_source_alert', CAST(source_alert_id AS VARCHAR) FROM bad_incidents GROUP BY source_alert_id HAVING count(*) > 1
UNION ALL SELECT 'incidents', 'fk_source_alert_id', CAST(id AS VARCHAR) FROM bad_incidents WHERE source_alert_id NOT IN (SELECT id FROM bad_alerts)
UNION ALL SELECT 'incidents', 'fk_assigned_user_id', CAST(id AS VARCHAR) FROM bad_incidents WHERE assigned_user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'notes', 'fk_incident_id', CAST(id AS VARCHAR) FROM bad_notes WHERE incident_id NOT IN (SELECT id FROM bad_incidents)
UNION ALL SELECT 'notes', 'fk_author_user_id', CAST(id AS VARCHAR) FROM bad_notes WHERE author_user_id NOT IN (SELECT id FROM users)"""))
def _(spark, folder):
    n = F.col("id")
    spoil = lambda every, value, column: F.when(n % every == 0, value).otherwise(F.col(column))
    alerts = B.alerts(spark, folder).filter(n % 999 != 0).withColumns(
        {"severity": spoil(101, "SEVERE", "severity"), "status": spoil(103, F.lit(None), "status")})
    incidents = B.incidents(spark, folder).withColumns({
        "status": spoil(50, "CLOSED", "status"), "source_alert_id": spoil(70, 3, "source_alert_id"),
        "assigned_user_id": spoil(90, -1, "assigned_user_id"), "title": spoil(80, F.repeat(F.lit("x"), 151), "title")})
    notes = B.notes(spark, folder).withColumns({"body": spoil(13, " ", "body"), "author_user_id": spoil(17, -2, "author_user_id")})
    logs = B.logs(spark, folder).withColumn("line_number", F.when(F.col("line_number") % 400 == 0, 1).otherwise(F.col("line_number")))
    return R.check_constraints(logs, alerts, incidents, notes, B.users(spark, folder))


@query("e07_accounts_and_lengths", B.with_tables("logs incidents notes users roles", """
WITH bad_logs AS (SELECT id, CASE WHEN id % 211 = 0 THEN repeat('u', 101) ELSE username END AS username, CASE WHEN id % 223 = 0 THEN repeat('e', 101) ELSE event_type END AS event_type,
  CASE WHEN id % 211 = 0 THEN repeat('f', 256) ELSE source_filename END AS source_filename FROM logs),
bad_alerts AS (SELECT id, CASE WHEN id % 101 = 0 THEN repeat('x', 151) ELSE title END AS title, CASE WHEN id % 101 = 0 THEN repeat('s', 21) ELSE severity END AS severity FROM alerts),
bad_notes AS (SELECT id, id % 19 = 0 AS seven, id % 23 = 0 AND id % 19 <> 0 AS wide FROM notes),
bad_users AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'same' WHEN id % 90 = 1 THEN repeat('u', 51) || id ELSE username END AS username,
  CASE WHEN id % 60 = 0 THEN 'one@example.com' ELSE email END AS email, CASE WHEN id % 70 = 0 THEN 99 ELSE role_id END AS role_id FROM users),
bad_roles AS (SELECT id, CASE WHEN id = 2 THEN 'Admin' WHEN id = 3 THEN repeat('r', 51) ELSE name END AS name FROM roles)
SELECT 'logs' AS table_name, 'username_length' AS "constraint", CAST(id AS VARCHAR) AS key FROM bad_logs WHERE length(username) > 100
UNION ALL SELECT 'logs', 'event_type_length', CAST(id AS VARCHAR) FROM bad_logs WHERE length(event_type) > 100
UNION ALL SELECT 'logs', 'source_filename_length', CAST(id AS VARCHAR) FROM bad_logs WHERE length(source_filename) > 255
UNION ALL SELECT 'alerts', 'title_length', CAST(id AS VARCHAR) FROM bad_alerts WHERE length(title) > 150
UNION ALL SELECT 'alerts', 'severity_length', CAST(id AS VARCHAR) FROM bad_alerts WHERE length(severity) > 20
UNION ALL SELECT 'notes', 'tag_count', CAST(id AS VARCHAR) FROM bad_notes WHERE seven
UNION ALL SELECT 'notes', 'tag_length', CAST(id AS VARCHAR) FROM bad_notes WHERE wide
UNION ALL SELECT 'users', 'username_length', CAST(id AS VARCHAR) FROM bad_users WHERE length(username) > 50
UNION ALL SELECT 'users', 'role_required', CAST(id AS VARCHAR) FROM bad_users WHERE role_id IS NULL
UNION ALL SELECT 'users', 'unique_username', username FROM bad_users GROUP BY username HAVING count(*) > 1
UNION ALL SELECT 'users', 'unique_email', email FROM bad_users GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'users', 'fk_role_id', CAST(id AS VARCHAR) FROM bad_users WHERE role_id NOT IN (SELECT id FROM bad_roles)
UNION ALL SELECT 'roles', 'name_length', CAST(id AS VARCHAR) FROM bad_roles WHERE length(name) > 50
UNION ALL SELECT 'roles', 'unique_name', name FROM bad_roles GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'incidents', 'fk_created_by_user_id', CAST(id AS VARCHAR) FROM incidents WHERE created_by_user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'incidents', 'fk_updated_by_user_id', CAST(id AS VARCHAR) FROM incidents WHERE updated_by_user_id NOT IN (SELECT id FROM users)"""))
def _(spark, folder):
    n = F.col("id")
    spoil = lambda test, value, column: F.when(test, value).otherwise(F.col(column))
    long = lambda letter, size: F.repeat(F.lit(letter), size)
    logs = B.logs(spark, folder).withColumns({
        "username": spoil(n % 211 == 0, long("u", 101), "username"), "event_type": spoil(n % 223 == 0, long("e", 101), "event_type"),
        "source_filename": spoil(n % 211 == 0, long("f", 256), "source_filename")})
    alerts = B.alerts(spark, folder).withColumns({
        "title": spoil(n % 101 == 0, long("x", 151), "title"), "severity": spoil(n % 101 == 0, long("s", 21), "severity")})
    notes = B.notes(spark, folder).withColumn("tags", F.when(n % 19 == 0, F.array_repeat(F.lit("tag"), 7)).when(n % 23 == 0, F.array(long("t", 41))).otherwise(F.col("tags")))
    users = B.users(spark, folder)
    bad_users = users.withColumns({
        "username": F.when(n % 50 == 0, "same").when(n % 90 == 1, F.concat(long("u", 51), n.cast("string"))).otherwise(F.col("username")),
        "email": spoil(n % 60 == 0, "one@example.com", "email"), "role_id": spoil(n % 70 == 0, 99, "role_id")})
    roles = B.roles(spark, folder).withColumn("name", F.when(n == 2, "Admin").when(n == 3, long("r", 51)).otherwise(F.col("name")))
    return R.check_accounts_and_lengths(logs, alerts, B.incidents(spark, folder), notes, bad_users, roles)


@query("e08_note_versions", """
SELECT conv_id AS note_id, conv_id * 100 + turn AS change_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version,
  CASE WHEN turn = 0 THEN 'Note created' WHEN turn % 4 = 2 THEN 'Note archived' WHEN turn % 4 = 3 THEN 'Note restored' ELSE 'Content updated' END AS summary FROM conversations""")
def _(spark, folder):
    turn = F.col("turn")
    changes = B.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("note_id"), (F.col("conv_id") * 100 + turn).alias("change_id"), F.when(turn == 0, "created").otherwise("updated").alias("kind"),
        F.when(turn % 4 == 2, True).when(turn % 4 == 3, False).alias("archived"))
    return R.note_versions(changes).select("note_id", "change_id", "version", "summary")
