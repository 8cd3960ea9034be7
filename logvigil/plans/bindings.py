"""The driver tables read as logs, alerts, incidents, notes, users and roles.

Each binding is a projection of one table, once as a DataFrame and once as the SQL text the
checking queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.functions import fixed_values as V
from logvigil.operators import browse, evidence
from logvigil.functions.text import lookup

NOW_US = 1_706_659_200_000_000  # 2024-01-31 00:00 UTC, just after the newest event
LINES_PER_UPLOAD = 2500
ALERTS_PER_UPLOAD = 3750
LINES_PER_FILE = 500
FORMATS = ["syslog", "apache_combined", "csv", "json", "generic"]
RULES = list(V.RULE_TITLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _choice(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def logs(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("bigint")
    user, event = F.col("user_id"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    tail = _text(user % 7, ".", user % 50)
    return raw.select(
        event.alias("id"), _text("u", F.floor(event / LINES_PER_UPLOAD)).alias("upload_id"),
        _text("src", user % 6, ".log").alias("source_filename"),
        _choice(user % 5, FORMATS).alias("source_format"),
        (event % LINES_PER_UPLOAD + 1).alias("line_number"),
        F.when(event % 97 != 0, ts).alias("event_timestamp"),
        F.when(user % 25 == 0, F.lit(None)).when(user % 4 == 0, _text("10.0.", tail))
        .when(user % 4 == 1, _text("203.0.113.", user % 50)).when(user % 4 == 2, _text("8.8.", tail))
        .otherwise(_text("192.168.", tail)).alias("ip_address"),
        F.when(k % 20 != 0, _text("user", k % 20)).alias("username"),
        lookup(F.col("event_type"), {
            "error": "login_attempt", "signup": "login_attempt", "click": "port_scan",
            "purchase": "privilege_escalation", "view": "security_event"}).alias("event_type"),
        lookup(F.col("event_type"), {"error": "FAILED", "purchase": "FAILED", "signup": "SUCCESS"},
               F.lit("UNKNOWN")).alias("status"),
        lookup(F.col("event_type"), {"error": "HIGH", "purchase": "MEDIUM", "click": "LOW"}).alias("severity"),
        _text("event ", event, " ", F.col("event_type"), " value=", F.col("value")).alias("raw_message"),
        ts.alias("ingested_at"),
        F.when(user % 4 == 2, "US").otherwise("").alias("country_code"),
        F.when(user % 4 == 2, "United States").otherwise("").alias("country"),
    )


LOGS = """
logs AS (
  SELECT event_id AS id, 'u' || (event_id // 2500) AS upload_id,
    'src' || (user_id % 6) || '.log' AS source_filename,
    ['syslog','apache_combined','csv','json','generic'][1 + user_id % 5] AS source_format,
    event_id % 2500 + 1 AS line_number,
    CASE WHEN event_id % 97 <> 0 THEN ts END AS event_timestamp,
    CASE WHEN user_id % 25 = 0 THEN NULL
      WHEN user_id % 4 = 0 THEN '10.0.' || (user_id % 7) || '.' || (user_id % 50)
      WHEN user_id % 4 = 1 THEN '203.0.113.' || (user_id % 50)
      WHEN user_id % 4 = 2 THEN '8.8.' || (user_id % 7) || '.' || (user_id % 50)
      ELSE '192.168.' || (user_id % 7) || '.' || (user_id % 50) END AS ip_address,
    CASE WHEN k % 20 <> 0 THEN 'user' || (k % 20) END AS username,
    CASE event_type WHEN 'error' THEN 'login_attempt' WHEN 'signup' THEN 'login_attempt'
      WHEN 'click' THEN 'port_scan' WHEN 'purchase' THEN 'privilege_escalation'
      ELSE 'security_event' END AS event_type,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'FAILED'
      WHEN 'signup' THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status,
    CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' END AS severity,
    'event ' || event_id || ' ' || event_type || ' value=' || value AS raw_message,
    ts AS ingested_at,
    CASE WHEN user_id % 4 = 2 THEN 'US' ELSE '' END AS country_code,
    CASE WHEN user_id % 4 = 2 THEN 'United States' ELSE '' END AS country
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k FROM events)
)"""


def _alert_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    created = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (key % 43200) * 60_000_000)
    rule = F.when(cust % 30 == 7, "custom_rule").otherwise(_choice(cust % 6, RULES))
    line = (key * 13) % LINES_PER_UPLOAD + 1
    count = key % 5 + 3
    return raw.select(
        (key + 1).alias("id"), _text("u", F.floor(key / ALERTS_PER_UPLOAD)).alias("upload_id"),
        rule.alias("rule"), _text("Alert on ", rule).alias("title"),
        lookup(F.col("o_orderpriority"), {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"},
               F.lit("LOW")).alias("severity"),
        F.when(key % 11 == 0, "ESCALATED").otherwise(
            lookup(F.col("o_orderstatus"), {"O": "NEW", "P": "REVIEWING"}, F.lit("CLOSED"))).alias("status"),
        F.when(cust % 40 != 0, _text("10.0.", cust % 7, ".", cust % 50)).alias("source_ip"),
        F.when(cust % 20 != 0, _text("user", cust % 20)).alias("username"),
        count.alias("event_count"), ((key % 10 + 1) * 60).alias("time_window_seconds"),
        (created - F.expr("INTERVAL 10 MINUTES")).alias("first_seen"),
        (created - F.expr("INTERVAL 5 MINUTES")).alias("last_seen"),
        _text("Repeated activity: ", count, " failed attempts by customer ", cust).alias("description"),
        F.array(line, line + 1, line + 2).alias("matched_line_numbers"),
        created.alias("created_at"), (created + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        "o_custkey", "o_orderstatus",
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return _alert_rows(spark, folder).drop("o_custkey", "o_orderstatus")


ALERTS = """
alerts AS (
  SELECT id, upload_id, rule, 'Alert on ' || rule AS title, severity, status, source_ip, username, event_count,
    time_window_seconds, created_at - INTERVAL 10 MINUTE AS first_seen, created_at - INTERVAL 5 MINUTE AS last_seen,
    'Repeated activity: ' || event_count || ' failed attempts by customer ' || cust AS description,
    [line, line + 1, line + 2] AS matched_line_numbers, created_at, created_at + INTERVAL 1 DAY AS updated_at
  FROM (
    SELECT o_orderkey + 1 AS id, 'u' || (o_orderkey // 3750) AS upload_id, o_custkey AS cust,
      CASE WHEN o_custkey % 30 = 7 THEN 'custom_rule' ELSE
        ['brute_force_login','invalid_user_enumeration','sudo_failure','password_spraying',
         'credential_stuffing_success','port_scan'][1 + o_custkey % 6] END AS rule,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
        WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      CASE WHEN o_orderkey % 11 = 0 THEN 'ESCALATED' WHEN o_orderstatus = 'O' THEN 'NEW'
        WHEN o_orderstatus = 'P' THEN 'REVIEWING' ELSE 'CLOSED' END AS status,
      CASE WHEN o_custkey % 40 <> 0 THEN '10.0.' || (o_custkey % 7) || '.' || (o_custkey % 50) END AS source_ip,
      CASE WHEN o_custkey % 20 <> 0 THEN 'user' || (o_custkey % 20) END AS username,
      o_orderkey % 5 + 3 AS event_count, (o_orderkey % 10 + 1) * 60 AS time_window_seconds,
      (o_orderkey * 13) % 2500 + 1 AS line,
      TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43200 AS INTEGER)) AS created_at
    FROM orders)
)"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    own = _alert_rows(spark, folder).filter(F.col("id") % 3 == 0)
    cust, state, created = F.col("o_custkey"), F.col("o_orderstatus"), F.col("created_at")
    day = lambda n: created + F.expr(f"INTERVAL {n} DAYS")
    false_positive = (state == "F") & (cust % 2 == 1)
    return own.select(
        F.floor(F.col("id") / 3).alias("id"), F.col("id").alias("source_alert_id"),
        F.when(cust % 5 != 0, cust).alias("assigned_user_id"), cust.alias("created_by_user_id"),
        (cust + 1).alias("updated_by_user_id"), _text("Case ", F.floor(F.col("id") / 3), " on ", F.col("rule")).alias("title"),
        _text("Investigate ", F.col("description")).alias("description"), F.col("severity").alias("priority"),
        F.when(state == "O", "OPEN").when(state == "P", "INVESTIGATING").when(false_positive, "FALSE_POSITIVE")
        .otherwise("RESOLVED").alias("status"),
        created.alias("opened_at"), F.when(state == "F", day(2)).alias("resolved_at"),
        F.when(false_positive, day(3)).alias("closed_at"), created.alias("created_at"), day(4).alias("updated_at"),
    )


INCIDENTS = """
incidents AS (
  SELECT a.id // 3 AS id, a.id AS source_alert_id, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS assigned_user_id,
    o_custkey AS created_by_user_id, o_custkey + 1 AS updated_by_user_id,
    'Case ' || (a.id // 3) || ' on ' || a.rule AS title, 'Investigate ' || a.description AS description,
    a.severity AS priority,
    CASE WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'P' THEN 'INVESTIGATING'
      WHEN o_custkey % 2 = 1 THEN 'FALSE_POSITIVE' ELSE 'RESOLVED' END AS status,
    a.created_at AS opened_at, CASE WHEN o_orderstatus = 'F' THEN a.created_at + INTERVAL 2 DAY END AS resolved_at,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 1 THEN a.created_at + INTERVAL 3 DAY END AS closed_at,
    a.created_at AS created_at, a.created_at + INTERVAL 4 DAY AS updated_at
  FROM alerts a JOIN orders ON a.id = o_orderkey + 1 WHERE a.id % 3 = 0
)"""


def notes(spark: SparkSession, folder: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    created = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (conv * 10 + turn) * 60_000_000)
    return table(spark, folder, "conversations").select(
        (conv * 100 + turn + 1).alias("id"), (conv + 1).alias("incident_id"), (conv * 7 % 1000).alias("author_user_id"),
        _text(F.col("role"), " note").alias("title"), F.col("text").alias("body"),
        F.array(F.col("role"), _text("turn", turn % 3)).alias("tags"),
        ((turn == 0) & (conv % 4 == 0)).alias("pinned"), (conv % 7 == 0).alias("archived"),
        created.alias("created_at"), F.timestamp_micros(F.unix_micros(created) + turn * 3_600_000_000).alias("updated_at"),
    )


NOTES = """
notes AS (
  SELECT conv_id * 100 + turn + 1 AS id, conv_id + 1 AS incident_id, conv_id * 7 % 1000 AS author_user_id,
    role || ' note' AS title, text AS body, [role, 'turn' || (turn % 3)] AS tags,
    (turn = 0 AND conv_id % 4 = 0) AS pinned, (conv_id % 7 = 0) AS archived,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn + turn * 60 AS INTEGER)) AS updated_at
  FROM conversations
)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))).alias("username"),
        _text("c", key, "@example.com").alias("email"), F.col("c_name").alias("full_name"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        lookup(F.col("c_mktsegment"), {"BUILDING": 1, "HOUSEHOLD": 2, "MACHINERY": 2, "FURNITURE": 3})
        .cast("bigint").alias("role_id"),
    )


USERS = """
users AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) AS username, 'c' || c_custkey || '@example.com' AS email,
    c_name AS full_name, c_acctbal > 0 AS is_active,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 2
      WHEN 'FURNITURE' THEN 3 END AS role_id
  FROM customer
)"""


def roles(spark: SparkSession, folder: str) -> DataFrame:
    named = {1: "Admin", 2: "Analyst", 3: "Viewer"}
    used = users(spark, folder).filter("role_id is not null").select(F.col("role_id").alias("id")).distinct()
    return used.withColumn("name", lookup(F.col("id").cast("int"), named)).withColumn(
        "description", _text("Role of ", F.col("name")))


ROLES = """
roles AS (
  SELECT id, name, 'Role of ' || name AS description FROM (
    SELECT DISTINCT role_id AS id, CASE role_id WHEN 1 THEN 'Admin' WHEN 2 THEN 'Analyst' ELSE 'Viewer' END AS name
    FROM users WHERE role_id IS NOT NULL)
)"""


# ---- dashboard views ----------------------------------------------------------------------

def event_views(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.evidence_join(logs(spark, folder), alerts(spark, folder))


def alert_views(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.alert_view(alerts(spark, folder), logs(spark, folder))


def incident_views(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.incident_view(incidents(spark, folder), alert_views(spark, folder))


def note_views(spark: SparkSession, folder: str) -> DataFrame:
    return browse.note_view(notes(spark, folder))


RISK = "CASE {0} WHEN 'critical' THEN 96 WHEN 'high' THEN 82 WHEN 'medium' THEN 58 WHEN 'low' THEN 30 WHEN 'info' THEN 10 ELSE {1} END"
RULE_ID = (
    "CASE {0} WHEN 'brute_force_login' THEN 'R-101' WHEN 'invalid_user_enumeration' THEN 'R-102' "
    "WHEN 'sudo_failure' THEN 'R-103' WHEN 'password_spraying' THEN 'R-104' "
    "WHEN 'credential_stuffing_success' THEN 'R-105' WHEN 'port_scan' THEN 'R-106' ELSE {1} END"
)
ALERT_STATUS = (
    "CASE upper({0}) WHEN 'NEW' THEN 'new' WHEN 'REVIEWING' THEN 'investigating' "
    "WHEN 'ESCALATED' THEN 'escalated' WHEN 'CLOSED' THEN 'resolved' ELSE coalesce(nullif(lower(trim({0})), ''), 'unknown') END"
)
INCIDENT_STATUS = (
    "CASE upper({0}) WHEN 'OPEN' THEN 'open' WHEN 'INVESTIGATING' THEN 'investigating' "
    "WHEN 'RESOLVED' THEN 'resolved' WHEN 'FALSE_POSITIVE' THEN 'false positive' WHEN 'CLOSED' THEN 'resolved' "
    "ELSE coalesce(nullif(lower(trim({0})), ''), 'unknown') END"
)

EV = f"""
listed AS (SELECT upload_id, unnest(matched_line_numbers) AS line_number, created_at, id, severity, rule, description FROM alerts),
first_alert AS (
  SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY upload_id, line_number ORDER BY created_at, id) = 1),
ev AS (
  SELECT *, {RISK.format('severity', 10)} AS risk FROM (
    SELECT 'EVT-' || CASE WHEN l.id = 0 THEN l.upload_id || '-' || l.line_number ELSE CAST(l.id AS VARCHAR) END AS id,
      l.id AS log_id, l.upload_id, l.line_number, a.id AS source_alert_id, l.event_timestamp AS "timestamp", l.ingested_at,
      l.source_filename AS source, coalesce(l.ip_address, 'Unknown') AS source_ip, coalesce(l.username, 'Unknown') AS "user",
      l.event_type AS event, lower(coalesce(a.severity, l.severity, 'info')) AS severity, lower(l.status) AS status,
      {RULE_ID.format('a.rule', "coalesce(a.rule, 'No detection rule')")} AS rule, l.raw_message AS message,
      l.country_code, l.country
    FROM logs l LEFT JOIN first_alert a ON a.upload_id = l.upload_id AND a.line_number = l.line_number)
)"""

AV = f"""
hits AS (
  SELECT a.id, list('EVT-' || CASE WHEN l.id = 0 THEN l.upload_id || '-' || l.line_number ELSE CAST(l.id AS VARCHAR) END ORDER BY l.line_number) AS evidence_ids
  FROM (SELECT id, upload_id, unnest(matched_line_numbers) AS line_number FROM alerts) a
  JOIN logs l ON l.upload_id = a.upload_id AND l.line_number = a.line_number GROUP BY a.id),
files AS (SELECT upload_id, arg_min(source_filename, line_number) AS source FROM logs GROUP BY upload_id),
av AS (
  SELECT *, {RISK.format('severity', 30)} AS risk FROM (
    SELECT 'ALT-' || CASE WHEN a.id < 10000 THEN lpad(CAST(a.id AS VARCHAR), 4, '0') ELSE CAST(a.id AS VARCHAR) END AS id,
      a.id AS backend_id, a.id AS source_alert_id, coalesce(evidence_ids[1], '') AS event_id, title, lower(a.severity) AS severity,
      {ALERT_STATUS.format('a.status')} AS status, coalesce(f.source, 'ingested log') AS source,
      coalesce(source_ip, 'Unknown') AS source_ip, coalesce(username, 'Unknown') AS "user", created_at, first_seen AS observed_at,
      first_seen, last_seen, time_window_seconds, {RULE_ID.format('rule', 'upper(rule)')} AS rule_id,
      replace(rule, '_', ' ') AS rule_name, description AS summary, description AS reason, 'Unassigned' AS assignee,
      coalesce(evidence_ids, []) AS evidence_ids
    FROM alerts a LEFT JOIN hits h ON h.id = a.id LEFT JOIN files f ON f.upload_id = a.upload_id)
)"""

IV = f"""
iv AS (
  SELECT 'INC-' || CASE WHEN i.id < 10000 THEN lpad(CAST(i.id AS VARCHAR), 4, '0') ELSE CAST(i.id AS VARCHAR) END AS id,
    i.id AS backend_id, i.source_alert_id, i.title, nullif(assigned_user_id, 0) AS assigned_user_id,
    coalesce('User ' || nullif(assigned_user_id, 0), 'Unassigned') AS owner, lower(priority) AS priority,
    {INCIDENT_STATUS.format('i.status')} AS status, i.updated_at AS updated,
    CASE WHEN i.status IN ('RESOLVED', 'FALSE_POSITIVE', 'CLOSED') THEN coalesce(closed_at, resolved_at, i.updated_at) END AS completed_at,
    CASE WHEN i.status IN ('RESOLVED', 'FALSE_POSITIVE', 'CLOSED') THEN nullif(updated_by_user_id, 0) END AS completed_by_user_id,
    CASE WHEN i.status IN ('RESOLVED', 'FALSE_POSITIVE', 'CLOSED') THEN 'User ' || nullif(updated_by_user_id, 0) END AS completed_by,
    CASE WHEN i.status IN ('RESOLVED', 'FALSE_POSITIVE', 'CLOSED') THEN 'Completed' ELSE 'Within target' END AS sla,
    i.description AS summary, coalesce(av.evidence_ids, []) AS event_ids
  FROM incidents i LEFT JOIN av ON av.source_alert_id = i.source_alert_id
)"""

NV = """
nv AS (
  SELECT 'NOTE-' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS id,
    id AS backend_id, title, body, 'User ' || author_user_id AS author, created_at, updated_at, tags,
    array_to_string(tags, ' ') AS tags_text, 'incident' AS linked_type,
    'INC-' || CASE WHEN incident_id < 10000 THEN lpad(CAST(incident_id AS VARCHAR), 4, '0') ELSE CAST(incident_id AS VARCHAR) END AS linked_id,
    incident_id AS linked_backend_id, pinned, archived
  FROM notes
)"""

_NEEDS = {
    "logs": (LOGS, []), "alerts": (ALERTS, []), "incidents": (INCIDENTS, ["alerts"]), "notes": (NOTES, []),
    "users": (USERS, []), "roles": (ROLES, ["users"]), "ev": (EV, ["logs", "alerts"]),
    "av": (AV, ["logs", "alerts"]), "iv": (IV, ["incidents", "av"]), "nv": (NV, ["notes"]),
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """SQL text of a checking query over the named bindings."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        sql, parents = _NEEDS[name]
        for parent in parents:
            need(parent)
        parts.setdefault(name, sql.strip())

    for name in names.split():
        need(name)
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    text = body.strip()
    if text.startswith("WITH "):
        return keyword + ",\n".join(parts.values()) + ",\n" + text[5:]
    return keyword + ",\n".join(parts.values()) + "\n" + text
