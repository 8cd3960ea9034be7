"""Registered queries for the detection rules and alert jobs (C1-C12).

The checking SQL steps through each subject's rows one by one with the window as list state; the
thresholds are wider than the defaults because the events lie minutes apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logvigil.functions import fixed_values as V
from logvigil.operators import alerts as A
from logvigil.operators import detection as D
from logvigil.plans import bindings as B
from logvigil.plans import snippets as S
from logvigil.plans.registry import query

DAY = 86_400
RULES = {
    "c01_brute_force_login": D.brute_force_login(3, 3 * DAY),
    "c02_invalid_user_enumeration": D.invalid_user_enumeration(3, 3 * DAY),
    "c03_sudo_failure": D.sudo_failure(5, DAY),
    "c04_password_spraying": D.password_spraying(5, DAY),
    "c05_credential_stuffing_success": D.credential_stuffing(2, 2 * DAY, DAY),
    "c06_port_scan": D.port_scan(3, 3 * DAY),
}
_SUBJECT = {"ip": "ip_address", "user": "username", "user_or_ip": "coalesce(username, ip_address)"}


def _description_sql(rule: D.Rule, count: str) -> str:
    text = S._s(V.RULE_DESCRIPTIONS[rule.name])
    for field, value in (("subject", "k"), ("count", f"CAST({count} AS VARCHAR)"), ("failures", f"CAST({count} - 1 AS VARCHAR)"),
                         ("window", f"'{rule.window_seconds}'")):
        text = f"replace({text}, '{{{field}}}', {value})"
    return text


def _threshold_sql(tag: str, rule: D.Rule) -> tuple[str, str]:
    """Common table expressions and final select of a threshold rule."""
    subject, window = _SUBJECT[rule.subject], rule.window_seconds * D.MICROS
    where = [f"event_type = '{rule.event_type}'", f"{subject} IS NOT NULL", "event_timestamp IS NOT NULL"]
    if rule.statuses:
        where.append("status = 'FAILED'")
    if rule.distinct:
        where.append("ip_address IS NOT NULL AND username IS NOT NULL")
    dim = rule.distinct or "CAST(line_number AS VARCHAR)"
    entry = "{'us': e.us, 'line': e.line, 'ip': e.ip, 'usr': e.usr, 'd': e.d}"
    size = "len(list_distinct(list_transform({0}, lambda y: y.d)))"
    ctes = f"""
e_{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY upload_id, k ORDER BY us, line) AS rn FROM (
    SELECT upload_id, {subject} AS k, epoch_us(event_timestamp) AS us, line_number AS line, ip_address AS ip, username AS usr, {dim} AS d
    FROM logs WHERE {' AND '.join(where)})),
s_{tag} AS (
  SELECT upload_id, k, rn, {rule.threshold} <= 1 AS fired, [{entry}] AS w FROM e_{tag} e WHERE rn = 1
  UNION ALL
  SELECT upload_id, k, rn, {size.format('w2')} >= {rule.threshold}, w2 FROM (
    SELECT e.upload_id, e.k, e.rn, list_filter(list_append(CASE WHEN s.fired THEN [] ELSE s.w END, {entry}), lambda y: e.us - y.us <= {window}) AS w2
    FROM s_{tag} s JOIN e_{tag} e ON e.upload_id = s.upload_id AND e.k = s.k AND e.rn = s.rn + 1))"""
    ip = {"ip": "k", "user": "w[-1].ip", "user_or_ip": "w[1].ip"}[rule.subject]
    user = "k" if rule.subject == "user" else "NULL" if rule.distinct == "username" else "w[1].usr"
    return ctes, f"""
SELECT upload_id, '{rule.name}' AS rule, '{rule.severity}' AS severity, {ip} AS source_ip, {user} AS username, {size.format('w')} AS "count",
  {rule.window_seconds} AS time_window_seconds, {S.ts_z('make_timestamp(w[1].us)')} AS first_seen, {S.ts_z('make_timestamp(w[-1].us)')} AS last_seen,
  {_description_sql(rule, size.format('w'))} AS description, {S.joined('list_transform(w, lambda y: y.line)')} AS matched_line_numbers
FROM s_{tag} WHERE fired"""


def _burst_sql(tag: str, rule: D.Rule) -> tuple[str, str]:
    window, after, back = rule.window_seconds * D.MICROS, rule.success_window_seconds * D.MICROS, rule.threshold - 1
    ctes = f"""
b_{tag} AS (
  SELECT *, coalesce(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY upload_id, k ORDER BY us, line
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
  FROM (SELECT upload_id, ip_address AS k, epoch_us(event_timestamp) AS us, line_number AS line, username AS usr, status FROM logs
    WHERE event_type = 'login_attempt' AND status IN ('FAILED', 'SUCCESS') AND ip_address IS NOT NULL AND event_timestamp IS NOT NULL)),
f_{tag} AS (
  SELECT *, row_number() OVER same AS n, us - lag(us, {back}) OVER same <= {window} AS closes FROM b_{tag} WHERE status = 'FAILED'
  WINDOW same AS (PARTITION BY upload_id, k, epoch ORDER BY us, line)),
l_{tag} AS (SELECT upload_id, k, epoch, max(n) AS last_n, arg_max(us, n) AS last_us FROM f_{tag} WHERE closes GROUP BY ALL),
g_{tag} AS (
  SELECT x.upload_id, x.k, x.us, x.line, x.usr, min(f.us) AS first_us, count(*) + 1 AS n, list(f.line ORDER BY f.us, f.line) AS burst
  FROM b_{tag} x JOIN l_{tag} l ON l.upload_id = x.upload_id AND l.k = x.k AND l.epoch = x.epoch AND x.us - l.last_us <= {after}
  JOIN f_{tag} f ON f.upload_id = x.upload_id AND f.k = x.k AND f.epoch = x.epoch AND f.n <= l.last_n AND f.us >= l.last_us - {window}
  WHERE x.status = 'SUCCESS' GROUP BY ALL)"""
    return ctes, f"""
SELECT upload_id, '{rule.name}' AS rule, '{rule.severity}' AS severity, k AS source_ip, usr AS username, n AS "count", {rule.window_seconds} AS time_window_seconds,
  {S.ts_z('make_timestamp(first_us)')} AS first_seen, {S.ts_z('make_timestamp(us)')} AS last_seen, {_description_sql(rule, 'n')} AS description,
  {S.joined('list_append(burst, line)')} AS matched_line_numbers
FROM g_{tag}"""


def detection_sql(rules: list[D.Rule]) -> str:
    parts = [(_burst_sql if r.is_burst else _threshold_sql)(f"r{i}", r) for i, r in enumerate(rules)]
    body = "WITH " + ",\n".join(p[0].strip() for p in parts) + "\n" + " UNION ALL ".join(p[1].strip() for p in parts)
    return B.with_tables("logs", body, recursive=True)


def _register(name: str, rules: list[D.Rule]) -> None:
    @query(name, detection_sql(rules))
    def _(spark, folder):
        return D.run_detection(B.logs(spark, folder), rules)


for _name, _rule in RULES.items():
    _register(_name, [_rule])
_register("c07_run_detection", list(RULES.values()))


@query("c07b_detect_runs", f"""
SELECT * EXCLUDE (matched_line_numbers), CAST(unnest(string_split(matched_line_numbers, ',')) AS BIGINT) AS line_number
FROM ({detection_sql(list(RULES.values()))})""")
def _(spark, folder):
    """The alerts of c07 with a row for each line, from runs of lines instead of arrays."""
    alerts, runs = D.detect(B.logs(spark, folder), list(RULES.values()))
    lines = runs.select(*D.ALERT_KEY, F.explode(F.sequence("first_line", "last_line")).alias("line_number"))
    return alerts.join(lines, D.ALERT_KEY).drop("subject", "end_us", "end_line")


_TITLE = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in V.RULE_TITLES.items()) + " ELSE 'Security alert' END"


@query("c08_describe_alerts", B.with_tables("alerts", f"""
SELECT id, rule, {_TITLE} AS title, source_ip AS ip_address, username AS "user", description AS reason,
  {S.ts_z('first_seen')} AS range_start, {S.ts_z('last_seen')} AS range_end FROM alerts"""))
def _(spark, folder):
    z = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)
    detected = B.alerts(spark, folder).drop("title").withColumns({"first_seen": z("first_seen"), "last_seen": z("last_seen")})
    return A.describe_alerts(detected).select(
        "id", "rule", "title", "ip_address", "user", "reason",
        F.col("timestamp_range.start").alias("range_start"), F.col("timestamp_range.end").alias("range_end"))


@query("c09_build_alert_rows", B.with_tables("alerts", """
SELECT id, upload_id, CASE WHEN id % 7 = 0 THEN 'unknown_rule' ELSE rule END AS rule, CASE WHEN id % 5 = 0 THEN 'LOW' ELSE severity END AS severity,
  'NEW' AS status, CASE WHEN id % 6 = 0 THEN NULL ELSE source_ip END AS source_ip, username, event_count, time_window_seconds,
  CASE WHEN id % 4 = 0 THEN NULL ELSE epoch_us(first_seen) END AS first_seen, epoch_us(last_seen) AS last_seen,
  CASE WHEN id % 9 = 0 THEN 'Security rule triggered.' ELSE description END AS description,
  array_to_string(matched_line_numbers, ',') AS matched_line_numbers, 1706659200000000 AS created_at FROM alerts"""))
def _(spark, folder):
    n, z = F.col("id"), lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dirty = B.alerts(spark, folder).select(
        "id", "upload_id", F.when(n % 7 != 0, F.col("rule")).alias("rule"), "title",
        F.when(n % 5 != 0, F.lower("severity")).otherwise("").alias("severity"),
        F.when(n % 6 == 0, F.concat(F.col("source_ip"), F.lit(".9"))).otherwise(F.col("source_ip")).alias("source_ip"),
        F.lit(None).cast("string").alias("ip_address"), F.lit("").alias("username"), F.col("username").alias("user"),
        F.col("event_count").alias("count"), "time_window_seconds",
        F.when(n % 4 != 0, z("first_seen")).otherwise("bad").alias("first_seen"), z("last_seen").alias("last_seen"),
        F.when(n % 9 != 0, F.col("description")).alias("description"), F.lit(None).cast("string").alias("reason"), "matched_line_numbers")
    with_id = A.build_alert_rows(dirty.withColumn("upload_id", F.concat_ws("|", "id", "upload_id")), F.timestamp_micros(F.lit(B.NOW_US)))
    part = lambda i: F.split_part("upload_id", F.lit("|"), F.lit(i))
    return with_id.withColumns({"id": part(1).cast("bigint"), "upload_id": part(2)}).drop("title", "updated_at")


_CATALOG = "(VALUES " + ", ".join(
    "(" + ", ".join(S._s(row[i]) for i in (0, 1, 2, 4, 5, 7)) + ")" for row in V.RULE_CATALOG
) + ") AS c(id, engine_key, name, technique, severity, criteria)"


@query("c10_rule_catalog", B.with_tables("alerts", f"""
SELECT c.id, c.engine_key, c.name, c.technique, c.severity, c.criteria, count(a.id) AS alerts
FROM {_CATALOG} LEFT JOIN alerts a ON a.rule = c.engine_key GROUP BY ALL"""))
def _(spark, folder):
    counts = B.alerts(spark, folder).groupBy(F.col("rule").alias("engine_key")).agg(F.count(F.lit(1)).alias("alerts"))
    catalog = A.rule_catalog(spark).select("id", "engine_key", "name", "technique", "severity", "criteria")
    return catalog.join(counts, "engine_key", "left").na.fill(0, ["alerts"])


REPEATED = """
rf AS (
  SELECT "user", count(*) AS failures, min(coalesce("timestamp", ingested_at)) AS t0, max(coalesce("timestamp", ingested_at)) AS t1,
    arg_min(source_ip, log_id) AS source_ip, min(log_id) AS first_log
  FROM ev WHERE status = 'failed' AND trim("user") <> '' AND lower("user") <> 'unknown' GROUP BY "user" HAVING count(*) >= 3
  ORDER BY failures DESC, first_log LIMIT 1)"""


@query("c11_repeated_failures", B.with_tables("ev", f"""WITH {REPEATED.strip()}
SELECT "user", failures, greatest(1, CAST(round((epoch_us(t1) - epoch_us(t0)) / 1000000) AS BIGINT)) AS window_seconds, source_ip FROM rf"""))
def _(spark, folder):
    return A.repeated_failures(B.event_views(spark, folder))


@query("c12_suspicious_ips", B.with_tables("alerts", f"""
SELECT source_ip, id, risk, severity, rule FROM (SELECT * REPLACE (coalesce(nullif(source_ip, ''), 'Unknown') AS source_ip), {B.RISK.format('lower(severity)', 30)} AS risk FROM alerts)
QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY risk DESC, id) = 1 ORDER BY risk DESC, id LIMIT 5"""))
def _(spark, folder):
    return A.suspicious_ips(B.alerts(spark, folder))
