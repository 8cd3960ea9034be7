"""Registered queries for the column expressions (B1-B31)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions import labels as L
from logvigil.functions import network as N
from logvigil.functions import text as X
from logvigil.functions import timefn as T
from logvigil.plans import bindings as B
from logvigil.plans import lines, snippets as S
from logvigil.plans.registry import query


def variant(index: Column, *values: Column | str) -> Column:
    """Value number ``index`` modulo their count."""
    n, chain = len(values), None
    for i, value in enumerate(values):
        value = value if isinstance(value, Column) else F.lit(value)
        test = index % n == i
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def variant_sql(index: str, *values: str) -> str:
    n = len(values)
    return "CASE " + " ".join(f"WHEN {index} % {n} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def text(*parts: object) -> Column:
    return lines._text(*parts)


def docs(spark, folder):
    return B.table(spark, folder, "documents")


# ---- cleaning and normalising -------------------------------------------------------------

_RAW = variant_sql("doc_id", "'  ' || source || '  '", "'-'", "' null '", "text", "''", "lang")


@query("b01_clean_text", f"SELECT doc_id, {S.clean('raw')} AS cleaned FROM (SELECT doc_id, {_RAW} AS raw FROM documents)")
def _(spark, folder):
    raw = variant(F.col("doc_id"), text("  ", F.col("source"), "  "), "-", " null ", F.col("text"), "", F.col("lang"))
    return docs(spark, folder).select("doc_id", X.clean_text(raw).alias("cleaned"))


@query("b02_first_ip", f"SELECT doc_id, {S.first_ip('text')} AS ip FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", X.first_ip(F.col("text")).alias("ip"))


_IPS = variant_sql("id", "ip_address", "' ' || ip_address || ' '", "ip_address || '.1'", "'999.1.1.1'", "'-'")


@query("b03_normalize_ip", B.with_tables("logs", f"""
SELECT id, CASE WHEN regexp_full_match({S.clean('raw')}, '{V.IPV4}') THEN {S.clean('raw')} END AS ip
FROM (SELECT id, {_IPS} AS raw FROM logs)"""))
def _(spark, folder):
    ip = F.col("ip_address")
    raw = variant(F.col("id"), ip, text(" ", ip, " "), text(ip, ".1"), "999.1.1.1", "-")
    return B.logs(spark, folder).select("id", X.normalize_ip(raw).alias("ip"))


_STATUSES = ["fail", " Denied ", "pass_ed", "OK", "weird-value_2", "", "-", "CLOSED", "Log-In  Failed", "null"]
_RAW_STATUS = variant_sql("id", *[f"'{s}'" for s in _STATUSES], "status")


@query("b04_normalize_status", B.with_tables("logs", f"""
SELECT id, {S.normalize_status('raw')} AS status FROM (SELECT id, {_RAW_STATUS} AS raw FROM logs)"""))
def _(spark, folder):
    raw = variant(F.col("id"), *_STATUSES, F.col("status"))
    return B.logs(spark, folder).select("id", X.normalize_status(raw).alias("status"))


_RAW_EVENT = variant_sql("id", "event_type", "'__' || upper(event_type) || '!!'", "raw_message", "'--'", "''", "NULL")


@query("b05_normalize_event_type", B.with_tables("logs", f"""
SELECT id, {S.normalize_event_type('raw')} AS event_type FROM (SELECT id, {_RAW_EVENT} AS raw FROM logs)"""))
def _(spark, folder):
    event = F.col("event_type")
    raw = variant(F.col("id"), event, text("__", F.upper(event), "!!"), F.col("raw_message"), "--", "",
                  F.lit(None).cast("string"))
    return B.logs(spark, folder).select("id", X.normalize_event_type(raw).alias("event_type"))


# ---- reading free text --------------------------------------------------------------------

def _free_text(spark, folder):
    own = lines.messages(spark, folder).select(text("m", F.col("id")).alias("key"), F.col("message").alias("body"))
    return own.unionByName(docs(spark, folder).select(text("d", F.col("doc_id")).alias("key"), F.col("text").alias("body")))


def _free_text_sql(expression: str, name: str) -> str:
    return B.with_tables("messages", f"""
SELECT key, {expression} AS {name} FROM (SELECT 'm' || id AS key, message AS body FROM messages
  UNION ALL SELECT 'd' || doc_id, text FROM documents)""")


@query("b06_status_from_text", _free_text_sql(S.status_from_text("body"), "status"))
def _(spark, folder):
    return _free_text(spark, folder).select("key", X.status_from_text(F.col("body")).alias("status"))


@query("b07_event_type_from_text", _free_text_sql(S.event_type_from_text("body"), "event_type"))
def _(spark, folder):
    return _free_text(spark, folder).select("key", X.event_type_from_text(F.col("body")).alias("event_type"))


_USER_LINE = variant_sql("id", "message", "'vpn from user ' || u || ' at 10.0.0.5'", "'auth user: ' || u || ' result=ok'",
                         "'username=' || u || ' action=login'", "u || ' : TTY=pts/0'", "'no account here'")


@query("b08_username_from_text", B.with_tables("messages", f"""
SELECT id, {S.username('body')} AS username
FROM (SELECT id, {_USER_LINE} AS body FROM (SELECT *, coalesce(username, 'Svc.Account-1') AS u FROM messages))"""))
def _(spark, folder):
    u = F.coalesce("username", F.lit("Svc.Account-1"))
    body = variant(F.col("id"), F.col("message"), text("vpn from user ", u, " at 10.0.0.5"),
                   text("auth user: ", u, " result=ok"), text("username=", u, " action=login"),
                   text(u, " : TTY=pts/0"), "no account here")
    return lines.messages(spark, folder).select("id", X.username_from_text(body).alias("username"))


@query("b09_status_from_http_code", """
SELECT event_id, CASE WHEN c BETWEEN 200 AND 399 THEN 'SUCCESS' WHEN c BETWEEN 400 AND 599 THEN 'FAILED' ELSE 'UNKNOWN' END AS status
FROM (SELECT event_id, event_id % 700 AS c FROM events)""")
def _(spark, folder):
    return B.table(spark, folder, "events").select("event_id", X.status_from_http_code(F.col("event_id") % 700).alias("status"))


@query("b10_coerce_cell", """
SELECT event_id, CASE v WHEN 0 THEN 'float' WHEN 1 THEN 'int' WHEN 2 THEN 'bool' WHEN 3 THEN 'null' WHEN 4 THEN 'null'
    WHEN 5 THEN 'float' WHEN 6 THEN 'string' ELSE 'int' END AS kind,
  CASE v WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'True' WHEN 5 THEN '1500.0'
    WHEN 6 THEN event_type WHEN 7 THEN CAST(event_id AS VARCHAR) END AS cell
FROM (SELECT *, event_id % 8 AS v FROM events)""")
def _(spark, folder):
    raw = variant(F.col("event_id"), F.col("value").cast("string"), text("00", F.col("user_id")), "TRUE", "null", " - ",
                  "1.5e3", text(" ", F.col("event_type"), " "), text("+", F.col("event_id")))
    cell = X.coerce_cell(raw)
    return B.table(spark, folder, "events").select("event_id", cell["kind"].alias("kind"), cell["text"].alias("cell"))


@query("b10b_number_texts", """
SELECT event_id, CASE WHEN v IN (0, 1, 2, 7) THEN 'int' WHEN v IN (3, 4, 5) THEN 'float' ELSE 'string' END AS kind,
  CASE v WHEN 0 THEN repeat('1234567890', 4) || event_id WHEN 1 THEN '-' || repeat('9', 50) || user_id WHEN 2 THEN (1 + event_id) || '000'
    WHEN 3 THEN '"NaN"' WHEN 4 THEN '"-Infinity"' WHEN 5 THEN '"Infinity"' WHEN 6 THEN '"' || event_id || '__1"' ELSE '0' END AS cell
FROM (SELECT *, event_id % 8 AS v FROM events)""")
def _(spark, folder):
    raw = variant(F.col("event_id"), text("+00", F.repeat(F.lit("1234567890"), 4), F.col("event_id")), text("-", F.repeat(F.lit("9"), 50), F.col("user_id")),
                  text(1 + F.col("event_id"), "_000"), "NaN", "-infinity", "1e999", text(F.col("event_id"), "__1"), "-0_0")
    cell = X.coerce_cell(raw)
    return B.table(spark, folder, "events").select("event_id", cell["kind"].alias("kind"), X.cell_json(cell).alias("cell"))


@query("b11_pick", B.with_tables("logs", "SELECT id, coalesce(username, ip_address) AS picked FROM logs"))
def _(spark, folder):
    rows = B.logs(spark, folder)
    return rows.select("id", X.pick(rows.columns, "account", "username", "ip_address").alias("picked"))


@query("b12_pick_path", B.with_tables("logs", "SELECT id, coalesce(username, CAST(line_number AS VARCHAR)) AS picked FROM logs"))
def _(spark, folder):
    document = F.to_json(
        F.struct(F.struct(F.col("username").alias("name")).alias("user"), F.lit("").alias("empty"),
                 F.array(F.lit(1)).alias("list"), F.col("line_number").alias("n")), {"ignoreNullFields": "false"})
    found = X.pick_path(F.try_parse_json(document), ["user", "empty", "list", "user.name", "absent", "n"])
    return B.logs(spark, folder).select("id", found.alias("picked"))


# ---- times --------------------------------------------------------------------------------

@query("b13_parse_event_ts", """
SELECT event_id,
  CASE v WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 7200000000
    WHEN 2 THEN epoch_us(ts) WHEN 3 THEN epoch_us(date_trunc('day', ts)) END AS event_us,
  CASE v WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 7200000000
    WHEN 2 THEN epoch_us(ts) WHEN 3 THEN epoch_us(date_trunc('day', ts))
    WHEN 5 THEN epoch_us(date_trunc('second', ts)) WHEN 6 THEN epoch_us(date_trunc('second', ts)) END AS detector_us
FROM (SELECT event_id, ts, event_id % 8 AS v FROM events)""")
def _(spark, folder):
    ts = F.col("ts").cast("timestamp")
    as_text = lambda fmt: F.date_format(ts, fmt)
    raw = variant(F.col("event_id"), as_text("yyyy-MM-dd'T'HH:mm:ss'Z'"), as_text("yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
                  as_text("yyyy-MM-dd HH:mm:ss.SSSSSS"), as_text("yyyy-MM-dd"), as_text("HH:mm:ss"),
                  as_text("MMM  d HH:mm:ss"), as_text("dd/MMM/2001:HH:mm:ss"), "not a time")
    return B.table(spark, folder, "events").select(
        "event_id", F.unix_micros(T.parse_event_ts(raw)).alias("event_us"),
        F.unix_micros(T.parse_detector_ts(raw, lines.YEAR)).alias("detector_us"))


@query("b13b_iso_forms", """
SELECT event_id, CASE v WHEN 0 THEN second_us WHEN 1 THEN second_us // 3600000000 * 3600000000 WHEN 2 THEN second_us
    WHEN 3 THEN day_us + second_us % 3600000000 // 60000000 * 60000000 WHEN 4 THEN epoch_us(ts) - 19800000000 WHEN 5 THEN day_us WHEN 6 THEN epoch_us(ts) + 3661000000 END AS event_us
FROM (SELECT event_id, ts, event_id % 8 AS v, epoch_us(date_trunc('second', ts)) AS second_us, epoch_us(date_trunc('day', ts)) AS day_us FROM events)""")
def _(spark, folder):
    """Basic, hour-only, odd separator, week date, basic offset, basic date, offset to the second, out of range."""
    ts = F.col("ts").cast("timestamp")
    as_text = lambda fmt: F.date_format(ts, fmt)
    week = text(F.expr("extract(YEAROFWEEK FROM ts)"), "-W", F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), "-", F.expr("extract(DAYOFWEEK_ISO FROM ts)"))
    raw = variant(F.col("event_id"), as_text("yyyyMMdd'T'HHmmss'Z'"), as_text("yyyy-MM-dd'T'HH"), as_text("yyyy-MM-dd'_'HH:mm:ss"),
                  F.concat(week, as_text("'T00'mm")), as_text("yyyyMMdd HHmmss.SSSSSS'123+0530'"), as_text("yyyyMMdd"),
                  as_text("yyyy-MM-dd'T'HH:mm:ss,SSSSSS'-01:01:01'"), as_text("yyyy-'13'-dd'T'HH"))
    return B.table(spark, folder, "events").select("event_id", F.unix_micros(T.parse_event_ts(raw)).alias("event_us"))


@query("b14_format_ts_z", f"SELECT event_id, {S.ts_z('ts')} AS z FROM events")
def _(spark, folder):
    return B.table(spark, folder, "events").select("event_id", T.format_ts_z(F.col("ts").cast("timestamp")).alias("z"))


@query("b15_log_dates", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Foo 99 11:22:33' ELSE {S.ts_z('ts')} END AS syslog,
  CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%d/%b/%Y') ELSE {S.ts_z('ts')} END AS apache FROM events""")
def _(spark, folder):
    ts, bad = F.col("ts").cast("timestamp"), F.col("event_id") % 5 == 0
    syslog = F.when(bad, "Foo 99 11:22:33").otherwise(F.date_format(ts, "MMM d HH:mm:ss"))
    apache = F.when(bad, F.date_format(ts, "dd/MMM/yyyy")).otherwise(F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss '-0700'"))
    return B.table(spark, folder, "events").select(
        "event_id", T.syslog_date(syslog, lines.YEAR).alias("syslog"), T.apache_date(apache).alias("apache"))


@query("b16_severity_from_text", _free_text_sql(S.severity_from_text("body"), "severity"))
def _(spark, folder):
    return _free_text(spark, folder).select("key", X.severity_from_text(F.col("body")).alias("severity"))


_LEVEL_LINE = variant_sql("id", "message || ' [warning]'", "'ERRORS ' || message", "'x=debug; ' || message", "message")


@query("b17_extract_level", B.with_tables("messages", f"""
SELECT id, upper({S.extract('body', V.LEVEL_PATTERN)}) AS level FROM (SELECT id, {_LEVEL_LINE} AS body FROM messages)"""))
def _(spark, folder):
    m = F.col("message")
    body = variant(F.col("id"), text(m, " [warning]"), text("ERRORS ", m), text("x=debug; ", m), m)
    return lines.messages(spark, folder).select("id", X.extract_level(body).alias("level"))


@query("b18_extract_kv", B.with_tables("messages", """
SELECT id, CASE WHEN id % 2 = 0 THEN 'last' WHEN message LIKE '%user=%' THEN coalesce(username, 'guest') END AS kv_user,
  CASE WHEN id % 2 = 0 THEN event_type || ' x' END AS kv_action,
  nullif(CASE WHEN message LIKE '%logname=%' THEN 3 WHEN message LIKE '%user=%' THEN 1 ELSE 0 END
    + CASE WHEN id % 2 = 0 THEN 1 + CASE WHEN message LIKE '%user=%' THEN 0 ELSE 1 END ELSE 0 END, 0) AS pairs
FROM messages"""))
def _(spark, folder):
    extra = F.when(F.col("id") % 2 == 0, text(' action="', F.col("event_type"), ' x" user=last')).otherwise("")
    kv = X.extract_kv(text(F.col("message"), extra))
    return lines.messages(spark, folder).select("id", kv.alias("kv")).select(
        "id", F.try_element_at("kv", F.lit("user")).alias("kv_user"), F.try_element_at("kv", F.lit("action")).alias("kv_action"),
        F.when(F.col("kv").isNotNull(), F.size("kv")).cast("bigint").alias("pairs"))


@query("b19_extract_json", B.with_tables("messages", """
SELECT id, CASE id % 4 WHEN 0 THEN '{"n":' || id || ',"o":{"t":"' || event_type || '"}}' WHEN 1 THEN '{"n":' || id || '}' END AS found
FROM messages"""))
def _(spark, folder):
    n = F.col("id")
    body = variant(n, text("got ", '{"n":', n, ',"o":{"t":"', F.col("event_type"), '"}} end'), text('{"n":', n, "}"),
                   text("broken {", F.col("message"), "}"), F.col("message"))
    return lines.messages(spark, folder).select("id", X.extract_json(body).alias("found"))


_TS_LINE = variant_sql("id", "strftime(moment, '%Y-%m-%d %H:%M:%S') || '.25+01:00 ' || message", "'at ' || strftime(moment, '%d/%b/%Y:%H:%M:%S') || ' ' || message",
                       "strftime(moment, '%b %d %H:%M:%S') || ' ' || message", "message")


@query("b20_extract_timestamp", B.with_tables("messages", f"""
SELECT id, coalesce({', '.join(S.extract('body', p) for p in V.TIMESTAMP_PATTERNS)}) AS found
FROM (SELECT id, {_TS_LINE} AS body FROM messages)"""))
def _(spark, folder):
    at, m = lambda f: F.date_format("moment", f), F.col("message")
    body = variant(F.col("id"), text(at("yyyy-MM-dd HH:mm:ss"), ".25+01:00 ", m), text("at ", at("dd/MMM/yyyy:HH:mm:ss"), " ", m),
                   text(at("MMM dd HH:mm:ss"), " ", m), m)
    return lines.messages(spark, folder).select("id", X.extract_timestamp(body).alias("found"))


# ---- older authentication schema ----------------------------------------------------------

AUTH_EVENT = (
    "CASE WHEN lower({0}) LIKE '%failed password%' THEN 'failed_login' WHEN lower({0}) LIKE '%invalid user%' THEN 'invalid_user' "
    "WHEN lower({0}) LIKE '%accepted password%' OR lower({0}) LIKE '%accepted publickey%' THEN 'successful_login' "
    "WHEN lower({0}) LIKE '%sudo%' AND (lower({0}) LIKE '%authentication failure%' OR lower({0}) LIKE '%auth failure%' OR contains(lower({0}), 'pam_unix')) "
    "THEN 'sudo_auth_failure' WHEN lower({0}) LIKE '%connection closed%' THEN 'connection_closed' ELSE 'unknown' END"
)
AUTH_STATUS = (
    "CASE {0} WHEN 'failed_login' THEN 'failure' WHEN 'invalid_user' THEN 'failure' WHEN 'successful_login' THEN 'success' "
    "WHEN 'sudo_auth_failure' THEN 'failure' WHEN 'connection_closed' THEN 'closed' ELSE 'unknown' END"
)
AUTH_USER = "coalesce(trim(CASE {1} " + " ".join(
    f"WHEN '{kind}' THEN coalesce(" + ", ".join(S.extract("{0}", p) for p in patterns) + ")"
    for kind, patterns in V.AUTH_USER_PATTERNS.items()) + " END, ',;'), '')"
AUTH_LINE = variant_sql("id", "message", "'Invalid user ' || coalesce(username, 'guest') || ', from x'", "message")


def auth_message() -> Column:
    m = F.col("message")
    return variant(F.col("id"), m, text("Invalid user ", F.coalesce("username", F.lit("guest")), ", from x"), m)


@query("b21_classify_auth_event", B.with_tables("messages", f"""
SELECT id, event, {AUTH_STATUS.format('event')} AS status
FROM (SELECT id, {AUTH_EVENT.format('body')} AS event FROM (SELECT id, {AUTH_LINE} AS body FROM messages))"""))
def _(spark, folder):
    outcome = X.classify_auth_event(auth_message())
    return lines.messages(spark, folder).select("id", outcome["event_type"].alias("event"), outcome["status"].alias("status"))


@query("b22_auth_user_source", B.with_tables("messages", f"""
SELECT id, {AUTH_USER.format('body', 'event')} AS "user",
  CASE WHEN id % 4 = 0 THEN 'sshd' WHEN lower(body) LIKE '%sudo%' THEN 'sudo' ELSE 'cron' END AS source
FROM (SELECT id, body, {AUTH_EVENT.format('body')} AS event FROM (SELECT id, {AUTH_LINE} AS body FROM messages))"""))
def _(spark, folder):
    body = auth_message()
    process = F.when(F.col("id") % 4 == 0, "SSHD").otherwise("CRON")
    return lines.messages(spark, folder).select(
        "id", X.extract_auth_user(body, X.classify_auth_event(body)["event_type"]).alias("user"),
        X.normalize_source(process, body).alias("source"))


# ---- addresses and labels -----------------------------------------------------------------

_V6 = ["2001:0DB8::0010", "::1", "2001:db8:0:0:1:0:0:1", "1.2.3", "fe80:0:0:0:0:0:0:9", "::", "1:2:3", ":::1", "12345::1", "::FFFF:1.2.3.4", "1:2:3:4:5:6:7:10.0.0.1"]
_V6_CANONICAL = ["'2001:db8::10'", "'::1'", "'2001:db8::1:0:0:1'", "NULL", "'fe80::9'", "'::'", "NULL", "NULL", "NULL", "'::ffff:102:304'", "NULL"]


@query("b23_optional_ip", B.with_tables("logs", f"SELECT id, {variant_sql('id', 'ip_address', *_V6_CANONICAL)} AS ip FROM logs"))
def _(spark, folder):
    raw = variant(F.col("id"), text(" ", F.col("ip_address"), " "), *_V6)
    return B.logs(spark, folder).select("id", N.optional_ip(raw).alias("ip"))


_ADDRESS = variant_sql("id", "ip_address", "'::1'", "'fd00::1'", "'2001:db8::10'", "ip_address", "'172.20.1.1'", "'172.32.1.1'",
                       "'unknown'", "'127.0.0.1'", "'1.2.3.400'", "'198.51.100.7'", "ip_address")
PLACE_TYPE = """CASE WHEN a IS NULL OR a IN ('', 'unknown') THEN 'unknown' WHEN a = '::1' OR a LIKE 'fd%' THEN 'private'
  WHEN a LIKE '2001:db8:%' THEN 'reserved' WHEN a = '1.2.3.400' THEN 'unknown'
  WHEN regexp_matches(a, '^(10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') THEN 'private'
  WHEN regexp_matches(a, '^(192\\.0\\.2|198\\.51\\.100|203\\.0\\.113)\\.') THEN 'reserved'
  WHEN country_code <> '' OR country <> '' THEN 'country' ELSE 'unknown' END"""


def place_sql(source: str) -> str:
    """Subquery adding type, code and label of address ``a``."""
    return f"""(SELECT *, CASE type WHEN 'private' THEN 'LOCAL' WHEN 'reserved' THEN 'TEST' WHEN 'country' THEN country_code ELSE '--' END AS code,
      CASE type WHEN 'private' THEN CASE WHEN a = '::1' OR a LIKE '127.%' THEN 'Loopback address' ELSE 'Private network' END
        WHEN 'reserved' THEN 'Documentation range' WHEN 'country' THEN country ELSE 'Unknown location' END AS label
    FROM (SELECT *, {PLACE_TYPE} AS type FROM {source}))"""


@query("b24_describe_ip", B.with_tables("logs", f"""
SELECT id, code, label, type FROM {place_sql(f"(SELECT *, {_ADDRESS} AS a FROM logs)")}"""))
def _(spark, folder):
    ip = F.col("ip_address")
    raw = variant(F.col("id"), ip, "::1", "fd00::1", "2001:db8::10", ip, "172.20.1.1", "172.32.1.1", "unknown", "127.0.0.1",
                  "1.2.3.400", "198.51.100.7", ip)
    place = N.describe_ip(raw, F.col("country_code"), F.col("country"))
    return B.logs(spark, folder).select("id", place.alias("p")).select("id", "p.code", "p.label", "p.type")


@query("b25_risk_score", B.with_tables("logs", f"""
SELECT id, {B.RISK.format('lower(severity)', 10)} AS event_risk, {B.RISK.format('lower(severity)', 30)} AS alert_risk FROM logs"""))
def _(spark, folder):
    severity = F.lower("severity")
    return B.logs(spark, folder).select("id", L.risk_score(severity).alias("event_risk"), L.risk_score(severity, "low").alias("alert_risk"))


@query("b26_status_views", B.with_tables("incidents", f"""
SELECT a.id, {B.ALERT_STATUS.format('a.status')} AS alert_status, {B.INCIDENT_STATUS.format('i.status')} AS incident_status,
  CASE {B.ALERT_STATUS.format('a.status')} WHEN 'new' THEN 'NEW' WHEN 'investigating' THEN 'REVIEWING' WHEN 'escalated' THEN 'ESCALATED' WHEN 'resolved' THEN 'CLOSED' END AS alert_stored,
  CASE {B.INCIDENT_STATUS.format('i.status')} WHEN 'open' THEN 'OPEN' WHEN 'investigating' THEN 'INVESTIGATING' WHEN 'resolved' THEN 'RESOLVED' WHEN 'false positive' THEN 'FALSE_POSITIVE' END AS incident_stored
FROM alerts a LEFT JOIN incidents i ON i.source_alert_id = a.id"""))
def _(spark, folder):
    incidents = B.incidents(spark, folder).select(F.col("source_alert_id").alias("id"), F.col("status").alias("i_status"))
    rows = B.alerts(spark, folder).join(incidents, "id", "left")
    alert, incident = L.alert_status_view(F.col("status")), L.incident_status_view(F.col("i_status"))
    return rows.select("id", alert.alias("alert_status"), incident.alias("incident_status"),
                       L.alert_status_stored(alert).alias("alert_stored"), L.incident_status_stored(incident).alias("incident_stored"))


@query("b27_display_ids", B.with_tables("alerts", f"""
SELECT id, {S.display_id('ALT', 'id')} AS display, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS backend FROM alerts"""))
def _(spark, folder):
    n = F.col("id")
    shown = L.display_id("ALT", n)
    return B.alerts(spark, folder).select(
        "id", shown.alias("display"), L.backend_id(F.when(n % 3 == 0, F.concat(shown, F.lit("x"))).otherwise(shown)).alias("backend"))


@query("b28_normalize_tags", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN lower(role) || ',turn' || turn ELSE lower(role) || ',phishing' END AS tags,
  turn < 6 AS valid FROM conversations""")
def _(spark, folder):
    role, turn = F.col("role"), F.col("turn")
    listed = F.array(text(" ", F.upper(role), " "), F.lit(""), role, text("Turn", turn), text("turn", turn))
    parts = text(role, " ,, Phishing,", F.upper(role))
    extra = F.array_repeat(F.lit("tag"), turn.cast("int") + 1)
    return B.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(turn % 2 == 0, L.normalize_tags(listed)).otherwise(L.split_tags(parts)).alias("tags"),
        L.tags_valid(extra).alias("valid"))


@query("b29_evidence_count", B.with_tables("alerts", """
SELECT id, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN event_count ELSE event_count END AS evidence FROM alerts"""))
def _(spark, folder):
    n, none = F.col("id"), F.array().cast("array<string>")
    ids = F.when(n % 4 == 0, F.transform("matched_line_numbers", lambda v: v.cast("string"))).otherwise(none)
    related = F.when(n % 4 == 1, F.array(F.lit("one"))).otherwise(none)
    number = F.when(n % 4 == 2, F.col("event_count"))
    return B.alerts(spark, folder).select("id", L.evidence_count(ids, related, number, F.col("description")).alias("evidence"))


def _playbook_sql(x: str) -> str:
    return S.keyword_case(x, V.PLAYBOOK_KEYWORDS, "none")


_STEPS_SQL = "CASE {0} " + " ".join(
    f"WHEN '{name}' THEN {S._s(' | '.join(steps))}" for name, steps in V.PLAYBOOKS.items()) + " ELSE '' END"
_ALERT_TEXT = variant_sql("id", "rule", "'Malware found by ' || rule", "'Login Success after ' || username", "description", "'R-710 transfer'",
                          "'script execution'", "'cloud session without MFA'", "'malicious IP'", "'domain reputation'")


@query("b30_recommend", B.with_tables("alerts", f"""
SELECT id, {_STEPS_SQL.format('key')} AS steps FROM (SELECT id, {_playbook_sql('body')} AS key FROM (SELECT id, {_ALERT_TEXT} AS body FROM alerts))"""))
def _(spark, folder):
    body = variant(F.col("id"), F.col("rule"), text("Malware found by ", F.col("rule")), text("Login Success after ", F.col("username")),
                   F.col("description"), "R-710 transfer", "script execution", "cloud session without MFA", "malicious IP", "domain reputation")
    return B.alerts(spark, folder).select("id", F.array_join(L.recommend(body), " | ").alias("steps"))


@query("b31_incident_workflow", B.with_tables("incidents", f"""
SELECT id, s IN ('resolved', 'false positive') AS terminal,
  CASE s WHEN 'open' THEN 'Open' WHEN 'investigating' THEN 'Investigating' WHEN 'resolved' THEN 'Resolved' ELSE 'False Positive' END AS label,
  CASE s WHEN 'open' THEN 'investigating' WHEN 'investigating' THEN 'resolved' END AS next_status,
  CASE s WHEN 'open' THEN 'Start investigation' WHEN 'investigating' THEN 'Resolve incident' END AS next_action,
  CASE s WHEN 'open' THEN 0 WHEN 'investigating' THEN 1 ELSE 2 END AS step, CASE s WHEN 'open' THEN 0 WHEN 'investigating' THEN 3 ELSE 6 END AS tasks_done
FROM (SELECT id, {B.INCIDENT_STATUS.format('status')} AS s FROM incidents)"""))
def _(spark, folder):
    flow = L.incident_workflow(L.incident_status_view(F.col("status")))
    return B.incidents(spark, folder).select("id", flow.alias("f")).select("id", "f.*")
