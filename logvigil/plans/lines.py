"""Raw log text rendered from the event table, so that ingest jobs have whole files to read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.plans import bindings as B
from logvigil.sources import files as S

YEAR = 2024


def _text(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows with a free-text ``message``, and the file each one belongs to."""
    rows = B.logs(spark, folder)
    user, ip, n = F.coalesce("username", F.lit("guest")), F.coalesce("ip_address", F.lit("-")), F.col("id")
    invalid = F.when(n % 3 == 0, "invalid user ").otherwise("")
    kind = F.col("event_type")
    message = (
        F.when(F.col("severity") == "HIGH", _text("Failed password for ", invalid, user, " from ", ip, " port 22 ssh2"))
        .when(kind == "login_attempt", _text("Accepted password for ", user, " from ", ip, " port 34567 ssh2"))
        .when(kind == "port_scan", _text("scan probe from ", ip, " to port 443 user=", user))
        .when(kind == "privilege_escalation",
              _text("sudo: pam_unix(sudo:auth): authentication failure; logname=", user, " uid=1000 user=", user))
        .otherwise(_text("Connection closed by ", ip, " port 34567"))
    )
    return rows.select(
        "*", message.alias("message"), F.floor(n / B.LINES_PER_FILE).alias("file_no"),
        F.coalesce("event_timestamp", "ingested_at").alias("moment"),
    )


MESSAGES = """
messages AS (
  SELECT *, id // 500 AS file_no, coalesce(event_timestamp, ingested_at) AS moment,
    CASE WHEN severity = 'HIGH' THEN 'Failed password for ' || CASE WHEN id % 3 = 0 THEN 'invalid user ' ELSE '' END
        || coalesce(username, 'guest') || ' from ' || coalesce(ip_address, '-') || ' port 22 ssh2'
      WHEN event_type = 'login_attempt' THEN 'Accepted password for ' || coalesce(username, 'guest') || ' from '
        || coalesce(ip_address, '-') || ' port 34567 ssh2'
      WHEN event_type = 'port_scan' THEN 'scan probe from ' || coalesce(ip_address, '-') || ' to port 443 user=' || coalesce(username, 'guest')
      WHEN event_type = 'privilege_escalation' THEN 'sudo: pam_unix(sudo:auth): authentication failure; logname='
        || coalesce(username, 'guest') || ' uid=1000 user=' || coalesce(username, 'guest')
      ELSE 'Connection closed by ' || coalesce(ip_address, '-') || ' port 34567' END AS message
  FROM logs
)"""
B._NEEDS["messages"] = (MESSAGES, ["logs"])


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    """One raw line per event in the format of its file, with some lines spoilt on purpose."""
    rows = messages(spark, folder)
    n, user, ip = F.col("id"), F.coalesce("username", F.lit("-")), F.coalesce("ip_address", F.lit("-"))
    syslog = _text(F.date_format("moment", "MMM dd HH:mm:ss"), " server", n % 3, " sshd[", n % 900 + 1, "]: ", F.col("message"))
    web = _text(ip, " - ", user, " [", F.date_format("moment", "dd/MMM/yyyy:HH:mm:ss"), " +0000] \"GET /item/", n % 50,
                " HTTP/1.1\" ", F.when(F.col("status") == "FAILED", 403).otherwise(200), " ",
                F.when(n % 9 == 0, "-").otherwise((n % 5000).cast("string")), " \"-\" \"agent/", n % 4, "\"")
    csv = _text(F.date_format("moment", B_TS), ",", F.coalesce("ip_address", F.lit("")), ",", F.coalesce("username", F.lit("")),
                ",", F.replace(F.col("event_type"), F.lit("_"), F.lit(" ")), ",", F.lower("status"), ",\"note ", n % 7,
                ", quoted \"\"x\"\"\",", n % 100)
    json = F.to_json(F.struct(
        F.date_format("moment", B_TS).alias("@timestamp"), F.struct(F.col("ip_address").alias("ip")).alias("source"),
        F.struct(F.col("username").alias("name")).alias("user"),
        F.struct(F.col("event_type").alias("action"), F.lower("status").alias("outcome")).alias("event"),
        F.col("message"), F.col("severity").alias("level")))
    generic = _text(F.date_format("moment", B_TS), " ", F.when(n % 2 == 0, "WARN").otherwise("notice"), " ", F.col("message"),
                    F.when(n % 4 == 0, _text(" action=\"", F.col("event_type"), "\" src=", ip, " status=", F.lower("status"))).otherwise(""))
    kind = F.col("file_no") % 5
    line = F.when(kind == 0, syslog).when(kind == 1, web).when(kind == 2, csv).when(kind == 3, json).otherwise(generic)
    spoilt = F.when((n % 50 == 7) & (kind != 2), F.when(kind == 3, "{broken ").otherwise(_text("garbage ", n))) \
        .when((n % 50 == 9) & (kind == 0), _text("# comment ", n)).when((n % 50 == 11) & (kind != 2), "   ").otherwise(line)
    return rows.withColumn("line", spoilt)


B_TS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CSV_HEADER = "Timestamp,Source IP,User,Event,Result,Remark,Score"
EXTENSIONS = ["log", "log", "csv", "jsonl", "log"]


def upload_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered lines as files of 500 events each, in the shape of a file scan."""
    lines = rendered(spark, folder)
    whole = lines.groupBy("file_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "id", "line"))), lambda e: e["line"]), "\n").alias("text")
    )
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("file_no") % 5 + 1).cast("int"))
    name = _text("upload", F.col("file_no"), ".", ext)
    text = F.when(F.col("file_no") % 5 == 2, _text(CSV_HEADER, "\n", F.col("text"))).otherwise(F.col("text"))
    content = F.encode(text, "UTF-8")
    return whole.select(
        _text("file:/uploads/", name).alias("path"), name.alias("name"), ext.alias("ext"),
        F.length(content).cast("bigint").alias("length"), content.alias("content"), "file_no",
    )


def accepted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Admitted files with their lines and format; the file name serves as upload id."""
    checked = S.validate_files(upload_files(spark, folder))
    return S.with_lines(S.admitted(checked)).withColumns(
        {"upload_id": F.col("name"), "source_filename": F.col("name")})


def records(spark: SparkSession, folder: str, wanted: str | None = None) -> DataFrame:
    found = accepted_files(spark, folder)
    if wanted is not None:
        found = found.filter(F.col("format") == wanted)
    return S.explode_records(found)


# The same files in SQL: every line with its number among the kept lines of its file.
def _line_sql() -> str:
    z = "strftime(moment, '%Y-%m-%dT%H:%M:%SZ')"
    return f"""
rendered AS (
  SELECT * EXCLUDE (upload_id), 'upload' || file_no || '.' || ['log','log','csv','jsonl','log'][1 + file_no % 5] AS upload_id,
    file_no % 5 AS kind, id % 50 = 7 AND file_no % 5 <> 2 AS garbage, id % 50 = 9 AND file_no % 5 = 0 AS is_comment,
    id % 50 = 11 AND file_no % 5 <> 2 AS blank, {z} AS z,
    CASE WHEN id % 4 = 0 THEN ' action="' || event_type || '" src=' || coalesce(ip_address, '-') || ' status=' || lower(status) ELSE '' END AS kv,
    CASE WHEN id % 2 = 0 THEN 'WARN' ELSE 'notice' END AS level
  FROM messages
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY id) AS line_number_kept,
    row_number() OVER (PARTITION BY file_no ORDER BY garbage, id) AS record_number,
    id % 500 + 1 AS physical
  FROM rendered WHERE NOT blank
)"""


B._NEEDS["numbered"] = (_line_sql(), ["messages"])
