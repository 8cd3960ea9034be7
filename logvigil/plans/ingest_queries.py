"""Registered queries for scans, parsers and sinks (A1-A16)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from logvigil.functions import fixed_values as V
from logvigil.plans import bindings as B
from logvigil.plans import function_queries as Q
from logvigil.plans import lines, snippets as S
from logvigil.plans.registry import CHECKS, query
from logvigil.session import shared_folder
from logvigil.sources import files, parsers, sinks, splits

CORE = ["timestamp", "ip_address", "username", "event_type", "status", "severity"]


def _named(path):
    return F.regexp_extract(path, "/name=([^/]+)/", 1)


def _as_files(texts: DataFrame, *order: str) -> str:
    """Rows of ``name, text`` written as files, one folder for each name; the folder they are in."""
    place = f"{shared_folder(texts.sparkSession)}/split-files-{uuid.uuid4().hex}"
    texts.repartition("name").sortWithinPartitions("name", *order).select("name", "text").write.partitionBy("name").text(place)
    return place


def _document_files(spark, folder) -> str:
    """A thousand documents a file."""
    name = Q.text("docs", F.floor(F.col("doc_id") / 1000), ".txt")
    return _as_files(B.table(spark, folder, "documents").select(name.alias("name"), "doc_id", "text"), "doc_id")


@query("a01_scan_files", """
SELECT 'docs' || (doc_id // 1000) || '.txt' AS name, 'txt' AS ext, CAST(sum(strlen(text) + 1) AS BIGINT) AS length,
  CAST(sum(strlen(text) + 1) AS BIGINT) AS content_bytes FROM documents GROUP BY doc_id // 1000""")
def _(spark, folder):
    """Files written from the documents, by name and size, with what was read of them."""
    found = files.scan_files(spark, _document_files(spark, folder)).withColumn("name", _named(F.col("path")))
    return found.select("name", files.file_extension(F.col("name")).alias("ext"), "length", F.length("content").cast("bigint").alias("content_bytes"))


# ---- admission ----------------------------------------------------------------------------

def _candidate_files(spark, folder):
    """Every document as a file, each tenth of them spoilt in a different way."""
    doc, kind = F.col("doc_id"), F.col("doc_id") % 10
    body = F.encode("text", "UTF-8")
    content = (
        F.when(kind == 2, F.encode(F.lit(" \n\t "), "UTF-8"))
        .when(kind == 3, F.concat(body, F.unhex(F.lit("00"))))
        .when(kind == 4, F.encode("text", "ISO-8859-1")).otherwise(body)
    )
    ext = F.when(kind == 0, "exe").when(kind == 5, "JSONL").otherwise("log")
    mime = F.when(kind == 1, "image/png").when(kind == 6, "text/plain; charset=utf-8").otherwise("")
    name = Q.text("doc", doc, ".", ext)
    return B.table(spark, folder, "documents").select(
        "doc_id", name.alias("name"), files.file_extension(name).alias("ext"), mime.alias("content_type"),
        F.length(content).cast("bigint").alias("length"), content.alias("content"))


@query("a02_validate_files", """
SELECT doc_id, lower(CASE doc_id % 10 WHEN 0 THEN 'exe' WHEN 5 THEN 'JSONL' ELSE 'log' END) AS ext,
  CASE doc_id % 10 WHEN 0 THEN 'INVALID_FILE_TYPE' WHEN 1 THEN 'INVALID_MIME_TYPE' WHEN 2 THEN 'EMPTY_FILE' WHEN 3 THEN 'BINARY_FILE'
    WHEN 4 THEN CASE WHEN regexp_matches(text, '[\\x{80}-\\x{FF}]') THEN 'ENCODING_ERROR' END END AS code
FROM documents""")
def _(spark, folder):
    return files.validate_files(_candidate_files(spark, folder)).select("doc_id", "ext", "code")


_BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@query("a03_explode_lines", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS line_number, raw
FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS place
  FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAKS}') AS parts FROM documents))
WHERE regexp_matches(raw, '\\S')""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents").select("doc_id", "text", files.text_lines(F.col("text")).alias("lines"))
    return files.explode_lines(docs)


@query("a04_detect_format", B.with_tables("numbered", """
SELECT upload_id AS name, ['syslog','apache_combined','csv','json','generic'][1 + min(kind)] AS format,
  count(*) + CASE WHEN min(kind) = 2 THEN 1 ELSE 0 END AS total_lines FROM numbered GROUP BY upload_id"""))
def _(spark, folder):
    return lines.accepted_files(spark, folder).select("name", "format", "total_lines")


# ---- parsers, reading back the rendered lines ----------------------------------------------

def _core_sql(timestamp, ip, user, event, status, severity):
    return (f"{timestamp} AS \"timestamp\", {ip} AS ip_address, {user} AS username, {event} AS event_type, "
            f"{status} AS status, {severity} AS severity")


_SYSLOG = _core_sql("z", S.first_ip("message"), S.username("message"), S.event_type_from_text("message"),
                    S.status_from_text("message"), S.severity_from_text("message"))
_APACHE = _core_sql("z", "ip_address", "username", "'http_get'", "CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'SUCCESS' END", "NULL")
_CSV = _core_sql("z", "ip_address", "username", "event_type", "status", "NULL")
_JSON = _core_sql("z", f"coalesce(ip_address, {S.first_ip('message')})", "username", "event_type", "status", "severity")
_GENERIC_TEXT = "CASE WHEN garbage THEN 'garbage ' || id ELSE z || ' ' || level || ' ' || message || kv END"
_GENERIC = _core_sql(
    "CASE WHEN NOT garbage THEN z END", S.first_ip("body"),
    # key=value text names the user before the message patterns do
    f"CASE WHEN NOT garbage AND message LIKE '% user=%' THEN coalesce(username, 'guest') ELSE {S.username('body')} END",
    f"CASE WHEN NOT garbage AND id % 4 = 0 THEN event_type ELSE {S.event_type_from_text('body')} END",
    f"CASE WHEN NOT garbage AND id % 4 = 0 THEN {S.normalize_status('status')} ELSE {S.status_from_text('body')} END",
    f"upper({S.extract('body', V.LEVEL_PATTERN)})")


def _parsed(frame, *extras):
    return frame.filter(F.col("reason").isNull()).select("upload_id", "line_number", *CORE, *extras)


def _field(name, kind="string"):
    return F.get_json_object("parsed_data", f"$.{name}").cast(kind).alias(name)


@query("a05_parse_syslog", B.with_tables("numbered", f"""
SELECT upload_id, line_number_kept AS line_number, {_SYSLOG}, 'server' || (id % 3) AS hostname, 'sshd' AS process, id % 900 + 1 AS pid
FROM numbered WHERE kind = 0 AND NOT garbage AND NOT is_comment"""))
def _(spark, folder):
    found = parsers.parse_syslog(lines.records(spark, folder, "syslog"), lines.YEAR)
    return _parsed(found, _field("hostname"), _field("process"), _field("pid", "bigint"))


@query("a06_parse_apache", B.with_tables("numbered", f"""
SELECT upload_id, line_number_kept AS line_number, {_APACHE}, '/item/' || (id % 50) AS path,
  CASE WHEN status = 'FAILED' THEN 403 ELSE 200 END AS status_code, CASE WHEN id % 9 = 0 THEN 0 ELSE id % 5000 END AS bytes
FROM numbered WHERE kind = 1 AND NOT garbage"""))
def _(spark, folder):
    found = parsers.parse_apache(lines.records(spark, folder, "apache_combined"))
    return _parsed(found, _field("path"), _field("status_code", "bigint"), _field("bytes", "bigint"))


@query("a07_parse_csv", B.with_tables("numbered", f"""
SELECT upload_id, line_number_kept + 1 AS line_number, {_CSV}, 'note ' || (id % 7) || ', quoted "x"' AS remark, id % 100 AS score
FROM numbered WHERE kind = 2"""))
def _(spark, folder):
    found = parsers.parse_csv(lines.records(spark, folder, "csv"))
    return _parsed(found, _field("remark"), _field("score", "bigint"))


@query("a08_parse_json", B.with_tables("numbered", f"""
SELECT upload_id, record_number AS line_number, {_JSON}, message FROM numbered WHERE kind = 3 AND NOT garbage"""))
def _(spark, folder):
    return _parsed(parsers.parse_json(lines.records(spark, folder, "json")), _field("message"))


@query("a09_parse_generic", B.with_tables("numbered", f"""
SELECT upload_id, line_number_kept AS line_number, {_GENERIC} FROM (SELECT *, {_GENERIC_TEXT} AS body FROM numbered WHERE kind = 4)"""))
def _(spark, folder):
    return _parsed(parsers.parse_generic(lines.records(spark, folder, "generic")))


# ---- older authentication schema ----------------------------------------------------------

_AUTH_STAMP = "strftime(moment, '%b %d %H:%M:%S')"


@query("a10_parse_auth_lines", B.with_tables("messages", f"""
SELECT * FROM (
  SELECT id, {_AUTH_STAMP} AS "timestamp", CASE WHEN id % 3 = 0 THEN '' ELSE 'host' || (id % 4) END AS host,
    CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN 'sshd' WHEN lower(body) LIKE '%sudo%' THEN 'sudo' WHEN id % 3 = 0 THEN '' ELSE 'cron' END AS source,
    regexp_extract(body, '{V.AUTH_IP}', 1) AS ip, {Q.AUTH_USER.format('body', 'event_type')} AS "user", event_type,
    {Q.AUTH_STATUS.format('event_type')} AS status
  FROM (SELECT id, moment, body, {Q.AUTH_EVENT.format('body')} AS event_type FROM (SELECT id, moment, {Q.AUTH_LINE} AS body FROM messages)))
WHERE event_type <> 'unknown'"""))
def _(spark, folder):
    n, body = F.col("id"), Q.auth_message()
    stamp = F.date_format("moment", "MMM dd HH:mm:ss")
    process = F.when(n % 5 == 0, "CRON").otherwise("sshd[77]")
    raw = F.when(n % 3 == 0, Q.text(" ", stamp, " ", body)).otherwise(Q.text(stamp, " host", n % 4, " ", process, ": ", body, " "))
    return parsers.parse_auth_lines(lines.messages(spark, folder).select("id", raw.alias("raw")))


@query("a11_parse_auth_csv", B.with_tables("messages", """
SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS "timestamp", '' AS host,
  CASE WHEN id % 2 = 0 THEN 'sshd' ELSE 'firewall' END AS source, coalesce(ip_address, '') AS ip, coalesce(username, '') AS "user",
  event_type, CASE status WHEN 'FAILED' THEN 'failure' WHEN 'SUCCESS' THEN 'success' ELSE 'unknown' END AS status
FROM messages"""))
def _(spark, folder):
    rows = lines.messages(spark, folder).select(
        F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "SSHD").otherwise("Firewall").alias("source"), F.col("ip_address").alias("ip"),
        "username", F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))).alias("event"), "status")
    return parsers.parse_auth_csv(rows)


# ---- dead letters, summary, stored rows and exports ----------------------------------------

def _all_parsed(spark, folder):
    return parsers.parse_records(lines.records(spark, folder), lines.YEAR)


@query("a12_dead_letter", B.with_tables("numbered", """
SELECT upload_id, upload_id AS source_filename, ['syslog','apache_combined','csv','json','generic'][1 + kind] AS format,
  CASE WHEN kind = 3 THEN physical ELSE line_number_kept END AS line_number,
  CASE WHEN kind = 3 THEN 'Invalid JSON: not a single well-formed document' ELSE 'No regex match' END AS reason,
  CASE WHEN kind = 3 THEN '{broken ' ELSE 'garbage ' || id END AS raw
FROM numbered WHERE garbage AND kind IN (0, 1, 3)"""))
def _(spark, folder):
    return parsers.dead_letter(_all_parsed(spark, folder))


@query("a13_parse_summary", B.with_tables("numbered", """
SELECT upload_id, upload_id AS source_filename, ['syslog','apache_combined','csv','json','generic'][1 + min(kind)] AS format,
  count(*) + CASE WHEN min(kind) = 2 THEN 1 ELSE 0 END AS total_lines,
  count(*) FILTER (WHERE NOT is_comment AND NOT (garbage AND kind IN (0, 1, 3))) AS parsed_entries,
  count(*) FILTER (WHERE garbage AND kind IN (0, 1, 3)) AS skipped_lines, CAST(NULL AS VARCHAR) AS code
FROM numbered GROUP BY upload_id"""))
def _(spark, folder):
    return parsers.parse_summary(_all_parsed(spark, folder), lines.accepted_files(spark, folder))


def _stored_sql() -> str:
    def part(kind: int, number: str, columns: str, where: str = "NOT garbage", body: str = "NULL") -> str:
        return (f"SELECT upload_id, {number} AS line_number, kind, {columns} "
                f"FROM (SELECT *, {body} AS body FROM numbered) WHERE kind = {kind} AND {where}")

    union = " UNION ALL ".join([
        part(0, "line_number_kept", _SYSLOG, "NOT garbage AND NOT is_comment"), part(1, "line_number_kept", _APACHE),
        part(2, "line_number_kept + 1", _CSV, "true"), part(3, "record_number", _JSON),
        part(4, "line_number_kept", _GENERIC, "true", _GENERIC_TEXT)])
    return B.with_tables("numbered", f"""
SELECT upload_id, ['syslog','apache_combined','csv','json','generic'][1 + kind] AS source_format, line_number,
  epoch_us(strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ')) AS event_timestamp, ip_address, username, event_type, upper(status) AS status,
  upper(severity) AS severity, 1706659200000000 AS ingested_at FROM ({union})""")


@query("a14_write_logs", _stored_sql())
def _(spark, folder):
    entries = parsers.entries(_all_parsed(spark, folder))
    rows = sinks.build_log_rows(entries, F.timestamp_micros(F.lit(B.NOW_US)))
    return rows.drop("source_filename", "raw_message", "parsed_data")


@query("a15_sink_json_csv", B.with_tables("messages", """
SELECT id, '{"id":' || id || ',"status":"' || status || '","event_type":"' || event_type || '"}' AS json_line FROM messages"""))
def _(spark, folder):
    """The record text the JSON sink writes, in its fixed column order."""
    rows = lines.messages(spark, folder)
    return rows.select("id", F.to_json(F.struct("id", "status", "event_type")).alias("json_line"))


_CELL = Q.variant_sql("turn", "'=' || text", "'-1 ' || role", "'say \"' || role || '\"'", "text", "'@' || role", "NULL")


@query("a16_export_csv", f"""
SELECT conv_id, turn, {S.csv_guard('conv_id')} || ',' || {S.csv_guard('cell')} AS line
FROM (SELECT conv_id, turn, {_CELL} AS cell FROM conversations)""")
def _(spark, folder):
    role = F.col("role")
    cell = Q.variant(F.col("turn"), F.concat(F.lit("="), "text"), Q.text("-1 ", role), Q.text('say "', role, '"'), F.col("text"),
                     Q.text("@", role), F.lit(None).cast("string"))
    rows = B.table(spark, folder, "conversations").select("conv_id", "turn", cell.alias("cell"))
    return rows.select("conv_id", "turn", F.concat_ws(",", sinks.csv_guard(F.col("conv_id")), sinks.csv_guard(F.col("cell"))).alias("line"))


# ---- files of any size, read by splits ------------------------------------------------------

@query("a02b_size_limit", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'INVALID_FILE_TYPE' WHEN doc_id % 10 = 1 THEN 'INVALID_MIME_TYPE' WHEN size > 2000 THEN 'FILE_TOO_LARGE'
    WHEN doc_id % 10 = 2 THEN 'EMPTY_FILE' WHEN doc_id % 10 = 3 THEN 'BINARY_FILE'
    WHEN doc_id % 10 = 4 THEN CASE WHEN regexp_matches(text, '[\\x{80}-\\x{FF}]') THEN 'ENCODING_ERROR' END END AS code
FROM (SELECT doc_id, text, CASE doc_id % 10 WHEN 2 THEN 4 WHEN 3 THEN strlen(text) + 1 WHEN 4 THEN length(text) ELSE strlen(text) END AS size FROM documents)""")
def _(spark, folder):
    return files.validate_files(_candidate_files(spark, folder), max_file_bytes=2000).select("doc_id", "code")


@query("a03b_split_lines", f"""
SELECT 'docs' || (doc_id // 1000) || '.txt' AS name, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, place) AS line_number, raw
FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS place
  FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAKS}') AS parts FROM documents))
WHERE regexp_matches(raw, '\\S')""")
def _(spark, folder):
    """A thousand documents a file, each file read in many splits."""
    return splits.split_lines(spark, _document_files(spark, folder), name=_named, split_bytes=1 << 18).select("name", "line_number", "raw")


def _split_uploads(spark, folder, texts: DataFrame) -> DataFrame:
    records, _ = splits.split_records(spark, _as_files(texts), name=_named, split_bytes=1 << 13)
    return records.withColumns({"upload_id": F.col("name"), "source_filename": F.col("name")})


def _uploads(spark, folder, ext: str) -> DataFrame:
    found = lines.upload_files(spark, folder).filter(F.col("ext") == ext)
    return found.select("name", F.col("content").cast("string").alias("text"))


@query("a07b_split_csv", CHECKS["a07_parse_csv"])
def _(spark, folder):
    """The CSV files of a07 in splits of 8 kB."""
    found = parsers.parse_csv(_split_uploads(spark, folder, _uploads(spark, folder, "csv")))
    return _parsed(found, _field("remark"), _field("score", "bigint"))


@query("a08b_split_json_lines", CHECKS["a08_parse_json"])
def _(spark, folder):
    """The JSON lines of a08 in splits of 8 kB."""
    return _parsed(parsers.parse_json(_split_uploads(spark, folder, _uploads(spark, folder, "jsonl"))), _field("message"))


@query("a08c_split_json_document", CHECKS["a08_parse_json"])
def _(spark, folder):
    """The good lines of each file of a08 as one array under a key, all on one line, in splits of 8 kB."""
    texts = _uploads(spark, folder, "jsonl")
    good = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"\S") & ~line.startswith("{broken"))
    document = F.concat(F.lit('{"source": "export, part [1] of {1}", "events": ['), F.array_join(good, ", "), F.lit('], "more": [{"events": [1]}]}'))
    return _parsed(parsers.parse_json(_split_uploads(spark, folder, texts.select("name", document.alias("text")))), _field("message"))


@query("a13b_split_summary", CHECKS["a13_parse_summary"])
def _(spark, folder):
    """All formats of a13 in splits of 8 kB; the files are read and parsed once."""
    texts = lines.upload_files(spark, folder).select("name", F.col("content").cast("string").alias("text"))
    records, found = splits.split_records(spark, _as_files(texts), name=_named, split_bytes=1 << 13)
    ids = {"upload_id": F.col("name"), "source_filename": F.col("name")}
    return parsers.parse_summary(parsers.parse_records(records.withColumns(ids), lines.YEAR), found.filter("code IS NULL").withColumns(ids))


_FIELDS = " ".join(f"WHEN {kind} THEN '{','.join([*V.CORE_FIELDS, *V.FORMAT_FIELDS[name]])}'"
                   for kind, name in ((0, "syslog"), (1, "apache_combined"), (3, "json"), (4, "generic")))


@query("a13c_summary_fields", B.with_tables("numbered", f"""
SELECT upload_id, count(*) + CASE WHEN min(kind) = 2 THEN 1 ELSE 0 END AS total_lines,
  CASE min(kind) {_FIELDS} ELSE '{",".join(V.CORE_FIELDS)},source_ip,user,event,result,remark,score' END AS fields
FROM numbered GROUP BY upload_id"""))
def _(spark, folder):
    found = lines.accepted_files(spark, folder)
    described = found.withColumn("fields", parsers.format_fields(found))
    return parsers.parse_summary(_all_parsed(spark, folder), described).select("upload_id", "total_lines", "fields")
