"""File admission, splitting and parsing on small files."""

import json

import pytest
from pyspark.sql import functions as F

from logvigil.sources import files as S, parsers as P, sinks
from logvigil.streaming import uploads

SYSLOG = """# a comment
Jun 14 02:11:43 server01 sshd[1234]: Failed password for root from 203.0.113.4 port 22 ssh2

Jun 14 02:11:45 server01 sshd[1235]: Invalid user admin from 203.0.113.4 port 22 ssh2
Jun 14 02:15:11 server01 sudo[2001]: pam_unix(sudo:auth): authentication failure; logname=jdoe uid=1000 user=jdoe
not a syslog line
Jun 14 02:19:01 server01 sshd[1240]: Connection closed by 10.0.0.5 port 34567
"""
APACHE = """10.0.0.9 - - [10/Oct/2000:13:55:36 -0700] "GET /a b HTTP/1.1" 200 -
10.0.0.9 - bob [10/Oct/2000:13:55:37 -0700] "POST /x HTTP/1.0" 404 12 "-" "Agent \u0001 1"
broken
"""
CSV = 'Time Stamp,timestamp,ip,Status,Result,note\n1,2026-06-14T00:00:00Z,,fail,fail,"line one\nhas 10.9.8.7, ""quoted"""\n2,x,1.2.3.4,,ok\n'
JSONL = '{"user": {"name": "sam"}, "source": {"ip": "1.2.3.4"}, "event": {"action": "login", "outcome": "failure"}}\n{bad\n[1, {"user": "ann", "level": "[high]"}]\n{"logs": [{"account": "x"}]}\n'


def ingest(spark, tmp_path, files, limit=None):
    for name, content in files.items():
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    checked = S.validate_files(S.scan_files(spark, str(tmp_path), max_file_bytes=limit), limit)
    found = S.with_lines(S.admitted(checked)).withColumns({"upload_id": F.col("name"), "source_filename": F.col("name")})
    return checked, found, P.parse_records(S.explode_records(found), 2026)


def test_admission(spark, tmp_path):
    checked, _, _ = ingest(spark, tmp_path, {
        "a.exe": "x", "blank.log": " \n\t", "nul.log": b"a\x00b", "latin.csv": "caf\xe9".encode("latin-1"), "noext": "x",
        "big.log": b"x" * (10 * 1024 * 1024 + 1), "fine.JSONL": "{}", "edge.log": b"y" * (10 * 1024 * 1024)}, 10 * 1024 * 1024)
    codes = {r["name"]: r["code"] for r in checked.select("name", "code").collect()}
    assert codes == {"a.exe": "INVALID_FILE_TYPE", "blank.log": "EMPTY_FILE", "nul.log": "BINARY_FILE", "latin.csv": "ENCODING_ERROR",
                     "noext": "INVALID_FILE_TYPE", "big.log": "FILE_TOO_LARGE", "fine.JSONL": None, "edge.log": None}


def test_no_size_limit_unless_asked(spark, tmp_path):
    (tmp_path / "big.log").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    assert S.validate_files(S.scan_files(spark, str(tmp_path))).first()["code"] is None


def test_format_over_all_lines(spark, tmp_path):
    (tmp_path / "late.log").write_text("banner\n" * 6 + "Jun 14 02:11:00 web1 sshd[1]: Failed password for bob from 10.0.0.1 port 22 ssh2\n")
    files = S.admitted(S.validate_files(S.scan_files(spark, str(tmp_path))))
    assert S.with_lines(files).first()["format"] == "generic"
    assert S.with_lines(files, sample_lines=None).first()["format"] == "syslog"


def test_empty_values_and_repeated_keys(spark, tmp_path):
    _, _, parsed = ingest(spark, tmp_path, {
        "a.log": 'hello {"ip": "", "user": ""} from 10.1.2.3\n',
        "b.json": '[{"user":"a","user":"b","ip":"1.2.3.4","event":"login","status":"ok"}]'})
    found = {r["upload_id"]: (r["ip_address"], r["username"], r["reason"]) for r in parsed.collect()}
    assert found == {"a.log": ("10.1.2.3", None, None), "b.json": ("1.2.3.4", "b", None)}


def test_mime_is_checked_before_size(spark):
    row = spark.createDataFrame([("a", "log", 99_999_999, b"x", "image/png")], "name string, ext string, length long, content binary, content_type string")
    assert S.validate_files(row).first()["code"] == "INVALID_MIME_TYPE"


def test_syslog(spark, tmp_path):
    _, files, parsed = ingest(spark, tmp_path, {"auth.log": SYSLOG})
    assert files.first()["format"] == "syslog" and files.first()["total_lines"] == 6
    rows = parsed.orderBy("line_number").collect()
    assert [(r["line_number"], r["reason"]) for r in rows] == [(2, None), (3, None), (4, None), (5, "No regex match"), (6, None)]
    assert [(r["event_type"], r["status"], r["username"], r["ip_address"]) for r in rows if r["reason"] is None] == [
        ("login_attempt", "FAILED", "root", "203.0.113.4"), ("login_attempt", "FAILED", "admin", "203.0.113.4"),
        ("privilege_escalation", "FAILED", "jdoe", None), ("connection_closed", "INFO", None, "10.0.0.5")]
    assert json.loads(rows[0]["parsed_data"])["pid"] == 1234 and rows[0]["timestamp"] == "2026-06-14T02:11:43Z"


def test_apache(spark, tmp_path):
    _, _, parsed = ingest(spark, tmp_path, {"web.log": APACHE})
    first, second, bad = parsed.orderBy("line_number").collect()
    assert (first["event_type"], first["status"], first["username"]) == ("http_get", "SUCCESS", None)
    assert json.loads(first["parsed_data"])["bytes"] == 0 and json.loads(first["parsed_data"])["protocol"] == "b HTTP/1.1"
    data = json.loads(second["parsed_data"])
    assert (second["status"], data["referer"], data["user_agent"], data["user"]) == ("FAILED", None, "Agent \u0001 1", "bob")
    assert bad["reason"] == "No regex match"


def test_csv(spark, tmp_path):
    _, _, parsed = ingest(spark, tmp_path, {"x.csv": CSV, "empty_header.csv": "\na,b\n1,2\n"})
    good = parsed.filter("source_filename = 'x.csv'").orderBy("line_number").collect()
    assert [r["line_number"] for r in good] == [2, 3]
    # a column named status stays as written; the address is found in free text
    assert (good[0]["status"], good[0]["ip_address"], good[1]["status"], good[1]["ip_address"]) == ("fail", "10.9.8.7", None, "1.2.3.4")
    data = json.loads(good[0]["parsed_data"])
    assert data["time_stamp"] == 1 and data["note"] == 'line one\nhas 10.9.8.7, "quoted"' and data["ip"] is None
    assert parsed.filter("source_filename = 'empty_header.csv'").first()["reason"] == "No header row found"


def test_csv_without_override(spark, tmp_path):
    (tmp_path / "x.csv").write_text("status,user\nfail,1001\n")
    files = S.with_lines(S.admitted(S.validate_files(S.scan_files(spark, str(tmp_path))))).withColumns(
        {"upload_id": F.col("name"), "source_filename": F.col("name")})
    row = P.parse_csv(S.explode_records(files), csv_override=False).first()
    assert (row["status"], row["username"]) == ("FAILED", "1001")


def test_json(spark, tmp_path):
    _, _, parsed = ingest(spark, tmp_path, {"x.jsonl": JSONL, "one.json": '{"events": [{"b": 1, "a": 2}, 5]}', "obj.json": '{"message": "from 9.9.9.9"}'})
    rows = parsed.filter("source_filename = 'x.jsonl'").collect()
    good = {r["line_number"]: r for r in rows if r["reason"] is None}
    assert (good[1]["username"], good[1]["ip_address"], good[1]["event_type"], good[1]["status"]) == ("sam", "1.2.3.4", "login", "FAILED")
    assert (good[3]["username"], good[3]["severity"], good[4]["username"]) == ("ann", "[high]", "x")
    reasons = sorted((r["line_number"], r["reason"].split(":")[0]) for r in rows if r["reason"])
    assert reasons == [(2, "Invalid JSON"), (2, "JSON event must be an object.")]
    one = parsed.filter("source_filename = 'one.json'").orderBy("line_number").collect()
    assert one[0]["raw"] == '{"b":1,"a":2}' and one[1]["reason"] == "JSON event must be an object."
    assert parsed.filter("source_filename = 'obj.json'").first()["ip_address"] == "9.9.9.9"


def test_generic_and_summary(spark, tmp_path):
    line = '2026-01-02 03:04:05 WARN src=4.4.4.4 status=ok {"user": "eve", "status": "denied"} hello'
    _, files, parsed = ingest(spark, tmp_path, {"g.log": line + "\n\nplain", "c.log": "# x\nJun 14 02:11:43 h p: m\n", "n.json": "[]"})
    row = parsed.filter("source_filename = 'g.log'").orderBy("line_number").first()
    assert (row["ip_address"], row["username"], row["status"], row["severity"], row["timestamp"]) == (
        "4.4.4.4", "eve", "SUCCESS", "WARN", "2026-01-02 03:04:05")
    summary = {r["upload_id"]: r for r in P.parse_summary(parsed, files).collect()}
    assert summary["g.log"]["parsed_entries"] == 2 and summary["n.json"]["code"] == "NO_PARSEABLE_EVENTS"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 'a"b'), ("x\ny", None)], "id string, title string")
    sinks.export_csv(rows, str(tmp_path / "out"), ["id", "title"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert '"\'=1","a""b"' in text and '"x y",""' in text and '"id","title"' in text
    sinks.sink_json_csv(rows, str(tmp_path / "both"), ["title", "id"])
    assert spark.read.json(str(tmp_path / "both" / "json")).count() == 2
    _, _, parsed = ingest(spark, (tmp_path / "in") if (tmp_path / "in").mkdir() is None else tmp_path, {"auth.log": SYSLOG})
    stored = sinks.build_log_rows(P.entries(parsed), F.to_timestamp(F.lit("2026-07-01")))
    sinks.write_logs(stored, str(tmp_path / "logs"))
    back = spark.read.parquet(str(tmp_path / "logs"))
    assert back.count() == 4 and back.filter("status = 'FAILED' and event_timestamp is not null").count() == 3


@pytest.mark.parametrize("runs", [2])
def test_upload_stream(spark, tmp_path, runs):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    burst = "".join(f"Jun 14 02:11:{40 + i} h sshd[{i}]: Failed password for root from 203.0.113.4 port 22 ssh2\n" for i in range(6))
    (inbox / "a.log").write_text(burst)
    (inbox / "b.exe").write_text("x")
    for _ in range(runs):  # the second run finds nothing new
        uploads.upload_stream(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "state"), 2026).awaitTermination()
    alerts = spark.read.parquet(str(tmp_path / "out" / "alerts")).collect()
    assert [(a["rule"], a["event_count"]) for a in alerts] == [("brute_force_login", 5)]
    assert spark.read.parquet(str(tmp_path / "out" / "logs")).count() == 6
    assert spark.read.parquet(str(tmp_path / "out" / "rejected_files")).first()["code"] == "INVALID_FILE_TYPE"


@pytest.mark.parametrize("by_split", [False, True])
def test_stored_ids_connect_ingest_with_the_dashboard(spark, tmp_path, by_split):
    from logvigil.operators import dashboard, evidence

    burst = lambda n, ip: "".join(f"Jun 14 02:11:{10 + i} h sshd[{i}]: Failed password for root from {ip} port 22 ssh2\n" for i in range(n))
    files = {"a.log": burst(6, "203.0.113.4"), "b.csv": CSV, "c.jsonl": JSONL, "d.exe": "x", "big.log": burst(40, "203.0.113.9")}
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    stream = lambda: uploads.upload_stream(spark, str(inbox), out, str(tmp_path / "state"), 2026, max_file_bytes=2000, by_split=by_split).awaitTermination()
    for name in ("a.log", "b.csv", "d.exe"):
        (inbox / name).write_text(files[name])
    stream()
    for name in ("c.jsonl", "big.log"):
        (inbox / name).write_text(files[name])
    (inbox / "e.log").write_text(burst(11, "198.51.100.7"))
    stream()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert {(r["name"], r["code"]) for r in read("rejected_files").collect()} == {("d.exe", "INVALID_FILE_TYPE"), ("big.log", "FILE_TOO_LARGE")}

    def stored():
        return [sorted((r["id"], r["upload_id"], r["line_number"], r["raw_message"]) for r in read("logs").collect()),
                sorted((r["id"], r["upload_id"], r["rule"], tuple(r["matched_line_numbers"])) for r in read("alerts").collect())]

    logs, alerts = stored()
    assert [r[0] for r in logs] == list(range(1, len(logs) + 1)) and [r[0] for r in alerts] == [1, 2, 3]
    # A batch that is run again takes the same ids.
    again = spark.read.format("binaryFile").load([str(inbox / n) for n in ("c.jsonl", "big.log", "e.log")])
    uploads.process_files(again.drop("content") if by_split else again, 1, out, 2026, max_file_bytes=2000)
    assert {r[0] for r in stored()[0]} == {r[0] for r in logs} and stored()[1] == alerts
    assert sorted(r[2:] for r in stored()[0]) == sorted(r[2:] for r in logs)
    events = evidence.evidence_join(read("logs"), read("alerts"))
    view = evidence.alert_view(read("alerts"), read("logs"))
    shown = {r["backend_id"]: set(r["evidence_ids"]) for r in view.collect()}
    assert [len(shown[i]) for i in (1, 2, 3)] == [5, 5, 5]
    listed = {r["id"] for r in events.filter("source_alert_id IS NOT NULL").collect()}
    assert listed == set().union(*shown.values())
    incidents = spark.createDataFrame([], "status string")
    stats = dashboard.dashboard_stats(events, view, incidents).first()
    assert (stats["events_ingested"], stats["active_alerts"], stats["new_alerts"]) == (len(logs), 3, 3)


def test_json_lines_are_parsed_a_few_times_each(spark):
    """The number of parsers in the plan does not grow with the container keys: before, each key had two for each use of a document."""
    files = spark.createDataFrame([('{"events": [{"a": 1}, 2]}\n{broken\n{"logs": [{"b": 2}], "data": 1}', "json")], "text string, format string")
    found = S.explode_records(files.withColumn("lines", S.text_lines(F.col("text"))))
    assert found._jdf.queryExecution().analyzed().toString().count("from_json(") < 20
    rows = sorted((r.line_number, r.record, r.raw, r.reason is None) for r in found.collect() if r.record)
    assert rows == [(1, '{"a":1}', '{"a":1}', True), (3, '{"b":2}', '{"b":2}', True)] and found.count() == 4
