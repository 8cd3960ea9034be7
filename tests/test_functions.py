"""Pinned values of the column expressions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logvigil.functions import labels as L, network as N, text as X, timefn as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("function,given,expected", [
    (X.clean_text, " admin \n", "admin"), (X.clean_text, " - ", None), (X.clean_text, "None", None),
    (X.normalize_event_type, "Login Success", "login_success"), (X.normalize_event_type, "", "security_event"),
    (X.normalize_event_type, "--", "security_event"), (X.normalize_status, "success", "SUCCESS"),
    (X.normalize_status, None, "UNKNOWN"), (X.normalize_status, "log_in  failed", "LOG IN FAILED"),
    (X.normalize_ip, "999.999.999.999", None), (X.normalize_ip, " 10.0.0.7 ", "10.0.0.7"),
    (X.first_ip, "connection from 10.0.0.7 port 22", "10.0.0.7"), (X.first_ip, "from 1.2.3.400 here", None),
    (X.status_from_text, "request rejected by policy", "FAILED"), (X.status_from_text, "health check passed", "SUCCESS"),
    (X.status_from_text, "service started", "INFO"), (X.status_from_text, "nothing", "UNKNOWN"),
    (X.event_type_from_text, "sudo auth failure", "privilege_escalation"),
    (X.username_from_text, "vpn from user analyst-1 at 10.0.0.5", "analyst-1"),
    (X.username_from_text, "auth user: SOC_admin result=ok", "SOC_admin"),
    (X.username_from_text, "username=svc.account action=login", "svc.account"),
    (X.username_from_text, "jdoe : TTY=pts/0 ; PWD=/", "jdoe"), (X.username_from_text, "no name", None),
    (X.severity_from_text, "critical error", "CRITICAL"), (X.severity_from_text, "transferred", "ERROR"),
    (X.extract_level, "a Warning here", "WARNING"), (X.csv_guard, '=HYPERLINK("https://example.com")',
     '"\'=HYPERLINK(""https://example.com"")"'), (X.csv_guard, "a\r\nb", '"a b"'), (X.csv_guard, None, '""'),
    (N.optional_ip, "10.0.0.5", "10.0.0.5"), (N.optional_ip, "010.0.0.5", None), (N.optional_ip, "2001:DB8::10", "2001:db8::10"),
    (N.optional_ip, "x", None), (L.backend_id, "ALT-0012", 12), (L.backend_id, "ALT-0000", None), (L.backend_id, "none", None),
    (L.alert_status_view, "REVIEWING", "investigating"), (L.alert_status_view, " Odd ", "odd"),
    (L.incident_status_view, "CLOSED", "resolved"), (L.incident_status_view, None, "unknown"),
])
def test_expression(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_display_id_keeps_long_numbers(spark):
    assert value(spark, L.display_id("ALT", F.lit(7))) == "ALT-0007"
    assert value(spark, L.display_id("ALT", F.lit(123456))) == "ALT-123456"


@pytest.mark.parametrize("ip,country,label", [
    ("10.0.0.5", None, "Private network"), ("127.0.0.1", None, "Loopback address"), ("203.0.113.4", None, "Documentation range"),
    ("2001:db8::10", None, "Documentation range"), ("8.8.8.8", "United States", "United States"), ("8.8.8.8", None, "Unknown location"),
    ("not-an-ip", None, "Unknown location"), ("300.1.1.1", None, "Unknown location"), (None, None, "Unknown location"),
])
def test_describe_ip(spark, ip, country, label):
    code = F.lit("us" if country else None).cast("string")
    place = value(spark, N.describe_ip(F.lit(ip).cast("string"), code, F.lit(country).cast("string")))
    assert place["label"] == label
    if country:
        assert (place["code"], place["type"]) == ("US", "country")


@pytest.mark.parametrize("raw,expected", [
    ("2026-06-14T02:11:43Z", "2026-06-14T02:11:43Z"), ("2026-06-14 02:11:43", "2026-06-14T02:11:43Z"),
    ("2026-06-14T02:11:43+02:00", "2026-06-14T00:11:43Z"), ("02:11:43", None), ("", None), ("Jun 14 02:11:43", None),
])
def test_event_time(spark, raw, expected):
    assert value(spark, T.format_ts_z(T.parse_event_ts(F.lit(raw)))) == expected


def test_detector_and_format_times(spark):
    assert value(spark, T.format_ts_z(T.parse_detector_ts(F.lit("Jun  4 02:11:43"), 2026))) == "2026-06-04T02:11:43Z"
    assert value(spark, T.format_ts_z(T.parse_detector_ts(F.lit("10/Oct/2000:13:55:36"), 2026))) == "2026-10-10T13:55:36Z"
    assert value(spark, T.apache_date(F.lit("10/Oct/2000:13:55:36 -0700"))) == "2000-10-10T13:55:36Z"
    assert value(spark, T.apache_date(F.lit("10/Xyz/2000:13:55:36 +0000"))) == "2000-01-10T13:55:36Z"
    assert value(spark, T.apache_date(F.lit("10/Oct/2000"))) == "10/Oct/2000"
    assert value(spark, T.syslog_date(F.lit("Jun 99 00:00:00"), 2026)) == "Jun 99 00:00:00"


def test_key_values_and_cells(spark):
    line = F.lit('a=1 b="x y" a=2 c="" d=p/q:1-2')
    assert value(spark, X.extract_kv(line)) == {"b": "x y", "a": "2", "c": None, "d": "p/q:1-2"}
    assert value(spark, X.extract_kv(F.lit("none"))) is None
    assert value(spark, X.extract_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert value(spark, X.extract_json(F.lit("x {a} y"))) is None
    kinds = {"7": ("int", "7"), "007": ("int", "7"), "1.50": ("float", "1.5"), "true": ("bool", "True"), " - ": ("null", None),
             "x": ("string", "x"), "1e2": ("float", "100.0")}
    for raw, expected in kinds.items():
        assert tuple(value(spark, X.coerce_cell(F.lit(raw)))) == expected


def test_tags(spark):
    tags = F.array(*[F.lit(t) for t in (" A", "b", "a", "")])
    assert value(spark, L.normalize_tags(tags)) == ["a", "b"]
    assert value(spark, L.split_tags(F.lit("x, Y,,x"))) == ["x", "y"]
    assert not value(spark, L.tags_valid(F.array(F.lit("t" * 41))))


def test_iso_forms_equal_the_standard_library(spark):
    rng = random.Random(2)
    dates = ["2026-06-14", "20260614", "2026-W24-7", "2026W247", "2026-W24", "2026W24", "2026-W53-1", "2025-W53", "2020-W53-7", "2026-13-01", "20260230", "2026-W00-1",
             "2026-061", "2024-02-29", "2023-0229", "2021-W01-1"]
    times = ["02", "02:11", "0211", "02:11:43", "021143", "021143.5", "02:11:43,123456789", "24:00", "02:60", "0211:43", "02:11:60", "2", "235959.9999999", ""]
    zones = ["", "Z", "+02", "-0530", "+05:30", "+05:30:15", "-053015.25", "+24:00", "+5", "z", "+23:59"]
    texts = [rng.choice(dates) + rng.choice(["T", " ", "_", "t", "é"]) + rng.choice(times) + rng.choice(zones) for _ in range(3000)] + dates

    def standard(text):
        try:
            moment = datetime.fromisoformat(text.strip()[:-1] + "+00:00" if text.strip().endswith("Z") else text.strip())
        except ValueError:
            return None
        return (moment.replace(tzinfo=moment.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    frame = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", F.unix_micros(T.parse_event_ts(F.col("raw"))).alias("us"))
    wrong = [(r.raw, r.us, standard(r.raw)) for r in frame.collect() if r.us != standard(r.raw)]
    assert not wrong, wrong[:10]


def test_number_texts_of_cells(spark):
    cases = {"-nan": ("float", "NaN"), "1_000.5": ("float", "1000.5"), "1_0e1_0": ("float", "1.0E11"), "_1": ("string", "_1"), "1_": ("string", "1_"),
             "-000" + "7" * 45: ("int", "-" + "7" * 45), "+" + "0" * 60: ("int", "0"), "-" + "0" * 60: ("int", "0"), "Infinity": ("float", "Infinity"), "info": ("string", "info")}
    rows = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", X.coerce_cell(F.col("raw")).alias("cell")).collect()
    assert {r.raw: (r.cell.kind, r.cell.text) for r in rows} == cases


def test_other_iso_forms_are_taken_apart_once(spark):
    """One match for the parts and one for each form, whatever number of parts there is."""
    plan = spark.range(1).select(T.parse_event_ts(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") == 0 and plan.count("regexp_replace(") == 1
