"""Detection rules: pinned cases, and random streams against a step-by-step model."""

import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from logvigil.operators import detection as D

BASE = datetime(2026, 6, 14, 2, 11, 0, tzinfo=timezone.utc)
SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType()), T.StructField("line_number", T.LongType()),
    T.StructField("event_timestamp", T.TimestampType()), T.StructField("ip_address", T.StringType()),
    T.StructField("username", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("status", T.StringType()),
])


def rec(line, second, ip=None, user=None, event_type="login_attempt", status="FAILED", upload="u"):
    moment = None if second is None else BASE + timedelta(seconds=second)
    return (upload, line, moment, ip, user, event_type, status)


def alerts(spark, records, *rules, partitions=None):
    frame = spark.createDataFrame(records, SCHEMA)
    return D.run_detection(frame, list(rules) or None, partitions).collect()


def fails(n, gap, ip="203.0.113.4", user="root", first=1, **more):
    return [rec(first + i, i * gap, ip, user, **more) for i in range(n)]


CASES = [
    ("at threshold", D.brute_force_login(), fails(5, 2), 1),
    ("below", D.brute_force_login(), fails(4, 2), 0),
    ("spread out", D.brute_force_login(), fails(5, 30), 0),
    ("successes only", D.brute_force_login(), fails(5, 2, status="SUCCESS"), 0),
    ("two sources", D.brute_force_login(),
     fails(3, 2, ip="1.1.1.1") + fails(3, 2, ip="2.2.2.2", first=4), 0),
    ("no time", D.brute_force_login(), [rec(i, None, "1.1.1.1", "root") for i in range(5)], 0),
    ("three users", D.invalid_user_enumeration(),
     [rec(i + 1, i * 60, "1.1.1.1", u) for i, u in enumerate(["alice", "bob", "charlie"])], 1),
    ("one user", D.invalid_user_enumeration(), fails(10, 10), 0),
    ("two users", D.invalid_user_enumeration(),
     [rec(1, 0, "1.1.1.1", "a"), rec(2, 1, "1.1.1.1", "b")], 0),
    ("users spread out", D.invalid_user_enumeration(window_seconds=60),
     [rec(i + 1, i * 120, "1.1.1.1", u) for i, u in enumerate("abc")], 0),
    ("no user", D.invalid_user_enumeration(), [rec(i, i, "1.1.1.1", None) for i in range(5)], 0),
    ("sudo", D.sudo_failure(), fails(3, 30, user="jdoe", event_type="privilege_escalation"), 1),
    ("sudo two", D.sudo_failure(), fails(2, 30, event_type="privilege_escalation"), 0),
    ("sudo spread out", D.sudo_failure(window_seconds=60),
     fails(3, 180, event_type="privilege_escalation"), 0),
    ("sudo users share ip", D.sudo_failure(),
     fails(2, 5, user="a", event_type="privilege_escalation")
     + fails(2, 5, user="b", first=3, event_type="privilege_escalation"), 0),
    ("five sources", D.password_spraying(),
     [rec(i + 1, i * 60, f"10.0.0.{i}", "admin") for i in range(5)], 1),
    ("four sources", D.password_spraying(),
     [rec(i + 1, i * 60, f"10.0.0.{i}", "admin") for i in range(4)], 0),
    ("one source", D.password_spraying(), fails(10, 5), 0),
    ("burst then success", D.credential_stuffing(),
     fails(5, 2) + [rec(6, 30, "203.0.113.4", "root", status="SUCCESS")], 1),
    ("burst alone", D.credential_stuffing(), fails(5, 2), 0),
    ("no burst", D.credential_stuffing(),
     fails(3, 2) + [rec(4, 10, "203.0.113.4", "root", status="SUCCESS")], 0),
    ("late success", D.credential_stuffing(success_window_seconds=30),
     fails(5, 2) + [rec(6, 300, "203.0.113.4", "root", status="SUCCESS")], 0),
    ("success elsewhere", D.credential_stuffing(),
     fails(5, 2) + [rec(6, 30, "2.2.2.2", "root", status="SUCCESS")], 0),
    ("scan", D.port_scan(), fails(10, 1, event_type="port_scan"), 1),
    ("scan nine", D.port_scan(), fails(9, 1, event_type="port_scan"), 0),
    ("scan slow", D.port_scan(), fails(10, 30, event_type="port_scan"), 0),
    ("not a scan", D.port_scan(), fails(10, 1), 0),
]


@pytest.fixture(scope="module")
def case_counts(spark):
    """Every case as an upload of its own, every case's rule in one run."""
    records = [(name, *r[1:]) for name, _, rows, _ in CASES for r in rows]
    found = alerts(spark, records, *[replace(rule, name=name) for name, rule, _, _ in CASES], partitions=5)
    return Counter(a["rule"] for a in found if a["rule"] == a["upload_id"])


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES])
def test_rule(case_counts, name, expected):
    assert case_counts[name] == expected


def test_alert_fields(spark):
    brute, = alerts(spark, fails(5, 2), D.brute_force_login())
    assert (brute["rule"], brute["severity"], brute["source_ip"], brute["username"], brute["count"]) == (
        "brute_force_login", "HIGH", "203.0.113.4", "root", 5)
    assert brute["matched_line_numbers"] == [1, 2, 3, 4, 5]
    assert (brute["first_seen"], brute["last_seen"]) == ("2026-06-14T02:11:00Z", "2026-06-14T02:11:08Z")
    assert brute["description"] == (
        "Brute-force detected from 203.0.113.4: 5 failed login attempts within 60s.")
    spray, = alerts(spark, [rec(i + 1, i * 60, f"10.0.0.{i}", "admin") for i in range(5)],
                    D.password_spraying())
    assert (spray["source_ip"], spray["username"], spray["count"]) == ("10.0.0.4", "admin", 5)
    stuffing, = alerts(spark, fails(5, 2) + [rec(6, 30, "203.0.113.4", "eve", status="SUCCESS")],
                       D.credential_stuffing())
    assert (stuffing["count"], stuffing["username"]) == (6, "eve")
    assert stuffing["matched_line_numbers"] == [1, 2, 3, 4, 5, 6]


def test_all_rules_together_and_custom_rule(spark):
    records = (
        fails(5, 2) + fails(3, 30, user="jdoe", first=20, event_type="privilege_escalation")
        + [rec(40 + i, i * 60, f"10.0.0.{i}", "admin") for i in range(5)]
        + fails(10, 1, ip="9.9.9.9", first=60, event_type="port_scan")
    )
    assert {a["rule"] for a in alerts(spark, records)} == {
        "brute_force_login", "sudo_failure", "password_spraying", "port_scan"}
    assert alerts(spark, [rec(1, 0, "1.1.1.1", "a", status="SUCCESS")]) == []
    custom = lambda logs: D.run_detection(logs, [D.port_scan()]).withColumn("rule", F.lit("mine"))
    frame = spark.createDataFrame(records, SCHEMA)
    found = D.run_detection(frame, [D.sudo_failure(), custom]).collect()
    assert {a["rule"] for a in found} == {"sudo_failure", "mine"}


# ---- a plain model that reads one row after the other -------------------------------------

def model(records, rule):
    groups = {}
    for r in records:
        upload, line, moment, ip, user, event_type, status = r
        if event_type != rule.event_type or (rule.statuses and status not in rule.statuses):
            continue
        if rule.distinct and not (ip and user):
            continue
        subject = {"ip": ip, "user": user, "user_or_ip": user or ip}[rule.subject]
        if subject and moment is not None:
            groups.setdefault((upload, subject), []).append(r)
    found = set()
    for (upload, subject), rows in groups.items():
        rows.sort(key=lambda r: (r[2], r[1]))
        held, burst = [], None
        for r in rows:
            if rule.is_burst and r[6] == "SUCCESS":
                if burst and (r[2] - burst[-1][2]).total_seconds() <= rule.success_window_seconds:
                    found.add((upload, subject, len(burst) + 1, tuple(b[1] for b in burst) + (r[1],)))
                held, burst = [], None
                continue
            held = [h for h in held + [r] if (r[2] - h[2]).total_seconds() <= rule.window_seconds]
            column = {"username": 4, "ip_address": 3, None: 1}[rule.distinct]
            size = len({h[column] for h in held})
            if size >= rule.threshold:
                if rule.is_burst:
                    burst = held
                else:
                    found.add((upload, subject, size, tuple(h[1] for h in held)))
                    held = []
    return found


RULES = [
    D.brute_force_login(3, 20), D.invalid_user_enumeration(3, 40), D.sudo_failure(2, 15),
    D.password_spraying(4, 60), D.credential_stuffing(3, 25, 30), D.port_scan(1, 10),
    D.port_scan(6, 12), D.credential_stuffing(1, 5, 9), D.invalid_user_enumeration(2, 5),
]


@pytest.fixture(params=[50, 10_000])
def batch_rows(spark, request):
    """Rows a task sees at once: with 50, subjects and windows go over many batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", range(6))
def test_matches_model_with_hot_subject(spark, seed, batch_rows):
    """One source holds most rows, so its rows spread over many pieces."""
    rng = random.Random(seed)
    dense = rng.choice([1, 4, 30])
    records, second = [], 0
    for line in range(1, 700):
        second += rng.choice([0, 0, 1, 1, 2, dense])
        if rng.random() < 0.01:
            second += 100
        records.append(rec(
            line, None if rng.random() < 0.02 else second,
            rng.choice(["9.9.9.9"] * 6 + ["1.1.1.1", "2.2.2.2", "3.3.3.3", None, ""]),
            rng.choice(["root"] * rng.choice([1, 12]) + ["a", "b", "c", None]),
            rng.choice(["login_attempt"] * 6 + ["privilege_escalation", "port_scan"]),
            rng.choice(["FAILED"] * rng.choice([3, 20]) + ["SUCCESS"]),
            rng.choice(["u1"] * 5 + ["u2"]),
        ))
    rng.shuffle(records)
    rules = [replace(rule, name=f"{i}") for i, rule in enumerate(RULES)]
    frame = spark.createDataFrame(records, SCHEMA).cache()
    for partitions in (1, 7, 60):
        found = D.run_detection(frame, rules, partitions).collect()
        for rule in rules:
            by_user = rule.subject == "user"
            actual = sorted(
                (a["upload_id"], a["username"] if by_user else "", a["count"],
                 tuple(sorted(a["matched_line_numbers"]))) for a in found if a["rule"] == rule.name)
            expected = sorted(
                (u, s if by_user else "", n, tuple(sorted(m))) for u, s, n, m in model(records, rule))
            assert actual == expected, (rule, partitions)


def test_what_a_task_keeps_between_batches_does_not_grow():
    import pandas as pd

    for rule, most in ((D.brute_force_login(5, 60), 4), (D.invalid_user_enumeration(3, 40), 41), (D.credential_stuffing(3, 25, 30), 57)):
        for n in (200, 20_000):
            rows = pd.DataFrame({"rule_no": 0, "upload_id": "u", "subject": "s", "us": np.arange(n) * D.MICROS, "line_number": np.arange(n), "dim": "FAILED"})
            piece = D.Piece(rows, [rule])
            kept = piece.open_rows(list(piece.picked(-1)))
            assert kept.stop == n and kept.stop - kept.start <= most
            summary = (D.BurstSummary if rule.is_burst else D.CountSummary)((0, "u", "s"), [rule])
            for at in range(0, n, 100):
                summary.add(rows.iloc[at : at + 100], at)
            assert len(summary.rows) <= rule.threshold and len(summary.head) < rule.threshold
