"""Runs of lines, pages by their last key, and dense numbers on small tables."""

import random
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
import oracle
from logvigil.operators import browse, evidence, pieces
from logvigil.plans import bindings


def test_line_runs_hold_the_same_lines(spark):
    rng = random.Random(4)
    lines = {(a, "u"): sorted(set(rng.choice([range(1, 40), range(1000, 1060), [5000, 5002, 5003]])[i % 3] for i in range(60)) | set(range(2040, 2050 + a))) for a in range(5)}
    frame = spark.createDataFrame([(a, u, n) for (a, u), some in lines.items() for n in some + some[:3]], "alert_id long, upload_id string, line_number long")
    runs = evidence.line_runs(frame, ["alert_id", "upload_id"]).collect()
    for (a, u), some in lines.items():
        mine = sorted((r.first_line, r.last_line, r.bucket) for r in runs if r.alert_id == a)
        assert [n for first, last, _ in mine for n in range(first, last + 1)] == some
        assert all(first // evidence.BUCKET == last // evidence.BUCKET == bucket for first, last, bucket in mine)
        assert all(b[0] > a_[1] + 1 or b[2] > a_[2] for a_, b in zip(mine, mine[1:]))


def test_an_alert_of_very_many_lines_needs_no_array(spark):
    n = 300_000
    lines = spark.range(1, n + 1).select(F.lit(1).cast("bigint").alias("alert_id"), F.lit("u").alias("upload_id"), F.col("id").alias("line_number"))
    runs = evidence.line_runs(lines, ["alert_id", "upload_id"])
    assert runs.count() == n // evidence.BUCKET + 1
    logs = lines.select("upload_id", "line_number", (F.col("line_number") + 7).alias("id")).filter("line_number % 3 = 0")
    rows = evidence.evidence_rows(runs, logs)
    assert rows.count() == n // 3 and rows.select("line_number").distinct().count() == n // 3


def test_pages_by_key_equal_offsets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(57)]
    frame = spark.createDataFrame(rows, "id long, score int, name string")
    for order in ([("score", True), ("name", False), ("id", True)], [("score", False), ("name", True), ("id", False)]):
        whole = [r.id for r in frame.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()]
        seen = []
        for page in browse.pages(frame, order, 10):
            seen.append([r.id for r in page.collect()])
        assert seen[-1] == [] and [i for page in seen for i in page] == whole and [len(p) for p in seen] == [10] * 5 + [7, 0]


def test_dense_numbers_follow_the_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r.k, r.n) for r in pieces.dense_number(frame, ["k"], "n", 5, partitions=6).collect())
    assert got == [(k, k + 5) for k in range(1000)]
    assert pieces.dense_number(frame.limit(0), ["k"], "n").count() == 0


def test_log_view_of_whole_seconds_equals_its_sql(spark, tmp_path):
    """A time without a fraction has six zeros in the SQL; the reference's own form leaves them out."""
    duckdb.sql("COPY (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts) "
               f"FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rows, problem = oracle.compare(spark, con, str(tmp_path), contract.queries()["d15_log_view"], contract.oracle_sql()["d15_log_view"])
    assert rows > 0 and problem is None


def test_evidence_by_runs_sorts_ranks_not_texts(spark):
    """The first alert of a line by runs is that by arrays, also in ties of time and on lines without a log; texts join only at the end."""
    rng, columns = random.Random(5), "id long, upload_id string, matched_line_numbers array<long>, created_at timestamp, severity string, rule string, description string"
    alerts = spark.createDataFrame([
        (i, f"u{i % 2}", [rng.randrange(1, 1100) for _ in range(30)], rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 2)]), rng.choice(["HIGH", None, ""]),
         rng.choice(["port_scan", "own", None]), f"text {i}") for i in range(200)], columns)
    logs = bindings.logs(spark, "/root/testdata/sf0.001").filter("line_number < 1050").withColumn("upload_id", F.concat(F.lit("u"), F.col("id") % 2))
    by_runs = evidence.evidence_join(logs, alerts.drop("matched_line_numbers"), evidence.alert_runs(alerts))
    assert sorted(map(str, by_runs.collect())) == sorted(map(str, evidence.evidence_join(logs, alerts).collect()))
    assert "min_by" not in by_runs._jdf.queryExecution().optimizedPlan().toString()


def test_alert_runs_of_arrays_equal_those_of_rows(spark):
    rng = random.Random(6)
    rows = [(i, f"u{i % 2}", [rng.choice([*range(1, 9), *range(1020, 1030), 2047, 2048, None]) for _ in range(rng.randrange(0, 25))] if i % 9 else None) for i in range(60)]
    alerts = spark.createDataFrame(rows, "id long, upload_id string, matched_line_numbers array<long>")
    lines = alerts.select(F.col("id").alias("alert_id"), "upload_id", F.explode("matched_line_numbers").alias("line_number"))
    runs = evidence.alert_runs(alerts)
    columns = ["alert_id", "upload_id", "bucket", "first_line", "last_line"]
    want = evidence.line_runs(lines, ["alert_id", "upload_id"]).filter("first_line IS NOT NULL").select(columns).collect()
    assert sorted(map(tuple, runs.select(columns).collect())) == sorted(map(tuple, want)) and want
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
