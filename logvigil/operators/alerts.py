"""Alert rows: description, storage shape, rule catalogue and simple alert analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.labels import risk_score
from logvigil.functions.network import optional_ip
from logvigil.functions.text import lookup, null_if_empty, strip
from logvigil.functions.timefn import parse_event_ts
from logvigil.operators.pieces import dense_number, running_number


def describe_alerts(detected: DataFrame) -> DataFrame:
    """Detected alerts with title and the aliases readers expect."""
    return detected.select(
        "*",
        lookup(F.col("rule"), V.RULE_TITLES, F.lit("Security alert")).alias("title"),
        F.col("source_ip").alias("ip_address"), F.col("username").alias("user"),
        F.col("description").alias("reason"),
        F.struct(F.col("first_seen").alias("start"), F.col("last_seen").alias("end")).alias("timestamp_range"),
    )


def build_alert_rows(described: DataFrame, created_at: Column) -> DataFrame:
    """Stored shape of described alerts, without ids: see ``assign_ids``."""
    text = lambda c: null_if_empty(strip(c))
    first = lambda *names: F.coalesce(*[null_if_empty(F.col(n)) for n in names])
    return described.select(
        "upload_id", F.coalesce(null_if_empty("rule"), F.lit("unknown_rule")).alias("rule"),
        F.coalesce(null_if_empty("title"), F.lit("Security alert")).alias("title"),
        F.upper(F.coalesce(null_if_empty("severity"), F.lit("LOW"))).alias("severity"),
        F.lit("NEW").alias("status"),
        optional_ip(first("source_ip", "ip_address")).alias("source_ip"),
        text(first("username", "user")).alias("username"),
        F.coalesce(F.col("count").cast("bigint"), F.lit(0)).alias("event_count"),
        F.coalesce(F.col("time_window_seconds").cast("bigint"), F.lit(0)).alias("time_window_seconds"),
        parse_event_ts(F.col("first_seen")).alias("first_seen"),
        parse_event_ts(F.col("last_seen")).alias("last_seen"),
        F.coalesce(first("description", "reason"), F.lit("Security rule triggered.")).alias("description"),
        F.coalesce("matched_line_numbers", F.array().cast("array<bigint>")).alias("matched_line_numbers"),
        created_at.alias("created_at"), created_at.alias("updated_at"),
    )


def assign_ids(rows: DataFrame, order: list[str], last_id: int | Column = 0) -> DataFrame:
    """Dense ids after ``last_id`` in the given order, which has to be unique."""
    if isinstance(last_id, Column):
        return running_number(rows, [], order, "id").withColumn("id", F.col("id") + last_id)
    return dense_number(rows, order, "id", last_id + 1)


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.RULE_CATALOG, V.RULE_CATALOG_COLUMNS)


def repeated_failures(events: DataFrame, minimum: int = 3) -> DataFrame:
    """The user with most failed events, at least ``minimum``; ties go to who appeared first."""
    user = strip(F.col("user"))
    moment = F.coalesce("timestamp", "ingested_at")
    failed = events.filter(
        (F.lower(strip(F.col("status"))) == "failed") & (user != "") & (F.lower(user) != "unknown")
    )
    per_user = failed.groupBy(user.alias("user")).agg(
        F.count(F.lit(1)).alias("failures"), F.count(moment).alias("timed"),
        F.min(moment).alias("first_seen"), F.max(moment).alias("last_seen"),
        F.min(F.when(F.col("source_ip") != "", F.struct("log_id", "source_ip"))).alias("first_ip"),
        F.min("log_id").alias("first_log_id"),
    )
    span = F.round((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000).cast("bigint")
    return (
        per_user.filter(F.col("failures") >= minimum)
        .orderBy(F.desc("failures"), "first_log_id").limit(1)
        .select(
            "user", "failures",
            F.when(F.col("timed") > 1, F.greatest(F.lit(1), span)).otherwise(F.lit(0)).cast("bigint").alias("window_seconds"),
            F.coalesce("first_ip.source_ip", F.lit("Unknown")).alias("source_ip"),
        )
    )


def suspicious_ips(alerts: DataFrame, k: int = 5) -> DataFrame:
    """Best alert of each source address, the ``k`` riskiest. Aggregating keeps a busy address from
    being sorted in one task. Alerts without an address count as the source "Unknown"."""
    ranked = alerts.withColumn("risk", risk_score(F.lower("severity"), "low"))
    address = F.coalesce(null_if_empty(F.col("source_ip")), F.lit("Unknown"))
    best = ranked.groupBy(address.alias("source_ip")).agg(
        F.min_by(F.struct("id", "risk", "severity", "rule"), F.struct(-F.col("risk"), F.col("id"))).alias("a")
    )
    return best.select("source_ip", "a.*").orderBy(F.desc("risk"), "id").limit(k)
