"""Stored log rows, and JSON / CSV / parquet outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import csv_guard, null_if_empty, strip
from logvigil.functions.timefn import parse_event_ts


def build_log_rows(entries: DataFrame, ingested_at: Column) -> DataFrame:
    """Stored shape of parsed entries: defaults filled, status and severity in upper case."""
    text = lambda name: null_if_empty(strip(F.col(name)))
    return entries.select(
        "upload_id", "source_filename", F.coalesce("format", F.lit("unknown")).alias("source_format"),
        "line_number", parse_event_ts(F.col("timestamp")).alias("event_timestamp"),
        text("ip_address").alias("ip_address"), text("username").alias("username"),
        F.coalesce(text("event_type"), F.lit("security_event")).alias("event_type"),
        F.upper(F.coalesce(text("status"), F.lit("UNKNOWN"))).alias("status"),
        F.upper(text("severity")).alias("severity"),
        F.coalesce("raw", F.lit("")).alias("raw_message"), "parsed_data",
        ingested_at.alias("ingested_at"),
    )


def write_logs(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Store log rows by ingest day. Days keep the folder count small where upload ids would not;
    rows are range-placed by upload and line, so file statistics find one upload quickly and a large
    upload is written by several tasks."""
    (
        rows.withColumn("ingest_day", F.to_date("ingested_at"))
        .repartitionByRange("ingest_day", "upload_id", "line_number").sortWithinPartitions("ingest_day", "upload_id", "line_number")
        .write.mode(mode).partitionBy("ingest_day").parquet(path)
    )


def sink_json_csv(records: DataFrame, folder: str, columns: Sequence[str] = tuple(V.AUTH_FIELDS)) -> None:
    """The records as JSON and as CSV with a header, in a fixed column order."""
    ordered = records.select(*columns)
    ordered.write.mode("overwrite").json(f"{folder}/json")
    ordered.write.mode("overwrite").csv(f"{folder}/csv", header=True)


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as one guarded CSV line in column ``line``."""
    return df.select(F.concat_ws(",", *[csv_guard(F.col(c)) for c in columns]).alias("line"))


def csv_header(columns: Sequence[str]) -> str:
    return ",".join(f'"{c}"' for c in columns)


def export_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Guarded CSV files with a header line in each, every cell quoted."""
    guarded = df.select(*[
        F.regexp_replace(csv_guard(F.col(c)), r'(?s)^"(.*)"$', "$1").alias(c) for c in columns
    ])
    unescaped = guarded.select(*[F.replace(F.col(c), F.lit('""'), F.lit('"')).alias(c) for c in columns])
    unescaped.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
