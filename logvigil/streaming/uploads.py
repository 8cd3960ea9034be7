"""Ingest of an upload folder as files arrive.

Every file is one upload and detection never crosses uploads, so a micro-batch of whole files gives
exactly the results of a batch job. No streaming state is kept. Each batch writes to its own
folders and overwrites them on a retry, so a batch that is run twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logvigil.operators import alerts as A
from logvigil.operators import detection as D
from logvigil.operators.pieces import one_row
from logvigil.sources import files as S
from logvigil.sources import parsers, sinks, splits

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: Orders in which the rows of a batch take their ids. Both are unique.
LOG_ORDER = ["upload_id", "line_number"]
ALERT_ORDER = ["upload_id", "rule", "first_seen", "last_seen", "source_ip", "username", "matched_line_numbers"]


def upload_stream(spark: SparkSession, inbox: str, output: str, checkpoint: str, year: int,
                  rules: Sequence[D.Rule] | None = None, max_files: int = 1000, max_file_bytes: int | None = None,
                  sample_lines: int | None = 5, by_split: bool = False) -> StreamingQuery:
    """Process what lies in ``inbox`` and stop; schedule it again, or change the trigger to run on.

    With ``by_split`` the stream carries only names and sizes, and files of any size are read by
    splits; else each file is one value.
    """
    found = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(inbox)
    )
    if by_split:
        found = found.drop("content")
    return (
        found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: process_files(
            batch, number, output, year, rules, max_file_bytes=max_file_bytes, sample_lines=sample_lines)).start()
    )


def process_files(found: DataFrame, number: int, output: str, year: int,
                  rules: Sequence[D.Rule] | None = None, ingested_at: datetime | None = None,
                  max_file_bytes: int | None = None, sample_lines: int | None = 5) -> None:
    """Admit, parse, detect and store one batch of files. Without their content, files are read by splits.

    Files are read once: the parsed records are written first, and everything else starts from that
    table. Logs and alerts take blocks of ids behind those of earlier batches, as the manifest of
    these tells; a batch that is run again takes the same block.
    """
    spark = found.sparkSession
    moment = F.lit(ingested_at or datetime.now(timezone.utc)).cast("timestamp")
    folder = lambda name: f"{output}/{name}/batch={number}"

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(folder(name))
        return spark.read.parquet(folder(name))

    ids = {"upload_id": F.sha2(F.concat_ws("|", "path", F.col("modified").cast("string")), 256), "source_filename": F.col("name")}
    if "content" in found.columns:
        checked = S.validate_files(S.describe_files(found), max_file_bytes)
        files = S.with_lines(S.admitted(checked), sample_lines)
        records, refused = S.explode_records(files.withColumns(ids)), S.rejected(checked)
    else:
        paths = [splits.escaped(row["path"]) for row in found.select("path").collect()]  # at most max_files
        if not paths:
            return
        records, checked = splits.split_records(spark, *paths, sample_lines=sample_lines, max_file_bytes=max_file_bytes)
        records, files, refused = records.withColumns(ids), checked.filter("code IS NULL"), checked.filter("code IS NOT NULL")
    parsed = store(parsers.parse_records(records, year), "parsed")
    store(refused.select("path", "name", "length", "code"), "rejected_files")
    store(parsers.dead_letter(parsed), "dead_letter")
    store(parsers.parse_summary(parsed, files.withColumns(ids)), "summary")
    entries = parsers.entries(parsed)
    last_log, last_alert = last_ids(spark, output, number)
    logs = store(A.assign_ids(sinks.build_log_rows(entries, moment), LOG_ORDER, last_log), "logs")
    detected = D.run_detection(D.log_records(entries, year), rules)
    alerts = store(A.assign_ids(A.build_alert_rows(A.describe_alerts(detected), moment), ALERT_ORDER, last_alert), "alerts")
    store(one_row(logs.agg((F.count(F.lit(1)) + last_log).alias("last_log_id")),
                  alerts.agg((F.count(F.lit(1)) + last_alert).alias("last_alert_id"))), "manifest")


def last_ids(spark: SparkSession, output: str, number: int) -> tuple[int, int]:
    """The last log and alert ids of the batches before ``number``; batches come one after the other."""
    try:
        manifest = spark.read.parquet(f"{output}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0, 0
    row = manifest.filter(F.col("batch") < number).agg(F.max("last_log_id"), F.max("last_alert_id")).first()
    return row[0] or 0, row[1] or 0
