"""Filters, reports and lookups over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions.text import null_if_empty


def contains_literal(c: Column, text: str) -> Column:
    """Case-insensitive literal search: wildcards in ``text`` have no meaning."""
    return F.lower(c).contains(text.lower())


def latest_upload(logs: DataFrame) -> DataFrame:
    """One row with the upload of the newest log row; a single aggregate, no sort."""
    return logs.agg(F.max_by("upload_id", F.struct("ingested_at", "id")).alias("upload_id"))


def upload_batch(logs: DataFrame, alerts: DataFrame, upload_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, logs by line and alerts by age of one upload."""
    own_logs = logs.filter(F.col("upload_id") == upload_id)
    own_alerts = alerts.filter(F.col("upload_id") == upload_id)
    return (
        upload_summaries(own_logs, own_alerts),
        own_logs.orderBy("line_number"),
        own_alerts.orderBy("created_at", "id"),
    )


def upload_summaries(logs: DataFrame, alerts: DataFrame) -> DataFrame:
    """File, time and counts of every upload. Both sides are aggregated before the join."""
    per_upload = logs.groupBy("upload_id").agg(
        F.min_by("source_filename", "line_number").alias("filename"),
        F.min_by("source_format", "line_number").alias("format"),
        F.max("ingested_at").alias("uploaded_at"), F.count(F.lit(1)).alias("stored_entries"),
    )
    return _with_alert_counts(per_upload, alerts)


def _with_alert_counts(per_upload: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("stored_alerts"))
    return per_upload.join(counts, "upload_id", "left").na.fill(0, ["stored_alerts"])


def _matching_uploads(logs: DataFrame, query: str | None) -> DataFrame:
    text = (query or "").strip()
    if not text:
        return logs
    return logs.filter(
        contains_literal(F.col("source_filename"), text) | contains_literal(F.col("source_format"), text)
    )


def uploads(logs: DataFrame, alerts: DataFrame, query: str | None = None) -> DataFrame:
    """All uploads with log and alert counts."""
    grouped = _matching_uploads(logs, query).groupBy(
        "upload_id", F.col("source_filename").alias("filename"), F.col("source_format").alias("format")
    ).agg(F.max("ingested_at").alias("uploaded_at"), F.count(F.lit(1)).alias("stored_entries"))
    return _with_alert_counts(grouped, alerts)


#: Newest uploads first: the order of ``upload_history``, for ``browse.page_after``.
UPLOAD_ORDER = [("uploaded_at", True), ("upload_id", True), ("filename", False), ("format", False)]


def upload_history(logs: DataFrame, alerts: DataFrame, query: str | None = None, page: int = 1,
                   page_size: int = 25) -> DataFrame:
    """A page of uploads, newest first, with log and alert counts."""
    return (
        uploads(logs, alerts, query)
        .orderBy(F.desc("uploaded_at"), F.desc("upload_id"), "filename", "format")
        .offset((page - 1) * page_size).limit(page_size)
    )


def count_uploads(logs: DataFrame, query: str | None = None, page_size: int = 25) -> DataFrame:
    """Number of distinct uploads and of pages."""
    total = F.count_distinct("upload_id")
    return _matching_uploads(logs, query).agg(total.alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint").alias("page_count")
    )


def _newest(df: DataFrame, limit: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def list_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None,
                limit: int = 100) -> DataFrame:
    found = alerts
    if severity:
        found = found.filter(F.col("severity") == severity.upper())
    if status:
        found = found.filter(F.col("status") == status.upper())
    return _newest(found, limit, "created_at", "id")


def list_incidents(incidents: DataFrame, status: str | None = None, priority: str | None = None,
                   assigned_user_id: int | None = None, limit: int = 100) -> DataFrame:
    found = incidents
    if status:
        found = found.filter(F.col("status") == status.upper())
    if priority:
        found = found.filter(F.col("priority") == priority.upper())
    if assigned_user_id is not None:
        found = found.filter(F.col("assigned_user_id") == assigned_user_id)
    return _newest(found, limit, "created_at", "id")


def incident_notes(notes: DataFrame, incident_id: int, limit: int = 100) -> DataFrame:
    return notes.filter(F.col("incident_id") == incident_id).orderBy("created_at", "id").limit(limit)


def recent_notes(notes: DataFrame, limit: int = 500) -> DataFrame:
    return _newest(notes, limit, "updated_at", "id")


def _with_role(users: DataFrame, roles: DataFrame, how: str) -> DataFrame:
    # A workspace defines a handful of roles; the planner broadcasts them under its size threshold.
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return users.join(named, "role_id", how)


def user_directory(users: DataFrame, roles: DataFrame) -> DataFrame:
    return _with_role(users, roles, "left").select(
        "id", "username", "email", "full_name", "is_active", "role"
    ).orderBy("id")


def assignable_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Active users with only what a picker shows."""
    return _with_role(users.filter("is_active"), roles, "left").select(
        "id", "username", "full_name", "role"
    ).orderBy("full_name", "username")


def active_admin_count(users: DataFrame, roles: DataFrame) -> DataFrame:
    admins = _with_role(users.filter("is_active"), roles.filter(F.col("name") == "Admin"), "inner")
    return admins.agg(F.count(F.lit(1)).alias("active_admins"))


def role_counts(users: DataFrame, roles: DataFrame) -> DataFrame:
    """All and active users per role; users without a role are counted under null."""
    return _with_role(users, roles, "left").groupBy("role").agg(
        F.count(F.lit(1)).alias("users"), F.count_if("is_active").alias("active_users")
    )


def roles_by_name(roles: DataFrame) -> DataFrame:
    return roles.orderBy("name")


def get_by_id(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == key)


def log_view(logs: DataFrame, parsed_timestamp: Column | None = None, all_digits: bool = False) -> DataFrame:
    """Dashboard projection of stored logs: no nulls, parsed time before stored time.

    A stored time has no fraction if it is a whole second, as in the reference, or always six digits with ``all_digits``."""
    parsed = F.get_json_object("parsed_data", "$.timestamp") if parsed_timestamp is None else parsed_timestamp
    event_time = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if not all_digits:
        event_time = F.replace(event_time, F.lit(".000000"), F.lit(""))
    return logs.select(
        "id", "upload_id", "line_number", "source_filename", "source_format",
        F.coalesce(null_if_empty(parsed), F.concat(event_time, F.lit("+00:00")), F.lit("")).alias("timestamp"),
        "ingested_at", F.coalesce("ip_address", F.lit("")).alias("ip"),
        F.coalesce("username", F.lit("")).alias("username"),
        F.coalesce(null_if_empty(F.col("event_type")), F.lit("Log Entry")).alias("event"),
        F.upper(F.coalesce(null_if_empty(F.col("status")), F.lit("UNKNOWN"))).alias("status"),
        F.upper(F.coalesce(null_if_empty(F.col("severity")), F.lit("INFO"))).alias("severity"),
        "raw_message",
    )


