"""StructTypes of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, LONG, INT, TIME, BOOL = (
    T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BooleanType(),
)

LOGS = _struct(
    ("id", LONG), ("upload_id", STRING), ("source_filename", STRING), ("source_format", STRING),
    ("line_number", LONG), ("event_timestamp", TIME), ("ip_address", STRING), ("username", STRING),
    ("event_type", STRING), ("status", STRING), ("severity", STRING), ("raw_message", STRING),
    ("parsed_data", STRING), ("ingested_at", TIME),
)

LOG_RECORD = _struct(
    ("upload_id", STRING), ("line_number", LONG), ("timestamp", STRING), ("ip_address", STRING),
    ("username", STRING), ("event_type", STRING), ("status", STRING),
)

DETECTIONS = _struct(
    ("upload_id", STRING), ("rule", STRING), ("severity", STRING), ("source_ip", STRING),
    ("username", STRING), ("count", LONG), ("time_window_seconds", LONG), ("first_seen", STRING),
    ("last_seen", STRING), ("description", STRING), ("matched_line_numbers", T.ArrayType(LONG)),
)

ALERTS = _struct(
    ("id", LONG), ("upload_id", STRING), ("rule", STRING), ("title", STRING), ("severity", STRING),
    ("status", STRING), ("source_ip", STRING), ("username", STRING), ("event_count", LONG),
    ("time_window_seconds", LONG), ("first_seen", TIME), ("last_seen", TIME),
    ("description", STRING), ("matched_line_numbers", T.ArrayType(LONG)), ("created_at", TIME),
    ("updated_at", TIME),
)

INCIDENTS = _struct(
    ("id", LONG), ("source_alert_id", LONG), ("assigned_user_id", LONG),
    ("created_by_user_id", LONG), ("updated_by_user_id", LONG), ("title", STRING),
    ("description", STRING), ("priority", STRING), ("status", STRING), ("opened_at", TIME),
    ("resolved_at", TIME), ("closed_at", TIME), ("created_at", TIME), ("updated_at", TIME),
)

NOTES = _struct(
    ("id", LONG), ("incident_id", LONG), ("author_user_id", LONG), ("title", STRING),
    ("body", STRING), ("tags", T.ArrayType(STRING)), ("pinned", BOOL), ("archived", BOOL),
    ("created_at", TIME), ("updated_at", TIME),
)

USERS = _struct(
    ("id", LONG), ("username", STRING), ("email", STRING), ("full_name", STRING),
    ("is_active", BOOL), ("role_id", LONG),
)

ROLES = _struct(("id", LONG), ("name", STRING), ("description", STRING))
