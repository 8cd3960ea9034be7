"""Triage as batch changes: a table and a set of requests in, the new table and the refusals out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions import labels as L
from logvigil.functions.text import null_if_empty, strip
from logvigil.operators.alerts import assign_ids
from logvigil.operators.pieces import running_number


class Change(NamedTuple):
    table: DataFrame
    rejected: DataFrame


class Promotion(NamedTuple):
    created: DataFrame
    alerts: DataFrame
    rejected: DataFrame


def _known(ids: DataFrame, column: str, flag: str) -> DataFrame:
    return ids.select(F.col("id").alias(column), F.lit(True).alias(flag))


def _unknown_user(column: str, flag: str) -> Column:
    return F.col(column).isNotNull() & F.col(flag).isNull()


def promote_alerts(alerts: DataFrame, incidents: DataFrame, users: DataFrame, requests: DataFrame,
                   now: Column) -> Promotion:
    """Turn alerts into incidents.

    Requests: request_id (their order), alert_id, created_by_user_id, assigned_user_id, title,
    description, priority. An alert gets one incident; of several requests the first sound one wins.
    """
    source = alerts.select(
        F.col("id").alias("alert_id"), F.col("title").alias("alert_title"),
        F.col("description").alias("alert_description"), F.col("severity").alias("alert_severity"),
    )
    taken = incidents.select(F.col("source_alert_id").alias("alert_id"), F.lit(True).alias("taken")).distinct()
    checked = (
        requests.join(source, "alert_id", "left").join(taken, "alert_id", "left")
        .join(_known(users, "assigned_user_id", "known_assignee"), "assigned_user_id", "left")
        .join(_known(users, "created_by_user_id", "known_creator"), "created_by_user_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("alert_severity").isNull(), "ALERT_NOT_FOUND")
            .when(F.col("taken"), "INCIDENT_EXISTS")
            .when(_unknown_user("assigned_user_id", "known_assignee")
                  | _unknown_user("created_by_user_id", "known_creator"), "USER_NOT_FOUND"),
        )
    )
    winners = checked.filter(F.col("reason").isNull()).groupBy("alert_id").agg(
        F.min("request_id").alias("winner")
    )
    decided = checked.join(winners, "alert_id", "left").withColumn(
        "reason",
        F.when((F.col("request_id") > F.col("winner"))
               & F.coalesce(F.col("reason") == "USER_NOT_FOUND", F.lit(True)), "INCIDENT_EXISTS")
        .otherwise(F.col("reason")),
    )
    accepted = decided.filter(F.col("reason").isNull())
    last_id = F.coalesce(incidents.select(F.max("id")).scalar(), F.lit(0))
    text = lambda own, inherited: F.coalesce(null_if_empty(strip(F.col(own))), F.col(inherited))
    created = assign_ids(accepted, ["request_id"], last_id).select(
        "id", F.col("alert_id").alias("source_alert_id"), "assigned_user_id", "created_by_user_id",
        F.col("created_by_user_id").alias("updated_by_user_id"), text("title", "alert_title").alias("title"),
        text("description", "alert_description").alias("description"),
        F.upper(F.coalesce(null_if_empty(F.col("priority")), F.col("alert_severity"))).alias("priority"),
        F.lit("OPEN").alias("status"), now.alias("opened_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("timestamp").alias("closed_at"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    escalated = accepted.select(F.col("alert_id").alias("id"), F.lit(True).alias("escalated"))
    after = alerts.join(escalated, "id", "left").withColumns({
        "status": F.when(F.col("escalated"), "ESCALATED").otherwise(F.col("status")),
        "updated_at": F.when(F.col("escalated"), now).otherwise(F.col("updated_at")),
    }).select(*alerts.columns)
    return Promotion(created, after, decided.filter(F.col("reason").isNotNull()).select(
        "request_id", "alert_id", "reason"))


def _latest(value: str, when: Column | None = None) -> Column:
    """Value of the last change that sets it; partial aggregation keeps a busy record cheap."""
    test = F.col(value).isNotNull() if when is None else when
    return F.max(F.when(test, F.struct(F.col("change_id"), F.col(value).alias("value"))))


def _not_in(column: str, allowed: list[str]) -> Column:
    return F.col(column).isNotNull() & ~F.upper(F.col(column)).isin(allowed)


def apply_incident_changes(incidents: DataFrame, changes: DataFrame, users: DataFrame, now: Column) -> Change:
    """Apply incident edits in change order.

    Changes: change_id, incident_id, title, description, priority, status, set_assignee,
    assigned_user_id, updated_by_user_id. Null leaves a field alone; ``set_assignee`` tells an
    assignee cleared on purpose from one not mentioned.
    """
    setting = F.coalesce("set_assignee", F.lit(False))
    empty = (
        F.coalesce(F.col("title"), F.col("description"), F.col("priority"), F.col("status")).isNull()
        & ~setting
    )
    checked = (
        changes.join(incidents.select(F.col("id").alias("incident_id"), F.lit(True).alias("known")), "incident_id", "left")
        .join(_known(users, "assigned_user_id", "known_assignee"), "assigned_user_id", "left")
        .join(_known(users, "updated_by_user_id", "known_updater"), "updated_by_user_id", "left")
        .withColumn(
            "reason",
            F.when(empty, "EMPTY_CHANGE")
            .when(_not_in("priority", V.SEVERITIES) | _not_in("status", V.INCIDENT_STATUSES), "INVALID_VALUE")
            .when(F.col("known").isNull(), "INCIDENT_NOT_FOUND")
            .when(setting & _unknown_user("assigned_user_id", "known_assignee"), "USER_NOT_FOUND")
            .when(_unknown_user("updated_by_user_id", "known_updater"), "USER_NOT_FOUND"),
        )
    )
    status = F.upper("status")
    merged = checked.filter(F.col("reason").isNull()).groupBy(F.col("incident_id").alias("id")).agg(
        _latest("title").alias("c_title"), _latest("description").alias("c_description"),
        _latest("priority").alias("c_priority"), _latest("status").alias("c_status"),
        _latest("updated_by_user_id").alias("c_updater"),
        _latest("assigned_user_id", setting).alias("c_assignee"),
        F.bool_and(F.coalesce(status == "FALSE_POSITIVE", F.lit(True))).alias("only_false_positive"),
    )
    new_status = F.upper("c_status.value")
    changed = F.col("only_false_positive").isNotNull()
    first_resolution = F.when(F.col("only_false_positive"), F.coalesce("resolved_at", now)).otherwise(now)
    none = F.lit(None).cast("timestamp")
    table = incidents.join(merged, "id", "left").withColumns({
        "title": F.coalesce("c_title.value", "title"),
        "description": F.coalesce("c_description.value", "description"),
        "priority": F.coalesce(F.upper("c_priority.value"), "priority"),
        "assigned_user_id": F.when(F.col("c_assignee").isNotNull(), F.col("c_assignee.value")).otherwise(F.col("assigned_user_id")),
        "updated_by_user_id": F.coalesce("c_updater.value", "updated_by_user_id"),
        "resolved_at": F.when(new_status == "RESOLVED", now).when(new_status == "FALSE_POSITIVE", first_resolution)
        .when(new_status.isNotNull(), none).otherwise(F.col("resolved_at")),
        "closed_at": F.when(new_status == "FALSE_POSITIVE", now).when(new_status.isNotNull(), none).otherwise(F.col("closed_at")),
        "status": F.coalesce(new_status, "status"),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }).select(*incidents.columns)
    return Change(table, checked.filter(F.col("reason").isNotNull()).select("change_id", "incident_id", "reason"))


def apply_alert_changes(alerts: DataFrame, changes: DataFrame, now: Column) -> Change:
    """Set severity and status of alerts. Changes: change_id, alert_id, severity, status."""
    checked = changes.join(
        alerts.select(F.col("id").alias("alert_id"), F.lit(True).alias("known")), "alert_id", "left"
    ).withColumn(
        "reason",
        F.when(F.coalesce(F.col("severity"), F.col("status")).isNull(), "EMPTY_CHANGE")
        .when(_not_in("severity", V.SEVERITIES) | _not_in("status", V.ALERT_STATUSES), "INVALID_VALUE")
        .when(F.col("known").isNull(), "ALERT_NOT_FOUND"),
    )
    merged = checked.filter(F.col("reason").isNull()).groupBy(F.col("alert_id").alias("id")).agg(
        _latest("severity").alias("c_severity"), _latest("status").alias("c_status"), F.lit(True).alias("changed")
    )
    table = alerts.join(merged, "id", "left").withColumns({
        "severity": F.coalesce(F.upper("c_severity.value"), "severity"),
        "status": F.coalesce(F.upper("c_status.value"), "status"),
        "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at")),
    }).select(*alerts.columns)
    return Change(table, checked.filter(F.col("reason").isNotNull()).select("change_id", "alert_id", "reason"))


def admit_notes(notes: DataFrame, incidents: DataFrame, users: DataFrame, requests: DataFrame) -> Change:
    """Admit new notes until an incident holds five.

    Requests: request_id (their order), incident_id, author_user_id, title, body, tags. Only a note
    that is otherwise sound takes up room. The table holds the admitted notes, without ids.
    """
    room = V.MAX_NOTES_PER_INCIDENT
    existing = notes.groupBy("incident_id").agg(F.count(F.lit(1)).alias("existing"))
    title, body = strip(F.coalesce("title", F.lit("Analyst note"))), strip(F.col("body"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    malformed = (
        F.coalesce(body == "", F.lit(True)) | (title == "") | (F.length("title") > 100)
        | (F.length("body") > 5000) | ~L.tags_valid(tags)
    )
    checked = (
        requests.join(incidents.select(F.col("id").alias("incident_id"), F.lit(True).alias("known")), "incident_id", "left")
        .join(existing, "incident_id", "left")
        .join(_known(users, "author_user_id", "known_author"), "author_user_id", "left")
        .withColumn("existing", F.coalesce("existing", F.lit(0)))
        .withColumn(
            "reason",
            F.when(malformed, "INVALID_VALUE").when(F.col("known").isNull(), "INCIDENT_NOT_FOUND")
            .when(F.col("existing") >= room, "NOTE_LIMIT").when(F.col("known_author").isNull(), "USER_NOT_FOUND"),
        )
    )
    # The constant bound lets Spark keep only the first five per incident in every task, before the
    # shuffle, so an incident with most of the requests costs no more than any other.
    order = Window.partitionBy("incident_id").orderBy("request_id")
    sound = checked.filter(F.col("reason").isNull())
    first = sound.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= room)
    admitted = first.filter(F.col("place") <= room - F.col("existing"))
    filled = admitted.groupBy("incident_id").agg(
        F.max("request_id").alias("last_admitted"), F.count(F.lit(1)).alias("admitted")
    )
    judged = checked.join(filled, "incident_id", "left")
    full_before = (
        (F.col("existing") + F.coalesce("admitted", F.lit(0)) >= room)
        & (F.col("request_id") > F.col("last_admitted"))
    )
    rejected = judged.withColumn(
        "reason",
        F.when(F.coalesce(full_before, F.lit(False))
               & F.coalesce(F.col("reason") == "USER_NOT_FOUND", F.lit(True)), "NOTE_LIMIT")
        .otherwise(F.col("reason")),
    ).filter(F.col("reason").isNotNull()).select("request_id", "incident_id", "reason")
    table = admitted.select(
        "request_id", "incident_id", "author_user_id", title.alias("title"), body.alias("body"),
        L.normalize_tags(tags).alias("tags"),
    )
    return Change(table, rejected)


def apply_note_changes(notes: DataFrame, changes: DataFrame, now: Column) -> Change:
    """Edit notes. Changes: change_id, note_id, title, body, tags, pinned, archived; null keeps."""
    fields = ["title", "body", "tags", "pinned", "archived"]
    blank = lambda c: F.col(c).isNotNull() & (strip(F.col(c)) == "")
    bad_tags = F.col("tags").isNotNull() & ~L.tags_valid(F.col("tags"))
    checked = changes.join(
        notes.select(F.col("id").alias("note_id"), F.lit(True).alias("known")), "note_id", "left"
    ).withColumn(
        "reason",
        F.when(F.greatest(*[F.col(f).isNotNull() for f in fields]) == F.lit(False), "EMPTY_CHANGE")
        .when(blank("title") | blank("body") | (F.length("title") > 100) | (F.length("body") > 5000) | bad_tags,
              "INVALID_VALUE")
        .when(F.col("known").isNull(), "NOTE_NOT_FOUND"),
    )
    merged = checked.filter(F.col("reason").isNull()).groupBy(F.col("note_id").alias("id")).agg(
        *[_latest(f).alias(f"c_{f}") for f in fields], F.lit(True).alias("changed")
    )
    clean = {"title": strip, "body": strip, "tags": L.normalize_tags}
    table = notes.join(merged, "id", "left").withColumns({
        **{f: F.coalesce(clean.get(f, lambda c: c)(F.col(f"c_{f}.value")), F.col(f)) for f in fields},
        "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at")),
    }).select(*notes.columns)
    return Change(table, checked.filter(F.col("reason").isNotNull()).select("change_id", "note_id", "reason"))


def delete_notes(notes: DataFrame, ids: DataFrame) -> Change:
    """Remove notes for good, which frees their room. ``ids`` has note_id."""
    wanted = ids.select(F.col("note_id").alias("id")).distinct()
    missing = wanted.join(notes.select("id"), "id", "left_anti")
    return Change(
        notes.join(wanted, "id", "left_anti"),
        missing.select(F.col("id").alias("note_id"), F.lit("NOTE_NOT_FOUND").alias("reason")),
    )


def backfill_closed(incidents: DataFrame) -> DataFrame:
    """Rows of the older vocabulary: CLOSED becomes RESOLVED with a resolution time."""
    closed = F.col("status") == "CLOSED"
    return incidents.withColumns({
        "resolved_at": F.when(closed, F.coalesce("resolved_at", "closed_at", "updated_at")).otherwise(F.col("resolved_at")),
        "status": F.when(closed, "RESOLVED").otherwise(F.col("status")),
    })


def revert_backfill(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn(
        "status", F.when(F.col("status") == "FALSE_POSITIVE", "CLOSED").otherwise(F.col("status"))
    )


def _broken(table: DataFrame, name: str, constraint: str, test: Column, key: str = "id") -> DataFrame:
    return table.filter(test).select(
        F.lit(name).alias("table_name"), F.lit(constraint).alias("constraint"),
        F.col(key).cast("string").alias("key"),
    )


def _duplicated(table: DataFrame, name: str, constraint: str, *columns: str) -> DataFrame:
    groups = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select(
        F.lit(name).alias("table_name"), F.lit(constraint).alias("constraint"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("key"),
    )


def _dangling(table: DataFrame, name: str, column: str, parent: DataFrame) -> DataFrame:
    keys = parent.select(F.col("id").alias(column))
    lost = table.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
    return _broken(lost, name, f"fk_{column}", F.lit(True))


def _all_broken(table: DataFrame, name: str, tests: dict[str, Column], key: str = "id") -> DataFrame:
    """Several tests of one table's rows in one scan."""
    failed = F.array_compact(F.array(*[F.when(test, F.lit(constraint)) for constraint, test in tests.items()]))
    return table.select(F.lit(name).alias("table_name"), F.explode(failed).alias("constraint"), F.col(key).cast("string").alias("key"))


def check_constraints(logs: DataFrame, alerts: DataFrame, incidents: DataFrame, notes: DataFrame,
                      users: DataFrame) -> DataFrame:
    """Violations as (table_name, constraint, key). Every check is a filter, a group or an anti join."""
    outside = lambda column, allowed: F.col(column).isNull() | ~F.col(column).isin(allowed)
    parts = [
        _broken(alerts, "alerts", "severity", outside("severity", V.SEVERITIES)),
        _broken(alerts, "alerts", "status", outside("status", V.ALERT_STATUSES)),
        _broken(incidents, "incidents", "priority", outside("priority", V.SEVERITIES)),
        _broken(incidents, "incidents", "status", outside("status", V.INCIDENT_STATUSES)),
        _broken(incidents, "incidents", "title_length", F.length("title") > 150),
        _broken(notes, "notes", "body_not_blank", F.coalesce(strip(F.col("body")) == "", F.lit(True))),
        _broken(notes, "notes", "body_length", F.length("body") > 5000),
        _broken(notes, "notes", "title_length", F.length("title") > 100),
        _duplicated(logs, "logs", "unique_upload_line", "upload_id", "line_number"),
        _duplicated(incidents, "incidents", "unique_source_alert", "source_alert_id"),
        _dangling(incidents, "incidents", "source_alert_id", alerts),
        _dangling(incidents, "incidents", "assigned_user_id", users),
        _dangling(notes, "notes", "incident_id", incidents),
        _dangling(notes, "notes", "author_user_id", users),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def check_accounts_and_lengths(logs: DataFrame, alerts: DataFrame, incidents: DataFrame, notes: DataFrame,
                               users: DataFrame, roles: DataFrame) -> DataFrame:
    """Further violations as (table_name, constraint, key): column lengths, required columns, tags, accounts and roles."""
    longer = lambda limits: {f"{column}_length": F.length(column) > most for column, most in limits.items()}
    parts = [
        _all_broken(logs, "logs", longer(V.LOG_LENGTHS)),
        _all_broken(alerts, "alerts", longer(V.ALERT_LENGTHS)),
        _all_broken(notes, "notes", {
            "tag_count": F.size("tags") > V.MOST_TAGS, "tag_length": F.exists("tags", lambda t: F.length(t) > V.LONGEST_TAG)}),
        _all_broken(users, "users", longer(V.USER_LENGTHS) | {"role_required": F.col("role_id").isNull()}),
        _all_broken(roles, "roles", longer(V.ROLE_LENGTHS)),
        *[_duplicated(users.filter(F.col(c).isNotNull()), "users", f"unique_{c}", c) for c in ("username", "email")],
        _duplicated(roles.filter(F.col("name").isNotNull()), "roles", "unique_name", "name"),
        _dangling(users, "users", "role_id", roles),
        *[_dangling(incidents, "incidents", c, users) for c in ("created_by_user_id", "updated_by_user_id")],
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def note_versions(changes: DataFrame) -> DataFrame:
    """Numbered history of note changes: change_id (their order), note_id, kind, archived."""
    summary = (
        F.when(F.col("kind") == "created", "Note created")
        .when(F.col("archived"), "Note archived").when(~F.col("archived"), "Note restored")
        .otherwise("Content updated")
    )
    return running_number(changes, ["note_id"], ["change_id"], "version").withColumn("summary", summary)
