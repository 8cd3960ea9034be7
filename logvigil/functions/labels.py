"""Dashboard vocabulary: risk, status views, display ids, tags, evidence counts, playbooks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import contains_any, lookup, match_group, null_if_empty, strip


def risk_score(severity: Column, default: str = "info") -> Column:
    """Risk points; events default an unknown severity to info, alerts to low."""
    return lookup(severity, V.RISK_SCORES, F.lit(V.RISK_SCORES[default])).cast("bigint")


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(strip(severity)), V.SEVERITY_RANKS, F.lit(0)).cast("int")


def _status_view(status: Column, table: dict) -> Column:
    fallback = F.coalesce(null_if_empty(F.lower(strip(status))), F.lit("unknown"))
    return lookup(F.upper(status), table, fallback)


def alert_status_view(status: Column) -> Column:
    return _status_view(status, V.ALERT_STATUS_VIEW)


def alert_status_stored(view: Column) -> Column:
    return lookup(view, V.ALERT_STATUS_STORED)


def incident_status_view(status: Column) -> Column:
    return _status_view(status, V.INCIDENT_STATUS_VIEW)


def incident_status_stored(view: Column) -> Column:
    return lookup(view, V.INCIDENT_STATUS_STORED)


def is_terminal_incident(status: Column) -> Column:
    """Takes the dashboard spelling of an incident status."""
    return F.coalesce(F.lower(strip(status)), F.lit("")).isin(V.TERMINAL_INCIDENT_STATUSES)


def is_active_alert(status: Column) -> Column:
    return ~F.coalesce(F.lower(strip(status)), F.lit("")).isin(V.TERMINAL_ALERT_STATUSES)


def display_id(prefix: str, value: Column) -> Column:
    """``ALT-0007``; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}-%04d", value.cast("bigint"))


def backend_id(text: Column) -> Column:
    """Trailing digits as a positive integer, else null."""
    number = match_group(text, r"(\d+)$").try_cast("bigint")
    return F.when((number > 0) & (number <= 9007199254740991), number)


def evidence_id(log_id: Column, upload_id: Column, line_number: Column) -> Column:
    """``EVT-<id>``; without an id, the whole upload id and the line number, so that no two uploads meet."""
    fallback = F.concat(
        F.coalesce(upload_id, F.lit("upload")), F.lit("-"),
        F.coalesce(line_number, F.lit(0)).cast("string"),
    )
    return F.concat(F.lit("EVT-"), F.coalesce(F.nullif(log_id, F.lit(0)).cast("string"), fallback))


def rule_id(rule: Column, default: Column) -> Column:
    return lookup(rule, V.RULE_IDS, default)


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct tags in first-seen order."""
    return F.array_distinct(
        F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t != "")
    )


def split_tags(text: Column) -> Column:
    return normalize_tags(F.split(F.coalesce(text, F.lit("")), ","))


def tags_valid(raw_tags: Column) -> Column:
    """At most six tags as given, none longer than forty characters once normalised."""
    return (F.size(raw_tags) <= 6) & ~F.exists(normalize_tags(raw_tags), lambda t: F.length(t) > 40)


def evidence_count(evidence_ids: Column, related: Column, number: Column, text: Column) -> Column:
    """Linked ids, else the evidence list, else the given count, else a count named in the text."""
    named = match_group(text, r"(?i)\b(\d+)\s+[^.]{0,48}\b(?:failures?|attempts?)\b").cast("bigint")
    given = F.greatest(F.coalesce(number.cast("bigint"), F.lit(0)), F.lit(0))
    return (
        F.when(F.coalesce(F.size(evidence_ids), F.lit(0)) > 0, F.size(evidence_ids).cast("bigint"))
        .when(F.coalesce(F.size(related), F.lit(0)) > 0, F.size(related).cast("bigint"))
        .when(given > 0, given)
        .otherwise(F.coalesce(named, F.lit(0)))
    )


def playbook_key(*texts: Column) -> Column:
    """Name of the response playbook for an alert's texts, null when none applies."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    chain = None
    for key, words in V.PLAYBOOK_KEYWORDS:
        test = contains_any(text, words)
        chain = F.when(test, key) if chain is None else chain.when(test, key)
    return chain


def recommend(*texts: Column) -> Column:
    """Ordered response steps for an alert, an empty array when no playbook applies."""
    key = playbook_key(*texts)
    chain = None
    for name, steps in V.PLAYBOOKS.items():
        value = F.array(*[F.lit(s) for s in steps])
        chain = F.when(key == name, value) if chain is None else chain.when(key == name, value)
    return chain.otherwise(F.array().cast("array<string>"))


def incident_workflow(status: Column) -> Column:
    """``struct(terminal, label, next_status, next_action, step, tasks_done)`` of an incident."""
    text = F.coalesce(F.lower(strip(status)), F.lit(""))
    terminal = is_terminal_incident(text)
    next_status = F.when(text == "open", "investigating").when(text == "investigating", "resolved")
    next_action = (
        F.when(text == "open", "Start investigation").when(text == "investigating", "Resolve incident")
    )
    step = (
        F.when(text.isin("investigating", "awaiting approval", "escalated", "contained"), 1)
        .when(terminal, 2).otherwise(0)
    )
    done = (
        F.when(terminal, V.RESPONSE_STEP_COUNT)
        .when(text == "investigating", (V.RESPONSE_STEP_COUNT + 1) // 2).otherwise(0)
    )
    label = F.initcap(F.when(text == "", "open").otherwise(text))
    return F.struct(
        terminal.alias("terminal"), label.alias("label"), next_status.alias("next_status"),
        next_action.alias("next_action"), step.cast("bigint").alias("step"),
        done.cast("bigint").alias("tasks_done"),
    )
