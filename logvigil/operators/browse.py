"""Search, facets, paging and orderings of the dashboard lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions import labels as L
from logvigil.functions.text import haystack_contains, null_if_empty

SEARCH_COLUMNS = {
    "events": ["id", "source", "source_ip", "user", "event", "rule", "message"],
    "alerts": ["id", "title", "source_ip", "rule_id", "rule_name", "assignee"],
    "alert_picker": ["id", "title", "severity", "status", "source_ip", "user", "rule_id", "rule_name"],
    "incidents": ["id", "title", "owner", "summary"],
    "incident_history": ["id", "title", "owner", "priority", "summary"],
    "notes": ["id", "title", "body", "author", "linked_id", "tags_text"],
    "users": ["full_name", "username", "email", "role"],
    "rules": ["id", "engine_key", "name", "description", "technique", "criteria"],
    "connectors": ["name"],
}


def search(df: DataFrame, columns: Sequence[str], query: str | None = None, **facets: object) -> DataFrame:
    """Rows whose joined columns contain the query, and whose facets match exactly.

    A facet on an array column tests membership. Empty facets do not filter.
    """
    found = df
    text = (query or "").strip()
    if text:
        found = found.filter(haystack_contains([F.col(c) for c in columns], text))
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    for name, value in facets.items():
        if value in (None, ""):
            continue
        test = F.array_contains(name, value) if name in arrays else F.col(name) == F.lit(value)
        found = found.filter(test)
    return found


def facets(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in order; array columns are flattened first."""
    value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    return df.select(value.alias("value")).filter(F.col("value") != "").distinct().orderBy("value")


class Page(NamedTuple):
    items: DataFrame
    page: int
    page_count: int
    start: int
    end: int
    total: int


def paginate(df: DataFrame, order: Sequence[Column | str], page: int = 1, page_size: int = 10) -> Page:
    """One page, the page number clamped to what exists. Counting the rows is the one action here."""
    size = page_size if page_size > 0 else 10
    total = df.count()
    page_count = max(1, -(-total // size))
    page = min(page_count, max(1, int(page)))
    offset = (page - 1) * size
    return Page(
        df.orderBy(*order).offset(offset).limit(size), page, page_count,
        offset + 1 if total else 0, min(offset + size, total), total,
    )


Key = tuple[str, bool]  # a column, and whether it descends


def page_after(df: DataFrame, order: Sequence[Key], last: Mapping[str, object] | None = None, page_size: int = 10) -> DataFrame:
    """The rows that follow the row ``last`` of the page before (none: the first page), in a unique order.

    A seek instead of an offset: what comes before is filtered out where it is read, and only
    ``page_size`` rows of each task are sorted out and sent on, however deep the page. Nulls sort as
    Spark has them, lowest: first where a column ascends, last where it descends.
    """
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, descends in order:
            column, value = F.col(name), last[name]
            if descends:
                further = F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
            else:
                further = column.isNotNull() if value is None else column > F.lit(value)
            beyond = beyond | (same & further)
            same = same & column.eqNullSafe(F.lit(value))
        df = df.filter(F.coalesce(beyond, F.lit(False)))
    return df.orderBy(*[F.desc(c) if descends else F.asc(c) for c, descends in order]).limit(page_size)


def pages(df: DataFrame, order: Sequence[Key], page_size: int = 10) -> Iterator[DataFrame]:
    """Page by page: each one starts behind the last row of the one before, the only row that is fetched."""
    page = page_after(df, order, None, page_size)
    while True:
        yield page
        down = [F.asc(c) if descends else F.desc(c) for c, descends in order]
        last = page.orderBy(*down).select(*[c for c, _ in order]).first()
        if last is None:
            return
        page = page_after(df, order, last.asDict(), page_size)


def incident_history(incidents: DataFrame) -> DataFrame:
    """Finished incidents, last finished first."""
    return incidents.filter(L.is_terminal_incident(F.col("status"))).orderBy(
        F.desc(F.coalesce("completed_at", "updated")), "backend_id"
    )


def notes_order(notes: DataFrame) -> DataFrame:
    return notes.orderBy(F.desc("pinned"), F.desc("updated_at"), "id")


def recent_failed(events: DataFrame, k: int = 5) -> DataFrame:
    return events.filter(F.col("status") == "failed").orderBy(F.desc("timestamp"), "log_id").limit(k)


def risk_ranked_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("risk"), "backend_id")


def next_sequential_id(df: DataFrame, prefix: str, minimum: int = 1, padding: int = 4,
                       column: str = "id") -> DataFrame:
    """Next free id after the highest well-formed one, never below ``minimum``."""
    text = F.col(column)
    digits = F.substr(text, F.lit(len(prefix) + 1))
    number = F.when(text.startswith(prefix) & digits.rlike(r"^\d+$"), digits.try_cast("bigint"))
    safe = F.when(number <= 9007199254740991, number)
    highest = F.coalesce(F.greatest(F.max(safe), F.lit(minimum - 1)), F.lit(minimum - 1)) + 1
    return df.agg(F.format_string(f"{prefix}%0{padding}d", highest.cast("bigint")).alias("next_id"))


def note_view(notes: DataFrame) -> DataFrame:
    """Stored notes as the dashboard lists them."""
    return notes.select(
        L.display_id("NOTE", F.col("id")).alias("id"), F.col("id").alias("backend_id"),
        F.coalesce(null_if_empty(F.col("title")), F.lit("Analyst note")).alias("title"), "body",
        F.concat(F.lit("User "), F.col("author_user_id").cast("string")).alias("author"),
        "created_at", "updated_at", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.array_join("tags", " ").alias("tags_text"), F.lit("incident").alias("linked_type"),
        L.display_id("INC", F.col("incident_id")).alias("linked_id"),
        F.col("incident_id").alias("linked_backend_id"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
    )
