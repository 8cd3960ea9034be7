"""Time expressions. The session time zone is UTC; text without a zone is read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import once, strip

ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
#: The other spellings of ISO 8601: basic dates and times, week dates, hours alone, any separator but a digit, offsets to the second.
_ISO_TIME = r"(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_ISO_ZONE = r"(?:Z|[+-]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?|\d{2}(?:\d{2}(?:\.\d+)?)?)?)?"
ISO_OTHER = rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}}|\d{{4}}-W\d{{2}}(?:-[1-7])?|\d{{4}}W\d{{2}}[1-7]?)(?:\D{_ISO_TIME}{_ISO_ZONE})?$"
_ISO_PARTS = (r"^(\d{4})-?(W?)(\d{2})-?(\d{0,2})(?:\D(\d{2}):?(\d{2})?:?(\d{2})?(?:[.,](\d+))?"
              r"(?:Z|([+-])(\d{2}):?(\d{2})?:?(\d{2})?(?:\.(\d+))?)?)?$")
Z_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_event_ts(c: Column) -> Column:
    """ISO-8601 text to a timestamp, null when it is anything else.

    The guard matters: Spark would read a bare time of day as today. Common spellings are cast; the
    others are taken apart.
    """
    text = strip(c)
    common = F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp")
    return F.coalesce(F.when(text.rlike(ISO_TEXT), common), F.when(text.rlike(ISO_OTHER), _iso_other(text)))


_ISO_GROUPS = ",".join(f"${i}" for i in range(1, 14))


def _iso_other(text: Column) -> Column:
    """A time from its parts, null where one is out of its range; fractions are cut to microseconds.

    The text is taken apart by one match, and each part is read once (``once``), however often it is used.
    """
    parts = F.split(F.regexp_replace(text, _ISO_PARTS, _ISO_GROUPS), ",", -1)
    return once(parts, lambda p: once(_iso_numbers(p), _iso_moment))


def _iso_numbers(parts: Column) -> Column:
    part = lambda i: F.get(parts, F.lit(i - 1))
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0).cast("bigint"))
    micros = lambda i: F.substring(F.rpad(part(i), 6, "0"), 1, 6).cast("bigint")
    year = part(1)
    date = lambda rest: F.concat(year, F.lit(rest)).try_cast("date")
    is_week = part(2) == "W"
    return F.struct(
        is_week.alias("is_week"), (year != "0000").alias("has_year"), number(3).alias("week"), number(4).alias("weekday"),
        F.when(~is_week, F.unix_date(F.concat_ws("-", year, part(3), part(4)).try_cast("date"))).alias("plain"),
        F.when(is_week, F.weekofyear(date("-12-28"))).alias("weeks"),
        F.when(is_week, F.unix_date(F.date_trunc("week", date("-01-04")).cast("date"))).alias("monday"),
        *(number(i).alias(f"n{i}") for i in (5, 6, 7, 10, 11, 12)), micros(8).alias("micros"), (part(9) == "-").alias("behind"), micros(13).alias("offset_micros"))


def _iso_moment(n: Column) -> Column:
    of = lambda i: n[f"n{i}"]
    by_week = F.when(n["week"].between(1, n["weeks"]), n["monday"] + (n["week"] - 1) * 7 + F.greatest(n["weekday"], F.lit(1)) - 1)
    day = F.when(n["is_week"], by_week).otherwise(n["plain"])
    in_range = (of(5) < 24) & (of(6) < 60) & (of(7) < 60) & (of(10) < 24) & (of(11) < 60) & (of(12) < 60)
    seconds = of(5) * 3600 + of(6) * 60 + of(7)
    offset = (of(10) * 3600 + of(11) * 60 + of(12)) * 1_000_000 + n["offset_micros"]
    moment = day * 86_400_000_000 + seconds * 1_000_000 + n["micros"] - F.when(n["behind"], -offset).otherwise(offset)
    return F.when(in_range & n["has_year"], F.timestamp_micros(moment))


def parse_detector_ts(c: Column, year: int) -> Column:
    """As ``parse_event_ts``, plus year-less syslog and access-log times placed in ``year``."""
    text = F.regexp_replace(strip(c), r"\s+", " ")
    syslog = F.try_to_timestamp(F.concat(text, F.lit(f" {year}")), F.lit("MMM d HH:mm:ss yyyy"))
    access = F.try_to_timestamp(
        F.regexp_replace(text, r"^(\d{2}/\w{3})/\d{4}:", f"$1/{year}:"),
        F.lit("d/MMM/yyyy:HH:mm:ss"),
    )
    return F.coalesce(
        parse_event_ts(c),
        F.when(text.rlike(r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{2}:\d{2}$"), syslog),
        F.when(text.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}$"), access),
    )


def format_ts_z(c: Column) -> Column:
    return F.date_format(c, Z_FORMAT)


def micros_to_z(c: Column) -> Column:
    return format_ts_z(F.timestamp_micros(c))


def syslog_date(c: Column, year: int) -> Column:
    """``Jan 10 08:00:01`` to ISO text in ``year``; unreadable text comes back unchanged."""
    text = F.concat(F.regexp_replace(strip(c), r"\s+", " "), F.lit(f" {year}"))
    return F.coalesce(format_ts_z(F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy"))), c)


def apache_date(c: Column) -> Column:
    """``10/Oct/2000:13:55:36 -0700`` to ISO text, the offset being dropped; else unchanged."""
    pattern = r"^(\d+)/([^/ ]*)/(\d+):(\d+):(\d+):(\d+) [^ ]*$"

    def part(i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    month = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), part(2)).cast("int")
    moment = F.try_make_timestamp(
        part(3).try_cast("int"), F.greatest(month, F.lit(1)), part(1).try_cast("int"),
        part(4).try_cast("int"), part(5).try_cast("int"), part(6).try_cast("decimal(8,6)"),
    )
    return F.coalesce(F.when(c.rlike(pattern), format_ts_z(moment)), c)
