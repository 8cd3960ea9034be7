"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import null_if_empty, strip


def optional_ip(c: Column) -> Column:
    """Canonical IPv4 or IPv6 text, null for anything else."""
    text = strip(c)
    return F.when(text.rlike(rf"^{V.IPV4}$"), text).otherwise(_canonical_ipv6(_hex_tail(F.lower(text))))


def _hex_tail(text: Column) -> Column:
    """The IPv4 spelling of an IPv6 address's last 32 bits as two groups."""
    tail = F.split(F.substring_index(text, ":", -1), r"\.")
    group = lambda i: F.lower(F.hex(F.get(tail, F.lit(i)).try_cast("int") * 256 + F.get(tail, F.lit(i + 1)).try_cast("int")))
    return F.when(
        text.rlike(rf":{V.IPV4}$"), F.concat(F.regexp_replace(text, r"[^:]+$", ""), group(0), F.lit(":"), group(2))
    ).otherwise(text)


def _canonical_ipv6(text: Column) -> Column:
    """Shortest lower-case spelling: no leading zeros, longest zero run folded to ``::``."""
    halves = F.split(text, "::")
    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    left = groups(halves[0])
    right = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.lit(8) - F.size(left) - F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    short = F.array_join(
        F.transform(filled, lambda g: F.regexp_replace(g, r"^0+(?=.)", "")), ":"
    )
    # Fold the longest run of two or more zero groups, the leftmost on a tie.
    folded = F.when(short == "0:0:0:0:0:0:0:0", "::")
    for run in range(7, 1, -1):
        zeros = ":".join(["0"] * run)
        folded = folded.when(
            short.rlike(rf"(^|:){zeros}(:|$)"),
            F.regexp_replace(short, rf"^(.*?)(^|:){zeros}(:|$)", "$1::"),
        )
    folded = folded.otherwise(short)
    well_formed = (
        text.rlike(r"^[0-9a-f:]+$")
        & text.contains(":")
        & ~text.rlike(r":::|[0-9a-f]{5}|^:[^:]|[^:]:$")
        & (
            ((F.size(halves) == 1) & (F.size(left) == 8))
            | ((F.size(halves) == 2) & (missing >= 1))
        )
    )
    return F.when(well_formed, folded)


def describe_ip(ip: Column, country_code: Column | None = None, country: Column | None = None) -> Column:
    """``struct(code, label, type)`` of an address. No geolocation is guessed: a country is
    reported only when telemetry supplied one."""
    def place(code: str | Column, label: str | Column, kind: str) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_col(code).alias("code"), as_col(label).alias("label"),
                        F.lit(kind).alias("type"))

    code = null_if_empty(country_code) if country_code is not None else F.lit(None).cast("string")
    name = null_if_empty(country) if country is not None else F.lit(None).cast("string")
    text = F.lower(F.coalesce(strip(ip), F.lit("")))
    is_ipv4 = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    parts = [F.split_part(text, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    in_range = is_ipv4 & (F.greatest(*parts) <= 255)
    first, second, third, _ = parts
    unknown = place("--", "Unknown location", "unknown")
    private = (
        (first == 10) | ((first == 169) & (second == 254))
        | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))
    )
    documentation = (
        ((first == 192) & (second == 0) & (third == 2))
        | ((first == 198) & (second == 51) & (third == 100))
        | ((first == 203) & (second == 0) & (third == 113))
    )
    supplied = place(
        F.coalesce(null_if_empty(F.upper(strip(code))), F.lit("--")),
        strip(F.coalesce(name, code)), "country",
    )
    return (
        F.when((text == "") | (text == "unknown"), unknown)
        .when(text == "::1", place("LOCAL", "Loopback address", "private"))
        .when(text.rlike("^(fc|fd|fe80:)"), place("LOCAL", "Private network", "private"))
        .when(text.startswith("2001:db8:"), place("TEST", "Documentation range", "reserved"))
        .when(~F.coalesce(in_range, F.lit(False)), unknown)
        .when(first == 127, place("LOCAL", "Loopback address", "private"))
        .when(private, place("LOCAL", "Private network", "private"))
        .when(documentation, place("TEST", "Documentation range", "reserved"))
        .when(code.isNotNull() | name.isNotNull(), supplied)
        .otherwise(unknown)
    )
