"""Text expressions: cleaning, normalising and classifying raw log fields.

Every function takes and returns a ``Column``, so Catalyst can fuse them into the scan stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from logvigil.functions import fixed_values as V


def strip(c: Column) -> Column:
    """Remove surrounding white space of any kind (``trim`` alone only drops blanks)."""
    return F.btrim(c, F.lit(" \t\n\r\u000b\f"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def match_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without a match. Evaluates the pattern once, where a
    null test around ``regexp_extract`` would evaluate it twice."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def first_match(c: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[match_group(c, flags + p) for p in patterns])


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Literal table lookup; the map is folded into one constant, so generated code stays short."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when any of the words occurs.

    Byte search per word beats one alternation pattern. A word that contains another one of the
    list adds nothing and is left out.
    """
    words = list(words)
    needed = [w for w in words if not any(other != w and other in w for other in words)]
    return reduce(lambda found, word: found | c.contains(word), needed[1:], c.contains(needed[0]))


def clean_text(c: Column) -> Column:
    stripped = strip(c.cast("string"))
    return F.when(~stripped.isin(V.NULL_TOKENS), stripped)


def first_ip(c: Column) -> Column:
    return match_group(c, rf"\b{V.IPV4}\b", 0)


def normalize_ip(c: Column) -> Column:
    cleaned = clean_text(c)
    return F.when(cleaned.rlike(rf"^{V.IPV4}$"), cleaned)


def normalize_status(c: Column) -> Column:
    key = F.lower(strip(F.regexp_replace(clean_text(c), r"[\s_-]+", " ")))
    return F.coalesce(lookup(key, V.STATUS_ALIASES, F.upper(key)), F.lit("UNKNOWN"))


def normalize_event_type(c: Column) -> Column:
    slug = F.regexp_replace(clean_text(c), r"[^a-zA-Z0-9]+", "_")
    slug = F.lower(F.regexp_replace(slug, r"^_+|_+$", ""))
    return F.coalesce(null_if_empty(slug), F.lit("security_event"))


def status_from_text(c: Column) -> Column:
    text = F.lower(c)
    return (
        F.when(contains_any(text, V.FAILED_WORDS), "FAILED")
        .when(contains_any(text, V.SUCCESS_WORDS), "SUCCESS")
        .when(contains_any(text, V.INFO_WORDS), "INFO")
        .otherwise("UNKNOWN")
    )


def event_type_from_text(c: Column) -> Column:
    text, chain = F.lower(c), None
    for event_type, words in V.EVENT_TYPE_WORDS:
        test = contains_any(text, words)
        chain = F.when(test, event_type) if chain is None else chain.when(test, event_type)
    return chain.otherwise("security_event")


def username_from_text(c: Column) -> Column:
    """Every pattern needs one of a few words, so most lines skip all nine of them."""
    worth_a_look = contains_any(F.lower(c), ["for", "user", "tty=", "logname="])
    return F.when(worth_a_look, first_match(c, V.USERNAME_PATTERNS, flags="(?i)"))


def status_from_http_code(c: Column) -> Column:
    return (
        F.when(c.between(200, 399), "SUCCESS").when(c.between(400, 599), "FAILED").otherwise("UNKNOWN")
    )


def severity_from_text(c: Column) -> Column:
    text, chain = F.lower(c), None
    for level, words in V.SEVERITY_WORDS:
        test = contains_any(text, words)
        chain = F.when(test, level) if chain is None else chain.when(test, level)
    return chain.otherwise("UNKNOWN")


def extract_level(c: Column) -> Column:
    return F.upper(match_group(c, V.LEVEL_PATTERN))


def extract_timestamp(c: Column) -> Column:
    return first_match(c, V.TIMESTAMP_PATTERNS)


def extract_kv(c: Column) -> Column:
    """``k=v`` and ``k="v"`` pairs as a map, the last duplicate winning; null when there is none."""
    found = F.when(c.contains("="), F.regexp_extract_all(c, F.lit(V.KEY_VALUE_PATTERN), F.lit(0)))

    def pair(text: Column) -> Column:
        value = F.substr(text, F.instr(text, "=") + 1)
        return F.struct(
            F.substring_index(text, "=", 1).alias("key"),
            F.nullif(F.when(value.startswith('"'), F.btrim(value, F.lit('"'))).otherwise(value), F.lit("")).alias("value"),
        )

    return F.when(F.size(found) > 0, F.map_from_entries(last_entries(F.transform(found, pair))))


def last_entries(pairs: Column) -> Column:
    """Key-value structs with only the last of each key, as ``map_from_entries`` wants them.

    A record holds a handful of pairs, so the quadratic scan is cheaper than a map of lists.
    """
    def is_last(pair: Column, i: Column) -> Column:
        later = F.slice(pairs, i + 2, F.size(pairs))
        return ~F.exists(later, lambda other: other["key"] == pair["key"])

    return F.filter(pairs, is_last)


def extract_json(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` when it is one valid JSON object, else null."""
    body = F.when(c.contains("{"), match_group(c, r"(?s)\{.*\}", 0))
    return F.when(F.size(json_items(body)) == 1, body)


def json_items(c: Column) -> Column:
    """The text read as the inside of a JSON array: null when it is not valid JSON.

    Each element keeps its own source text in compact form and key order. A single valid document
    gives one element, which is how callers tell one document from several.
    """
    return F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")


def coerce_cell(c: Column) -> Column:
    """Typed reading of a CSV cell as ``struct(kind, text)``: see ``coerce_cells``."""
    return coerce_cells(F.array(c))[0]


def coerce_cells(cells: Column) -> Column:
    """Typed reading of CSV cells.

    ``kind`` is null / int / float / bool / string and ``text`` the canonical spelling of the value.
    Digits may be grouped by single underscores and an integer may have any length; nan, inf and infinity are floats.
    Each step binds its result to a lambda variable, so a cell is cleaned and matched only once.
    """
    digits = r"\d+(?:_\d+)*"

    def kind(value: Column) -> Column:
        number_like = F.ascii(value) < 58  # digits, signs and the dot sort before letters
        return (
            F.when(value.isNull(), "null")
            .when(number_like & value.rlike(rf"^[+-]?{digits}$"), "int")
            .when(number_like & value.rlike(rf"^[+-]?({digits}\.?({digits})?|\.{digits})([eE][+-]?{digits})?$"), "float")
            .when((F.length(value) < 6) & F.lower(value).isin("true", "false"), "bool")
            .when((F.length(value) < 10) & F.lower(value).isin(V.NOT_FINITE), "float")
            .otherwise("string")
        )

    def canonical(cell: Column) -> Column:
        value = cell["text"]
        return F.struct(cell["kind"].alias("kind"), (
            F.when(cell["kind"] == "string", value)
            .when((cell["kind"] == "int") & (F.length(value) < 39) & ~value.contains("_"), value.try_cast("decimal(38,0)").cast("string"))
            .when(cell["kind"] == "int", F.regexp_replace(
                F.regexp_replace(F.replace(value, F.lit("_")), r"^\+?(-?)0*(?=\d)", "$1"), r"^-0$", "0"))
            .when(cell["kind"] == "float", F.coalesce(F.replace(value, F.lit("_")).try_cast("double").cast("string"), F.lit("NaN")))  # a signed nan
            .when(cell["kind"] == "bool", F.initcap(value))
        ).alias("text"))

    values = F.transform(F.transform(cells, lambda c: strip(c.cast("string"))),
                         lambda v: F.when(~v.isin(V.NULL_TOKENS), v))
    kinds = F.transform(values, lambda v: F.struct(kind(v).alias("kind"), v.alias("text")))
    return F.transform(kinds, canonical)


def json_text(c: Column) -> Column:
    """JSON string literal of a text, null for null. Only text with special characters is encoded."""
    encoded = F.to_json(F.array(c))
    return F.when(c.rlike(r'["\\\x00-\x1F\x7F]'), F.substr(encoded, F.lit(2), F.length(encoded) - 2)).otherwise(
        F.concat(F.lit('"'), c, F.lit('"')))


def cell_json(cell: Column) -> Column:
    """JSON literal of a coerced cell; a number that is not finite, which JSON cannot write, is a string."""
    return (
        F.when(cell["kind"] == "null", "null")
        .when((cell["kind"] == "float") & cell["text"].isin("NaN", "Infinity", "-Infinity"), json_text(cell["text"]))
        .when(cell["kind"].isin("int", "float"), cell["text"])
        .when(cell["kind"] == "bool", F.lower(cell["text"]))
        .otherwise(json_text(cell["text"]))
    )


def pick(available: Iterable[str], *aliases: str) -> Column:
    """First non-null among the alias columns that exist."""
    names = set(available)
    present = [F.col(a) for a in aliases if a in names]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def pick_key(mapping: Column, aliases: Iterable[str]) -> Column:
    """First non-null among map keys."""
    return F.coalesce(*[F.try_element_at(mapping, F.lit(a)) for a in aliases])


def scalar_fields(document: Column, parents: Iterable[str] = ()) -> Column:
    """Scalar fields of a VARIANT object as ``map<path, text>``, with those of the named parents
    under dotted paths. Objects, arrays, nulls and empty strings are left out."""
    def scalars(value: Column, prefix: str) -> Column:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        named = F.map_filter(
            fields,
            lambda k, x: ~k.contains(".") & ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)")
            & (x.cast("string") != ""),
        )
        named = F.transform_values(named, lambda k, x: x.cast("string"))
        renamed = F.transform_keys(named, lambda k, x: F.concat(F.lit(prefix), k)) if prefix else named
        return F.coalesce(renamed, F.create_map().cast("map<string,string>"))

    return F.map_concat(scalars(document, ""), *[
        scalars(F.try_variant_get(document, f"$.{parent}", "variant"), f"{parent}.")
        for parent in parents
    ])


def pick_path(document: Column, paths: Iterable[str]) -> Column:
    """First scalar, non-empty value among dotted paths of a VARIANT document."""
    paths = list(paths)
    parents = sorted({p.split(".")[0] for p in paths if "." in p})
    return pick_key(scalar_fields(document, parents), paths)


def classify_auth_event(c: Column) -> Column:
    """``struct(event_type, status)`` of an authentication message, first matching family wins."""
    text = F.lower(c)

    def outcome(event_type: str, status: str) -> Column:
        return F.struct(F.lit(event_type).alias("event_type"), F.lit(status).alias("status"))

    sudo_failed = text.contains("sudo") & contains_any(
        text, ["authentication failure", "auth failure", "pam_unix"]
    )
    return (
        F.when(text.contains("failed password"), outcome("failed_login", "failure"))
        .when(text.contains("invalid user"), outcome("invalid_user", "failure"))
        .when(contains_any(text, ["accepted password", "accepted publickey"]),
              outcome("successful_login", "success"))
        .when(sudo_failed, outcome("sudo_auth_failure", "failure"))
        .when(text.contains("connection closed"), outcome("connection_closed", "closed"))
        .otherwise(outcome("unknown", "unknown"))
    )


def extract_auth_user(message: Column, event_type: Column) -> Column:
    chain = None
    for kind, patterns in V.AUTH_USER_PATTERNS.items():
        user = F.regexp_replace(first_match(message, patterns), r"^[,;]+|[,;]+$", "")
        test = event_type == kind
        chain = F.when(test, user) if chain is None else chain.when(test, user)
    return F.coalesce(chain, F.lit(""))


def normalize_source(source: Column, message: Column) -> Column:
    process, text = F.lower(F.coalesce(source, F.lit(""))), F.lower(message)
    return (
        F.when(process.contains("sshd") | text.contains("sshd"), "sshd")
        .when(process.contains("sudo") | text.contains("sudo"), "sudo")
        .otherwise(process)
    )


def csv_guard(c: Column) -> Column:
    """Quoted CSV cell that a spreadsheet will not read as a formula."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " ")
    text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def haystack_contains(columns: Iterable[Column], query: str) -> Column:
    """Case-insensitive literal search over the blank-joined columns; nulls count as empty."""
    text = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.lower(text).contains(query.lower())
