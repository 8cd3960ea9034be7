"""Record parsers: one projection per format, no shuffle and no Python.

Every parser reads exploded records (``raw``, ``record``, ``header``, ``reason``) and adds the five
core fields, ``severity``, the format's own fields as JSON in ``parsed_data``, and ``reason`` for a
record that does not parse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions import text as X
from logvigil.functions.timefn import apache_date, syslog_date
from logvigil.sources.files import csv_cells, csv_header_fields

SEPARATOR = "\u0001"
NO_MATCH = "No regex match"


def regex_groups(c: Column, pattern: str, count: int) -> Column:
    """All groups of an anchored pattern from one match, null when it does not match.

    Calling ``regexp_extract`` per group would match the line once per group. That is done only for
    the odd line that contains the separator itself.
    """
    whole = pattern.rstrip("$") + r"(?s:.*)$"
    joined = F.regexp_replace(c, whole, SEPARATOR.join(f"${i}" for i in range(1, count + 1)))
    one_by_one = F.array(*[F.regexp_extract(c, pattern, i) for i in range(1, count + 1)])
    return F.when(
        c.rlike(pattern),
        F.when(F.instr(c, SEPARATOR) == 0, F.split(joined, SEPARATOR)).otherwise(one_by_one),
    )


@dataclass(frozen=True)
class Format:
    """How one format reads a record.

    ``stages`` are columns computed before the rest. ``given`` are the core fields the record states;
    what it leaves open is read from free ``text``, and an address from ``ip_text``.
    """

    stages: list[dict[str, Column]]
    given: dict[str, Column]
    severity: Column
    data: Column
    text: Column | None = None
    ip_text: Column | None = None
    reason: Column | None = None
    override: Column | None = None  # map of fields that replace the normalised value


PARSED = ["upload_id", "source_filename", "format", "line_number", "raw", *V.CORE_FIELDS,
          "severity", "parsed_data", "reason"]


def parse_records(records: DataFrame, year: int, csv_override: bool = True) -> DataFrame:
    """Parse records of mixed formats in one pass over the input."""
    formats = {
        "syslog": _syslog(year), "apache_combined": _apache(), "csv": _csv(csv_override),
        "json": _json(), "generic": _generic(),
    }
    comment = (F.col("format") == "syslog") & F.col("raw").startswith("#")
    return _parse(records.filter(~comment), formats).select(*PARSED)


def parse_syslog(records: DataFrame, year: int) -> DataFrame:
    return _parse(records.filter(~F.col("raw").startswith("#")), {"syslog": _syslog(year)})


def parse_apache(records: DataFrame) -> DataFrame:
    return _parse(records, {"apache_combined": _apache()})


def parse_csv(records: DataFrame, csv_override: bool = True) -> DataFrame:
    """Cells by header name. A column that is itself named like a core field replaces the
    normalised value as it stands, unless ``csv_override`` is off."""
    return _parse(records, {"csv": _csv(csv_override)})


def parse_json(records: DataFrame) -> DataFrame:
    return _parse(records, {"json": _json()})


def parse_generic(records: DataFrame) -> DataFrame:
    return _parse(records, {"generic": _generic()})


def _parse(records: DataFrame, formats: dict[str, Format]) -> DataFrame:
    """Add the parsed fields. With several formats, a row evaluates only its own branch, and what
    all formats share is written once, which keeps the generated code small.

    Sets ``spark.sql.variant.allowDuplicateKeys``: of a key that a JSON record repeats, the last value counts."""
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def branch(columns: dict[str, Column | None]) -> Column:
        chain = None
        for name, column in columns.items():
            if column is None:
                continue
            if len(formats) == 1:
                return column
            test = F.col("format") == name
            chain = F.when(test, column) if chain is None else chain.when(test, column)
        return F.lit(None).cast("string") if chain is None else chain

    def per_format(attribute: str) -> Column:
        return branch({name: getattr(fmt, attribute) for name, fmt in formats.items()})

    found, kept = records, [*records.columns, *V.CORE_FIELDS, "severity", "parsed_data"]
    for level in range(max(len(f.stages) for f in formats.values())):
        found = found.withColumns({
            key: branch({name: column})
            for name, fmt in formats.items() if level < len(fmt.stages)
            for key, column in fmt.stages[level].items()
        })
    found = found.withColumns({
        "_text": per_format("text"), "_ip_text": per_format("ip_text"),
        **{f"_{field}": branch({n: f.given.get(field) for n, f in formats.items()})
           for field in V.CORE_FIELDS},
    })
    text, given = F.col("_text"), lambda field: F.col(f"_{field}")
    core = {
        "timestamp": X.clean_text(given("timestamp")),
        "ip_address": X.normalize_ip(F.coalesce(given("ip_address"), X.first_ip(F.col("_ip_text")))),
        "username": X.clean_text(F.coalesce(given("username"), X.username_from_text(text))),
        "event_type": X.normalize_event_type(
            F.coalesce(given("event_type"), X.event_type_from_text(text))),
        "status": X.normalize_status(F.coalesce(given("status"), X.status_from_text(text))),
    }
    replaced = per_format("override")
    if any(fmt.override is not None for fmt in formats.values()):
        core = {
            name: F.when(F.map_contains_key(replaced, F.lit(name)),
                         F.try_element_at(replaced, F.lit(name))).otherwise(value)
            for name, value in core.items()
        }
    found = found.withColumns({**core, "severity": per_format("severity")})
    found = found.withColumns({
        "parsed_data": per_format("data"), "reason": F.coalesce("reason", per_format("reason")),
    })
    return found.select(*kept)


def _object(*extras: Column) -> Column:
    return F.to_json(F.struct(*V.CORE_FIELDS, *extras), {"ignoreNullFields": "false"})


def _syslog(year: int) -> Format:
    m = F.col("_sys")
    message = m[4]
    data = _object(
        m[1].alias("hostname"), X.strip(m[2]).alias("process"),
        m[3].try_cast("bigint").alias("pid"), X.strip(message).alias("message"),
        F.col("severity"),
    )
    return Format([{"_sys": regex_groups(F.col("raw"), V.SYSLOG_LINE, 5)}],
                  {"timestamp": syslog_date(m[0], year)}, X.severity_from_text(message), data, text=message,
                  ip_text=message, reason=F.when(m.isNull(), NO_MATCH))


def _apache() -> Format:
    m = F.col("_web")
    dash = lambda c: F.when(~c.isin("-", ""), c)
    request = F.split(F.concat(m[4], F.lit(" ")), " ", 3)
    method, code = request[0], m[5].try_cast("int")
    event_type = F.when(method != "", F.concat(F.lit("http_"), F.lower(method))).otherwise("http_request")
    given = {"timestamp": apache_date(m[3]), "ip_address": m[0], "username": dash(m[2]),
             "event_type": event_type, "status": X.status_from_http_code(code)}
    data = _object(
        m[0].alias("ip"), dash(m[1]).alias("ident"), dash(m[2]).alias("user"),
        X.null_if_empty(X.strip(method)).alias("method"),
        X.null_if_empty(X.strip(request[1])).alias("path"),
        X.null_if_empty(X.strip(F.get(request, F.lit(2)))).alias("protocol"),
        code.alias("status_code"),
        F.when(m[6] == "-", F.lit(0)).otherwise(m[6].try_cast("bigint")).alias("bytes"),
        dash(m[7]).alias("referer"), X.null_if_empty(m[8]).alias("user_agent"),
    )
    return Format([{"_web": regex_groups(F.col("raw"), V.APACHE_LINE, 9)}], given,
                  F.lit(None).cast("string"), data, reason=F.when(m.isNull(), NO_MATCH))


def _generic() -> Format:
    raw, kv, js, doc = F.col("raw"), F.col("_kv"), F.col("_js"), F.col("_doc")

    given = {
        field: F.coalesce(X.null_if_empty(X.pick_key(kv, names)), X.null_if_empty(X.pick_key(doc, names)))
        for field, names in V.GENERIC_ALIASES.items()
    }
    given["timestamp"] = X.extract_timestamp(raw)
    data = _object(F.col("severity").alias("level"), kv.alias("key_values"), js.alias("json"),
                   X.strip(raw).alias("message"))
    stages = [{"_kv": X.extract_kv(raw), "_js": X.extract_json(raw)},
              {"_doc": F.from_json(js, "map<string,string>")}]
    return Format(stages, given, X.extract_level(raw), data, text=raw, ip_text=raw)


def _json() -> Format:
    record, fields = F.col("record"), F.col("_fields")
    parents = sorted({a.split(".")[0] for names in V.JSON_ALIASES.values() for a in names if "." in a})
    pick = lambda field: X.pick_key(fields, V.JSON_ALIASES[field])
    given = {field: pick(field) for field in V.CORE_FIELDS}
    data = _object(F.col("severity"),
                   F.coalesce(pick("message"), record).alias("message"), record.alias("json"))
    stages = [{"_document": F.try_parse_json(record)}, {"_fields": X.scalar_fields(F.col("_document"), parents)}]
    return Format(stages, given,
                  pick("severity"), data, ip_text=record)


def _csv(override: bool) -> Format:
    pairs, row = F.col("_pairs"), F.col("_row")
    cells = X.coerce_cells(csv_cells(F.col("record")))
    zipped = F.filter(
        F.arrays_zip(F.col("header").alias("key"), cells.alias("cell")), lambda p: p["key"].isNotNull()
    )
    named = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["cell"]["text"].alias("value")))
    pick = lambda field: X.pick_key(row, V.CSV_ALIASES[field])
    cell_parts = F.transform(pairs, lambda p: F.concat(
        X.json_text(p["key"]), F.lit(":"), X.cell_json(p["cell"])))
    own = F.array(*[
        F.when(~F.map_contains_key(row, F.lit(name)),
               F.concat(F.lit(f'"{name}":'), F.when(F.col(name).isNull(), "null").otherwise(X.json_text(F.col(name)))))
        for name in V.CORE_FIELDS
    ])
    data = F.concat(F.lit("{"), F.array_join(F.concat(F.array_compact(own), cell_parts), ","), F.lit("}"))
    level = F.coalesce(F.try_element_at(row, F.lit("severity")), F.try_element_at(row, F.lit("level")))
    stages = [{"_pairs": F.when(F.col("reason").isNull(), zipped)},
              {"_row": F.map_from_entries(X.last_entries(named))}]
    return Format(stages, {field: pick(field) for field in V.CORE_FIELDS}, level, data,
                  ip_text=F.concat_ws(" ", F.map_values(row)), override=row if override else None)


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def dead_letter(parsed: DataFrame) -> DataFrame:
    """Skipped records: where they were, why, and their text."""
    return parsed.filter(F.col("reason").isNotNull()).select(
        "upload_id", "source_filename", "format", "line_number", "reason", "raw"
    )


def format_fields(files: DataFrame) -> Column:
    """The fields that parsing a file gives: the core fields and those of its format, or the columns of a CSV file's
    header, each once; none for a CSV file without a header. Reads format and text, or header where that is known."""
    array = lambda names: F.array(*map(F.lit, names))
    head = F.col("header") if "header" in files.columns else csv_header_fields(F.col("text"))
    chain = F.when(F.col("format") == "csv", F.when(F.size(head) > 0, F.array_distinct(F.concat(array(V.CORE_FIELDS), head))).otherwise(F.array().cast("array<string>")))
    for name, own in V.FORMAT_FIELDS.items():
        chain = chain.when(F.col("format") == name, array([*V.CORE_FIELDS, *own]))
    return chain


def parse_summary(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per upload: parsed and skipped counts, and the rejection of uploads without any event.

    ``files`` (with total_lines) keeps uploads that produced no record at all; ``fields`` is
    carried over where they have it (see ``format_fields``).
    """
    counts = parsed.groupBy("upload_id").agg(
        F.count_if(F.col("reason").isNull()).alias("parsed_entries"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped_lines"),
    )
    if files is not None:
        described = files.select("upload_id", "source_filename", "format", "total_lines", *[c for c in ("fields",) if c in files.columns])
        counts = described.join(counts, "upload_id", "left").na.fill(0, ["parsed_entries", "skipped_lines"])
    return counts.withColumn(
        "code", F.when(F.col("parsed_entries") == 0, "NO_PARSEABLE_EVENTS")
    )


def parse_auth_lines(lines: DataFrame) -> DataFrame:
    """Seven-field authentication records of an auth log; unclassified lines are dropped."""
    line = X.strip(F.col("raw"))
    found = lines.withColumn("m", regex_groups(line, V.AUTH_SYSLOG_LINE, 4)).withColumn(
        "old", regex_groups(line, V.AUTH_LEGACY_LINE, 2)
    )
    m, old = F.col("m"), F.col("old")
    found = found.withColumn("message", F.coalesce(m[3], old[1]))
    # An exploded empty array drops the row. A filter would be pushed below these projections and
    # evaluate the whole chain of patterns a second time.
    known = F.filter(F.array(X.classify_auth_event(F.col("message"))), lambda o: o["event_type"] != "unknown")
    kept = found.select("*", F.explode(known).alias("outcome"))
    return kept.select(
        *[c for c in lines.columns if c != "raw"], F.coalesce(m[0], old[0]).alias("timestamp"),
        F.coalesce(m[1], F.lit("")).alias("host"), X.normalize_source(m[2], F.col("message")).alias("source"),
        F.regexp_extract("message", V.AUTH_IP, 1).alias("ip"),
        X.extract_auth_user(F.col("message"), F.col("outcome.event_type")).alias("user"),
        "outcome.event_type", "outcome.status",
    )


def parse_auth_csv(rows: DataFrame) -> DataFrame:
    """The same seven fields from a CSV read with a header."""
    have = lambda *names: X.pick(rows.columns, *names)
    text = lambda c: F.coalesce(c, F.lit(""))
    event = F.replace(F.lower(text(have("event_type", "event"))), F.lit(" "), F.lit("_"))
    status = F.lower(text(have("status")))
    return rows.select(
        text(have("timestamp")).alias("timestamp"), text(have("host")).alias("host"),
        X.normalize_source(have("source"), text(have("event_type"))).alias("source"),
        text(have("ip")).alias("ip"), text(have("user", "username")).alias("user"),
        event.alias("event_type"),
        F.when(status.isin("fail", "failed"), "failure")
        .when(status.isin("ok", "success", "successful"), "success").otherwise(status).alias("status"),
    )
