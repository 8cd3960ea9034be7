"""File scan, admission checks, format detection and splitting into records.

Everything up to the split works on one row per file, so the split needs no shuffle. No file is refused
for its size unless the caller sets ``max_file_bytes``; a file has to fit into one value, below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import json_items, once, strip

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
CSV_FIELD = r'(?:"(?:[^"]++|"")*+(?:"|\z)[^,\r\n]*+|[^,\r\n]*+)'
CSV_RECORD = rf"({CSV_FIELD}(?:,{CSV_FIELD})*+)(?:\r\n|\n|\r|\z)"


def scan_files(spark: SparkSession, *paths: str, recursive: bool = True, max_file_bytes: int | None = None) -> DataFrame:
    """One row per file: path, name, ext, length, modified, content.

    With a size limit, content is read only for files within it; the reader prunes the others on length.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .load(list(paths))
    )
    if max_file_bytes is None:
        return describe_files(found)
    within = found.filter(F.col("length") <= max_file_bytes)
    beyond = found.filter(F.col("length") > max_file_bytes).withColumn(
        "content", F.lit(None).cast("binary")
    )
    return describe_files(within.unionByName(beyond))


def describe_files(found: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        "path", name.alias("name"), file_extension(name).alias("ext"), "length",
        F.col("modificationTime").alias("modified"), "content",
    )


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last dot, empty without a dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def validate_files(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Adds ``code`` (null when admitted) and ``text``. The first failing check names the code.

    Reads name, ext, length, content and, when present, content_type.
    """
    as_bytes = F.decode(F.col("content"), "ISO-8859-1")  # one character per byte
    checks = F.when(~F.concat(F.lit("."), F.col("ext")).isin(V.ALLOWED_EXTENSIONS), "INVALID_FILE_TYPE")
    if "content_type" in files.columns:
        mime = strip(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))
        checks = checks.when((mime != "") & ~mime.isin(V.ALLOWED_MIME_TYPES), "INVALID_MIME_TYPE")
    if max_file_bytes is not None:
        checks = checks.when(F.col("length") > max_file_bytes, "FILE_TOO_LARGE")
    checks = (
        checks.when(~as_bytes.rlike(r"[^\s]"), "EMPTY_FILE")
        .when(as_bytes.contains("\u0000"), "BINARY_FILE")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "ENCODING_ERROR")
    )
    return files.withColumn("code", checks).withColumn(
        "text", F.when(F.col("code").isNull(), F.col("content").cast("string"))
    )


def admitted(files: DataFrame) -> DataFrame:
    return files.filter(F.col("code").isNull()).drop("code", "content")


def rejected(files: DataFrame) -> DataFrame:
    return files.filter(F.col("code").isNotNull()).drop("text", "content")


def text_lines(text: Column) -> Column:
    """Non-blank lines of a text, in order."""
    return F.filter(F.split(text, LINE_BREAK), lambda line: line.rlike(r"\S"))


def detect_format(ext: Column, lines: Column, sample_lines: int | None = 5) -> Column:
    """Format by extension, else by the first ``sample_lines`` lines; None: by any line of the file."""
    head = lines if sample_lines is None else F.slice(lines, 1, sample_lines)
    return (
        F.when(ext == "csv", "csv")
        .when(ext.isin("json", "jsonl"), "json")
        .when(F.exists(head, lambda line: line.rlike(V.APACHE_HINT)), "apache_combined")
        .when(F.exists(head, lambda line: line.rlike(V.SYSLOG_HINT)), "syslog")
        .otherwise("generic")
    )


def with_lines(files: DataFrame, sample_lines: int | None = 5) -> DataFrame:
    """Adds lines, format and total_lines to admitted files."""
    lines = files.withColumn("lines", text_lines(F.col("text")))
    return lines.withColumn("format", detect_format(F.col("ext"), F.col("lines"), sample_lines)).withColumn(
        "total_lines", F.size("lines").cast("bigint")
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per non-blank line, numbered from one within its file."""
    keep = [c for c in files.columns if c not in ("lines", "text")]
    return files.select(*keep, F.posexplode("lines").alias("_i", "raw")).select(
        *keep, (F.col("_i") + 1).cast("bigint").alias("line_number"), "raw"
    )


def csv_cells(record: Column) -> Column:
    """Unquoted cells of one CSV record."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({CSV_FIELD})"), F.lit(1))

    def unquoted(field: Column) -> Column:
        inner = F.regexp_extract(field, r'(?s)^"((?:[^"]++|"")*+)"?', 1)
        rest = F.regexp_extract(field, r'(?s)^"(?:[^"]++|"")*+"?(.*)$', 1)
        return F.when(
            field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)
        ).otherwise(field)

    return F.transform(fields, unquoted)


def csv_header_fields(text: Column) -> Column:
    """Column names of a CSV text's first record; empty when that is blank."""
    first = F.regexp_extract(text, CSV_RECORD, 1)
    names = F.transform(csv_cells(first), lambda h: F.replace(F.lower(strip(h)), F.lit(" "), F.lit("_")))
    return F.when(first != "", names).otherwise(F.array().cast("array<string>"))


_RECORD = "struct<line_number:bigint,raw:string,record:string,reason:string>"


def _record(number: Column, raw: Column, record: Column, reason: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        number.cast("bigint").alias("line_number"), raw.alias("raw"), record.alias("record"),
        (none if reason is None else reason).alias("reason"),
    )


def _line_records(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: _record(i + 1, line, line))


def _csv_records(text: Column, lines: Column) -> Column:
    """Data rows numbered from two, since the header is row one. No header: one skipped record."""
    found = F.regexp_extract_all(text, F.lit(CSV_RECORD), F.lit(1))
    rows = F.filter(F.slice(found, 2, F.size(found)), lambda r: r != "")
    missing = F.array(_record(F.lit(1), F.lit(""), F.lit(""), F.lit("No header row found")))
    data = F.transform(
        rows, lambda r, i: _record(i + 2, F.coalesce(F.get(lines, i + 1), F.lit("")), r)
    )
    return F.when(F.coalesce(F.get(found, F.lit(0)), F.lit("")) == "", missing).otherwise(data)


def json_records(document: Column) -> Column:
    """Records of one JSON document: an array, the array under a container key, or itself."""
    array = lambda value: F.when(value.startswith("["), F.from_json(value, "array<string>"))
    inside = once(F.from_json(document, "map<string,string>"), lambda keys: F.coalesce(*[
        array(F.try_element_at(keys, F.lit(k))) for k in V.JSON_CONTAINER_KEYS
    ]))
    return (
        F.when(document.startswith("["), F.from_json(document, "array<string>"))
        .when(document.startswith("{"), F.coalesce(inside, F.array(document)))
        .otherwise(F.array().cast("array<string>"))
    )


def one_document(text: Column) -> Column:
    """Compact text of the single JSON document in ``text``, null when there is not exactly one."""
    return once(json_items(text), lambda items: F.when(F.size(items) == 1, items[0]))


def _json_text_records(text: Column) -> Column:
    """Records of a whole document, else of every line, bad lines kept with a reason.

    Good records are numbered in sequence over the file, bad lines by their physical line.
    """
    physical = F.split(text, LINE_BREAK)
    per_line = F.filter(
        F.transform(physical, lambda line, i: F.struct(
            line.alias("line"), (i + 1).alias("number"), one_document(line).alias("document"))),
        lambda l: l["line"].rlike(r"\S"),
    )

    def numbered(good: Column) -> Column:
        return F.transform(
            good,
            lambda r, i: F.when(r.startswith("{"), _record(i + 1, r, r)).otherwise(
                _record(i + 1, r, F.lit(None).cast("string"),
                        F.lit("JSON event must be an object."))),
        )

    def of_lines(lines: Column) -> Column:
        bad = F.transform(
            F.filter(lines, lambda l: l["document"].isNull()),
            lambda l: _record(l["number"], l["line"], F.lit(None).cast("string"),
                              F.lit("Invalid JSON: not a single well-formed document")),
        )
        documents = F.transform(
            F.filter(lines, lambda l: l["document"].isNotNull()), lambda l: json_records(l["document"])
        )
        return F.concat(numbered(F.flatten(documents)), bad)

    # The whole text and each line are parsed once.
    return once(one_document(text), lambda whole: F.when(whole.isNotNull(), numbered(json_records(whole))).otherwise(
        once(per_line, of_lines)))


def explode_records(files: DataFrame) -> DataFrame:
    """One row per record of any format: line_number, raw, record, reason, and the CSV header."""
    keep = [c for c in files.columns if c not in ("lines", "text")]
    text, lines = F.col("text"), F.col("lines")
    records = (
        F.when(F.col("format") == "csv", _csv_records(text, lines))
        .when(F.col("format") == "json", _json_text_records(text))
        .otherwise(_line_records(lines))
    ).cast(f"array<{_RECORD}>")
    header = F.when(
        F.col("format") == "csv",
        F.transform(
            csv_cells(F.regexp_extract(text, CSV_RECORD, 1)),
            lambda h: F.replace(F.lower(strip(h)), F.lit(" "), F.lit("_")),
        ),
    )
    return files.select(*keep, header.alias("header"), F.explode(records).alias("r")).select(
        *keep, "header", "r.line_number", "r.raw", "r.record", "r.reason"
    )
