"""Ingest of files of any size: the records of ``files.explode_records``, read by file splits.

The whole-file path holds a file in one value. Here Spark's text reader cuts files into splits, rows keep the order of
their split, and everything that depends on the rest of a file is a small summary of each split, combined over the
splits of a file:

* line numbers are prefix sums of the lines of each split;
* whether a CSV row starts inside quotes is a map from two states to two states for each row; a row either forces a
  state, keeps it or turns it round, so maps combine by "last forced state and parity since". Only records that go
  over several rows are brought together;
* a JSON file is read in pieces that end at a closing brace, so that a document on one line is cut too. A split maps
  inside / outside of a string to the same and to a change of depth. With its start known, a split cuts the elements
  of the array at hand at their commas; only those at its ends are brought together with those of its neighbours.

Rows are materialised once, in the reader's partitions and order (``checkpoint``), so passes agree on the splits. What
reaches the driver: two states for each split of a JSON file or of a CSV file with a record over a split's end, and the paths of JSON
files, which the reader's file listing holds there anyway. A single record, or a JSON document without an array to
cut, still has to fit into one value. A byte order mark at the start of a file is left out by the text reader.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import json_items, strip
from logvigil.session import reliable_checkpoint, ship_with_tasks
from logvigil.sources import files as S

Name = Callable[[Column], Column]
_CONTAINERS = tuple(V.JSON_CONTAINER_KEYS)
FILE = ["path", "name", "ext", "length", "modified", "format", "total_lines"]
RECORD = [*FILE, "header", "line_number", "raw", "record", "reason"]


def last_element(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


#: Bytes of a task's splits where the split size is set for a call.
TASK_BYTES = 32 << 20


@contextmanager
def _split_size(spark: SparkSession, size: int | None, listed: DataFrame):
    """The reader's split size, for tests and small inputs; None leaves the session's.

    A split is a place where a file is cut, not a task: small splits of the files ``listed`` are packed into tasks of
    ``TASK_BYTES``, but into as many as a shuffle has at least. Tasks stream, so none holds its splits.
    """
    if size is None:
        yield
        return
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    values = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": tasks}
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def list_files(spark: SparkSession, *paths: str, name: Name = last_element) -> DataFrame:
    """One row per file, without its content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    found = found.select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"))
    named = found.withColumn("name", name(_decoded(F.col("path"))))
    return named.select("path", "name", S.file_extension(F.col("name")).alias("ext"), "length", "modified")


def _rows(spark: SparkSession, paths: list[str], separator: str, name: Name, wanted: Callable[[Column], Column], max_file_bytes: int | None) -> DataFrame:
    """``path, start, value`` in order: what lies between separators, by file and split. Files not wanted are not opened."""
    found = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(paths)
    ext = S.file_extension(name(_decoded(F.col("_metadata.file_path"))))
    if max_file_bytes is not None:
        found = found.filter(F.col("_metadata.file_size") <= max_file_bytes)
    return found.filter(wanted(ext)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _held(rows: DataFrame) -> DataFrame:
    """Materialised with a number that grows over the rows of a split."""
    return reliable_checkpoint(rows.withColumn("seq", F.monotonically_increasing_id()))


_PART = ["path", "start"]


def _prefix(name: str) -> Column:
    """Sum over the splits before, within a file."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(before), F.lit(0))


def _of_file(aggregate: Column) -> Column:
    """Over all splits of a file."""
    return aggregate.over(Window.partitionBy("path"))


# Lines


def _body(value: Column) -> Column:
    """A row without the carriage return of its line break."""
    return F.regexp_replace(value, r"\r\z", "")


def _lines(rows: DataFrame) -> DataFrame:
    """Non-blank lines; ``at`` numbers them and ``physical_at`` all lines, in order, within a partition."""
    lines = rows.select(*_PART, F.explode(F.split(_body(F.col("value")), S.LINE_BREAK)).alias("raw"))
    lines = lines.withColumn("physical_at", F.monotonically_increasing_id())
    return lines.filter(F.col("raw").rlike(r"\S")).withColumn("at", F.monotonically_increasing_id())


def _flags(rows: DataFrame) -> DataFrame:
    """What admission asks of a split: readable text, null bytes, valid UTF-8."""
    value = F.col("value")
    return rows.groupBy(*_PART).agg(
        F.max(F.decode(value.cast("binary"), "ISO-8859-1").rlike(r"[^\s]")).alias("has_text"),
        F.max(value.contains("\u0000")).alias("has_null"), F.max(~F.is_valid_utf8(value)).alias("is_broken"))


def _line_splits(rows: DataFrame) -> DataFrame:
    """For each split its numbers of lines, what lies before it, and of its file the first line that looks like a format."""
    hint = lambda pattern: F.min(F.when(F.col("raw").rlike(pattern), F.col("at")))
    counts = _lines(rows).groupBy(*_PART).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"),
        hint(V.APACHE_HINT).alias("apache"), hint(V.SYSLOG_HINT).alias("syslog"))
    physical = rows.select(*_PART, F.explode(F.split(_body(F.col("value")), S.LINE_BREAK)).alias("raw"))
    physical = physical.withColumn("physical_at", F.monotonically_increasing_id()).groupBy(*_PART).agg(
        F.count(F.lit(1)).alias("n_physical"), F.min("physical_at").alias("first_physical"))
    splits = physical.join(counts, _PART, "left").join(_flags(rows), _PART).fillna(0, ["n"])
    splits = splits.withColumns({"before": _prefix("n"), "before_physical": _prefix("n_physical")})
    place = lambda at: _of_file(F.min(F.col(at) - F.col("first_at") + F.col("before") + 1))
    return splits.withColumns({"apache": place("apache"), "syslog": place("syslog"), "total_lines": _of_file(F.sum("n"))})


def _numbered(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``line_number, physical, raw`` with the columns of the split."""
    return _lines(rows).join(splits, _PART).withColumns({
        "line_number": F.col("at") - F.col("first_at") + F.col("before") + 1,
        "physical": F.col("physical_at") - F.col("first_physical") + F.col("before_physical") + 1,
    })


def line_files(splits: DataFrame, sample_lines: int | None) -> DataFrame:
    """Per file its flags, lines and format by content."""
    near = lambda c: F.col(c).isNotNull() if sample_lines is None else F.col(c) <= sample_lines
    return splits.groupBy("path").agg(
        F.max("has_text").alias("has_text"), F.max("has_null").alias("has_null"), F.max("is_broken").alias("is_broken"),
        F.max("total_lines").alias("total_lines"), F.max("apache").alias("apache"), F.max("syslog").alias("syslog"),
    ).withColumn("by_content", F.when(near("apache"), "apache_combined").when(near("syslog"), "syslog").otherwise("generic")).drop("apache", "syslog")


# CSV

_CLOSED = r'(?:"(?:[^"]++|"")*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'
_OPENS = rf'(?:{_CLOSED}[,\r\n])*+"(?:[^"]++|"")*+\z'
_REST = r'(?:[^"]++|"")*+"[^,\r\n]*+'


def _csv_states(value: Column) -> dict[str, Column]:
    """Of a row, from outside (0) and inside (1) of quotes: does it end inside, and how many records begin in it."""
    quoted = value.contains('"')
    inner = F.regexp_replace(value, rf'\A{_REST}(?:,{S.CSV_FIELD})*+(?:\r\n|\n|\r|\z)', "")
    closes = quoted & value.rlike(rf"\A{_REST}")
    begin = lambda text: F.size(F.filter(F.regexp_extract_all(text, F.lit(S.CSV_RECORD), F.lit(1)), lambda r: r != ""))
    return {
        "f0": quoted & value.rlike(rf"\A{_OPENS}"),
        "f1": ~closes | value.rlike(rf"\A{_REST}[,\r\n]{_OPENS}"),
        "c0": begin(value), "c1": F.when(closes, begin(inner)).otherwise(0),
        "lines": F.size(S.text_lines(_body(value))),
    }


def _split_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """Stretches of rows of one split, and whether the split begins with them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        codes = paths.indices.to_numpy()
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = (paths.dictionary[codes[low]].as_py(), int(starts[low]))
            yield key, key != last, batch.slice(low, high - low)
            last = key


def _states(f0: np.ndarray, f1: np.ndarray, state: bool) -> np.ndarray:
    """The state before each row and after the last, from two-state maps and the state at the start."""
    n = len(f0)
    turns = np.r_[0, np.cumsum(f0 & ~f1)]
    forced = np.maximum.accumulate(np.r_[0, np.where(f0 == f1, np.arange(1, n + 1), 0)])
    value = np.r_[state, f0][forced]
    return value ^ ((turns - turns[forced]) % 2).astype(bool)


def _csv_maps(rows: DataFrame) -> DataFrame:
    """``path, start, e0, e1``: the state map of each split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, (False, True)
        for key, begins, part in _split_groups(batches):
            if begins:
                if now:
                    yield pa.RecordBatch.from_pydict({"path": [now[0]], "start": [now[1]], "e0": [ends[0]], "e1": [ends[1]]})
                now, ends = key, (False, True)
            f0, f1 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("f0", "f1"))
            ends = tuple(bool(_states(f0, f1, e)[-1]) for e in ends)
        if now:
            yield pa.RecordBatch.from_pydict({"path": [now[0]], "start": [now[1]], "e0": [ends[0]], "e1": [ends[1]]})

    return rows.select(*_PART, "f0", "f1").mapInArrow(run, "path string, start long, e0 boolean, e1 boolean")


def _start_inside(maps: DataFrame) -> set[tuple[str, int]]:
    """Splits that start inside quotes. Files of which no split opens a quote and leaves it open are not looked at."""
    some = maps.withColumn("any", _of_file(F.max("e0"))).filter("any").select(*_PART, "e0", "e1")
    found, now, inside = set(), None, False
    for path, start, e0, e1 in sorted(map(tuple, some.collect())):
        inside = inside if path == now else False
        if inside:
            found.add((path, start))
        now, inside = path, (e1 if inside else e0)
    return found


def _csv_rows(rows: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """Rows with their state, and counted within their split: units (stretches of rows that belong together), records, lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, unit, record, line, number = False, 0, 0, 0, 0
        for key, begins, part in _split_groups(batches):
            if begins:
                state, unit, record, line, number = key in inside, 0, 0, 0, 0
            f0, f1, c0, c1, lines = (part.column(c).to_numpy(zero_copy_only=False) for c in ("f0", "f1", "c0", "c1", "lines"))
            states = _states(f0, f1, state)
            before, n = states[:-1], len(f0)
            begin = np.where(before, c1, c0).astype(np.int64)
            columns = {
                **{c: part.column(c) for c in ("path", "start", "seq", "value", "lines")},
                "within": pa.array(before), "goes_on": pa.array(states[1:]), "unit": pa.array(unit + np.cumsum(~before)),
                "record": pa.array(record + np.cumsum(begin) - begin), "begin": pa.array(begin),
                "line": pa.array(line + np.cumsum(lines, dtype=np.int64) - lines),
                "is_first": pa.array((key[1] == 0) & (number + np.arange(n) == 0)),
            }
            yield pa.RecordBatch.from_pydict(columns)
            state, unit, record = bool(states[-1]), unit + int((~before).sum()), record + int(begin.sum())
            line, number = line + int(lines.sum()), number + n

    return rows.mapInArrow(run, "path string, start long, seq long, value string, lines int, within boolean, goes_on boolean, "
                                "unit long, record long, begin long, line long, is_first boolean")


def _csv_records(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Data records with the header; ``lines``: the numbered lines of the same files."""
    rows = reliable_checkpoint(_csv_rows(rows, _start_inside(_csv_maps(rows))))
    splits = rows.groupBy(*_PART).agg(F.sum((~F.col("within")).cast("bigint")).alias("n_units"), F.sum("begin").alias("n_records"), F.sum("lines").alias("n_lines"))
    splits = splits.select(*_PART, _prefix("n_units").alias("units"), _prefix("n_records").alias("records"), _prefix("n_lines").alias("before_lines"))
    placed = rows.join(splits, _PART).select(
        *_PART, "seq", "value", "lines", "is_first", F.col("unit") + F.col("units").alias("unit"), (F.col("record") + F.col("records")).alias("record"),
        (F.col("line") + F.col("before_lines") + 1).alias("line"), (F.col("within") | F.col("goes_on")).alias("is_part"),
        (F.col("unit") + F.col("units")).alias("unit_no"))
    single = placed.filter("NOT is_part").select("path", "start", "value", "is_first", "record", "line", "lines")
    order = F.struct("start", "seq", "value", "is_first", "record")
    parts = placed.filter("is_part").groupBy("path", "unit_no").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    joined = parts.select("path", F.col("rows")[0]["start"].alias("start"), F.array_join(F.transform("rows", lambda r: r["value"]), "\n").alias("value"),
                          F.col("rows")[0]["is_first"].alias("is_first"), F.col("rows")[0]["record"].alias("record"),
                          F.lit(None).cast("bigint").alias("line"), F.lit(0).alias("lines"))
    found = F.regexp_extract_all("value", F.lit(S.CSV_RECORD), F.lit(1))
    units = single.unionByName(joined).withColumn("found", found)
    first = units.filter("is_first").select("path", F.get("found", F.lit(0)).alias("head"))
    splits = splits.select(*_PART).join(first, "path")
    records = units.select(*_PART, "record", "line", "lines", F.col("value").alias("own"), F.posexplode(F.filter("found", lambda r: r != "")).alias("k", "text"))
    records = records.withColumn("line_number", F.col("record") + F.col("k") + 1).join(splits, _PART)
    data = records.filter((F.col("head") != "") & (F.col("line_number") > 1))
    # ``raw`` is the line of that number; for a plain file it is the record's own.
    same = F.coalesce((F.col("lines") == 1) & (F.col("line") == F.col("line_number")), F.lit(False))
    first_line = F.get(S.text_lines(_body(F.col("own"))), F.lit(0))
    kept = [*_PART, "line_number", "text", "head"]
    own = data.filter(same).select(*kept, first_line.alias("raw"))
    other = data.filter(~same).select(kept).join(lines.select("path", "line_number", "raw"), ["path", "line_number"], "left").select(*kept, "raw")
    header = lambda: _header(F.col("head")).alias("header")
    good = own.unionByName(other).select(
        *_PART, header(), "line_number", F.coalesce("raw", F.lit("")).alias("raw"), F.col("text").alias("record"), F.lit(None).cast("string").alias("reason"))
    missing = first.filter(F.col("head") == "").select(
        "path", F.lit(0).cast("bigint").alias("start"), header(), F.lit(1).cast("bigint").alias("line_number"), F.lit("").alias("raw"),
        F.lit("").alias("record"), F.lit("No header row found").alias("reason"))
    return good.unionByName(missing)


def _header(first: Column) -> Column:
    return F.transform(S.csv_cells(first), lambda h: F.replace(F.lower(strip(h)), F.lit(" "), F.lit("_")))


# JSON

_INSIDE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[\[\]{},]', re.S)
_KEYED = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def _tokens(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """Places of brackets and commas outside of strings; last, the state at the end as ``in`` or ``out``."""
    at, inside_now = 0, inside
    if inside:
        m = _INSIDE.match(text)
        if not m[1]:
            yield len(text), "in"
            return
        at, inside_now = m.end(), False
    for m in _TOKEN.finditer(text, at):
        c = m[0]
        if c[0] == '"':
            inside_now = not m[1]
        else:
            yield m.start(), c
    yield len(text), "in" if inside_now else "out"


class Cut:
    """A file's place in a walk over its pieces."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth

    def step(self, text: str) -> Iterator[tuple[int, str, int]]:
        """``place, token, depth before it`` of a piece."""
        for at, c in _tokens(text, self.inside):
            if c in ("in", "out"):
                self.inside = c == "in"
            else:
                yield at, c, self.depth
                self.depth += 1 if c in "[{" else -1 if c in "]}" else 0


def _json_maps(rows: DataFrame) -> DataFrame:
    """Of each split, from outside and inside of a string: the state at its end and the change of depth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cuts = None, None
        def told():
            return pa.RecordBatch.from_pydict({"path": [now[0]], "start": [now[1]], "e0": [cuts[0].inside], "d0": [cuts[0].depth], "e1": [cuts[1].inside], "d1": [cuts[1].depth]})
        for key, begins, part in _split_groups(batches):
            if begins:
                if now:
                    yield told()
                now, cuts = key, (Cut(False, 0), Cut(True, 0))
            for piece in part.column("piece").to_pylist():
                for cut in cuts:
                    for _ in cut.step(piece):
                        pass
        if now:
            yield told()

    return rows.select(*_PART, "piece").mapInArrow(run, "path string, start long, e0 boolean, d0 long, e1 boolean, d1 long")


def _json_starts(maps: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int]], set[str]]:
    """The state and depth at the start of each split, and the files that end outside of everything."""
    starts, whole, now, inside, depth = {}, set(), None, False, 0
    for path, start, e0, d0, e1, d1 in sorted(map(tuple, maps.collect())):
        if path != now:
            if now is not None and not inside and depth == 0:
                whole.add(now)
            now, inside, depth = path, False, 0
        starts[path, start] = (inside, depth)
        inside, depth = (e1, depth + d1) if inside else (e0, depth + d0)
    if now is not None and not inside and depth == 0:
        whole.add(now)
    return starts, whole


def _json_marks(rows: DataFrame, starts: dict) -> DataFrame:
    """Arrays that may hold the records: at the top of the file, or under a container key of the object there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for key, begins, part in _split_groups(batches):
            if begins:
                cut = Cut(*starts[key])
            out = []
            for seq, piece in zip(part.column("seq").to_pylist(), part.column("piece").to_pylist()):
                for at, c, depth in cut.step(piece):
                    if depth == 0 and c in "[{":
                        out.append((*key, seq, at, 0, c))
                    elif depth == 1 and c == "[":
                        named = _KEYED.search(piece, 0, at)
                        if named and named[1] in _CONTAINERS:
                            out.append((*key, seq, at, 1, named[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "start", "seq", "at", "depth", "kind"])

    return rows.select(*_PART, "seq", "piece").mapInArrow(run, "path string, start long, seq long, at long, depth long, kind string")


def _json_choice(marks: DataFrame) -> dict[str, tuple[int, int, int, int] | None]:
    """By file with a single top value: the place and depth of the array whose elements are the records; None for an object that is itself the record."""
    rank = F.when(F.col("depth") == 0, -1).otherwise(F.array_position(F.array(*map(F.lit, V.JSON_CONTAINER_KEYS)), F.col("kind")))
    place = F.struct(F.col("start"), F.col("seq"), F.col("at"), (F.col("depth") + 1).alias("level"))
    tops = marks.groupBy("path").agg(
        F.sum((F.col("depth") == 0).cast("int")).alias("tops"), F.max(F.when(F.col("depth") == 0, F.col("kind"))).alias("kind"),
        F.max(F.when(F.col("kind") == "[", place)).alias("top"),
        # The first key of the list that has an array; of a repeated key the last one.
        F.max(F.when(F.col("depth") == 1, F.struct((-rank).alias("rank"), place.alias("place")))).alias("inner"))
    out = {}
    for path, n, kind, top, inner in tops.collect():
        if n == 1:
            out[path] = tuple(top) if kind == "[" else tuple(inner["place"]) if inner else None
    return out


def _json_fragments(rows: DataFrame, starts: dict, choice: dict) -> DataFrame:
    """``path, start, kind, k, n, text``: elements cut at commas (``k``: commas of the split before it), and the text around the array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        out: list[tuple] = []

        class Walk:
            def __init__(self, key):
                self.key, self.cut, self.chosen = key, Cut(*starts[key]), choice[key[0]]
                self.k, self.order, self.text = 0, 0, []
                place = (key[1], -1, -1)
                self.active = bool(self.chosen) and place > self.chosen[:3] and self.cut.depth >= self.chosen[3]
                self.over = bool(self.chosen) and place > self.chosen[:3] and not self.active

            def flush(self, kind):
                out.append((*self.key, kind, self.k if kind == "element" else self.order, "".join(self.text)))
                self.text, self.order = [], self.order + 1

            def piece(self, seq, text):
                at = 0
                for place, c, depth in self.cut.step(text):
                    if self.active:
                        level = self.chosen[3]
                        if c == "," and depth == level:
                            self.text.append(text[at:place])
                            self.flush("element")
                            self.k, at = self.k + 1, place + 1
                        elif c in "]}" and depth == level:
                            self.text.append(text[at:place])
                            self.flush("element")
                            self.active, self.over, at = False, True, place
                    elif self.chosen and not self.over and (self.key[1], seq, place) == self.chosen[:3]:
                        self.text.append(text[at : place + 1])
                        self.flush("around")
                        self.active, at = True, place + 1
                self.text.append(text[at:])

            def end(self):
                self.flush("element" if self.active else "around")
                out.append((*self.key, "count", self.k, ""))

        for key, begins, part in _split_groups(batches):
            if key[0] not in choice:
                continue
            if begins:
                if state:
                    state.end()
                state = Walk(key)
            for seq, piece in zip(part.column("seq").to_pylist(), part.column("piece").to_pylist()):
                state.piece(seq, piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "start", "kind", "k", "text"])
                out.clear()
        if state:
            state.end()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "start", "kind", "k", "text"])

    return rows.select(*_PART, "seq", "piece").mapInArrow(run, "path string, start long, kind string, k long, text string")


def _json_documents(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, start, n, record`` of the JSON files that are one document, and these files with their number of lines."""
    spark = rows.sparkSession
    sizes = rows.groupBy(*_PART).agg(F.sum(F.octet_length("value") + 1).alias("size"), F.max("seq").alias("last"))
    sizes = sizes.join(listed.select("path", "length"), "path").withColumns({"total": _of_file(F.sum("size")), "last_start": _of_file(F.max("start"))})
    # The rows' bytes with a brace each are the file's, with or without a byte order mark, or one more.
    unclosed = (F.col("total") == F.col("length") + 1) | (F.col("total") == F.col("length") - 2)
    open_ends = {(r[0], r[1]): r[2] for r in sizes.filter(unclosed & (F.col("start") == F.col("last_start"))).select("path", "start", "last").collect()}

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, part in _split_groups(batches):
            last = open_ends.get(key)
            pieces = [v if s == last else v + "}" for s, v in zip(part.column("seq").to_pylist(), part.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("path"), part.column("start"), part.column("seq"), pa.array(pieces)], names=["path", "start", "seq", "piece"])

    valid = rows.filter(F.is_valid_utf8("value"))
    pieces = valid.mapInArrow(close, "path string, start long, seq long, piece string")
    starts, complete = _json_starts(_json_maps(pieces))
    choice = {path: at for path, at in _json_choice(_json_marks(pieces, starts)).items() if path in complete}
    found = reliable_checkpoint(_json_fragments(pieces, starts, choice))
    counts = found.filter("kind = 'count'").select(*_PART, F.col("k").alias("commas")).withColumn("before", _prefix("commas"))
    totals = counts.groupBy("path").agg(F.sum("commas").alias("commas"))
    text = lambda *by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, "text"))), lambda p: p["text"]), "")
    placed = found.filter("kind = 'element'").join(counts, _PART).withColumn("n", F.col("before") + F.col("k"))
    inner = placed.filter("k > 0 AND k < commas").select(*_PART, "n", "text")
    edges = placed.filter("k = 0 OR k >= commas").groupBy("path", "n").agg(F.min("start").alias("start"), text("start").alias("text")).select(*_PART, "n", "text")
    elements = inner.unionByName(edges).withColumn("items", json_items(F.col("text"))).join(totals, "path")
    nothing = (F.col("commas") == 0) & ~F.col("text").rlike(r"\S")
    elements = reliable_checkpoint(
        elements.filter(~nothing).select(*_PART, "n", F.coalesce(F.size("items") == 1, F.lit(False)).alias("is_good"), F.get("items", F.lit(0)).alias("record")))
    frames = found.filter("kind = 'around'").groupBy("path").agg(text("start", "k").alias("text")).withColumn("items", json_items(F.col("text")))
    whole = frames.filter(F.size("items") == 1).join(elements.filter("NOT is_good").select("path").distinct(), "path", "left_anti")
    cut = spark.createDataFrame([(path, at is not None) for path, at in choice.items()], "path string, is_cut boolean")
    whole = whole.join(cut, "path")
    single = whole.filter("NOT is_cut").select("path", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n"), F.get("items", F.lit(0)).alias("record"))
    several = elements.join(whole.select("path"), "path", "left_semi").select(*_PART, "n", "record")
    # A piece ends with a brace, so its first line is one that the piece before has begun and that is not blank.
    parts = F.transform(F.split("piece", S.LINE_BREAK), lambda line: line.rlike(r"\S").cast("int"))
    sizes = pieces.select("path", "start", "seq", parts.alias("parts")).groupBy("path").agg(
        (F.sum(F.aggregate("parts", F.lit(0), lambda a, b: a + b) - F.get("parts", F.lit(0))) + F.min_by(F.get("parts", F.lit(0)), F.struct("start", "seq"))).alias("total_lines"))
    return single.unionByName(several), whole.select("path").join(sizes, "path")


def _json_line_records(lines: DataFrame) -> DataFrame:
    """Records of the documents on each line, numbered over the file; broken lines by their place in it."""
    documents = reliable_checkpoint(lines.select(*_PART, "at", "physical", "raw", S.one_document(F.col("raw")).alias("document")))
    none = F.lit(None).cast("string")
    bad = documents.filter("document IS NULL").select(
        *_PART, F.col("physical").alias("line_number"), "raw", none.alias("record"), F.lit("Invalid JSON: not a single well-formed document").alias("reason"))
    good = documents.filter("document IS NOT NULL").select(*_PART, "at", F.posexplode(S.json_records(F.col("document"))).alias("k", "raw"))
    counts = good.groupBy(*_PART, "at").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*_PART).agg(F.sum("n").alias("n")).withColumn("before", _prefix("n")).drop("n")
    within = Window.partitionBy(*_PART).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one split
    offsets = counts.withColumn("done", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    numbered = good.join(offsets, [*_PART, "at"]).join(sizes, _PART).withColumn("line_number", F.col("before") + F.col("done") + F.col("k") + 1)
    return numbered.select(*_PART, "line_number", "raw", *_object("raw")).unionByName(bad)


def _object(name: str) -> list[Column]:
    """``record`` and ``reason``: an element that is not an object is no event."""
    is_object = F.coalesce(F.col(name).startswith("{"), F.lit(False))
    return [F.when(is_object, F.col(name)).alias("record"), F.when(~is_object, "JSON event must be an object.").alias("reason")]


# All together


def split_records(spark: SparkSession, *paths: str, name: Name = last_element, sample_lines: int | None = 5, max_file_bytes: int | None = None,
                  split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of all admitted files as ``files.explode_records`` gives them, and all files with code, format and total_lines.

    ``name`` reads a file's name from its path. ``split_bytes`` sets the reader's split size for this call.
    """
    ship_with_tasks(__name__)
    listed = reliable_checkpoint(list_files(spark, *paths, name=name))
    allowed = [e.lstrip(".") for e in V.ALLOWED_EXTENSIONS]
    there = {r[0] for r in listed.filter(F.col("ext").isin(allowed)).select("ext").distinct().collect()}
    read = lambda separator, wanted, where=paths: _rows(spark, list(where), separator, name, wanted, max_file_bytes)
    none, no_header = F.lit(None).cast("string"), F.lit(None).cast("array<string>").alias("header")
    shape = [*_PART, "header", "line_number", "raw", "record", "reason"]
    records: list[DataFrame] = []  # of each kind of file
    seen: list[DataFrame] = []  # what is known of its files
    parts: list[DataFrame] = []  # and its splits

    def flags(found: DataFrame, kind: Column) -> DataFrame:
        return found.groupBy("path").agg(
            *(F.max(c).alias(c) for c in ("has_text", "has_null", "is_broken")), F.max("total_lines").alias("total_lines"), F.max(kind).alias("format"))

    with _split_size(spark, split_bytes, listed):
        if there - {"csv", "json", "jsonl"}:
            rows = _held(read("\n", lambda ext: ext.isin(allowed) & ~ext.isin("csv", "json", "jsonl")))
            found = reliable_checkpoint(_line_splits(rows))
            records.append(_numbered(rows, found).select(*_PART, no_header, "line_number", "raw", F.col("raw").alias("record"), none.alias("reason")))
            seen.append(line_files(found, sample_lines).withColumnRenamed("by_content", "format"))
            parts.append(found.select(_PART))
        if "csv" in there:
            rows = _held(read("\n", lambda ext: ext == "csv").withColumns(_csv_states(F.col("value"))))
            found = reliable_checkpoint(_line_splits(rows))
            records.append(_csv_records(rows, _numbered(rows, found)))
            seen.append(flags(found, F.lit("csv")))
            parts.append(found.select(_PART))
        if there & {"json", "jsonl"}:
            rows = _held(read("}", lambda ext: ext.isin("json", "jsonl")))
            documents, whole = _json_documents(rows, listed)
            whole, found = reliable_checkpoint(whole), reliable_checkpoint(_flags(rows))
            records.append(documents.select(*_PART, no_header, (F.col("n") + 1).alias("line_number"), F.col("record").alias("raw"), *_object("record")))
            seen.append(flags(found.join(whole, "path"), F.lit("json")))
            parts.append(found.select(_PART))
            json = listed.filter(F.col("ext").isin("json", "jsonl") & (F.coalesce(F.lit(max_file_bytes), "length") >= F.col("length")))
            others = [escaped(r[0]) for r in json.join(whole, "path", "left_anti").select(_decoded(F.col("path"))).collect()]
            if others:
                rows = _held(read("\n", lambda ext: F.lit(True), others))
                found = reliable_checkpoint(_line_splits(rows))
                records.append(_json_line_records(_numbered(rows, found)).select(*_PART, no_header, "line_number", "raw", "record", "reason"))
                seen.append(flags(found, F.lit("json")))
                parts.append(found.select(_PART))

    def together(frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)

    known = together(seen, "path string, has_text boolean, has_null boolean, is_broken boolean, total_lines long, format string")
    code = F.when(~F.col("ext").isin(allowed), "INVALID_FILE_TYPE")
    if max_file_bytes is not None:
        code = code.when(F.col("length") > max_file_bytes, "FILE_TOO_LARGE")
    code = code.when(~F.coalesce("has_text", F.lit(False)), "EMPTY_FILE").when(F.col("has_null"), "BINARY_FILE").when(F.col("is_broken"), "ENCODING_ERROR")
    files = reliable_checkpoint(listed.join(known, "path", "left").withColumn("code", code).select(
        "path", "name", "ext", "length", "modified", "code", F.when(code.isNull(), F.col("format")).alias("format"), F.when(code.isNull(), F.col("total_lines")).alias("total_lines")))
    # The file's columns come by split, so that a file with most of the rows is not one key.
    places = together(parts, "path string, start long").distinct().join(files.filter("code IS NULL").drop("code"), "path")
    every = together([r.select(shape) for r in records], "path string, start long, header array<string>, line_number long, raw string, record string, reason string")
    return every.join(places, _PART).select(*RECORD), files


def split_lines(spark: SparkSession, *paths: str, name: Name = last_element, split_bytes: int | None = None) -> DataFrame:
    """``path, name, line_number, raw``: the non-blank lines of all files, whatever their format, numbered from one."""
    ship_with_tasks(__name__)
    with _split_size(spark, split_bytes, list_files(spark, *paths, name=name)):
        rows = _held(_rows(spark, list(paths), "\n", name, lambda ext: F.lit(True), None))
    found = _numbered(rows, _line_splits(rows))
    return found.select("path", name(_decoded(F.col("path"))).alias("name"), "line_number", "raw")


def escaped(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
