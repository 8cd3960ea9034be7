"""Detection rules: keyed sliding windows that start afresh after every alert.

A row fires when, looking back over the rows of its subject since the last alert, the rows within
the window hold ``threshold`` matches (rows, or distinct values of a dimension). Let ``s(j)`` be the
latest row at which a look back from row ``j`` has gathered ``threshold`` matches. Then ``j`` can
fire when ``time(j) - time(s(j)) <= window``, and does fire when ``s(j)`` also lies after the last
alert. Finding alerts is thus picking disjoint intervals ``[s(j), j]``, earliest end first.

All rules run in one pass: each log row becomes one row per rule that wants it, these rows are
range-partitioned on (rule, upload, subject, time, line), and every task picks intervals in its own
piece. A subject that spans several pieces is stitched together from piece summaries of at most
``threshold`` rows each, so no task ever holds a whole subject.

A task reads its piece batch by batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) and keeps
between batches only the rows of the last subject that a later alert can still list: those after the
last alert and within the window. Memory is a batch and an open window, however large the piece.
"""

from __future__ import annotations

import bisect
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions import fixed_values as V
from logvigil.functions.text import lookup
from logvigil.functions.timefn import micros_to_z, parse_detector_ts
from logvigil.operators.evidence import line_runs
from logvigil.operators.pieces import sorted_pieces
from logvigil.session import reliable_checkpoint, ship_with_tasks

MICROS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``subject`` is ``ip``, ``user`` or ``user_or_ip``. ``distinct`` names the counted dimension, none
    meaning rows. With ``success_window_seconds`` the rule instead wants a burst of failures followed
    by a success.
    """

    name: str
    severity: str
    subject: str
    event_type: str
    threshold: int
    window_seconds: int
    statuses: tuple[str, ...] = ("FAILED",)
    distinct: str | None = None
    success_window_seconds: int | None = None

    @property
    def is_burst(self) -> bool:
        return self.success_window_seconds is not None


def brute_force_login(threshold: int = 5, window_seconds: int = 60) -> Rule:
    return Rule("brute_force_login", "HIGH", "ip", "login_attempt", threshold, window_seconds)


def invalid_user_enumeration(threshold: int = 3, window_seconds: int = 600) -> Rule:
    return Rule("invalid_user_enumeration", "MEDIUM", "ip", "login_attempt", threshold,
                window_seconds, distinct="username")


def sudo_failure(threshold: int = 3, window_seconds: int = 300) -> Rule:
    return Rule("sudo_failure", "MEDIUM", "user_or_ip", "privilege_escalation", threshold,
                window_seconds)


def password_spraying(threshold: int = 5, window_seconds: int = 600) -> Rule:
    return Rule("password_spraying", "HIGH", "user", "login_attempt", threshold, window_seconds,
                distinct="ip_address")


def credential_stuffing(fail_threshold: int = 5, window_seconds: int = 60,
                        success_window_seconds: int = 120) -> Rule:
    return Rule("credential_stuffing_success", "HIGH", "ip", "login_attempt", fail_threshold,
                window_seconds, statuses=("FAILED", "SUCCESS"),
                success_window_seconds=success_window_seconds)


def port_scan(threshold: int = 10, window_seconds: int = 60) -> Rule:
    return Rule("port_scan", "MEDIUM", "ip", "port_scan", threshold, window_seconds, statuses=())


DEFAULT_RULES: tuple[Rule, ...] = (
    brute_force_login(), invalid_user_enumeration(), sudo_failure(), password_spraying(),
    credential_stuffing(), port_scan(),
)

CustomRule = Callable[[DataFrame], DataFrame]


def log_records(logs: DataFrame, year: int) -> DataFrame:
    """Detector input from parsed records whose ``timestamp`` is still text."""
    return logs.withColumn("event_timestamp", parse_detector_ts(F.col("timestamp"), year))


def run_detection(logs: DataFrame, rules: Sequence[Rule | CustomRule] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Alerts of all rules over the logs, each upload on its own.

    Built-in rules share one scan and one shuffle. Any other callable from logs to alerts can be
    added to the list.
    """
    chosen = DEFAULT_RULES if rules is None else rules
    specs = [r for r in chosen if isinstance(r, Rule)]
    results = [rule(logs) for rule in chosen if not isinstance(rule, Rule)]
    if specs:
        results.insert(0, _alerts(_matched_rows(_candidates(logs, specs), specs, partitions), specs))
    combined = results[0]
    for result in results[1:]:
        combined = combined.unionByName(result)
    return combined


class Detected(NamedTuple):
    """Alerts without their lines, and the lines as runs: a table of its own (see ``evidence.line_runs``)."""

    alerts: DataFrame
    runs: DataFrame


ALERT_KEY = ["rule", "upload_id", "subject", "end_us", "end_line"]


def detect(logs: DataFrame, rules: Sequence[Rule] | None = None, partitions: int | None = None) -> Detected:
    """``run_detection`` for alerts of any number of lines: no array of an alert's lines is built.

    Both tables are keyed by ``ALERT_KEY``: the rule, its subject in the upload, and the row that ends the alert.
    """
    specs = list(DEFAULT_RULES if rules is None else rules)
    matched = reliable_checkpoint(_matched_rows(_candidates(logs, specs), specs, partitions))
    named = matched.withColumn("rule", lookup(F.col("rule_no"), {i: r.name for i, r in enumerate(specs)}))
    return Detected(_alerts(matched, specs, lists=False), line_runs(named, ALERT_KEY))


# ---- rows wanted by the rules ------------------------------------------------------------

KEYS = ["rule_no", "upload_id", "subject"]
ORDER = ["us", "line_number"]


def _candidates(logs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    ip, user = present("ip_address"), present("username")
    subjects = {"ip": ip, "user": user, "user_or_ip": F.coalesce(user, ip)}

    def wanted(number: int, rule: Rule) -> Column:
        subject = subjects[rule.subject]
        test = (F.col("event_type") == rule.event_type) & subject.isNotNull()
        if rule.statuses:
            test = test & F.col("status").isin(*rule.statuses)
        dimension = F.lit(None).cast("string")
        if rule.is_burst:
            dimension = F.col("status")
        elif rule.distinct:
            dimension = F.col(rule.distinct)
            test = test & ip.isNotNull() & user.isNotNull()
        return F.when(
            test,
            F.struct(F.lit(number).alias("rule_no"), subject.alias("subject"), dimension.alias("dim")),
        )

    any_rule = F.array_compact(F.array(*[wanted(i, r) for i, r in enumerate(rules)]))
    return (
        logs.filter(F.col("event_type").isin(sorted({r.event_type for r in rules})))
        .filter(F.col("event_timestamp").isNotNull())
        .select(
            F.explode(any_rule).alias("want"), "upload_id",
            F.unix_micros(F.col("event_timestamp").cast("timestamp")).alias("us"),
            F.col("line_number").cast("bigint").alias("line_number"), ip.alias("ip_address"),
            user.alias("username"),
        )
        .select("want.rule_no", "upload_id", "want.subject", "us", "line_number", "want.dim",
                "ip_address", "username")
    )


# ---- one piece ---------------------------------------------------------------------------

def _key_runs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Where the rows of each key start and end, and the keys."""
    keys = [rows[k].to_numpy() for k in KEYS]
    change = np.zeros(len(rows), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(rows)), [tuple(k[s] for k in keys) for s in starts]


class Piece:
    """Sorted rows as arrays, with the interval structure of every row."""

    def __init__(self, rows: pd.DataFrame, rules: Sequence[Rule]):
        self.rows, self.rules = rows, rules
        self.us = rows["us"].to_numpy(np.int64)
        self.line = rows["line_number"].to_numpy(np.int64)
        self.dim = rows["dim"].to_numpy(object)
        self.starts, self.ends, self.keys = _key_runs(rows)
        self.rule_of_key = [int(k[0]) for k in self.keys]
        self.burst_end: dict[int, int] = {}
        self.ends_at, self.starts_at = self._intervals()

    def _intervals(self) -> tuple[list[int], list[int]]:
        """Rows that may fire, in order, and the row each one reaches back to."""
        tight = np.full(len(self.us), -1, np.int64)
        for k in range(len(self.keys)):
            start, end, rule = int(self.starts[k]), int(self.ends[k]), self.rules[self.rule_of_key[k]]
            if rule.is_burst:
                self._burst_intervals(start, end, rule, tight)
            elif rule.distinct:
                self._distinct_reach(start, end, rule, tight)
            elif end - start >= rule.threshold:
                back = rule.threshold - 1
                at = np.arange(start + back, end)
                tight[at] = np.where(
                    self.us[at] - self.us[at - back] <= rule.window_seconds * MICROS, at - back, -1
                )
        fires = np.flatnonzero(tight >= 0)
        return fires.tolist(), tight[fires].tolist()

    def _distinct_reach(self, start: int, end: int, rule: Rule, tight: np.ndarray) -> None:
        recent: dict[object, int] = {}  # most recently seen last; never more than threshold values
        limit, wanted = rule.window_seconds * MICROS, rule.threshold
        us, reach = self.us[start:end].tolist(), [-1] * (end - start)
        for j, value in enumerate(self.dim[start:end].tolist()):
            recent.pop(value, None)
            recent[value] = j
            if len(recent) > wanted:
                del recent[next(iter(recent))]
            if len(recent) == wanted:
                s = recent[next(iter(recent))]
                if us[j] - us[s] <= limit:
                    reach[j] = s + start
        tight[start:end] = reach

    def _burst_intervals(self, start: int, end: int, rule: Rule, tight: np.ndarray) -> None:
        """A success reaches back to the start of its epoch: the rows since the success before."""
        for epoch, success in self._epochs(start, end):
            last = self._last_burst(epoch, success, rule)
            if last is not None and self.us[success] - self.us[last] <= rule.success_window_seconds * MICROS:
                tight[success] = epoch
                self.burst_end[success] = last

    def _epochs(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        epoch = start
        for success in start + np.flatnonzero(self.dim[start:end] == "SUCCESS"):
            yield epoch, int(success)
            epoch = int(success) + 1

    def _last_burst(self, start: int, end: int, rule: Rule) -> int | None:
        """Last of the failures in [start, end) that closes a burst."""
        back = rule.threshold - 1
        if end - start <= back:
            return None
        at = np.arange(start + back, end)
        closing = at[self.us[at] - self.us[at - back] <= rule.window_seconds * MICROS]
        return int(closing[-1]) if len(closing) else None

    def picked(self, after: int, before: int | None = None) -> Iterator[tuple[int, int]]:
        """Firing rows after row ``after`` with the firing row before each, in order."""
        stop = len(self.us) if before is None else before
        i = bisect.bisect_right(self.starts_at, after)
        while i < len(self.ends_at) and self.ends_at[i] < stop:
            fired = self.ends_at[i]
            yield fired, after
            after = fired
            i = bisect.bisect_right(self.starts_at, after, lo=i + 1)

    def open_rows(self, picks: list[tuple[int, int]]) -> slice:
        """Rows of the last key that an alert further on may list."""
        start, end, rule = int(self.starts[-1]), int(self.ends[-1]), self.rules[self.rule_of_key[-1]]
        now, window = self.us[end - 1], rule.window_seconds * MICROS
        floor = now - window
        if rule.is_burst:
            successes = np.flatnonzero(self.dim[start:end] == "SUCCESS")
            start += int(successes[-1]) + 1 if len(successes) else 0
            last = self._last_burst(start, end, rule)
            if last is not None and now - self.us[last] <= rule.success_window_seconds * MICROS:
                floor = min(floor, self.us[last] - window)
        else:
            if picks:
                start = max(start, picks[-1][0] + 1)
            if not rule.distinct:
                start = max(start, end - rule.threshold + 1)
        return slice(start + int(np.searchsorted(self.us[start:end], floor, "left")), end)


def _point(rows: pd.DataFrame, j: int) -> list[int]:
    return [int(rows["us"].iat[j]), int(rows["line_number"].iat[j])]


class CountSummary:
    """Bounded description of one key's rows in a piece, fed in order: see ``stitch``.

    Alerts are followed once from the start and once from each of the first sights, since an earlier
    piece may fire at any of them.
    """

    def __init__(self, key: tuple, rules: Sequence[Rule]):
        self.key, self.rules, self.rule = key, rules, rules[int(key[0])]
        self.rows: pd.DataFrame | None = None  # last sights, most recent last
        self.at = np.zeros(0, np.int64)  # their places in the task
        self.head: list[list] = []
        self.seen: set = set()
        self.first = None
        self.after, self.last = [-1], [None]  # by walk: the row it fired at last

    def add(self, part: pd.DataFrame, offset: int) -> None:
        held = 0 if self.rows is None else len(self.rows)
        rows = pd.concat([self.rows, part], ignore_index=True) if held else part.reset_index(drop=True)
        at = np.append(self.at, offset + np.arange(len(part)))
        piece = Piece(rows, self.rules)
        new = bisect.bisect_left(piece.ends_at, held)
        ends, starts = piece.ends_at[new:], piece.starts_at[new:]
        distinct = self.rule.distinct
        fresh = held + np.flatnonzero(~part["dim"].duplicated().to_numpy()) if distinct else np.arange(held, len(rows))
        for j in fresh.tolist():  # first sight of each value, until the piece stands on its own
            if len(self.head) == self.rule.threshold - 1:
                break
            value = piece.dim[j] if distinct else None
            if distinct and value in self.seen:
                continue
            self.seen.add(value)
            self.head.append([*_point(rows, j), value, int(at[j])])
            self.after.append(int(at[j]))
            self.last.append(None)
        where = at[np.array(starts, np.int64)].tolist() if starts else []
        for walk, after in enumerate(self.after):
            i = bisect.bisect_right(where, after)
            while i < len(ends):
                self.last[walk] = _point(rows, ends[i])
                after = int(at[ends[i]])
                if walk == 0 and self.first is None:
                    self.first = [*self.last[0], after]
                i = bisect.bisect_right(where, after, lo=i + 1)
            self.after[walk] = after
        kept = ~rows["dim"].duplicated(keep="last").to_numpy() if distinct else np.ones(len(rows), bool)
        kept = np.flatnonzero(kept)[-self.rule.threshold :]
        self.rows, self.at = rows.iloc[kept], at[kept]

    def told(self) -> dict:
        value = (lambda j: self.rows["dim"].iat[j]) if self.rule.distinct else (lambda j: None)
        return {
            "head": [[*h, last or h[:2]] for h, last in zip(self.head, self.last[1:])],
            "first": self.first, "last": self.last[0],
            "tail": [[*_point(self.rows, j), value(j)] for j in range(len(self.rows) - 1, -1, -1)],
        }


class BurstSummary:
    """The same for a burst that a success has to follow."""

    def __init__(self, key: tuple, rules: Sequence[Rule]):
        self.key, self.rules, self.rule = key, rules, rules[int(key[0])]
        self.rows: pd.DataFrame | None = None  # the latest since the last success
        self.head: list[list] = []
        self.head_burst = self.success = self.last_success = self.tail_burst = None

    def add(self, part: pd.DataFrame, offset: int) -> None:
        held = 0 if self.rows is None else len(self.rows)
        rows = pd.concat([self.rows, part], ignore_index=True) if held else part.reset_index(drop=True)
        piece = Piece(rows, self.rules)
        successes = np.flatnonzero(piece.dim == "SUCCESS").tolist()
        before = successes[0] if successes else len(rows)
        burst = piece._last_burst(0, before, self.rule)
        burst = None if burst is None else _point(rows, burst)
        if self.success is None:
            room = self.rule.threshold - 1 - len(self.head)
            self.head += [_point(rows, j) for j in range(held, min(held + room, before))]
            self.head_burst = burst or self.head_burst
        self.tail_burst = burst or self.tail_burst
        start = 0
        if successes:
            if self.success is None:
                self.success = [*_point(rows, successes[0]), int(offset + successes[0] - held)]
            self.last_success, start = _point(rows, successes[-1]), successes[-1] + 1
            last = piece._last_burst(start, len(rows), self.rule)
            self.tail_burst = None if last is None else _point(rows, last)
        self.rows = rows.iloc[max(start, len(rows) - self.rule.threshold) :]

    def told(self) -> dict:
        return {
            "head": self.head, "head_burst": self.head_burst, "success": self.success, "last_success": self.last_success,
            "tail": [_point(self.rows, j) for j in range(len(self.rows) - 1, -1, -1)], "tail_burst": self.tail_burst,
        }


# ---- pieces of one subject ----------------------------------------------------------------

def stitch(pieces: Sequence[tuple[int, dict]], rule: Rule) -> tuple[dict[int, int], list[dict]]:
    """Carry the state of one subject over its pieces.

    Returns, per piece, the row after which the piece may pick on its own, and the alerts whose rows
    may reach into earlier pieces.
    """
    carry = _stitch_burst if rule.is_burst else _stitch_counts
    return carry(pieces, rule, rule.window_seconds * MICROS)


def _interval(lower, floor: int, end, success=None) -> dict:
    return {"lower": lower, "floor": floor, "end": end, "success": success}


def _stitch_counts(pieces, rule, window):
    resume, spanning = {}, []
    context, fired = [], None  # last sights before this piece, most recent first; last alert
    for chunk, piece in pieces:
        seen, hit = set(), None
        for i, (us, line, value, row, last) in enumerate(piece["head"]):
            seen.add(value)
            before = [c for c in context if not rule.distinct or c[2] not in seen]
            missing = rule.threshold - (i + 1)
            if len(before) >= missing:
                reach = before[missing - 1]
                if us - reach[0] <= window and (fired is None or reach[:2] > fired):
                    hit = (us, line, row, last)
                    break
        if hit is None and piece["first"] is not None:
            hit = (*piece["first"], piece["last"])
        if hit is not None:
            us, line, row, last = hit
            spanning.append(_interval(fired, us - window, [us, line]))
            resume[chunk], fired = row, last
        known = {t[2] for t in piece["tail"]} if rule.distinct else set()
        older = [c for c in context if not rule.distinct or c[2] not in known]
        context = (piece["tail"] + older)[: rule.threshold]
    return resume, spanning


def _stitch_burst(pieces, rule, window):
    resume, spanning = {}, []
    context, burst, lower = [], None, None
    for chunk, piece in pieces:
        for i, (us, line) in enumerate(piece["head"]):
            missing = rule.threshold - (i + 1)
            if len(context) >= missing and us - context[missing - 1][0] <= window:
                burst = [us, line]
        burst = piece["head_burst"] or burst
        if piece["success"] is not None:
            us, line, row = piece["success"]
            if burst is not None and us - burst[0] <= rule.success_window_seconds * MICROS:
                spanning.append(_interval(lower, burst[0] - window, burst, [us, line]))
            resume[chunk] = row
            lower, context, burst = piece["last_success"], piece["tail"], piece["tail_burst"]
        else:
            context = (piece["tail"] + context)[: rule.threshold]
    return resume, spanning


# ---- two passes over the pieces -----------------------------------------------------------

SUMMARY_SCHEMA = "chunk int, rule_no int, upload_id string, subject string, summary string"
MATCH_SCHEMA = (
    "rule_no int, upload_id string, subject string, end_us bigint, end_line bigint, us bigint, "
    "line_number bigint, dim string, ip_address string, username string"
)


def _matched_rows(candidates: DataFrame, rules: Sequence[Rule], partitions: int | None) -> DataFrame:
    """The rows of every alert, one row per alert and matched log line."""
    placed = sorted_pieces(candidates, KEYS, ORDER, partitions)

    def summarise(batches):
        first = now = chunk = None
        offset = 0
        for rows in batches:
            if not len(rows):
                continue
            chunk = int(rows["chunk"].iat[0])
            starts, ends, keys = _key_runs(rows)
            for k in sorted({0, len(keys) - 1}):  # only these can continue in another piece
                if now is None or now.key != keys[k]:
                    now = (BurstSummary if rules[int(keys[k][0])].is_burst else CountSummary)(keys[k], rules)
                    first = first or now
                now.add(rows.iloc[starts[k] : ends[k]], offset + int(starts[k]))
            offset += len(rows)
        if now is not None:
            yield pd.DataFrame(
                [(chunk, *key.key, json.dumps(key.told())) for key in ([now] if now is first else [first, now])],
                columns=["chunk", *KEYS, "summary"],
            )

    # At most two rows per partition, each bounded by the thresholds: safe to bring to the driver.
    subjects = defaultdict(list)
    narrow = placed.select("chunk", *KEYS, *ORDER, "dim")
    for row in narrow.mapInPandas(summarise, SUMMARY_SCHEMA).collect():
        subjects[(row.rule_no, row.upload_id, row.subject)].append((row.chunk, json.loads(row.summary)))
    resume: dict[int, int] = {}
    spanning: dict[tuple, list[dict]] = {}
    for key, pieces in subjects.items():
        if len(pieces) > 1:
            pieces.sort(key=lambda p: p[0])
            later, spanning[key] = stitch(pieces, rules[key[0]])
            # The first piece of a subject is not the first key of its task unless it fills it.
            resume.update({chunk: row for chunk, row in later.items() if chunk != pieces[0][0]})
            spanning[key] = [
                s for s in spanning[key] if not _inside_first(s, pieces[0][1])
            ]

    shared = candidates.sparkSession.sparkContext.broadcast((resume, spanning))

    def match(batches):
        resume, spanning = shared.value
        carried, offset = None, 0
        for rows in batches:
            if not len(rows):
                continue
            skip = resume.get(int(rows["chunk"].iat[0]), -1) + 1 - offset
            offset += len(rows)
            yield from _spanning_rows(rows, spanning)
            rows = rows.iloc[skip:] if skip > 0 else rows
            if carried is not None and len(carried):
                rows = pd.concat([carried, rows], ignore_index=True)
            if len(rows):
                piece = Piece(rows, rules)
                picks = list(piece.picked(-1))
                if picks:
                    hit, fired = _local_rows(piece, picks)
                    yield _taken(rows, hit, piece.us[fired], piece.line[fired])
                carried = rows.iloc[piece.open_rows(picks)]

    return placed.mapInPandas(match, MATCH_SCHEMA)


def _taken(rows: pd.DataFrame, hit: np.ndarray, end_us, end_line) -> pd.DataFrame:
    taken = rows.take(hit.astype(np.int64)).reset_index(drop=True)
    taken["end_us"], taken["end_line"] = end_us, end_line
    return taken[["rule_no", "upload_id", "subject", "end_us", "end_line", "us", "line_number", "dim", "ip_address", "username"]]


def _spanning_rows(rows: pd.DataFrame, spanning: dict[tuple, list[dict]]) -> Iterator[pd.DataFrame]:
    """The batch's rows of alerts that reach over several pieces."""
    for start, end, key in zip(*_key_runs(rows)):
        intervals = spanning.get(key)
        if intervals:
            us, line = (rows[c].to_numpy(np.int64)[start:end] for c in ORDER)
            for interval in intervals:
                hit, close = _rows_of(us, line, interval), interval["success"] or interval["end"]
                if len(hit):
                    yield _taken(rows, int(start) + hit, close[0], close[1])


def _inside_first(interval: dict, first: dict) -> bool:
    """Alerts that end in a subject's first piece are picked by that piece itself."""
    own = first.get("first") or first.get("success")
    return own is not None and own[:2] == (interval["success"] or interval["end"])


def _order_position(us: np.ndarray, line: np.ndarray, point: Sequence[int], after: bool) -> int:
    """Where ``point`` = (us, line) falls among the rows of a key."""
    lo, hi = (int(np.searchsorted(us, point[0], side)) for side in ("left", "right"))
    return lo + int(np.searchsorted(line[lo:hi], point[1], "right" if after else "left"))


def _rows_of(us: np.ndarray, line: np.ndarray, interval: dict) -> np.ndarray:
    first = int(np.searchsorted(us, interval["floor"], "left"))
    if interval["lower"] is not None:
        first = max(first, _order_position(us, line, interval["lower"], after=True))
    rows = np.arange(first, max(first, _order_position(us, line, interval["end"], after=True)))
    if interval["success"] is not None:
        lo = _order_position(us, line, interval["success"], after=False)
        rows = np.append(rows, np.arange(lo, _order_position(us, line, interval["success"], after=True)))
    return rows


def _local_rows(piece: Piece, picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the alerts a piece picks on its own, and the firing row of each of them."""
    fired = np.array([p[0] for p in picks], np.int64)
    lower = np.array([p[1] + 1 for p in picks], np.int64)
    last = np.array([piece.burst_end.get(p[0], p[0]) for p in picks], np.int64)
    first, key = lower.copy(), np.searchsorted(piece.starts, fired, "right") - 1
    for k in np.unique(key):
        mine = slice(*np.searchsorted(key, [k, k + 1]))
        start, end = piece.starts[k], piece.ends[k]
        rule = piece.rules[piece.rule_of_key[k]]
        floor = piece.us[last[mine]] - rule.window_seconds * MICROS
        first[mine] = np.maximum(start + np.searchsorted(piece.us[start:end], floor, "left"), lower[mine])
        if rule.is_burst:  # an epoch begins after the success before, whether or not that one fired
            epoch = [piece.starts_at[bisect.bisect_left(piece.ends_at, f)] for f in fired[mine].tolist()]
            first[mine] = np.maximum(first[mine], epoch)
    length = last - first + 1
    total = int(length.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    rows, owner = np.repeat(first, length) + offset, np.repeat(fired, length)
    successes = fired[fired != last]  # a burst's success is a row of its own
    return np.concatenate([rows, successes]), np.concatenate([owner, successes])


# ---- alerts -------------------------------------------------------------------------------

def _alerts(matched: DataFrame, rules: Sequence[Rule], lists: bool = True) -> DataFrame:
    """One alert per group of matched rows. A group is exactly what the alert has to list."""
    at = F.struct("us", "line_number")
    lines = F.transform(F.array_sort(F.collect_list(at)), lambda e: e["line_number"]).alias("matched_line_numbers")
    rest = ["matched_line_numbers"] if lists else ["subject", "end_us", "end_line"]
    grouped = matched.groupBy("rule_no", "upload_id", "subject", "end_us", "end_line").agg(
        F.count(F.lit(1)).alias("rows"),
        F.size(F.collect_set("dim")).cast("bigint").alias("values"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("username", at).alias("first_user"), F.max_by("username", at).alias("last_user"),
        F.min_by("ip_address", at).alias("first_ip"), F.max_by("ip_address", at).alias("last_ip"),
        *([lines] if lists else []),
    )

    def per_rule(value: Callable[[Rule], object]) -> Column:
        return lookup(F.col("rule_no"), {i: value(r) for i, r in enumerate(rules)})

    def choose(by_rule: Callable[[Rule], str]) -> Column:
        chain = None
        for i, rule in enumerate(rules):
            test, value = F.col("rule_no") == i, F.col(by_rule(rule))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain

    none = F.lit(None).cast("string")
    shaped = grouped.withColumn("no_user", none).select(
        "upload_id",
        per_rule(lambda r: r.name).alias("rule"),
        per_rule(lambda r: r.severity).alias("severity"),
        choose(lambda r: {"ip": "subject", "user": "last_ip", "user_or_ip": "first_ip"}[r.subject]).alias("source_ip"),
        choose(lambda r: "last_user" if r.is_burst else "subject" if r.subject == "user"
               else "no_user" if r.distinct == "username" else "first_user").alias("username"),
        choose(lambda r: "values" if r.distinct else "rows").alias("count"),
        per_rule(lambda r: r.window_seconds).cast("bigint").alias("time_window_seconds"),
        micros_to_z(F.col("first_us")).alias("first_seen"),
        micros_to_z(F.col("last_us")).alias("last_seen"),
        *dict.fromkeys(["subject", *rest]),
    )
    return shaped.select(
        "upload_id", "rule", "severity", "source_ip", "username", "count", "time_window_seconds",
        "first_seen", "last_seen", _description(rules).alias("description"), *rest,
    )


def _description(rules: Sequence[Rule]) -> Column:
    chain = None
    for name in dict.fromkeys(r.name for r in rules):
        template = V.RULE_DESCRIPTIONS.get(name, "{subject}: {count} matches within {window}s.")
        order, text = [], template.replace("%", "%%")
        for field, column in (("subject", "subject"), ("count", "count"), ("failures", "failures"),
                              ("window", "time_window_seconds")):
            if "{" + field + "}" in template:
                order.append((template.index("{" + field + "}"), field, column))
        arguments = []
        for _, field, column in sorted(order):
            text = text.replace("{" + field + "}", "%s")
            arguments.append(F.col("count") - 1 if field == "failures" else F.col(column))
        value = F.format_string(text, *[a.cast("string") for a in arguments])
        test = F.col("rule") == name
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


ship_with_tasks(__name__)
