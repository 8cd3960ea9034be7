"""Files read by splits of a few bytes against the same files read whole."""

import json
import random

import pytest

from logvigil.sources import files as S, splits

SYSLOG = "Jun 14 02:11:43 server01 sshd[1234]: Failed password for root from 203.0.113.4 port 22 ssh2"
CELLS = ["a", '"q, x"', '"l1\nl2"', '"a ""b"" c"', "", 'x"y', '"open" tail', '"l\r\nm\n\nn"', "é", "1.5"]


def element(rnd):
    return rnd.choice([{"a": 1, "b": {"c": '}{][,"\\'}}, {"m": "x" * 30, "l": [1, [2], {"z": 3}]}, 5, "str}", None, [1, 2], {"n": 1.50}, {"e": "é\n"}])


def write_files(rnd, folder):
    def write(name, text):
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    for i in range(3):
        lines = [rnd.choice([SYSLOG + str(k), "", "  ", "x\x0by", "é" * 5, "p\rq", "word w"]) + rnd.choice(["\n", "\r\n"]) for k in range(rnd.choice([1, 50]))]
        write(f"a{i}.log", "".join(lines))
    for i in range(6):
        text = "\nH,G\n" if i == 4 else 'H1,h 2,"H\n3"' + rnd.choice(["\n", "\r\n", "\r"])
        for _ in range(rnd.choice([0, 1, 3, 60])):
            text += ",".join(rnd.choice(CELLS) for _ in range(rnd.randint(1, 4))) + rnd.choice(["\n", "\n", "\r\n", "\r", "\n\n", "\n  \n"])
        write(f"c{i}.csv", text + ('1,"never closed\n2,3\n4' if i == 5 else ""))
    for i in range(8):
        many = [element(rnd) for _ in range(rnd.choice([0, 1, 2, 40]))]
        write(f"j{i}.{'json' if i % 2 else 'JSONL'}", [
            json.dumps(many), json.dumps(many, indent=1, ensure_ascii=False), json.dumps({"x": {"events": [1]}, "logs": many, "z": [1, {"q": 2}]}),
            json.dumps({"data": [1], "events": many, "pad": "}"}, indent=2), json.dumps({"a": many}), "\n".join(map(json.dumps, many)),
            "\n".join(rnd.choice([json.dumps(r), "{bad", "", json.dumps({"events": [r, r]})]) for r in many) + "\n", json.dumps(many)[:-3] + "}"][i])
    for name, text in {"bad.exe": "x", "empty.log": " \n", "nul.csv": "a,b\nx\0,y\n", "latin.json": '["é"]'.encode("latin-1"), "zero.log": "",
                       "sp ace+%41.log": "one\ntwo\n"}.items():
        write(name, text)


def told(frame):
    return {(r.name, r.line_number, r.raw, r.record, r.reason, r.header and tuple(r.header), r.format, r.total_lines) for r in frame.collect()}


@pytest.mark.parametrize("seed,sizes", [(1, [23, 1000]), (2, [97])])
def test_split_records_equal_whole_files(spark, tmp_path, seed, sizes):
    write_files(random.Random(seed), tmp_path)
    checked = S.validate_files(S.scan_files(spark, str(tmp_path)))
    whole = S.explode_records(S.with_lines(S.admitted(checked)))
    for size in sizes:
        records, found = splits.split_records(spark, str(tmp_path), split_bytes=size)
        assert {(r.name, r.code) for r in found.collect()} == {(r.name, r.code) for r in checked.collect()}
        assert told(records) == told(whole) and records.count() == whole.count()


def test_cuts_inside_lines_and_characters(spark, tmp_path):
    """Any split size gives the same lines: cuts fall inside lines and inside characters of several bytes."""
    (tmp_path / "a.log").write_text("日本語 😀 first\n" * 7 + "\n \nlast é", encoding="utf-8")
    whole = [(r.line_number, r.raw) for r in S.explode_lines(S.with_lines(S.admitted(S.validate_files(S.scan_files(spark, str(tmp_path)))))).collect()]
    for size in (1, 2, 3, 5, 50):
        assert sorted((r.line_number, r.raw) for r in splits.split_lines(spark, str(tmp_path), split_bytes=size).collect()) == sorted(whole)


def test_size_limit_and_no_files_of_a_kind(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"a": 1}] * 100))
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    records, found = splits.split_records(spark, str(tmp_path), max_file_bytes=100)
    assert {(r.name, r.code) for r in found.collect()} == {("big.json", "FILE_TOO_LARGE"), ("small.csv", None)}
    assert [(r.name, r.line_number, r.header, r.record) for r in records.collect()] == [("small.csv", 2, ["a", "b"], "1,2")]


def test_small_splits_share_tasks(spark, tmp_path):
    """A split is where a file is cut: thousands of them are no thousands of tasks, and the session's settings come back."""
    for i in range(3):
        (tmp_path / f"a{i}.log").write_text("".join(f"line {k} of {i}\n" for k in range(500)))
    limit, names = int(spark.conf.get("spark.sql.shuffle.partitions")), ["spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    with splits._split_size(spark, 20, splits.list_files(spark, str(tmp_path))):
        rows = splits._held(splits._rows(spark, [str(tmp_path)], "\n", splits.last_element, lambda ext: ext == "log", None))
    assert rows.select("path", "start").distinct().count() > 1000 and rows.rdd.getNumPartitions() <= 2 * limit + 2
    assert [spark.conf.get(n, None) for n in names] == before
    lines = sorted((r.name, r.line_number, r.raw) for r in splits.split_lines(spark, str(tmp_path), split_bytes=20).collect())
    assert lines == sorted((f"a{i}.log", k + 1, f"line {k} of {i}") for i in range(3) for k in range(500))
