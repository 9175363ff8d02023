"""Growing files as a stream: each line once, torn ones when they are whole."""

import random
import threading
import time

import pytest

from tidewell.functions.embed import Guarded, Limits
from tidewell.sources import tail


def streamed(spark, path, tmp_path, name):
    query = tail.lines(spark, path, True).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = [(r.file, r.at, r.line) for r in spark.table(name).collect()]
    spark.sql(f"drop view if exists {name}")
    return rows


def appended(spark, path, tmp_path, out):
    query = tail.lines(spark, path, True).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted((r.at, r.line) for r in spark.read.parquet(out).collect())


def test_growing_file_gives_each_line_once(spark, tmp_path, monkeypatch):
    file, out = tmp_path / "in.jsonl", str(tmp_path / "out")
    steps = ['{"a": 1}\n\n{"a": 2}\n{"a"', ": 3}\n", "", "{", '"a": 4}\n{"a": 5}\n', "no end"]
    written = ""
    file.write_text("")
    for text in steps:
        with file.open("a") as f:
            f.write(text)
        written += text
        whole = written[: written.rfind("\n") + 1]
        want, at = [], 0
        for line in whole.splitlines(keepends=True):
            want.append((at, line.rstrip("\n")))
            at += len(line.encode())
        if whole:
            assert appended(spark, str(file), tmp_path, out) == want  # stopped and started again each time
            assert sorted((r.at, r.line) for r in tail.lines(spark, str(file)).collect()) == want
    rows = tail.parsed(tail.lines(spark, str(file)), "a int").orderBy("at").collect()
    assert [(r.a, r.torn) for r in rows] == [(k, False) for k in (1, 2, 3, 4, 5)]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_ranges_have_all_lines(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "RANGE", size)
    monkeypatch.setattr(tail, "LOOK", 5)
    r = random.Random(size)
    for k in range(30):
        text = "".join(r.choice(["a", "é", "\n", "bb", "\r\n"]) for _ in range(r.randrange(60)))
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
    ends = tail._ends(str(tmp_path), ".txt", {})
    found = {}
    for part in tail._ranges({}, ends):
        for b in tail._read(str(tmp_path), part):
            for row in b.to_pylist():
                found.setdefault(row["file"], []).append((row["at"], row["line"]))
    for f, n in ends.items():
        raw = open(f, "rb").read()[:n]
        assert raw.endswith(b"\n") or not raw
        assert [x for _, x in sorted(found.get(f, []))] == [x.rstrip(b"\r").decode() for x in raw.split(b"\n")[:-1]]


def test_folder_with_new_files_and_no_folder(spark, tmp_path):
    assert tail.lines(spark, str(tmp_path / "none")).count() == 0
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"a": 1}\n{"a": "x"}\nnot json\n')
    (folder / "_hidden.jsonl").write_text("x\n")
    assert len(appended(spark, str(folder), tmp_path, out)) == 3
    (folder / "b.jsonl").write_text('{"a": 2}\n')
    assert len(appended(spark, str(folder), tmp_path, out)) == 4
    rows = tail.parsed(tail.lines(spark, str(folder), pattern=".jsonl"), "a int")
    assert rows.count() == 4 and rows.where("torn").count() == 2


def test_calls_that_take_too_long_or_answer_wrongly():
    gate, calls = threading.Event(), []

    def embed(texts):
        calls.append(texts)
        if "slow" in texts:
            gate.wait(30)
        return [[1.0]] * (len(texts) + ("odd" in texts))

    guarded = Guarded(embed, Limits(batch=1, failures=3, pause_s=1000, timeout_s=0.2))
    start = time.monotonic()
    assert guarded(["slow", "good", "odd"]) == [None, [1.0], None] and time.monotonic() - start < 5
    assert guarded(["good"]) == [[1.0]] and len(calls) == 3
    assert guarded(["odd", "slow", "new"]) == [None, None, None] and len(calls) == 5  # three failures in a row open the circuit
    gate.set()
