"""Runs over files and logs: failures before and after a commit, growth, replacement, nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from turnstone.operators.incremental import FileRuns, LogRuns, pending_records, read_lines


def lines(runs):
    return sorted((r.path.rsplit("/", 1)[-1], r.position, r.line) for r in runs.output().collect())


def test_file_runs(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("1\n2\n")
    (src / "007.txt").write_text("x")
    runs = FileRuns(spark, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        runs.output()

    def broken(files):
        read_lines(files).write.parquet(f"{tmp_path}/out/data/half")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        runs.run(str(src), broken)
    assert runs.manifest().count() == 0
    first = runs.run(str(src))
    assert first and runs.run(str(src)) is None
    assert lines(runs) == [("007.txt", 0, "x"), ("a.txt", 0, "1"), ("a.txt", 2, "2")]
    with (src / "a.txt").open("a") as f:  # grows, with half a line
        f.write("3\nha")
    second = runs.run(str(src))
    assert second != first
    assert lines(runs) == [("007.txt", 0, "x"), ("a.txt", 0, "1"), ("a.txt", 2, "2"), ("a.txt", 4, "3"), ("a.txt", 6, "ha")]
    (src / "007.txt").write_text("y")  # replaced, same size
    (src / "b.txt").write_text("")
    assert runs.run(str(src))
    assert [x[2] for x in lines(runs)] == ["y", "1", "2", "3", "ha"]
    (src / "a.txt").touch()  # another time, same content
    assert runs.run(str(src)) is None
    (src / "007.txt").write_text("x")  # back to a former version
    assert runs.run(str(src)) and lines(runs)[0][2] == "x"


def test_crash_before_and_after_commit(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("1\n")
    runs = FileRuns(spark, str(tmp_path / "out"))
    create = runs.folder.create
    monkeypatch.setattr(runs.folder, "create", lambda *_: (_ for _ in ()).throw(OSError("before")))
    with pytest.raises(OSError):
        runs.run(str(src))
    monkeypatch.setattr(runs.folder, "create", lambda *x: (create(*x), (_ for _ in ()).throw(OSError("after"))))
    with pytest.raises(OSError):
        runs.run(str(src))
    monkeypatch.undo()
    assert runs.run(str(src)) is None  # it had been committed
    assert lines(runs) == [("a.txt", 0, "1")]


def test_file_changed_while_read(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("1\n")
    runs = FileRuns(spark, str(tmp_path / "out"))

    def late(files):
        (src / "a.txt").write_text("2\n")
        return read_lines(files)

    with pytest.raises(Exception, match="changed since"):
        runs.run(str(src), late)
    assert runs.run(str(src)) and lines(runs) == [("a.txt", 0, "2")]


def tables(spark, turns, state):
    at = lambda day: dt.datetime(2024, 1, day) if day else None
    t = spark.createDataFrame([(i, f, p, at(w), "x") for i, f, p, w in turns], "id long, transcript_file string, turn_index long, written_at timestamp, offset string")
    s = spark.createDataFrame([(f, o, r, at(w)) for f, o, r, w in state], "transcript_path string, last_byte_offset long, run_status string, saved_at timestamp")
    return t, s


TURNS = [(1, "a", 0, 1), (2, "a", 50, 1), (3, "a", 100, 1), (4, "a", 0, 9), (5, "b", 0, 1), (6, "c", 0, 1), (7, None, 0, 1), (8, "a", None, 1), (9, "d", 0, 1), (1, "a", 0, 1), (10, "e", 5, None)]
STATE = [("/x/a", 100, "ok", 5), ("/x/a", 10, "ok", 2), ("/x/a", 900, "failed", 7), (" /x/b/ ", 100, "ok", 5), ("/x/c", None, "ok", 5), ("/x/d", 100, None, 5), ("/x/e", 10, "ok", 5)]


def test_log_runs(spark, tmp_path):
    turns, state = tables(spark, TURNS, STATE)
    want = {3, 4, 6, 7, 8, 9, 10}
    got = pending_records(turns, state)
    assert {r.id for r in got.collect()} == want and got.columns == turns.columns
    runs = LogRuns(spark, str(tmp_path / "runs"))
    batch = runs.run(turns, state)
    assert {r.id for r in runs.output(batch).collect()} == want
    assert runs.run(turns, state, lambda df: df.where(F.lit(False))) == batch and runs.output(batch).count() == 7
    with pytest.raises(ValueError):
        runs.output("other")
    assert runs.run(turns.where("id = 2"), state) is None
    assert runs.run(turns.where("false"), state) is None
    assert {r.id for r in pending_records(turns, state.where("false")).collect()} == {r[0] for r in TURNS}
