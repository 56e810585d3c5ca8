"""Pointer, buckets, schema, half lines, bad files, retention, requests and the command line."""

import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F
from turnstone import api, cli
from turnstone.sources import store as stores
from turnstone.streaming import ingest


def line(kind, text, ts="2025-01-01T00:00:00Z"):
    content = text if kind == "user" else [{"type": "text", "text": text}]
    return json.dumps({"type": kind, "timestamp": ts, "gitBranch": "main", "message": {"content": content}}) + "\n"


def rows(spark, *keys, **more):
    df = spark.createDataFrame([(k, f"text of {k}", i) for i, k in enumerate(keys)], "doc_id string, content string, turn_index long")
    return df.withColumns({c: F.lit(v) for c, v in more.items()})


def test_half_lines(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    first, second = line("user", "A first question of some length"), line("user", "A second question of some length")
    f.write_text(first + second[:30])
    e = api.Engine(spark, str(tmp_path / "db"))
    assert e.index_file(str(f)) == {"turns": 1, "added": 1, "offset": len(first)}
    f.write_text(first + second[:-1])  # complete, but for the line break
    assert e.index_file(str(f)) == {"turns": 1, "added": 1, "offset": len(first + second) - 1}
    f.write_text(first + second)
    assert e.index_file(str(f))["added"] == 0 and e.store.turns().count() == 2
    assert e.store.state()[str(f)]["offset"] == len(first + second)


def test_backfill_and_known_offsets(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "-srv-p").mkdir(parents=True)
    for k in "ab":
        (folder / "-srv-p" / f"{k}.jsonl").write_bytes(line("user", f"Question of file {k} \udcff".replace("\udcff", "é")).encode() + b'\xff{"bad\n')
    e = api.Engine(spark, str(tmp_path / "db"))
    e.store.register_project("/srv.p".replace(".", "/"))
    assert e.index_file(str(folder / "-srv-p" / "a.jsonl"), project_root="/srv/p")["added"] == 1
    assert e.backfill(str(folder)) == 1 and e.backfill(str(folder)) == 0
    with (folder / "-srv-p" / "a.jsonl").open("a") as f:
        f.write(line("user", "Another question of file a"))
    assert e.backfill(str(folder)) == 1
    assert {r.project_root for r in e.store.turns().collect()} == {"/srv/p"} and e.store.turns().count() == 3
    assert e.counters.errors == 0 and e.counters.added == 3


def test_a_bad_file_stops_nothing(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "db"))
    f = tmp_path / "x.jsonl"
    f.write_text(line("user", "A question that could not be read"))
    schema = "path string, session_id string, byte_offset long, line string, breaks int, next_offset long"
    good = line("user", "A question that could be read")[:-1]
    lines = spark.createDataFrame([("/in/g.jsonl", "g", 0, good, 1, len(good) + 1), (str(f), "x", 0, None, 0, 0)], schema)
    counters = ingest.Counters()
    assert ingest.process(store, lines, "/in", counters) == 1
    assert counters.errors == 1 and store.note(ingest.FAILED)[str(f)]["offset"] == 0
    assert ingest.retry(store, "/in", counters) == 1 and store.note(ingest.FAILED) == {}
    assert store.turns().count() == 2


def test_pointer(spark, tmp_path, monkeypatch):
    store = stores.Store(spark, str(tmp_path / "db"))
    assert store.add(rows(spark, "s::1", "s::2", "t::1")) == 3 and store.add(rows(spark, "s::2", "u::1", "u::1")) == 1
    assert store.index()[0].where("term = 'text' and col = 'content'").count() == 4
    monkeypatch.setattr(store.folder, "advance", lambda *_: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        store.add(rows(spark, "v::1"))
    monkeypatch.undo()
    assert stores.Store(spark, store.root).turns().count() == 4  # the former version stands
    store.vacuum()
    assert len(store.folder.names("turns")) == len(store.head()["folders"]) == len(store.folder.names("index"))
    newest = sorted((tmp_path / "db").glob("HEAD-*"))[-1]
    newest.write_text("{")
    (tmp_path / "db" / f".{newest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="cannot be read"):
        stores.Store(spark, store.root)
    for x in (tmp_path / "db").glob("*HEAD-*"):
        x.unlink()
    with pytest.raises(ValueError, match="no pointer"):
        stores.Store(spark, store.root)


def test_appends_read_their_buckets_only(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "db"))
    store.add(rows(spark, *[f"s{i}::1" for i in range(50)]))
    plan = store._rows().where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert store._rows().where(F.col("bucket") != stores.bucket(F.col("doc_id"))).count() == 0


def test_another_schema_is_rewritten(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "db"))
    store.add(rows(spark, "s::1", "s::2"))
    head = store.head() | {"schema": "older"}
    store.folder.advance("HEAD", json.dumps(head))
    again = stores.Store(spark, store.root)
    assert again.head()["schema"] == stores.schema_hash() and again.turns().count() == 2 and again.head()["folders"] != head["folders"]


def test_retention(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text(line("user", "An old question of some length", "2001-01-01T00:00:00Z") + line("user", "A new question of some length", "2999-01-01T00:00:00Z") + line("user", "The end of it all and more", "2999-01-02T00:00:00Z"))
    e = api.Engine(spark, str(tmp_path / "db"), retention_days=365)
    e.store.add(rows(spark, "o::1", timestamp="2001-01-01T00:00:00Z", session_id="o", project_root="/q"))
    assert e.index_file(str(f), project_root="/p")["added"] == 3
    assert e.store.turns().where("timestamp < '2002'").count() == 0 and e.store.turns().count() == 3
    assert e.expire(365) is None and e.expire(0) is None
    assert e.delete_older_than(1, dt.datetime(3000, 1, 1, tzinfo=dt.timezone.utc), "/other") == 0
    assert e.cleanup_sessions(session_id="s", project_root="/other") == {"by_session": 0, "remaining": 0}
    assert e.cleanup_sessions(session_id="s", git_branch="none", project_root="/p") == {"by_session": 3, "by_branch": 0, "remaining": 0}
    with pytest.raises(ValueError):
        e.cleanup_sessions(max_age_days=0)


def test_states_are_merged(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "db"))
    schema = "path string, offset bigint, project_root string"
    store.save_offsets(spark.createDataFrame([("/a", 5, "/p")], schema))
    store.save_offsets(spark.createDataFrame([("/a", 7, "/p")], schema))
    store.save_note("EXPIRE", {"last_expire_check": 10})
    store.merge_older(spark.createDataFrame([("/a", 99, "/q"), ("/b", 3, "/q")], schema), 20)
    assert {k: v["offset"] for k, v in store.state().items()} == {"/a": 7, "/b": 3} and store.note("EXPIRE")["last_expire_check"] == 20
    store.merge_older(spark.createDataFrame([], schema), 15)
    assert store.note("EXPIRE")["last_expire_check"] == 20 and store.offset("/none") == 0


def test_requests(spark, tmp_path):
    e = api.Engine(spark, str(tmp_path / "db"))
    assert e.index_request({})[0] == 400 and e.index_request({"transcript_path": "/no/file", "session_id": "x"})[0] == 404
    f = tmp_path / "s.jsonl"
    f.write_text(line("user", "A question of sufficient length"))
    status, body = e.index_request({"transcript_path": str(f), "session_id": "named", "cwd": "/srv/p"})
    assert status == 200 and body["added"] == 1
    row = e.store.turns().first()
    assert row.session_id == "named" and row.project_root == "/srv/p" and e.store.slugs() == {"-srv-p": "/srv/p"}
    assert e.health()["counters"]["turns"] == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    e = api.Engine(spark, str(tmp_path / "db"))
    e.store.add(rows(spark, "s::1", "s::2", session_id="s", git_branch="b", timestamp="2020-01-01T00:00:00"))
    at = ["--store", str(tmp_path / "db")]
    assert cli.main([*at, "list"], spark) == 0 and "Total: 1 sessions, 2 turns" in capsys.readouterr().out
    assert cli.main([*at, "stats"], spark) == 0 and "**Total Turns:** 2" in capsys.readouterr().out
    assert cli.main([*at, "delete"], spark) == 2
    assert cli.main([*at, "delete", "--session", "none", "--branch", "b"], spark) == 0 and "0 turns" in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main([*at, "reset"], spark) == 1
    assert cli.main([*at, "expire", "--days", "1"], spark) == 0 and "2 turns" in capsys.readouterr().out
    assert cli.main([*at, "reset", "--yes"], spark) == 0
    assert cli.hook_request({"stop_hook_active": True, "transcript_path": "x", "session_id": "y"}) is None
    assert cli.hook_request({"transcript_path": "x", "session_id": "y", "cwd": str(tmp_path)}) == {"transcript_path": "x", "session_id": "y", "cwd": str(tmp_path)}
    monkeypatch.setattr("sys.stdin", io.StringIO("no json"))
    assert cli.main(["hook"]) == 0
