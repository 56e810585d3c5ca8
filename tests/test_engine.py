"""Store, engine and stream: idempotence, deletes, restarts."""

import json

from turnstone import api
from turnstone.streaming import ingest


def line(kind, text, ts="2025-01-01T00:00:00Z"):
    content = text if kind == "user" else [{"type": "text", "text": text}]
    return json.dumps({"type": kind, "timestamp": ts, "gitBranch": "main", "message": {"content": content}}) + "\n"


def test_engine(spark, tmp_path):
    f = tmp_path / "in" / "s1.jsonl"
    f.parent.mkdir()
    f.write_text(line("user", "How do I restart the watcher?") + line("assistant", "Use the restart script."))
    e = api.Engine(spark, str(tmp_path / "db"), current="/p")
    assert e.index_file(str(f)) == {"turns": 1, "added": 1, "offset": f.stat().st_size}
    assert e.index_file(str(f))["added"] == 0
    with f.open("a") as out:
        out.write(line("user", "And how is the index rebuilt?", "2025-02-01T00:00:00Z"))
    assert e.index_file(str(f))["added"] == 1
    hits = e.search_all_sessions("restart watcher").collect()
    assert hits[0].content.startswith("User: How do I restart") and "Result 1" in api.format_results(hits)
    assert e.get_session_stats()["total_turns"] == 2
    assert len(e.get_turns("s1", 0, 1).collect()) == 2
    e.store.build_index()
    assert e.store.index()[0].where("term = 'watcher'").count() == 1
    assert "Total: 1 sessions, 2 turns" in api.format_sessions(e.list_sessions().collect())
    assert e.delete_by_branch("none") == 0 and e.store.delete(api.F.col("timestamp") < "2025-01-15") == 1
    assert e.get_session_stats()["total_turns"] == 1
    e.store.vacuum()
    assert e.delete_by_session("s1") == 1
    e.reset()
    assert e.store.state() == {} and api.format_results([]) == "No results found."


def test_stream(spark, tmp_path):
    folder, f = tmp_path / "in", tmp_path / "in" / "s2.jsonl"
    folder.mkdir()
    store = api.Store(spark, str(tmp_path / "db"))
    second = line("user", "A second question of some length")
    f.write_text(line("user", "A first question of some length") + second[:20])

    def run():
        q = ingest.start(spark, store, str(folder), str(tmp_path / "ck"), None)
        q.awaitTermination()
        return store.turns().count()

    assert run() == 1
    with f.open("a") as out:
        out.write(second[20:])
    assert run() == 2
    assert run() == 2


def test_registry_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_search" in entry.queries()
