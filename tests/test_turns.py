"""Golden transcript, edge lines, splits and incremental reads."""

import json

import pytest
from turnstone.operators import turns
from turnstone.session import Scratch
from turnstone.sources import transcripts

GOLDEN = """{"type":"file-history-snapshot","timestamp":"2025-01-01T09:59:00.000Z"}
{"type":"user","timestamp":"2025-01-01T10:00:00.000Z","gitBranch":"main","message":{"content":"  Why did the deploy fail?  "}}
{"type":"assistant","timestamp":"2025-01-01T10:00:05.000Z","message":{"content":[{"type":"thinking","thinking":"x"},{"type":"text","text":" Missing env var. "},{"type":"tool_use","id":"t"}]}}
{"type":"user","timestamp":"2025-01-01T10:00:06.000Z","message":{"content":[{"type":"tool_result","content":"ok"}]}}
{"type":"assistant","timestamp":"2025-01-01T10:00:09.000Z","message":{"content":[{"type":"text","text":"Fixed it é."}]}}
{"type":"user","timestamp":"2025-01-01T10:01:00.000Z","gitBranch":"dev","isMeta":true,"message":{"content":"meta message that is skipped"}}
{"type":"user","timestamp":"2025-01-01T10:02:00.000Z","message":{"content":"ok"}}
{"type":"summary","summary":"Deploy fix"}
{"type":"assistant","message":{"content":[{"type":"text","text":"orphan text dropped"}]}}
{"type":"user","timestamp":"2025-01-01T10:03:00.000Z","message":{"content":"Now add a regression test please"}}
"""
EXPECTED = [
    (72, "turn", "2025-01-01T10:02:00.000Z", "dev", "User: Why did the deploy fail?\n\nAssistant: Missing env var.\n\nFixed it é.", "S1::0cf2502fe0c74bd7", 973661768439652623),
    (853, "summary", "2025-01-01T10:02:00.000Z", "dev", "Session Summary: Deploy fix", "S1::99c07dda015fb15c", 566269843115165724),
    (984, "turn", "2025-01-01T10:03:00.000Z", "dev", "User: Now add a regression test please", "S1::4230b8175b870265", 1125645611319817148),
]


def rows(df):
    return [(r.turn_index, r.chunk_type, r.timestamp, r.git_branch, r.content, r.doc_id, r.id) for r in df.orderBy("turn_index").collect()]


@pytest.mark.parametrize("spread", [False, True])
def test_golden(spark, tmp_path, spread):
    (tmp_path / "S1.jsonl").write_text(GOLDEN)
    lines = transcripts.read_lines(spark, str(tmp_path), split=300)
    got = turns.assemble(turns.from_json_lines(lines), Scratch(spark, "t") if spread else None, key="path")
    assert rows(got) == EXPECTED


def test_offsets_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"x":1}\r\n\n{"y":"\xc3\xa9"}\n{"last":1}')
    want = [(0, '{"x":1}', 2), (9, "", 1), (10, '{"y":"é"}', 1), (21, '{"last":1}', 0)]
    for split in (1, 3, 7, 1000):
        got = transcripts.read_lines(spark, str(tmp_path), split=split).orderBy("byte_offset").collect()
        assert [(r.byte_offset, r.line, r.breaks) for r in got] == want


def test_bad_lines_are_skipped(spark, tmp_path):
    good = json.dumps({"type": "user", "message": {"content": "A question that is long enough"}})
    (tmp_path / "b.jsonl").write_text("\n".join(["{bad", "5", "[1]", "", good + " x", good]) + "\n")
    got = turns.assemble(turns.from_json_lines(transcripts.read_lines(spark, str(tmp_path))), key="path").collect()
    assert [r.content for r in got] == ["User: A question that is long enough"]


def test_empty(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("")
    assert turns.assemble(turns.from_json_lines(transcripts.read_lines(spark, str(tmp_path))), key="path").count() == 0


@pytest.mark.parametrize("n", [7994, 7995, 9000])
def test_long_turns_are_cut(spark, tmp_path, n):
    (tmp_path / "d.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "x" * n}}) + "\n")
    (r,) = turns.assemble(turns.from_json_lines(transcripts.read_lines(spark, str(tmp_path))), key="path").collect()
    assert len(r.content) == (n + 6 if n <= 7994 else 8013)
