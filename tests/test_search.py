"""Text search against SQLite's engine, fusion and recency against golden values."""

import sqlite3

import pytest
from turnstone.operators import context, fts, fusion, vector
from turnstone.schema import canonical

DOCS = {
    "s1::aa11": "Deploy script failed with an error. The deploy was retried!",
    "s1::bb22": "error code: don't deploy the CAFÉ build",
    "s2::cc33": "nothing to see here, only a/b tests and C++ code",
    "s2::dd44": "what was the error? deploy-script error",
    "s3::ee55": "", "s3::ff66": "日本語 テキスト deployment of café",
}
QUERIES = [
    "deploy error", "deploy OR tests", "error NOT code", "dep*", "what was the error?", "error code.", "don't", "a/b", "C++", "deploy-script", '"deploy script"',
    "session_id:s1", "aa11", "doc_id:s1", "", "  ", "cafe", "content:deploy", "^deploy", "deploy + script", "NEAR(deploy error)", "NEAR(deploy error, 2)", "(deploy OR a) AND error", "{doc_id content}:deploy",
]


def sqlite(query):
    """What SQLite's engine finds, by the fallbacks of the query language."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(doc_id, content, session_id unindexed, git_branch unindexed, turn_index unindexed, timestamp unindexed, chunk_type unindexed, project_root unindexed)")
    con.executemany("insert into t (doc_id, content, session_id) values (?, ?, ?)", [(k, v, k[:2]) for k, v in DOCS.items()])
    sql = "select doc_id, bm25(t, 0.0, 1.0) from t where t match ? order by 2"

    def ask(q):
        return dict(con.execute(sql, (q,)).fetchall())

    safe = query.replace('"', '""')
    try:
        want = ask(safe)
    except sqlite3.OperationalError:
        try:
            want = ask(f'"{safe}"')
        except sqlite3.OperationalError:
            want = {}
    return want


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index of two parts."""
    root, docs = tmp_path_factory.mktemp("index"), list(DOCS.items())
    for name, part in (("a", docs[:2]), ("b", docs[2:])):
        fts.write_index(spark.createDataFrame(part, "doc_id string, content string"), f"{root}/{name}")
    return fts.read_index(spark, [f"{root}/a", f"{root}/b"])


@pytest.mark.parametrize("query", QUERIES)
def test_index_like_sqlite(stored, query):
    want = sqlite(query)
    got = {r.doc_id: r.fts_rank for r in fts.search_index(*stored, query).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query and "^" not in query:
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_reads_terms_only(spark, stored):
    found = fts.search_index(*stored, "deploy dep*")
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "EqualTo(term,deploy)" in plan and "StringStartsWith(term,dep)" in plan
    allowed = spark.createDataFrame([("s2::dd44", 1)], "doc_id string, x int")
    assert [r.doc_id for r in fts.search_index(*stored, "error", allowed=allowed).collect()] == ["s2::dd44"]
    assert fts.search_index(*fts.read_index(spark, []), "error").count() == 0


@pytest.mark.parametrize("query", QUERIES)
def test_like_sqlite(spark, query):
    want = sqlite(query)
    got = {r.doc_id: r.fts_rank for r in fts.search(spark.createDataFrame(list(DOCS.items()), "doc_id string, content string"), query).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query and "^" not in query:
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion(spark):
    v = spark.createDataFrame([(k, i, 0.1 * i, f"p{k}") for i, k in enumerate("abcd", 1)], "doc_id string, vector_rank int, distance double, timestamp string")
    t = spark.createDataFrame([(k, i, f"q{k}") for i, k in enumerate("cea", 1)], "doc_id string, text_rank int, timestamp string")
    got = fusion.reciprocal_rank_fusion(v, t, 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.rrf_score, 6)) for r in got] == [("a", 0.032266), ("c", 0.032266), ("b", 0.016129), ("e", 0.016129), ("d", 0.015625)]
    assert got[3].distance == 0 and got[3].timestamp == "qe" and got[0].timestamp == "pa"
    alone = fusion.reciprocal_rank_fusion(v.where("false"), t, 10).orderBy("rank").collect()
    assert [r.doc_id for r in alone] == list("cea")


def test_recency(spark):
    data = [("e", 0.0, "2025-01-02"), ("a", 0.2, "2025-01-03"), ("b", 0.1, "2025-01-01"), ("d", 0.26, "2025-01-03"), ("c", 0.3, "")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data, 1)], "rank int, key string, distance double, timestamp string")
    got = fusion.recency_boost(df).orderBy("rank").collect()
    assert [(r.key, round(r.boosted, 3)) for r in got] == [("e", 1.1), ("a", 0.96), ("b", 0.9), ("d", 0.888), ("c", 0.805)]
    few = fusion.recency_boost(df.withColumn("timestamp", df.timestamp.substr(20, 1))).orderBy("rank").collect()
    assert [r.key for r in few] == list("eabdc")


@pytest.mark.parametrize(("at", "size", "want"), [(250, 1, [100, 200, 300]), (9999, 2, [200, 300, 400]), (0, 1, [0, 100])])
def test_context(spark, at, size, want):
    df = spark.createDataFrame([(f"d{i}", "s", i) for i in range(0, 500, 100)], "doc_id string, session_id string, turn_index long")
    assert [r.turn_index for r in context.around(df, "s", at, size).collect()] == want
    assert context.around(df, "unknown", at, size).count() == 0


def test_context_of_all(spark):
    rows = [(f"d{i}", f"s{i % 3}", (i * 37) % 50) for i in range(40)] + [("x", "one", 5)]
    df = spark.createDataFrame(rows, "doc_id string, session_id string, turn_index long")
    got = {(r.session_id, r.doc_id, r.position) for r in context.around_all(df, 20, 2).collect()}
    want = set()
    for s in {r[1] for r in rows}:
        own = sorted((t, d) for d, k, t in rows if k == s)
        at = own.index(min(own, key=lambda x: (abs(x[0] - 20), x)))
        want |= {(s, d, i - at) for i, (_, d) in enumerate(own) if abs(i - at) <= 2}
    assert got == want and context.around_all(df.where("false"), 20).count() == 0


def test_neighbours_of_all(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8)).astype(np.float32)
    x[7], x[9] = x[8], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<float>")
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    for size in (1 << 28, 200):  # one pass, several passes
        got = {}
        for n in vector.nearest_to_all(df.where("id % 4 < 2"), df, 5, "id", "v", size).collect():
            got.setdefault(n.query_id, []).append((n["rank"], n.id))
        assert set(got) == {i for i in range(60) if i % 4 < 2 and i != 9}
        for q, found in got.items():
            d = np.round(1 - unit @ unit[q], 12)
            assert [k for _, k in sorted(found)] == sorted((i for i in range(60) if i not in (q, 9)), key=lambda i: (d[i], i))[:5]
    assert vector.nearest_to_all(df.where("false"), df, 5, "id", "v").count() == 0


def test_one_row_per_key(spark):
    rows = [(3, "a", "x", "/p"), (1, "a", "y", None), (1, "a", "y", None), (5, None, "n", "/p"), (6, None, "m", "/p")]
    df = spark.createDataFrame(rows, "id long, doc_id string, content string, project_root string")
    assert sorted((r.id, r.content, r.project_root) for r in canonical(df).collect()) == [(1, "y", ""), (5, "n", "/p"), (6, "m", "/p")]
    narrow = canonical(df, "project_root", where=df.project_root == "/p")
    assert sorted(r.id for r in narrow.collect()) == [5, 6] and set(narrow.columns) == {"id", "doc_id", "project_root"}
