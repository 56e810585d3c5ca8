"""Queries of the recall operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone import api
from turnstone.functions import ids, text
from turnstone.operators import admin, context, fts, fusion, turns, vector
from turnstone.plans import stored
from turnstone.schema import canonical
from turnstone.session import Scratch, table

CUTOFF = "2024-07-01T00:00:00"
PROJECT = "/srv/oss/alert.retention"
NEAR = 20000


#: The part of the turns that is taken as stored already where a query shows what an append does.
STORED = "written_at < timestamp'2024-07-01 00:00:00'"


def _turns(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    return canonical(table(spark, d, "turn"), *columns, where=where)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stored.text_index(spark, d, "documents", _docs(spark, d))


META = ("session_id", "turn_index", "timestamp", "git_branch", "chunk_type", "project_root")


def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, *META).select("id", "doc_id", *META)


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    """What an append of all turns adds to those written before a time: an anti join by doc_id, of several versions the first."""
    turns = table(spark, d, "turn").select("id", "doc_id", "turn_index", "written_at").where("doc_id is not null")
    known = turns.where(STORED).select("doc_id").distinct()
    new = canonical(turns, "turn_index").join(known, "doc_id", "left_anti")
    return new.select("doc_id", F.when(F.col("id").isNotNull(), "new").alias("state"), "turn_index")


def filter_equality(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d, "session_id", "git_branch", "turn_index", where=admin.equals(project_root=PROJECT))
    return rows.select("doc_id", "session_id", "git_branch", "turn_index")


def stats(spark: SparkSession, d: str) -> DataFrame:
    s = admin.stats(_turns(spark, d, "session_id", "git_branch", "chunk_type"))
    return s.select("total_turns", "sessions", F.array_join("branches", "|").alias("branches"), *[F.col("by_type")[k].alias(f"n_{k}") for k in ("turn", "summary")])


def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    return admin.sessions(_turns(spark, d, "session_id", "git_branch", "timestamp")).withColumn("branches", F.array_join("branches", "|"))


def session_totals(spark: SparkSession, d: str) -> DataFrame:
    return admin.sessions(_turns(spark, d, "session_id", "git_branch", "timestamp")).agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    rows = context.around_all(_turns(spark, d, "session_id", "turn_index").where("session_id <> ''"), NEAR, 1)
    return rows.select("session_id", "doc_id", "turn_index", F.col("position").cast("bigint").alias("position"))


def context_one(spark: SparkSession, d: str) -> DataFrame:
    """The turns around a place of the session with the least identifier among the largest."""
    rows = _turns(spark, d, "session_id", "turn_index", "content")
    name = table(spark, d, "turn").where("session_id <> ''").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return context.around(rows, name[0] if name else "", NEAR, 2).select("session_id", "doc_id", "turn_index", F.length("content").cast("bigint").alias("chars"))


def expire_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, "timestamp").where(~admin.older_than(CUTOFF)).select("doc_id", "timestamp")


def expire_count(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, "timestamp").where(admin.older_than(CUTOFF)).agg(F.count("*").alias("deleted"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("fts_rank", 6).alias("score"))


def _fts(query: str):  # noqa: ANN202
    return lambda spark, d: _ranked(fts.search_index(*_index(spark, d), query))


def fts_scan(spark: SparkSession, d: str) -> DataFrame:
    """Text search without a stored index, over the texts themselves."""
    return _ranked(fts.search(_docs(spark, d), "rollback watcher"))


def fts_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics are those of all documents, only what is returned is filtered."""
    allowed = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return _ranked(fts.search_index(*_index(spark, d), "rollback OR watcher", allowed=allowed))


def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    """The stored index itself: places of two terms."""
    post = _index(spark, d)[0].where(F.col("term").isin("rollback", "watcher") & (F.col("col") == "content"))
    return post.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    post = _index(spark, d)[0].where("col = 'content'")
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf").cast("bigint")).alias("cf"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 7").select("embedding").first()[0]
    return vector.nearest(rows, q, 15, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


def knn_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    near = vector.nearest_to_all(rows.where("vec_id % 20 = 0"), rows, 5, "vec_id", "embedding")
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def rrf(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = rows.where("vec_id = 7").select("embedding").first()[0]
    near = vector.nearest(rows, q, 100, "vec_id", "embedding").select(F.col("vec_id").alias("doc_id"), "distance")
    near = near.withColumn("vector_rank", F.row_number().over(Window.orderBy("distance", "doc_id")))
    hits = fts.search_index(*_index(spark, d), "the and", limit=100).withColumn("text_rank", F.row_number().over(Window.orderBy(F.round("fts_rank", 6), "doc_id")))
    out = fusion.reciprocal_rank_fusion(near, hits, 150)
    return out.select("doc_id", F.round("rrf_score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def recency(spark: SparkSession, d: str) -> DataFrame:
    """Re-ranking of the candidates of one search, here the turns of one project."""
    rows = _turns(spark, d, "timestamp", "turn_index", where=admin.equals(project_root=PROJECT))
    rows = rows.select("doc_id", "timestamp", ((F.col("turn_index") % 97) / 100.0).alias("distance"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("distance", "doc_id")))
    return fusion.recency_boost(ranked).select("doc_id", F.round("recency", 6).alias("recency"), F.round("boosted", 6).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and texts as stored: documents with the vectors of ``embeddings`` of the same number, text search over the stored index."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = vectors.where("doc_id = 7").select("vector").first()
    docs = table(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("document"), F.coalesce("source", F.lit("")).alias("session_id"), F.lit("").alias("transcript_file"), F.coalesce("n_chars", F.lit(0)).alias("turn_index"),
        F.coalesce(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("timestamp"), F.lit("").alias("git_branch"), F.lit("turn").alias("chunk_type"), F.coalesce("project_root", F.lit("")).alias("project_root"),
    )
    out = api.hybrid_search(docs.join(vectors, "doc_id", "left"), "rollback watcher", n=20, recency=True, index=_index(spark, d), query_vector=list(q[0]) if q else [1.0])
    return out.select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "session_id", "timestamp", F.round("distance", 6).alias("distance"), F.round("boosted", 6).alias("score"), F.length("content").cast("bigint").alias("chars"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d, *META)
    head = F.concat_ws(
        " ",
        F.when(F.col("timestamp") != "", F.concat(F.lit("("), text.shown_time(F.col("timestamp")), F.lit(")"))),
        F.when(F.col("git_branch") != "", F.concat(F.lit("["), "git_branch", F.lit("]"))),
        F.when(F.col("project_root") != "", F.concat(F.lit("project:"), text.base_name(F.col("project_root")))),
        F.when(F.col("session_id") != "", F.concat(F.lit("session:"), "session_id")),
    )
    meta = F.format_string("*Turn: %d | Type: %s*", "turn_index", "chunk_type")
    return t.select("doc_id", head.alias("head"), meta.alias("meta"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Null texts and sources count as empty."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    c = F.col("text")
    doc = ids.doc_id(F.col("source"), F.col("doc_id"), text.cut(c))
    return t.select(
        "doc_id", F.length(text.strip(c)).cast("bigint").alias("stripped"), F.length(text.cut(c)).cast("bigint").alias("cut"), F.octet_length(c).cast("bigint").alias("bytes"),
        doc.alias("key"), ids.numeric_id(doc).alias("id"), F.substring_index("source", ":", 1).alias("kind"),
    )


def slug_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("source", ":", -1).alias("slug"))
    return admin.with_project(docs, table(spark, d, "slug_map")).select("doc_id", "slug", "project_root")


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slug_map").select("project_root", text.slug(F.col("project_root")).alias("slug")).distinct()


def stale_transcripts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "turn").groupBy(F.col("transcript_file").alias("path")).agg(F.max("turn_index").alias("size"))
    state = table(spark, d, "index_state").where("run_status = 'ok'").groupBy(text.base_name(F.col("transcript_path")).alias("path")).agg(F.max("last_byte_offset").alias("offset"))
    return admin.stale(files, state).select("path", "size", "offset")


def merged_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "index_state").groupBy("run_status", F.col("transcript_path").alias("path")).agg(F.max("last_byte_offset").alias("offset"))
    pick = [s.where(F.col("run_status") == k).select("path", "offset") for k in ("ok", "failed")]
    return admin.merge_states(*pick)


def sidecar_missing(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d, "chunk_type")
    return t.join(t.where("chunk_type = 'turn'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "chunk_type")


def turns_from_entries(spark: SparkSession, d: str) -> DataFrame:
    built = turns.assemble(turns.from_entries(table(spark, d, "entry")), Scratch(spark, "turns"))
    return built.select("id", "doc_id", "session_id", "turn_index", "timestamp", "git_branch", "chunk_type", "project_root", F.length("content").cast("bigint").alias("chars"))


CANON = """t as (select id, doc_id, coalesce(content, '') as content, coalesce(session_id, '') as session_id, coalesce(turn_index, 0) as turn_index,
  coalesce("timestamp", '') as "timestamp", coalesce(git_branch, '') as git_branch, coalesce(chunk_type, 'turn') as chunk_type, coalesce(project_root, '') as project_root
  from (select *, row_number() over (partition by doc_id, case when doc_id is null then id end order by id) as rn from turn) where rn = 1)"""
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_SESSIONS = """select session_id, count(*) as turns, coalesce(array_to_string(list_sort(list(distinct git_branch) filter (git_branch <> '')), '|'), '') as branches,
  coalesce(min("timestamp") filter ("timestamp" <> ''), '') as min_ts, coalesce(max("timestamp") filter ("timestamp" <> ''), '') as max_ts from t where session_id <> '' group by session_id"""
_TOKENS = f"list_filter(regexp_split_to_array(lower(translate(regexp_replace({{c}}, '[̀-ͯ]', '', 'g'), '{text.ACCENTED}', '{text.PLAIN}')), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w : w <> '')"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _tokens_sql(c: str) -> str:
    return _TOKENS.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def _count(p: list[str], prefix: bool = False) -> str:
    cond = " and ".join((f"starts_with(k[i{f'+{j}' if j else ''}], '{w}')" if prefix and j == len(p) - 1 else f"k[i{f'+{j}' if j else ''}] = '{w}'") for j, w in enumerate(p))
    return f"len(list_filter(range(1, len(k) + 2 - {len(p)}), lambda i : {cond}))"


def _bm25(phrases: list[list[str]], match: str, limit: int | None = 15, prefix: bool = False, counts: list[str] | None = None, more: str = "", digits: int = 6) -> str:
    """SQL of the formula: counts of each phrase, statistics over all rows, rank of the rows that match."""
    counts = counts or [_count(p, prefix) for p in phrases]
    f = ", ".join(f"{c} as f{i}" for i, c in enumerate(counts))
    n = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(counts)))
    idf = [f"ln((n - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(counts))]
    total = " + ".join(f"(case when {x} <= 0 then 1e-6 else {x} end) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i, x in enumerate(idf))
    tail = f" order by -({total}), doc_id limit {limit}" if limit else ""
    return f"""with k as (select doc_id, coalesce({_tokens_sql('text')}, []) as k from documents),
c as (select doc_id, len(k) + 1 as dl, {f}{more} from k), s as (select count(*) as n, avg(dl) as a, {n} from c)
select doc_id, round(-({total}), {digits}) as score from c, s where {match}{tail}"""


_KNN = "1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
QUERIES = {
    "hybrid_search": hybrid_search, "ingest_dedup": ingest_dedup, "insert_new": insert_new, "context_one": context_one, "fts_scan": fts_scan, "fts_filtered": fts_filtered,
    "fts_near": _fts("NEAR(log offset, 4)"), "fts_first": _fts("^session summary"), "fts_column": _fts("content:rollback {doc_id}:1*"), "filter_equality": filter_equality, "stats": stats, "list_sessions": list_sessions,
    "session_totals": session_totals, "context_window": context_window, "expire_survivors": expire_survivors, "expire_count": expire_count,
    "fts_and": _fts("rollback watcher"), "fts_phrase": _fts("left a note?"), "fts_or_not": _fts("rollback NOT watcher OR heartbeat"), "fts_prefix": _fts("roll*"),
    "fts_postings": fts_postings, "term_statistics": term_statistics, "knn_topk": knn_topk, "knn_all": knn_all, "rrf": rrf, "recency": recency,
    "result_lines": result_lines, "text_functions": text_functions, "slug_lookup": slug_lookup, "slugify": slugify, "stale_transcripts": stale_transcripts,
    "merged_states": merged_states, "sidecar_missing": sidecar_missing, "turns_from_entries": turns_from_entries,
}
_AND = _bm25([["rollback"], ["watcher"]], "f0 > 0 and f1 > 0")
SQL = {
    "ingest_dedup": f'with {CANON} select id, doc_id, session_id, turn_index, "timestamp", git_branch, chunk_type, project_root from t',
    "filter_equality": f"with {CANON} select doc_id, session_id, git_branch, turn_index from t where project_root = '{PROJECT}'",
    "stats": f"""with {CANON} select count(*) as total_turns, count(distinct session_id) filter (session_id <> '') as sessions,
 array_to_string(list_sort(list(distinct git_branch) filter (git_branch <> '')), '|') as branches,
 count(*) filter (chunk_type = 'turn') as n_turn, count(*) filter (chunk_type = 'summary') as n_summary from t""",
    "list_sessions": f"with {CANON} {_SESSIONS}",
    "session_totals": f"with {CANON}, x as ({_SESSIONS}) select count(*) as sessions, cast(sum(turns) as bigint) as turns from x",
    "context_window": f"""with {CANON}, r as (select *, row_number() over (partition by session_id order by turn_index, doc_id) as rn,
 row_number() over (partition by session_id order by abs(turn_index - {NEAR}), turn_index, doc_id) as near from t where session_id <> '')
select r.session_id, r.doc_id, r.turn_index, r.rn - c.rn as position from r join r c on r.session_id = c.session_id and c.near = 1 where abs(r.rn - c.rn) <= 1""",
    "expire_survivors": f"""with {CANON} select doc_id, "timestamp" from t where not ("timestamp" < '{CUTOFF}' and "timestamp" <> '')""",
    "expire_count": f"""with {CANON} select count(*) as deleted from t where "timestamp" < '{CUTOFF}' and "timestamp" <> ''""",
    "insert_new": f"""with {CANON}, known as (select distinct doc_id from turn where {STORED} and doc_id is not null)
select doc_id, 'new' as state, turn_index from t where doc_id is not null and doc_id not in (select doc_id from known)""",
    "context_one": f"""with {CANON}, s as (select session_id from turn where session_id <> '' group by 1 order by count(*) desc, session_id limit 1),
r as (select *, row_number() over (order by turn_index, doc_id) as rn, row_number() over (order by abs(turn_index - {NEAR}), turn_index, doc_id) as near from t where session_id = (select session_id from s))
select r.session_id, r.doc_id, r.turn_index, length(r.content) as chars from r join r c on c.near = 1 where abs(r.rn - c.rn) <= 2""",
    "fts_and": _AND,
    "fts_scan": _AND,
    "fts_filtered": _bm25([["rollback"], ["watcher"]], "(f0 > 0 or f1 > 0) and doc_id in (select doc_id from documents where lang = 'en')"),
    "fts_near": _bm25([["log"], ["offset"]], "near > 0", more=""", len(list_filter(range(1, len(k) + 1), lambda i : k[i] = 'log' and len(list_filter(range(greatest(1, i - 5), least(len(k), i + 5) + 1), lambda j : k[j] = 'offset')) > 0)) as near"""),
    "fts_first": _bm25([], "f0 > 0 and f1 > 0", counts=["(case when k[1] = 'session' then 1 else 0 end)", _count(["summary"])]),
    "fts_column": _bm25([["rollback"]], "f0 > 0 and starts_with(cast(doc_id as varchar), '1')"),
    "fts_postings": f"""with k as (select doc_id, coalesce({_tokens_sql('text')}, []) as k from documents), p as (select doc_id, len(k) + 1 as dl, unnest(['rollback', 'watcher']) as term, k from k),
q as (select term, doc_id, dl, list_filter(range(0, len(k)), lambda i : k[i + 1] = term) as pos from p)
select term, doc_id, len(pos) as tf, dl, array_to_string(pos, ',') as places from q where len(pos) > 0""",
    "hybrid_search": f"""with q as (select embedding from embeddings where vec_id = 7),
v as (select doc_id, dist, row_number() over (order by dist, doc_id) as rv from (select d.doc_id, {_KNN} as dist from documents d join embeddings e on d.doc_id = e.vec_id, q order by dist, doc_id limit 60)),
b as ({_bm25([["rollback"], ["watcher"]], "f0 > 0 and f1 > 0", 60, digits=9)}), f as (select doc_id, row_number() over (order by score, doc_id) as rf from b),
m as (select coalesce(v.doc_id, f.doc_id) as doc_id, dist, rv, rf, coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rf), 0) as s from v full join f on v.doc_id = f.doc_id),
o as (select *, row_number() over (order by s desc, rv nulls last, rf nulls last) as r0 from m),
x as (select o.doc_id, coalesce(dist, 0) as distance, r0, coalesce(strftime(captured_at, '%Y-%m-%dT%H:%M:%S'), '') as ts, coalesce(source, '') as session_id, length(coalesce(text, '')) as chars from o join documents d on o.doc_id = d.doc_id where r0 <= 60),
y as (select *, percent_rank() over (partition by ts <> '' order by ts) as p, count(*) filter (ts <> '') over () as n, min(ts) filter (ts <> '') over () as lo, max(ts) filter (ts <> '') over () as hi from x),
z as (select *, (1 - distance) * (1 + 0.3 * coalesce(case when n < 2 then null when ts = '' or lo = hi then 0.5 else p end, 0)) as boosted from y),
w as (select *, row_number() over (order by case when n >= 2 then -boosted end, r0) as rank from z)
select rank, doc_id, session_id, ts as "timestamp", round(distance, 6) as distance, round(boosted, 6) as score, chars from w where rank <= 20""",
    "fts_phrase": _bm25([["left", "a", "note"]], "f0 > 0"),
    "fts_or_not": _bm25([["rollback"], ["watcher"], ["heartbeat"]], "(f0 > 0 and not f1 > 0) or f2 > 0"),
    "fts_prefix": _bm25([["roll"]], "f0 > 0", prefix=True),
    "term_statistics": f"""with k as (select doc_id, unnest({_tokens_sql('text')}) as term from documents)
select term, count(distinct doc_id) as df, count(*) as cf from k group by term""",
    "knn_topk": f"select e.vec_id, round({_KNN}, 6) as distance from embeddings e, (select embedding from embeddings where vec_id = 7) q order by {_KNN}, e.vec_id limit 15",
    "knn_all": f"""with p as (select q.vec_id as query_id, e.vec_id, {_KNN} as dist from embeddings e, embeddings q where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query_id order by round(dist, 12), vec_id) as rank from p) select query_id, vec_id, round(dist, 6) as distance, rank from r where rank <= 5""",
    "rrf": f"""with v as (select doc_id, row_number() over (order by dist, doc_id) as rv from (select e.vec_id as doc_id, {_KNN} as dist from embeddings e,
 (select embedding from embeddings where vec_id = 7) q order by dist, doc_id limit 100)),
b as ({_bm25([["the"], ["and"]], "f0 > 0 and f1 > 0", 100)}), f as (select doc_id, row_number() over (order by score, doc_id) as rf from b),
m as (select coalesce(v.doc_id, f.doc_id) as doc_id, rv, rf, coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rf), 0) as s from v full join f on v.doc_id = f.doc_id),
r as (select doc_id, round(s, 6) as score, row_number() over (order by s desc, rv nulls last, rf nulls last) as rank from m) select * from r where rank <= 150""",
    "recency": f"""with {CANON}, x as (select doc_id, "timestamp" as ts, (turn_index % 97) / 100.0 as distance from t where project_root = '{PROJECT}'),
y as (select *, percent_rank() over (partition by ts <> '' order by ts) as p, count(*) filter (ts <> '') over () as n, min(ts) filter (ts <> '') over () as lo, max(ts) filter (ts <> '') over () as hi from x),
z as (select doc_id, distance, case when n < 2 then null when ts = '' or lo = hi then 0.5 else p end as recency from y)
select doc_id, round(recency, 6) as recency, round((1 - distance) * (1 + 0.3 * coalesce(recency, 0)), 6) as score from z""",
    "result_lines": f"""with {CANON} select doc_id, concat_ws(' ', case when "timestamp" <> '' then '(' || left("timestamp", 19) || ')' end, case when git_branch <> '' then '[' || git_branch || ']' end,
 case when project_root <> '' then 'project:' || split_part(project_root, '/', -1) end, case when session_id <> '' then 'session:' || session_id end) as head,
 '*Turn: ' || turn_index || ' | Type: ' || chunk_type || '*' as meta from t""",
    "text_functions": f"""with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as source from documents), x as (select doc_id, source, text, case when length(text) > {text.TURN_CHARS} then left(text, {text.TURN_CHARS}) || chr(10) || chr(10) || '[truncated]' else text end as cut
 from d), y as (select *, source || '::' || left(sha256(doc_id || ':' || cut), 16) as key from x)
select doc_id, length({_strip_sql('text')}) as stripped, length(cut) as cut, strlen(text) as bytes, key, ('0x' || left(sha256(key), 15))::bigint as id, split_part(source, ':', 1) as kind from y""",
    "slug_lookup": """select doc_id, split_part(source, ':', -1) as slug, coalesce(m.project_root, '') as project_root from documents d
 left join (select slug, max(project_root) as project_root from slug_map group by slug) m on split_part(d.source, ':', -1) = m.slug""",
    "slugify": "select distinct project_root, translate(project_root, '/.', '--') as slug from slug_map",
    "stale_transcripts": """with f as (select transcript_file as path, max(turn_index) as size from turn group by 1),
s as (select split_part(transcript_path, '/', -1) as path, max(last_byte_offset) as o from index_state where run_status = 'ok' group by 1)
select f.path, size, coalesce(o, 0) as "offset" from f left join s on f.path = s.path where coalesce(o, 0) < size""",
    "merged_states": """with s as (select run_status, transcript_path as path, max(last_byte_offset) as o from index_state group by 1, 2)
select path, o as "offset" from s where run_status = 'ok' union all
select path, o from s where run_status = 'failed' and path not in (select path from s where run_status = 'ok')""",
    "sidecar_missing": f"with {CANON} select doc_id, chunk_type from t where chunk_type <> 'turn'",
    "turns_from_entries": f"""with e as (select * from (select *, row_number() over (partition by session_id, byte_offset order by received_at) as rn from entry where session_id is not null) where rn = 1),
f as (select session_id, byte_offset as pos, lower(trim(type)) as kind, nullif("timestamp", '') as t, nullif(git_branch, '') as b, coalesce(is_meta, false) as meta, coalesce(summary, '') as summary,
  coalesce(project_root, '') as project_root, content, case when starts_with(content, '[') and json_valid(content) then content end as j from e),
g as (select *, case when kind = 'user' and not meta and j is null and {_strip_sql('content')} <> '' then {_strip_sql('content')} end as said, case when kind = 'summary' then summary end as summ,
  case when kind = 'assistant' then list_filter(list_transform(list_filter(from_json(j, '[{{"type":"VARCHAR","text":"VARCHAR"}}]'), lambda x : x.type = 'text'), lambda x : {_strip_sql("coalesce(x.text, '')")}), lambda x : x <> '') end as blocks from f),
h as (select *, last_value(t ignore nulls) over w as tn, last_value(b ignore nulls) over w as bn, max(case when said is not null or summ is not null then pos end) over w as start
  from g window w as (partition by session_id order by pos rows between unbounded preceding and current row)),
z as (select session_id, arg_max(coalesce(tn, ''), pos) as tz, arg_max(coalesce(bn, ''), pos) as bz from h group by session_id),
a as (select session_id, start as pos, array_to_string(flatten(list(blocks order by pos)), chr(10) || chr(10)) as answer from h where len(blocks) > 0 and start is not null group by 1, 2),
bd as (select *, lead(coalesce(tn, '')) over v as tl, lead(coalesce(bn, '')) over v as bl from h where start = pos window v as (partition by session_id order by pos)),
m as (select bd.session_id, project_root, case when said is null then bd.pos + 1 else bd.pos end as turn_index, case when said is null then coalesce(tn, '') else coalesce(tl, tz) end as ts,
  case when said is null then coalesce(bn, '') else coalesce(bl, bz) end as br, case when said is null then 'summary' else 'turn' end as chunk_type,
  case when said is null then 'Session Summary: ' || summ else 'User: ' || said || coalesce(chr(10) || chr(10) || 'Assistant: ' || answer, '') end as c
  from bd join z on bd.session_id = z.session_id left join a on a.session_id = bd.session_id and a.pos = bd.pos),
n as (select *, case when chunk_type = 'turn' and length(c) > {text.TURN_CHARS} then left(c, {text.TURN_CHARS}) || chr(10) || chr(10) || '[truncated]' else c end as content from m),
o as (select *, session_id || '::' || left(sha256(turn_index || ':' || content), 16) as doc_id from n where (chunk_type = 'turn' and length({_strip_sql('content')}) >= 20) or (chunk_type = 'summary' and c <> 'Session Summary: '))
select ('0x' || left(sha256(doc_id), 15))::bigint as id, doc_id, session_id, turn_index, ts as "timestamp", br as git_branch, chunk_type, project_root, length(content) as chars from o""",
}
