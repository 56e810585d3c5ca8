"""The engine as a user calls it: search, context, statistics, ingestion, retention."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstone.functions import text
from turnstone.operators import admin, context, fts, fusion, turns, vector
from turnstone.session import Scratch
from turnstone.sources import transcripts
from turnstone.sources.store import Store
from turnstone.streaming import ingest

EXPIRE_EVERY = 86400


def hybrid_search(
    rows: DataFrame, query: str, n: int = 5, session_id: str | None = None, git_branch: str | None = None, project_root: str | None = None,
    recency: bool = False, model: str = vector.DEFAULT_MODEL, text_col: str = "document", index: tuple[DataFrame, DataFrame] | None = None,
    query_vector: list[float] | None = None,
) -> DataFrame:
    """The n best turns by vector and text search, fused, optionally ordered anew by recency.

    ``rows`` are turns with ``vector``. Each engine gives 3n candidates under the
    same filters; text statistics are those of all rows. With a stored ``index``
    text search reads the query's terms from it instead of all texts, and the
    payload of the candidates, 6n at most, is joined at the end. Result: turn
    columns, ``distance`` (1 - cosine; 0 for hits of text alone), ``rank``.
    """
    keep = admin.equals(session_id, git_branch, project_root)
    fetch = fusion.OVERFETCH * n
    key = "doc_id"
    payload = [key, F.col(text_col).alias("content"), "session_id", "transcript_file", "turn_index", "timestamp", "git_branch", "chunk_type", "project_root"]
    q = query_vector or vector.embed_texts([query], is_query=True, model=model)[0].tolist()
    near = vector.nearest(rows.where(keep).select(key, "vector"), q, fetch, key, "vector").drop("vector")
    near = near.withColumn("vector_rank", F.row_number().over(Window.orderBy("distance", key)))
    if index:
        filtered = bool(session_id or git_branch or project_root)
        hits = fts.search_index(*index, query, key, rows.where(keep).select(key) if filtered else None, fetch)
    else:
        hits = fts.search(rows.select(*payload), query, where=keep, limit=fetch).select(key, "fts_rank")
    hits = hits.withColumn("text_rank", F.row_number().over(Window.orderBy(F.round("fts_rank", 9), key))).drop("fts_rank")
    ranked = fusion.reciprocal_rank_fusion(near, hits, fetch)
    # At most ``fetch`` candidates: a broadcast of fixed size against the scan of the payload.
    ranked = rows.select(*payload).join(F.broadcast(ranked), key)
    if recency:
        ranked = fusion.recency_boost(ranked)
    return ranked.where(F.col("rank") <= n).orderBy("rank")


class Engine:
    """One store and the operations on it. ``current`` is the project that searches default to.

    ``retention_days``: after an ingest that added turns, and at most once a
    day, turns older than this are deleted; 0 keeps all.
    """

    def __init__(self, spark: SparkSession, root: str, current: str | None = None, model: str = vector.DEFAULT_MODEL, retention_days: int = 0) -> None:
        self.spark, self.current, self.model, self.retention_days = spark, current, model, retention_days
        self.store = Store(spark, root, model)
        self.counters = ingest.Counters()

    def _index(self) -> tuple[DataFrame, DataFrame]:
        return self.store.index()

    # --- queries
    def search_session(self, query: str, n: int = 5, session_id: str | None = None) -> DataFrame:
        """In the current project, recent turns first among like ones."""
        return hybrid_search(self.store.turns(), query, n, session_id=session_id, project_root=self.current, recency=True, model=self.model, index=self._index())

    def search_all_sessions(self, query: str, n: int = 10, git_branch: str | None = None, project_root: str | None = None) -> DataFrame:
        """In the current project, a named one, or all (``*``); by relevance alone."""
        return hybrid_search(self.store.turns(), query, n, git_branch=git_branch, project_root=admin.scope(project_root, self.current), model=self.model, index=self._index())

    def get_turns(self, session_id: str, turn_index: int, context_size: int = 2) -> DataFrame:
        return context.around(self.store.turns().drop("vector").withColumnRenamed("document", "content"), session_id, turn_index, context_size)

    def get_session_stats(self, project_root: str | None = None) -> dict:
        r = admin.stats(self.store.turns().where(admin.equals(project_root=project_root))).first()
        return {"total_turns": r.total_turns, "sessions": r.sessions, "branches": list(r.branches), "by_type": dict(r.by_type or {})}

    def list_sessions(self, project_root: str | None = None) -> DataFrame:
        return admin.sessions(self.store.turns().where(admin.equals(project_root=project_root))).orderBy(F.desc("max_ts"), "session_id")

    # --- ingestion
    def index_file(self, path: str, session_id: str | None = None, project_root: str | None = None) -> dict:
        """Reads a transcript from its stored offset; {turns, added, offset}. A missing file raises FileNotFoundError.

        The offset is that of the last complete line, so a line that is still
        being written is read when it is complete.
        """
        files = transcripts.list_files(path)
        if not files:
            raise FileNotFoundError(path)
        ((name, size),) = files.items()
        at = self.store.offset(name)
        if at >= size:
            return {"turns": 0, "added": 0, "offset": at}
        root = project_root or self.current or ""
        scratch = Scratch(self.spark, "file")
        try:
            lines = scratch.save(transcripts.read_lines(self.spark, path, start=at, whole=True), "delivered")
            end = lines.agg(F.max("next_offset")).first()[0] or at
            if session_id:
                lines = lines.withColumn("session_id", F.lit(session_id))
            facts = turns.from_json_lines(lines.where("line is not null")).withColumn("project_root", F.lit(root))
            built = scratch.save(turns.assemble(facts, scratch, key="path"), "turns")
            found, added = built.count(), self.store.add(built)
        finally:
            scratch.drop()
        if end > at:
            self.store.save_offsets(self.spark.createDataFrame([(name, end, root)], "path string, offset bigint, project_root string"))
        self.counters.turns, self.counters.added, self.counters.files = self.counters.turns + found, self.counters.added + added, self.counters.files + 1
        if added:
            self.expire(self.retention_days)
        return {"turns": found, "added": added, "offset": end}

    def index_request(self, body: dict, project_root: str | None = None) -> tuple[int, dict]:
        """(status, payload) of a pushed request: ``transcript_path`` and ``session_id`` are required, ``cwd`` is optional.

        400 for a body that lacks them, 404 for a file that does not exist. A
        ``project_root`` of the sender's own counts before ``cwd``.
        """
        if not isinstance(body, dict) or not all(isinstance(body.get(k), str) and body[k] for k in ("transcript_path", "session_id")):
            return 400, {"error": "transcript_path and session_id are required"}
        root = project_root or body.get("cwd") or ""
        if root:
            self.store.register_project(root)
        try:
            return 200, {"status": "ok"} | self.index_file(body["transcript_path"], body["session_id"], root or None)
        except FileNotFoundError:
            return 404, {"error": f"no such file: {body['transcript_path']}"}

    def backfill(self, folder: str, recursive: bool = True) -> int:
        """Indexes what is new in every file of a folder, by the ingest stream run once; how many turns were added."""
        before = self.counters.added
        name = hashlib.sha256(f"{folder}|{recursive}".encode()).hexdigest()[:16]
        ingest.start(self.spark, self.store, folder, f"{self.store.root}/streams/{name}", None, recursive, self.counters).awaitTermination()
        if self.counters.added > before:
            self.expire(self.retention_days)
        return self.counters.added - before

    def watch(self, folder: str, seconds: float = 2.0, recursive: bool = True) -> StreamingQuery:
        """Keeps a folder indexed until the query is stopped; ``ingest.status`` tells what it did."""
        name = hashlib.sha256(f"{folder}|{recursive}".encode()).hexdigest()[:16]
        self.expire(self.retention_days)  # before the stream begins: the store has one writer at a time
        return ingest.start(self.spark, self.store, folder, f"{self.store.root}/streams/{name}", seconds, recursive, self.counters)

    def health(self) -> dict:
        """What a service reports of itself."""
        return {"status": "ok", "model": self.model, "version": self.store.head()["version"], "counters": self.counters.as_dict()}

    # --- retention
    def _scoped(self, condition: Column, project_root: str | None) -> Column:
        return condition & admin.equals(project_root=project_root)

    def delete_by_session(self, session_id: str, project_root: str | None = None) -> int:
        return self.store.delete(self._scoped(F.col("session_id") == session_id, project_root))

    def delete_by_branch(self, git_branch: str, project_root: str | None = None) -> int:
        return self.store.delete(self._scoped(F.col("git_branch") == git_branch, project_root))

    def delete_older_than(self, days: int, now: dt.datetime | None = None, project_root: str | None = None) -> int:
        now = now or dt.datetime.now(dt.timezone.utc)
        cutoff = self.spark.range(1).select(text.cutoff_time(F.lit(now), days)).first()[0]
        return self.store.delete(self._scoped(admin.older_than(cutoff), project_root))

    def cleanup_sessions(
        self, max_age_days: int | None = None, session_id: str | None = None, git_branch: str | None = None, project_root: str | None = None
    ) -> dict:
        """Runs every deletion asked for, within a project if one is named, and reports what is left of it; an age of 0 asks for nothing."""
        if not (max_age_days or session_id or git_branch):
            raise ValueError("give max_age_days, session_id or git_branch")
        root = admin.scope(project_root, None)
        out = {}
        if max_age_days:
            out["by_age"] = self.delete_older_than(max_age_days, project_root=root)
        if session_id:
            out["by_session"] = self.delete_by_session(session_id, root)
        if git_branch:
            out["by_branch"] = self.delete_by_branch(git_branch, root)
        return out | {"remaining": self.get_session_stats(root)["total_turns"]}

    def expire(self, days: int = 365, now: dt.datetime | None = None) -> int | None:
        """Age-based deletion at most once a day; None if it is not due, 0 days switch it off."""
        now = now or dt.datetime.now(dt.timezone.utc)
        if not days or now.timestamp() - self.store.note("EXPIRE").get("last_expire_check", 0) < EXPIRE_EVERY:
            return None
        self.store.save_note("EXPIRE", {"last_expire_check": now.timestamp()})
        return self.delete_older_than(days, now)

    def reset(self, confirm: bool = True) -> None:
        """Drops the store; ``confirm`` False keeps it, so that a caller who asks first may pass the answer on."""
        if confirm:
            self.store.clear()


# --- text output -------------------------------------------------------------

# Headings, labels and texts for empty results.
EMPTY = {"results": "No results found.", "turns": "No turns found.", "sessions": "No sessions indexed."}
HEADS = {"results": "**Result {number}**", "turns": "**Turn {turn_index}**"}
LABELS = {
    "results": [("timestamp", "({:.19})"), ("git_branch", "[{}]"), ("project", "project:{}"), ("session_id", "session:{}")],
    "turns": [("timestamp", "({:.19})"), ("git_branch", "[{}]")],
}
NOTES = {"results": "*Turn: {turn_index} | Type: {chunk_type} | Relevance: {relevance:.2f}*", "turns": "*Type: {chunk_type}*"}
TABLE = [("Session ID", "<40"), ("Turns", ">6"), ("Branch", "<30"), ("First", ">20"), ("Last", ">20")]


def _markdown(kind: str, rows: list) -> str:
    """Rows as Markdown blocks, by the tables above."""
    blocks = []
    for number, r in enumerate(rows, 1):
        facts = r.asDict() if hasattr(r, "asDict") else dict(r)
        facts |= {"number": number, "project": (facts.get("project_root") or "").rstrip("/").rsplit("/", 1)[-1], "relevance": 1 - facts.get("distance", 0.0)}
        head = [HEADS[kind].format(**facts), *(form.format(facts[name]) for name, form in LABELS[kind] if facts.get(name))]
        blocks.append("\n".join([" ".join(head), NOTES[kind].format(**facts), "", facts["content"], "", "---", ""]))
    return "\n".join(blocks) or EMPTY[kind]


def format_results(rows: list) -> str:
    """Numbered search results as Markdown."""
    return _markdown("results", rows)


def format_turns(rows: list) -> str:
    return _markdown("turns", rows)


def format_stats(stats: dict, location: str) -> str:
    """Totals, branches and types, the most frequent first; parts without entries are left out."""
    lines = {"Total Turns": stats["total_turns"], "Sessions": stats["sessions"], "Branches": ", ".join(stats["branches"])}
    out = [f"**{label}:** {value}" for label, value in lines.items() if value != ""]
    kinds = sorted(stats["by_type"].items(), key=lambda x: -x[1])
    out += ["\n### By Type", *(f"- {k}: {n}" for k, n in kinds)] if kinds else []
    return "\n".join([*out, f"\n**Index Location:** {location}"])


def format_sessions(rows: list) -> str:
    """Fixed-width table of sessions with a line of totals."""
    if not rows:
        return EMPTY["sessions"]
    cells = [[r["session_id"], r["turns"], ", ".join(r["branches"]) or "(none)", r["min_ts"][:19], r["max_ts"][:19]] for r in rows]
    table = [" ".join(f"{c:{width}}" for c, (_, width) in zip(row, TABLE)) for row in [[name for name, _ in TABLE], *cells]]
    table.insert(1, "-" * 120)
    return "\n".join([*table, f"\nTotal: {len(rows)} sessions, {sum(r['turns'] for r in rows)} turns"])
