"""Rebuilding conversations from message rows (problem 2).

``resolve`` is the general operator: rows with parent pointers become trees by
iterative pointer jumping, orphans and cycles are told apart, and every node
gets its root and depth. ``message_lines`` and ``parents`` derive messages and
pointers from delivered transcript lines; ``judge`` decides which sessions fall
away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import ordered
from turnstone.session import Scratch

#: White space in the widest sense: Java's, the separators U+001C to U+001F, U+0085 and every Unicode space.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def is_blank(c: Column) -> Column:
    """Empty or only white space; null for null."""
    return ~c.rlike(f"[^{_SPACE}]")


def message_lines(entry: DataFrame) -> DataFrame:
    """One compact row per delivered line: (session_id, byte_offset, instant, role, broken).

    A line delivered again (same session and offset) counts once, in the
    version received first. ``role`` is user or assistant for messages and null
    for all other lines; ``broken`` marks a user or assistant line without
    content, or cut content of an assistant line. ``instant`` is null where the
    time is missing, empty or unreadable. Content itself is left behind: what
    follows moves some tens of bytes per line. JSON with repeated keys in one
    object counts as invalid.
    """
    kind = F.lower(F.regexp_replace("type", f"^[{_SPACE}]+|[{_SPACE}]+$", ""))
    assistant, user = kind == "assistant", kind == "user"
    lines = entry.where(F.col("session_id").isNotNull()).select(
        "session_id",
        "byte_offset",
        "received_at",
        "content",
        kind.alias("kind"),
        F.try_to_timestamp("timestamp").alias("instant"),
        (~F.coalesce("is_meta", F.lit(False))).alias("own"),
        # Only what may be a block list is parsed; the parser itself ignores what follows the first value.
        F.when((assistant | user) & F.ltrim("content").startswith("[") & F.rtrim("content").endswith("]"), F.try_parse_json("content")).alias("json"),
    )
    blocks = F.expr("try_variant_get(json, '$', 'array<variant>')")
    lines = lines.withColumn("blocks", blocks)
    is_list = F.coalesce(F.forall("blocks", lambda b: F.schema_of_variant(b).startswith("OBJECT")), F.lit(False))
    has_text = F.coalesce(
        F.exists(
            "blocks",
            lambda b: (F.try_variant_get(b, "$.type", "string") == "text")
            & F.coalesce(~is_blank(F.try_variant_get(b, "$.text", "string")), F.lit(False)),
        ),
        F.lit(False),
    )
    spoken = F.col("own") & F.col("content").isNotNull()
    role = (
        F.when((F.col("kind") == "user") & spoken & ~is_list & ~is_blank(F.col("content")), "user")
        .when((F.col("kind") == "assistant") & F.col("content").isNotNull() & is_list & has_text, "assistant")
    )
    broken = F.coalesce(
        (F.col("kind").isin("user", "assistant") & F.col("own") & F.col("content").isNull())
        | ((F.col("kind") == "assistant") & F.col("content").startswith("[{") & F.col("json").isNull()),
        F.lit(False),
    )
    facts = lines.select("session_id", "byte_offset", F.struct("received_at", "instant", role.alias("role"), broken.alias("broken")).alias("f"))
    once = facts.groupBy("session_id", "byte_offset").agg(F.min("f").alias("f"))
    return once.select("session_id", "byte_offset", "f.instant", "f.role", "f.broken")


def parents(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Messages with parent pointers: (session_id, node, parent, role, parent_role).

    The parent of a message is the message before it by instant, then byte
    offset; a line without a time takes that of the line before it by offset.
    Both orders run over chunks, so a session of any length is spread over
    tasks.
    """
    by_offset = ordered.chunked(lines, scratch, "by_offset", "session_id", ["byte_offset"])
    timed = ordered.carry_last(by_offset, "session_id", ["byte_offset"], "instant", "at")
    messages = timed.where("role is not null").select("session_id", "byte_offset", "role", "at")
    by_time = ordered.chunked(messages, scratch, "by_time", "session_id", ["at", "byte_offset"])
    here = F.struct(F.col("byte_offset").alias("node"), F.col("role").alias("role"))
    linked = ordered.previous(by_time, "session_id", ["at", "byte_offset"], here, "p")
    return linked.select(
        "session_id", F.col("byte_offset").alias("node"), F.col("p.node").alias("parent"), "role", F.col("p.role").alias("parent_role")
    )


def resolve(nodes: DataFrame, scratch: Scratch, tree: str = "session_id") -> DataFrame:
    """Root and depth of every node by pointer jumping.

    Input: (tree, node, parent, ...): ``node`` is unique in its tree, a null
    ``parent`` makes a root. Output: (tree, node, root, depth, status), depth 0
    at the root, status ``ok``, ``orphan`` (an ancestor's parent does not exist;
    root is that ancestor) or ``cycle`` (root and depth are null). Every round
    joins each unresolved pointer with its target's pointer, so pointers double
    in length. After k rounds every path of a tree of at most 2^k nodes is
    resolved, or runs in a circle; such trees are set aside by that number alone
    and take no further part. An empty input gives an empty result.
    """
    at = "_tree"
    base = nodes.select(F.col(tree).alias(at), "node", "parent")
    known = base.select(at, F.col("node").alias("parent"), F.lit(True).alias("_there"))
    start = base.join(known, [at, "parent"], "left").select(
        at,
        "node",
        F.when(F.col("_there"), F.col("parent")).otherwise(F.col("node")).alias("ptr"),
        F.when(F.col("_there"), 1).otherwise(0).cast("bigint").alias("dist"),
        F.coalesce(F.col("_there"), F.lit(False)).alias("open"),
        (F.col("parent").isNotNull() & F.col("_there").isNull()).alias("orphan"),
    )
    count = base.groupBy(at).agg(F.count("*").alias("_nodes"))
    live = scratch.save(start.join(count, at), "jump-0")
    columns = [at, "node", "ptr", "dist", "open", "orphan"]
    settled: list[DataFrame] = []
    k = 0
    while live.where("open").limit(1).count():
        k += 1
        target = live.select(
            at, F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("open").alias("_open"), F.col("orphan").alias("_orphan")
        )
        moved = live.where("open").join(target, [at, "ptr"]).select(
            at, "node", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_open").alias("open"), F.col("_orphan").alias("orphan"), "_nodes"
        )
        both = scratch.save(live.where("not open").unionByName(moved), f"jump-{k}")
        settled.append(both.where(F.col("_nodes") <= 2**k).select(*columns))
        live = both.where(F.col("_nodes") > 2**k)
    live = live.select(*columns)
    out = live
    for s in settled:
        out = out.unionByName(s)
    # What is open in a tree set aside has gone more steps than the tree has nodes.
    status = F.when(F.col("open"), "cycle").when(F.col("orphan"), "orphan").otherwise("ok")
    return out.select(F.col(at).alias(tree), "node", F.when(~F.col("open"), F.col("ptr")).alias("root"), F.when(~F.col("open"), F.col("dist")).alias("depth"), status.alias("status"))


def paths(entry: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lines, placed messages): what ``judge`` and ``conversations`` need."""
    lines = scratch.save(message_lines(entry), "lines")
    linked = scratch.save(parents(lines, scratch), "linked")
    placed = resolve(linked, scratch).join(linked, ["session_id", "node"])
    return lines, placed


def judge(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(session_id, reason) of every session to drop: broken, empty or unanswered.

    Per session only counters and the roles at both ends of its path are
    aggregated, partly before the shuffle, so a large session costs no more
    than its rows.
    """
    flags = lines.groupBy("session_id").agg(F.max("broken").alias("broken"), F.count("role").alias("messages"))
    ends = placed.groupBy("session_id").agg(
        F.min_by("role", "depth").alias("first"),
        F.max_by("role", "depth").alias("last"),
        F.max((F.col("role") == "user") & F.coalesce(F.col("parent_role") == "user", F.lit(False))).alias("skipped"),
        F.max(F.col("status") != "ok").alias("astray"),
    )
    both = flags.join(ends, "session_id", "left")
    reason = (
        F.when(F.col("broken") | F.coalesce(F.col("astray"), F.lit(False)) | F.coalesce(F.col("first") == "assistant", F.lit(False)), "broken")
        .when(F.col("messages") == 0, "empty")
        .when(F.col("skipped") | (F.col("last") == "user"), "unanswered")
    )
    return both.select("session_id", reason.alias("reason")).where("reason is not null")


def conversations(entry: DataFrame, scratch: Scratch) -> DataFrame:
    """The kept sessions as ordered messages: (session_id, position, role, text), one row per message.

    ``text`` is the content of a user message and the non-blank text blocks of
    an assistant message, joined by blank lines. Rows instead of one array per
    session: a session may be larger than any task's memory.
    """
    lines, placed = paths(entry, scratch)
    placed = scratch.save(placed, "placed")  # read twice
    kept = placed.join(judge(lines, placed), "session_id", "left_anti").select("session_id", F.col("node").alias("byte_offset"), "depth", "role")
    # One version of each line, chosen by its hash, so that texts are not gathered.
    text = entry.select("session_id", "byte_offset", "received_at", "content").groupBy("session_id", "byte_offset").agg(
        F.min_by("content", F.struct("received_at", F.xxhash64("content"))).alias("content")
    )
    blocks = F.expr("try_variant_get(try_parse_json(content), '$', 'array<variant>')")
    said = F.filter(
        F.transform(
            F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string")
        ),
        lambda t: ~is_blank(t),
    )
    return kept.join(text, ["session_id", "byte_offset"]).select(
        "session_id", F.col("depth").alias("position"), "role", F.when(F.col("role") == "user", F.col("content")).otherwise(F.array_join(said, "\n\n")).alias("text")
    )
