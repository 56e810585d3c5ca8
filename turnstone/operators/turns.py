"""From transcript lines to turns: carry-forward, segmentation, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import ids, text
from turnstone.operators import ordered
from turnstone.session import Scratch


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Raw lines (path, session_id, byte_offset, line) as facts; malformed lines and JSON that is no object fall away.

    A user line is accepted if its content is a string that is not blank and it
    is not marked as meta; an assistant line gives its text blocks.
    """
    stripped = text.strip(F.col("line"))
    v = F.when(stripped.endswith("}"), F.try_parse_json(stripped))
    df = lines.withColumn("v", v).where(F.schema_of_variant("v").startswith("OBJECT"))
    content = F.expr("try_variant_get(v, '$.message.content', 'variant')")
    df = df.withColumn("c", content)
    is_text = F.schema_of_variant("c") == "STRING"
    blocks = F.expr("try_variant_get(c, '$', 'array<variant>')")
    lead = F.octet_length("line") - F.octet_length(F.regexp_replace("line", r"^[\s\x1c-\x1f\x85\p{Z}]+", ""))
    trail = F.octet_length("line") - F.octet_length(F.regexp_replace("line", r"[\s\x1c-\x1f\x85\p{Z}]+$", ""))
    return df.select(
        "path",
        "session_id",
        F.col("byte_offset").alias("pos"),
        # The line break counts as stripped white space too.
        (lead + trail + F.col("breaks")).cast("bigint").alias("stripped"),
        _get(F.col("v"), "$.type").alias("kind"),
        F.coalesce(_get(F.col("v"), "$.timestamp"), F.lit("")).alias("timestamp"),
        F.coalesce(_get(F.col("v"), "$.gitBranch"), F.lit("")).alias("git_branch"),
        F.coalesce(_get(F.col("v"), "$.isMeta", "boolean"), F.lit(False)).alias("is_meta"),
        F.coalesce(_get(F.col("v"), "$.summary"), F.lit("")).alias("summary"),
        F.when(is_text, _get(F.col("c"), "$")).alias("said"),
        _block_texts(blocks).alias("blocks"),
    )


def _block_texts(blocks: Column) -> Column:
    texts = F.transform(
        F.filter(blocks, lambda b: F.schema_of_variant(b).startswith("OBJECT") & (F.try_variant_get(b, "$.type", "string") == "text")),
        lambda b: text.strip(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))),
    )
    return F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>"))


def from_entries(entry: DataFrame) -> DataFrame:
    """The delivered lines of the table ``entry`` as facts; a line delivered again counts once."""
    once = entry.where("session_id is not null").groupBy("session_id", "byte_offset").agg(
        F.min_by(F.struct("transcript_file", "type", "timestamp", "git_branch", "is_meta", "summary", "content", "project_root"), F.struct("received_at", F.xxhash64("content"))).alias("e")
    )
    e = once.select("session_id", F.col("byte_offset").alias("pos"), "e.*")
    # The parser takes the first value and ignores what follows, so the end is looked at as well.
    e = e.withColumn("blocks_v", F.when(F.startswith("content", F.lit("[")) & F.rtrim("content").endswith("]"), F.expr("try_variant_get(try_parse_json(content), '$', 'array<variant>')")))
    empty = F.lit("")
    return e.select(
        F.col("transcript_file").alias("path"),
        "session_id",
        "pos",
        F.lit(1).cast("bigint").alias("stripped"),
        F.lower(text.strip(F.col("type"))).alias("kind"),
        F.coalesce("timestamp", empty).alias("timestamp"),
        F.coalesce("git_branch", empty).alias("git_branch"),
        F.coalesce("is_meta", F.lit(False)).alias("is_meta"),
        F.coalesce("summary", empty).alias("summary"),
        F.when(F.col("blocks_v").isNull(), F.col("content")).alias("said"),
        _block_texts(F.col("blocks_v")).alias("blocks"),
        F.coalesce("project_root", empty).alias("project_root"),
    )


def assemble(facts: DataFrame, scratch: Scratch | None = None, key: str = "session_id") -> DataFrame:
    """Turns and summaries of line facts; lines of any other kind only carry time and branch on.

    A boundary is an accepted user line or any summary line. A turn is a user
    text with the assistant texts up to the next boundary; it carries time and
    branch as known at that boundary's line (or at the end), each the last
    non-empty one of any line. Text before the first user line and between a
    summary and the next user line belongs to no turn. Turns whose text is
    under 20 characters fall away, summaries do not. Files of any length are
    spread over tasks, by way of ``scratch``. Of the texts of one turn no task
    passes on more than may stand before the cut. An empty input gives an empty
    result.
    """
    scratch = scratch or Scratch(facts.sparkSession, "turns")
    root = F.col("project_root") if "project_root" in facts.columns else F.lit("")
    user = (F.col("kind") == "user") & ~F.col("is_meta") & F.coalesce(text.strip(F.col("said")) != "", F.lit(False))
    summary = F.col("kind") == "summary"
    df = facts.select(
        F.col(key).alias("k"), "pos", "stripped", "path", "session_id", root.alias("project_root"),
        F.when(F.col("timestamp") != "", F.col("timestamp")).alias("t"),
        F.when(F.col("git_branch") != "", F.col("git_branch")).alias("b"),
        F.when(user, text.strip(F.col("said"))).alias("said"),
        F.when(F.coalesce(summary, F.lit(False)), F.col("summary")).alias("summary"),
        F.when(F.col("kind") == "assistant", F.col("blocks")).alias("blocks"),
    )
    df = ordered.chunked(df, scratch, "lines", "k", ["pos"])
    df = df.withColumn("boundary", F.when(F.col("said").isNotNull() | F.col("summary").isNotNull(), F.col("pos")))
    for value, out in (("t", "t_now"), ("b", "b_now"), ("boundary", "start")):
        df = ordered.carry_last(df, "k", ["pos"], value, out)
    bounds = df.where("boundary is not null").select("k", ordered.CHUNK, "pos", "stripped", "path", "session_id", "project_root", "said", "summary", "t_now", "b_now")
    now = F.struct(F.coalesce("t_now", F.lit("")).alias("t"), F.coalesce("b_now", F.lit("")).alias("b"))
    bounds = ordered.following(bounds, "k", ["pos"], now, "next")
    end = df.groupBy("k").agg(F.max_by(now, "pos").alias("end"))
    spoken = df.where("blocks is not null and start is not null and size(blocks) > 0").select("k", ordered.CHUNK, "start", "pos", F.substring(F.array_join("blocks", "\n\n"), 1, text.TURN_CHARS + 1).alias("said"))
    before = Window.partitionBy("k", ordered.CHUNK, "start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spoken = spoken.withColumn("_before", F.coalesce(F.sum(F.length("said")).over(before), F.lit(0))).where(F.col("_before") <= text.TURN_CHARS)
    spoken = spoken.groupBy("k", F.col("start").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "said"))).alias("s"))
    joined = bounds.join(end, "k").join(spoken, ["k", "pos"], "left")
    answer = F.array_join(F.transform("s", lambda x: x.said), "\n\n")
    is_turn = F.col("said").isNotNull()
    body = F.when(
        is_turn,
        text.cut(F.concat(F.lit("User: "), F.col("said"), F.when(F.coalesce(F.size("s"), F.lit(0)) > 0, F.concat(F.lit("\n\nAssistant: "), answer)).otherwise(""))),
    ).otherwise(F.concat(F.lit("Session Summary: "), F.col("summary")))
    at = F.when(is_turn, F.col("pos")).otherwise(F.col("pos") + F.col("stripped"))
    stamp = F.when(is_turn, F.coalesce("next", "end")).otherwise(now)
    out = joined.select("path", "session_id", "project_root", at.alias("turn_index"), body.alias("content"), stamp.alias("n"), F.when(is_turn, "turn").otherwise("summary").alias("chunk_type"))
    keep = F.when(F.col("chunk_type") == "turn", F.length(text.strip(F.col("content"))) >= text.LEAST_CHARS).otherwise(F.col("content") != "Session Summary: ")
    out = out.where(keep).withColumn("doc_id", ids.doc_id(F.col("session_id"), F.col("turn_index"), F.col("content")))
    return out.select(
        ids.numeric_id(F.col("doc_id")).alias("id"), "doc_id", "session_id", text.base_name(F.col("path")).alias("transcript_file"),
        "turn_index", F.col("n.t").alias("timestamp"), F.col("n.b").alias("git_branch"), "chunk_type", "project_root", "content",
    )
