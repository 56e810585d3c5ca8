"""Statistics, session lists, filters and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(session_id: str | None = None, git_branch: str | None = None, project_root: str | None = None) -> Column:
    """Conjunction of the filters given; an empty or missing value filters nothing. Values are literals, never text of a query."""
    out = F.lit(True)
    for name, value in (("session_id", session_id), ("git_branch", git_branch), ("project_root", project_root)):
        if value:
            out = out & (F.col(name) == F.lit(value))
    return out


def scope(project_root: str | None, current: str | None) -> str | None:
    """Project a search is confined to: the current one if none is named, all for ``*``."""
    return None if project_root == "*" else (project_root or current)


def older_than(cutoff: str) -> Column:
    """Non-empty times before the cutoff, compared as strings."""
    return (F.col("timestamp") < cutoff) & (F.col("timestamp") != "")


def _set(name: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(name) != "", F.col(name))))


def stats(turns: DataFrame) -> DataFrame:
    """One row: total_turns, sessions, branches (sorted, non-empty), by_type (counts). Zero and empty for an empty table."""
    by_type = turns.groupBy(F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"))
    kinds = by_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type")).withColumn("one", F.lit(1))
    totals = turns.agg(
        F.count("*").alias("total_turns"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"), _set("git_branch").alias("branches")
    ).withColumn("one", F.lit(1))
    return totals.join(kinds, "one").drop("one")


def sessions(turns: DataFrame) -> DataFrame:
    """Per session: turns, branches, first and last non-empty time (else empty); latest first, then by session."""
    own = turns.where(F.col("session_id") != "")
    time = F.when(F.col("timestamp") != "", F.col("timestamp"))
    return own.groupBy("session_id").agg(
        F.count("*").alias("turns"), _set("git_branch").alias("branches"), F.coalesce(F.min(time), F.lit("")).alias("min_ts"), F.coalesce(F.max(time), F.lit("")).alias("max_ts")
    )


def stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, size) whose committed offset (0 if there is none) is below their size."""
    known = state.select("path", "offset")
    return files.join(known, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0))).where(F.col("offset") < F.col("size"))


def merge_states(current: DataFrame, older: DataFrame) -> DataFrame:
    """State of ``current`` and, for paths it lacks, of ``older``."""
    return current.unionByName(older.join(current.select("path"), "path", "left_anti"))


def with_project(df: DataFrame, slugs: DataFrame, slug_col: str = "slug") -> DataFrame:
    """Adds ``project_root`` by slug, empty if unknown; of several roots with one slug the last in order counts."""
    one = slugs.groupBy("slug").agg(F.max("project_root").alias("project_root")).withColumnRenamed("slug", slug_col)
    return df.join(one, slug_col, "left").withColumn("project_root", F.coalesce("project_root", F.lit("")))
