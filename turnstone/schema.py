"""The one fact table, its defaults and the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("document", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("transcript_file", T.StringType()),
        T.StructField("turn_index", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("project_root", T.StringType()),
    ]
)
#: Defaults of missing values; missing is the empty string, never null.
DEFAULTS = {"session_id": "", "transcript_file": "", "turn_index": 0, "timestamp": "", "git_branch": "", "chunk_type": "turn", "project_root": ""}
#: Longest stored text, in characters.
STORED_CHARS = 65535


def with_defaults(df: DataFrame) -> DataFrame:
    """Null metadata becomes its default, missing metadata columns are added."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()})


def canonical(turns: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """The test table ``turn`` as turns: defaults filled, one row per doc_id (null doc_id: per id).

    Of rows with one doc_id the one of least id stays. Only ``columns`` (all of
    the table if none are named) are read and moved. ``where``, a condition on
    columns as stored, reaches the scan: the rows it leaves are joined with the
    least ids, for which doc_id and id are read alone. Columns that are not part
    of the table are left out, so their names cannot clash.
    """
    cols = [c for c in dict.fromkeys(["id", "doc_id", *(columns or ["content", *DEFAULTS])]) if c in turns.columns]
    key = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("id")).alias("_own")]
    if where is None:
        one = turns.select(*cols).groupBy(*key).agg(F.min_by(F.struct(*cols), "id").alias("r")).select("r.*")
    else:
        least = turns.groupBy(*key).agg(F.min("id").alias("_least")).select(F.col("doc_id").alias("_doc_id"), "_least")
        own = turns.where(where).select(*cols)
        one = own.join(least, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("id") == F.col("_least")), "left_semi").dropDuplicates(["id", "doc_id"])
    named = {c: v for c, v in DEFAULTS.items() if not columns or c in columns}
    one = one.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in one.columns else F.lit(v) for c, v in named.items()})
    return one.withColumn("content", F.coalesce("content", F.lit(""))) if "content" in one.columns else one
