"""Ordered scans over groups of any size.

A window over a whole group puts it into one task. Here a group is cut into
chunks by range partitioning on its order, windows run inside chunks, and what
crosses from one chunk to the next is carried by a table with one row per group
and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.session import Scratch

CHUNK = "_chunk"


def chunked(df: DataFrame, scratch: Scratch, name: str, key: str, order: list[str]) -> DataFrame:
    """``df`` with its range-partition number in ``_chunk``, written out.

    Rows of one key are in ascending chunks by ``order``; rows equal in key and
    order share a chunk. A key may span any number of chunks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, key, *order).withColumn(CHUNK, F.spark_partition_id())
    return scratch.save(cut, name)


def carry_last(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the row or those before it, null if there is none."""
    inside = Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tails = df.groupBy(key, CHUNK).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.withColumn("_head", F.last("_tail", ignorenulls=True).over(before)).where("_head is not null").drop("_tail")
    own = df.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    return own.join(heads, [key, CHUNK], "left").withColumn(out, F.coalesce(out, "_head")).drop("_head")


def previous(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: ``value`` (never null) of the row right before, null for a key's first row."""
    inside = Window.partitionBy(key, CHUNK).orderBy(*order)
    own = df.withColumn("_value", value)
    tails = own.groupBy(key, CHUNK).agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(key).orderBy(CHUNK)
    heads = tails.withColumn("_head", F.lag("_tail").over(across)).where("_head is not null").drop("_tail")
    own = own.withColumn(out, F.lag("_value").over(inside)).drop("_value")
    return own.join(heads, [key, CHUNK], "left").withColumn(out, F.coalesce(out, "_head")).drop("_head")


def following(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: ``value`` (never null) of the row right after, null for a key's last row."""
    inside = Window.partitionBy(key, CHUNK).orderBy(*order)
    own = df.withColumn("_value", value)
    heads = own.groupBy(key, CHUNK).agg(F.min_by("_value", F.struct(*order)).alias("_head"))
    across = Window.partitionBy(key).orderBy(CHUNK)
    tails = heads.withColumn("_tail", F.lead("_head").over(across)).where("_tail is not null").drop("_head")
    own = own.withColumn(out, F.lead("_value").over(inside)).drop("_value")
    return own.join(tails, [key, CHUNK], "left").withColumn(out, F.coalesce(out, "_tail")).drop("_tail")
