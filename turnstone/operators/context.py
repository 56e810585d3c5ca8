"""The turns around a position of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(turns: DataFrame, session_id: str, turn_index: int, context: int = 2) -> DataFrame:
    """``context`` turns on both sides of the turn nearest to ``turn_index``, clipped at the ends, in order.

    The nearest turn is that of least distance, the earlier one on ties. It is
    found by an aggregate; the rows before and after it are two top-k reads, so
    a session of any size is neither sorted nor gathered. An unknown session
    gives no rows.
    """
    own = turns.where(F.col("session_id") == session_id)
    near = F.min_by("turn_index", F.struct(F.abs(F.col("turn_index") - F.lit(turn_index)), "turn_index"))
    key = F.min_by("doc_id", F.struct(F.abs(F.col("turn_index") - F.lit(turn_index)), "turn_index", "doc_id"))
    found = own.agg(near.alias("_at"), key.alias("_key"))
    place = own.join(F.broadcast(found))  # one row
    order = F.struct("turn_index", "doc_id")
    target = F.struct(F.col("_at").alias("turn_index"), F.col("_key").alias("doc_id"))
    before = place.where(order < target).orderBy(F.desc("turn_index"), F.desc("doc_id")).limit(context)
    after = place.where(order >= target).orderBy("turn_index", "doc_id").limit(context + 1)
    return before.unionByName(after).drop("_at", "_key").orderBy("turn_index", "doc_id")


def around_all(turns: DataFrame, turn_index: int, context: int = 1) -> DataFrame:
    """``around`` for every session at once: adds ``position`` relative to the nearest turn.

    The nearest turn of each session is an aggregate that combines before the
    shuffle; of the rows on its two sides every task passes on ``context`` per
    session only, so a session with a third of all rows is nowhere gathered.
    """
    distance = F.abs(F.col("turn_index") - F.lit(turn_index))
    near = turns.groupBy("session_id").agg(F.min(F.struct(distance.alias("d"), "turn_index", "doc_id")).alias("_t"))
    near = near.select(F.col("session_id").alias("_session"), F.struct("_t.turn_index", "_t.doc_id").alias("_target"))
    placed = turns.join(near, F.col("session_id") == F.col("_session")).drop("_session")
    place = F.struct("turn_index", "doc_id")
    own = Window.partitionBy("session_id")
    back, on = F.row_number().over(own.orderBy(F.desc("turn_index"), F.desc("doc_id"))), F.row_number().over(own.orderBy("turn_index", "doc_id"))
    before = placed.where(place < F.col("_target")).withColumn("_n", back).where(F.col("_n") <= context).withColumn("position", -F.col("_n"))
    after = placed.where(place >= F.col("_target")).withColumn("_n", on).where(F.col("_n") <= context + 1).withColumn("position", F.col("_n") - 1)
    return before.unionByName(after).drop("_n", "_target")
