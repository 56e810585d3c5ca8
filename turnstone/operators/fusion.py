"""Merging ranked lists and re-ranking by recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion, candidates per engine and result, weight of recency.
RRF_K = 60
OVERFETCH = 3
RECENCY_WEIGHT = 0.3


def reciprocal_rank_fusion(vector: DataFrame, text: DataFrame, n: int | None, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Union of two ranked lists (``vector_rank``, ``text_rank``, from 1) by sum of 1/(k + rank).

    Payload columns come from the vector list where a key is in both. Ties go by
    vector rank, then text rank. With one list empty the other's order stays.
    A key found by text alone has distance 0. Lists are a few rows each (the
    candidates of one search), so their size does not follow the data.
    """
    payload = [c for c in vector.columns if c in text.columns and c not in (key, "distance", "vector_rank", "text_rank")]
    v = vector.select(key, "vector_rank", "distance", F.struct(*payload).alias("v"))
    t = text.select(key, "text_rank", F.struct(*payload).alias("t"))
    both = v.join(t, key, "full_outer")
    score = F.coalesce(1 / (F.lit(k) + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(k) + F.col("text_rank")), F.lit(0.0))
    out = both.select(
        key, *[F.coalesce(F.col(f"v.{c}"), F.col(f"t.{c}")).alias(c) for c in payload], F.coalesce("distance", F.lit(0.0)).alias("distance"),
        "vector_rank", "text_rank", score.alias("rrf_score"),
    )
    order = [F.col("rrf_score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("text_rank").asc_nulls_last()]
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return out.where(F.col("rank") <= n) if n else out


def recency_boost(ranked: DataFrame, weight: float = RECENCY_WEIGHT) -> DataFrame:
    """``ranked`` (distance, timestamp, rank) ordered anew by similarity times 1 + weight * recency.

    Recency is the percent rank of the time among non-empty times (equal times
    share the lowest), 0.5 for an empty time or if all times are equal. With
    fewer than two non-empty times the order stays. Adds ``recency``,
    ``boosted`` and replaces ``rank``.
    """
    timed = F.coalesce(F.col("timestamp"), F.lit("")) != ""
    everything = Window.partitionBy(F.lit(1))
    df = ranked.withColumns(
        {
            "_timed": timed,
            "_n": F.count_if(timed).over(everything),
            "_lo": F.min(F.when(timed, F.col("timestamp"))).over(everything),
            "_hi": F.max(F.when(timed, F.col("timestamp"))).over(everything),
        }
    )
    share = F.percent_rank().over(Window.partitionBy("_timed").orderBy("timestamp"))
    recency = F.when(~F.col("_timed") | (F.col("_lo") == F.col("_hi")), 0.5).otherwise(share)
    df = df.withColumn("recency", F.when(F.col("_n") >= 2, recency))
    df = df.withColumn("boosted", (1 - F.col("distance")) * (1 + F.lit(weight) * F.coalesce("recency", F.lit(0.0))))
    order = F.row_number().over(Window.orderBy(F.when(F.col("_n") >= 2, -F.col("boosted")), "rank"))
    return df.withColumn("rank", order).drop("_timed", "_n", "_lo", "_hi")
