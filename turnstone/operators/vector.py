"""Embedding and exhaustive nearest-neighbour search by cosine distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.fts import fold


@dataclass(frozen=True)
class Model:
    name: str
    dimension: int
    max_tokens: int
    query_prefix: str
    document_prefix: str
    encode: Callable[[list[str], int], np.ndarray]


def _hashed(texts: list[str], dimension: int) -> np.ndarray:
    """Feature hashing of words and word pairs, unit length; no semantics, but deterministic and offline."""
    features: dict[str, int] = {}
    rows, places = [], []
    for i, t in enumerate(texts):
        words = fold(t)
        for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            rows.append(i)
            places.append(features.setdefault(f, len(features)))
    out = np.zeros((len(texts), dimension), np.float32)
    if rows:
        h = np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))[np.array(places)]
        np.add.at(out, (np.array(rows), (h % np.uint64(dimension)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32))
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
    return out


MODELS: dict[str, Model] = {"hash-768": Model("hash-768", 768, 8192, "search_query: ", "search_document: ", _hashed)}
DEFAULT_MODEL = "hash-768"


def register_model(model: Model) -> None:
    MODELS[model.name] = model


def embed_texts(texts: list[str], is_query: bool = False, model: str = DEFAULT_MODEL) -> np.ndarray:
    m = MODELS[model]
    prefix = m.query_prefix if is_query else m.document_prefix
    return m.encode([prefix + " ".join(t.split(" ")[: m.max_tokens]) for t in texts], m.dimension)


def embed(c: Column | str, model: str = DEFAULT_MODEL) -> Column:
    """Embedding of a text column; the model is loaded once per Python worker, batches come by Arrow."""
    m = MODELS[model]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        MODELS.setdefault(m.name, m)
        for batch in batches:
            yield pd.Series(list(embed_texts(batch.fillna("").tolist(), model=m.name)))

    return run(c)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null if a vector is null, of another length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.lit(1.0) - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def nearest(rows: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k nearest rows to one query vector with ``distance`` ascending; ties go by id.

    The vector is a literal of the plan, so the scan keeps a top k per task and
    merges them. Rows with a null or zero vector are no neighbours.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    out = rows.withColumn("distance", cosine_distance(F.col(vector_col), q)).where("distance is not null")
    return out.orderBy("distance", id_col).limit(k)


#: Bytes of query vectors that one scan of the rows serves, and queries multiplied at a time.
PASS_BYTES, BLOCK = 256 << 20, 2048


def nearest_to_all(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows to every query row, itself excluded.

    One scan of the rows serves all queries of a pass, whose vectors are sent to
    the tasks in single precision: ``pass_bytes`` bound what is sent, and more
    queries take more passes (about 87,000 of 768 dimensions each). A task
    multiplies its batches with blocks of queries and keeps k candidates per
    query, so what is shuffled is k rows per query and task. Null and zero
    vectors are neither queries nor neighbours.
    """
    named = queries.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    facts = named.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("d")).first()
    passes = max(1, -(-facts.n * (facts.d or 1) * 4 // pass_bytes))
    kind = rows.schema[id_col].dataType.simpleString()
    clean = rows.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    parts: list[DataFrame] = []
    for b in range(passes):
        own = (named.where(F.pmod(F.xxhash64(id_col), F.lit(passes)) == b) if passes > 1 else named).toArrow()
        if not own.num_rows:
            continue
        m = np.asarray(own.column(1).combine_chunks().flatten(), np.float32).reshape(own.num_rows, -1)
        shared = rows.sparkSession.sparkContext.broadcast((own.column(0).to_numpy(), m))  # at most pass_bytes and the ids

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best_d, best_i = [np.zeros((0, 0))] * -(-len(ids) // BLOCK), [np.zeros((0, 0), ids.dtype)] * -(-len(ids) // BLOCK)
            unit = [u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300) for u in (m[lo : lo + BLOCK].astype(np.float64) for lo in range(0, len(ids), BLOCK))] if len(ids) <= 8 * BLOCK else None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1)
                x = (x / np.maximum(norm, 1e-300)[:, None]).T
                name = batch.column(0).to_numpy(zero_copy_only=False)
                for g, lo in enumerate(range(0, len(ids), BLOCK)):
                    own = ids[lo : lo + BLOCK]
                    if unit:
                        u = unit[g]
                    else:
                        u = m[lo : lo + BLOCK].astype(np.float64)
                        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
                    d = np.round(1 - u @ x, 12)
                    d[:, norm == 0] = np.inf
                    d[own[:, None] == name[None, :]] = np.inf
                    i = np.broadcast_to(name, d.shape)
                    if best_d[g].size:
                        d, i = np.hstack([best_d[g], d]), np.hstack([best_i[g], i])
                    if d.shape[1] > k:  # what may be among the k best, ties included, then these in order
                        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                        width = int((d <= edge).sum(1).max())
                        some = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                        d, i = np.take_along_axis(d, some, 1), np.take_along_axis(i, some, 1)
                        order = np.lexsort((i, d), axis=1)[:, :k]
                        d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                    best_d[g], best_i[g] = d, i
            for g, lo in enumerate(range(0, len(ids), BLOCK)):
                own, d, i = ids[lo : lo + BLOCK], best_d[g], best_i[g]
                if d.size:
                    zero = np.linalg.norm(m[lo : lo + BLOCK], axis=1) == 0
                    ok = np.isfinite(d) & ~zero[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, d.shape[1])[ok.ravel()]), pa.array(i[ok]), pa.array(d[ok])], names=["query_id", id_col, "distance"])

        parts.append(clean.mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, distance double"))
    schema = f"query_id {kind}, `{id_col}` {kind}, distance double"
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
