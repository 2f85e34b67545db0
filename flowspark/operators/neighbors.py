"""Exact nearest vectors by cosine distance.

A side counted as small is sent to the tasks: `nearest` sends the index and works row by row without a
shuffle; `nearest_in_large` sends the queries and merges each partition's best k. Where that side is
larger, both go through the blocked join of two large sides.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.nearest_join import DIGITS, nearest_join, unit
from flowspark.session import materialise

MAX_SMALL_ROWS = 10_000
MAX_SMALL_CELLS = 32_000_000


def collect_small(df: DataFrame, id_column, vector_column):
    """(ids, row-normalised matrix) of a table proven small; None for a larger one."""
    vectors = df.select(id_column, F.col(vector_column).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    rows = vectors.limit(MAX_SMALL_ROWS + 1).collect()
    if len(rows) > MAX_SMALL_ROWS:
        return None
    if not rows:
        return np.empty(0, dtype=object), np.empty((0, 0))
    matrix = np.array([r["v"] for r in rows], dtype=float)
    if matrix.size > MAX_SMALL_CELLS:
        return None
    return np.array([r[id_column] for r in rows]), unit(matrix)


def nearest(queries: DataFrame, index: DataFrame, k, query_vector="embedding", index_id="id",
            index_vector="embedding", where=None, name="hits"):
    """Add `name`: array of (id, distance), the k nearest index rows, nearest first, ties by id.

    A query without a vector gets an empty array.

    where is a condition on the index that is applied before the search. k is cut to the index size.
    """
    if where is not None:
        index = index.filter(where)
    kind = index.schema[index_id].dataType.simpleString()
    small = collect_small(index, index_id, index_vector)
    if small is None:
        return _joined_hits(queries, index, k, query_vector, index_id, index_vector, name)
    ids, matrix = small
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    k = min(k, len(ids))

    @F.pandas_udf(f"array<struct<id:{kind},distance:double>>")
    def search(vectors: pd.Series) -> pd.Series:
        hits = [[] for _ in range(len(vectors))]
        present = np.flatnonzero(vectors.notna().to_numpy())
        if k == 0 or len(present) == 0:
            return pd.Series(hits)
        distance = _distances(np.stack(vectors.to_numpy()[present]).astype(float), matrix)
        best = np.argsort(distance, axis=1, kind="stable")[:, :k]
        for at, row, chosen in zip(present, distance, best):
            hits[at] = [
                {"id": ids[j].item() if hasattr(ids[j], "item") else ids[j], "distance": float(row[j])} for j in chosen
            ]
        return pd.Series(hits)

    return queries.withColumn(name, search(F.col(query_vector)))


def _joined_hits(queries, index, k, query_vector, index_id, index_vector, name):
    """What nearest gives, from the blocked join; a query is known by its row."""
    rows = materialise(queries.withColumn("_row", F.monotonically_increasing_id()), "nearest-asked")
    pairs = nearest_join(rows, index, k, "_row", query_vector, index_id, index_vector)
    # k hits a query
    hits = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("_hits"))
    plain = F.transform("_hits", lambda h: F.struct(h["id"].alias("id"), h["distance"].alias("distance")))
    joined = rows.join(hits, rows["_row"] == hits["query_id"], "left")
    kind = pairs.schema["id"].dataType.simpleString()
    return joined.withColumn(name, F.coalesce(plain, F.array().cast(f"array<struct<id:{kind},distance:double>>"))).select(*queries.columns, name)


def hit_rows(found: DataFrame, keep, name="hits"):
    """One row per hit: keep, rank (from 0), id, distance.

    The outer form of the generator is used on purpose: for the plain one Spark adds a size check on
    the array below it, which would run the search a second time.
    """
    rows = found.select(*keep, F.posexplode_outer(name).alias("rank", "_h")).filter("rank IS NOT NULL")
    return rows.select(*keep, "rank", F.col("_h.id").alias("id"), F.col("_h.distance").alias("distance"))


def nearest_in_large(index: DataFrame, queries: DataFrame, k, index_id="id", index_vector="embedding",
                     query_id="query_id", query_vector="embedding", where=None):
    """(query_id, id, distance, rank): the k nearest rows of a large index per query of a small table."""
    if where is not None:
        index = index.filter(where)
    small = collect_small(queries, query_id, query_vector)
    if small is None:
        return nearest_join(queries, index, k, query_id, query_vector, index_id, index_vector)
    query_ids, matrix = small
    query_kind = queries.schema[query_id].dataType.simpleString()
    id_kind = index.schema[index_id].dataType.simpleString()

    def partition_best(batches):
        best = None
        for pdf in batches:
            if not len(pdf) or not len(query_ids):
                continue
            distance = _distances(matrix, np.stack(pdf["v"].to_numpy()).astype(float))
            ids = np.broadcast_to(pdf["id"].to_numpy(), distance.shape)
            if best is not None:
                ids = np.concatenate([best[0], ids], axis=1)
                distance = np.concatenate([best[1], distance], axis=1)
            chosen = np.lexsort((ids, distance), axis=1)[:, :k]
            best = np.take_along_axis(ids, chosen, 1), np.take_along_axis(distance, chosen, 1)
        if best is not None:
            width = best[0].shape[1]
            yield pd.DataFrame({
                "query_id": np.repeat(query_ids, width), "id": best[0].ravel(), "distance": best[1].ravel(),
            })

    vectors = index.select(
        F.col(index_id).alias("id"), F.col(index_vector).alias("v")
    ).filter("v IS NOT NULL")
    found = vectors.mapInPandas(partition_best, f"query_id {query_kind}, id {id_kind}, distance double")
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _distances(rows, normalised):
    """Cosine distances of rows against normalised rows; a zero vector is at distance 1."""
    return np.round(1.0 - unit(rows) @ unit(normalised).T, DIGITS)
