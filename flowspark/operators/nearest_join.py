"""Exact k nearest rows by cosine distance between two tables of any size.

Distinct vectors are compared: of the index rows that share a vector only the k with the smallest ids can
be among anybody's nearest. Index vectors lie in cells: the nearest of a few pivots, and a ring of the angle
to it. For a query the angles to the pivots bound its angle to every row of a cell from below. A first
round compares it with the cells nearest by that bound that hold k rows, which gives a distance that the
k-th neighbour cannot exceed; a second round with every other cell whose bound does not exceed it. Cells
are cut into blocks of bounded size on both sides, and a block meets a block in one task. There products in
single precision, with room for their error, leave out the rows beyond a query's limit; distances of the
others are taken in double precision.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import materialise

DIGITS = 9
PIVOTS, RINGS = 64, 16
#: Rows of a block: at least the first, and while a table has fewer blocks than SIDE_BLOCKS no more; numbers in its vectors.
BLOCK_ROWS, SIDE_BLOCKS, BLOCK_NUMBERS = 4096, 16, 1 << 21
#: Queries and rows that are compared at once, and pairs whose distances are taken at once.
TILE_QUERIES, TILE_ROWS, TILE_PAIRS = 256, 8192, 1 << 16
#: Slack for rounded distances and for angles of nearly equal vectors.
_SLACK = 4e-9


def unit(matrix):
    """Rows of length 1; rows that cannot be scaled are zero, which is at distance 1 from all."""
    with np.errstate(all="ignore"):
        largest = np.abs(matrix).max(axis=1, keepdims=True, initial=0.0)
        scaled = np.divide(matrix, largest, out=np.zeros_like(matrix), where=np.isfinite(largest) & (largest > 0))
        norm = np.linalg.norm(scaled, axis=1, keepdims=True)
        return np.divide(scaled, norm, out=np.zeros_like(scaled), where=norm > 0)


def _matrix(column, width):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if len(column) else np.zeros((0, width))


def _distances(a, b):
    """Distances of the rows of a from those of b at the same places."""
    return np.round(1.0 - np.einsum("ij,ij->i", a, b), DIGITS)


def _near_pairs(asking, vectors, product, floor):
    """(place of the query, place of the row, distance) of the pairs whose product is at least the query's floor."""
    row, col = np.nonzero(product >= floor[:, None])
    far = np.empty(len(row))
    for i in range(0, len(row), TILE_PAIRS):
        far[i:i + TILE_PAIRS] = _distances(asking[row[i:i + TILE_PAIRS]], vectors[col[i:i + TILE_PAIRS]])
    return row, col, far


def _cut(row, col, far, k):
    """The k nearest of every query, ties by place."""
    order = np.lexsort((col, far, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[order][rank < k], far[order][rank < k]


def _nearest_rows(asking, vectors, limits, k):
    """(place of the query, place of the row, distance): of the rows within each query's limit the k nearest, ties by place.

    All vectors have length 1 or are zero. A query's limit falls to the k-th distance found so far.
    """
    narrow = vectors.astype(np.float32)
    # the error of a product of two such vectors in single precision, and rounded distances
    slack = (vectors.shape[1] + 4) * 2.0 ** -23 + _SLACK
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for i in range(0, len(asking), TILE_QUERIES):
        some = asking[i:i + TILE_QUERIES]
        few, limit = some.astype(np.float32), limits[i:i + TILE_QUERIES].copy()
        best = found[0]
        for j in range(0, len(vectors), TILE_ROWS):
            product = few @ narrow[j:j + TILE_ROWS].T
            floor = 1.0 - limit - slack
            open_ = np.flatnonzero(limit >= 2.0)
            if len(open_) and product.shape[1] > k:
                # k rows of this tile are at least as near as the k-th product says
                floor[open_] = np.partition(product[open_], -k, axis=1)[:, -k] - 2 * slack
            row, col, far = _near_pairs(some, vectors[j:j + TILE_ROWS], product, floor.astype(np.float32))
            near = far <= limit[row]
            best = _cut(*(np.concatenate(x) for x in zip(best, (row[near], col[near] + j, far[near]))), k)
            full = np.bincount(best[0], minlength=len(limit)) >= k
            last = np.searchsorted(best[0], np.flatnonzero(full), "right") - 1
            limit[full] = np.minimum(limit[full], best[2][last])
        found.append((best[0] + i, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cells(vectors, pivots, rings):
    """Cell number and angle to its pivot; zero vectors have a cell of their own at the end."""
    zero = ~vectors.any(axis=1)
    cosine = np.clip(vectors @ pivots.T, -1.0, 1.0)
    nearest = cosine.argmax(axis=1)
    angle = np.arccos(cosine[np.arange(len(vectors)), nearest])
    ring = np.minimum((angle / np.pi * 2 * rings).astype(np.int64), rings - 1)
    return np.where(zero, len(pivots) * rings, nearest * rings + ring), np.where(zero, 0.0, angle)


def _least_distance(queries, pivots, cells, rings):
    """For queries and cells (numbers, least and largest angle): no row of the cell is nearer than this."""
    number, low, high = cells
    pivot = np.minimum(number // rings, len(pivots) - 1)
    to_pivot = np.arccos(np.clip(queries @ pivots.T, -1.0, 1.0))[:, pivot]
    angle = np.maximum(np.maximum(to_pivot - high, low - to_pivot) - 1e-7, 0.0)
    bound = 1.0 - np.cos(angle)
    bound[:, number == len(pivots) * rings] = 1.0
    bound[~queries.any(axis=1)] = 1.0
    return bound


def _typed(df, id_column, vector_column):
    return df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("v IS NOT NULL")


def nearest_join(queries: DataFrame, index: DataFrame, k, query_id="query_id", query_vector="embedding", index_id="id",
                 index_vector="embedding", where=None, pivots=PIVOTS, block_rows=None) -> DataFrame:
    """(query_id, id, distance, rank from 1): the k nearest index rows of every query, ties by id.

    All vectors have one length. Rows without a vector are no queries and no neighbours; a vector of
    zeros is at distance 1 from all. A query id that occurs more than once has its rows each time.
    block_rows bounds the rows of a block on either side; it follows from the table where it is not given.
    """
    spark = index.sparkSession
    if where is not None:
        index = index.filter(where)
    asked = materialise(_typed(queries, query_id, query_vector), "nearest-queries")
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = materialise(_typed(index, index_id, index_vector).withColumn("n", smallest).where(F.col("n") <= k).drop("n"), "nearest-index")
    kinds = {"query": asked.schema["id"].dataType.simpleString(), "index": kept.schema["id"].dataType.simpleString()}
    result = f"query_id {kinds['query']}, id {kinds['index']}, distance double, rank int"
    n_rows, first_row = kept.count(), kept.select("v").head()
    if first_row is None:
        return spark.createDataFrame([], result)
    if block_rows is None:
        # every row goes to a block of each block of the other side: few blocks for large tables
        most = BLOCK_NUMBERS // max(1, len(first_row["v"]))
        block_rows = max(1, min(most, max(BLOCK_ROWS, -(-n_rows // SIDE_BLOCKS))))
    # as many cells as blocks, up to the limits
    blocks = -(-n_rows // block_rows)
    sample = kept.orderBy(F.xxhash64("v")).limit(max(1, min(pivots, blocks))).select("v").collect()
    centre = unit(np.array([r["v"] for r in sample], dtype=float))
    centre = centre[centre.any(axis=1)] if centre.any() else centre[:1]
    width, rings = centre.shape[1], max(1, min(RINGS, blocks // len(centre)))

    def place(batches):
        for batch in batches:
            cell, angle = _cells(unit(_matrix(batch.column(1), width)), centre, rings)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "v", "cell", "angle"])

    placed = materialise(kept.mapInArrow(place, f"id {kinds['index']}, v array<double>, cell long, angle double"), "nearest-placed")
    # at most a row for each pivot and ring
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell").collect()
    held = np.array([r["n"] for r in stats])
    bounds = tuple(np.array([r[c] for r in stats]) for c in ("cell", "low", "high"))
    parts = F.expr(f"map({', '.join(f'{r.cell}L, {-(-r.n // block_rows)}' for r in stats)})")
    rows = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell"))).cast("int").alias("part"))

    distinct = materialise(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "nearest-distinct")

    def first_cells(batches):
        """The cells of the least bounds that hold k rows together."""
        for batch in batches:
            least = _least_distance(unit(_matrix(batch.column(1), width)), centre, bounds, rings)
            order = np.argsort(least, axis=1, kind="stable")
            enough = np.cumsum(held[order], axis=1) - held[order] < k
            row, place_ = np.nonzero(enough)
            yield _wanted(batch, row, bounds[0][order[row, place_]], np.full(batch.num_rows, 2.0))

    def other_cells(batches):
        """Every cell that may hold a nearer row, those of the first round left out."""
        for batch in batches:
            least = _least_distance(unit(_matrix(batch.column(1), width)), centre, bounds, rings)
            order = np.argsort(least, axis=1, kind="stable")
            seen = np.zeros(least.shape, dtype=bool)
            np.put_along_axis(seen, order, np.cumsum(held[order], axis=1) - held[order] < k, axis=1)
            limit = batch.column(2).to_numpy(zero_copy_only=False)
            row, cell = np.nonzero((least <= limit[:, None] + _SLACK) & ~seen)
            yield _wanted(batch, row, bounds[0][cell], limit)

    def _wanted(batch, row, cell, limit):
        """A row for each query: the cells that it goes to, which are told apart when the blocks meet."""
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(limit), cells], names=["q", "v", "limit", "cells"])

    def compare(left, right):
        """The k nearest of a block's rows within the limits of a block of queries."""
        names, vectors = right.column("id"), unit(_matrix(right.column("v").combine_chunks(), width))
        number = names.to_numpy() if pa.types.is_integer(names.type) else None
        by_id = np.argsort(number if number is not None else np.array(names.to_pylist(), dtype=object), kind="stable")
        names = names.take(pa.array(by_id))
        asking = unit(_matrix(left.column("v").combine_chunks(), width))
        row, at, far = _nearest_rows(asking, vectors[by_id], left.column("limit").to_numpy(), k)
        return pa.table([left.column("q").take(pa.array(row)), names.take(pa.array(at)), pa.array(far)],
                        names=["q", "id", "distance"])

    def found(wanted):
        """Blocks of queries against blocks of rows; both keep to block_rows."""
        wanted = wanted.withColumn("cell", F.explode("cells")).drop("cells")
        per_cell = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("sides")).collect()
        if not per_cell:
            return spark.createDataFrame([], f"q long, id {kinds['index']}, distance double")
        sides = F.expr(f"map({', '.join(f'{r.cell}L, {r.sides}' for r in per_cell)})")
        every = F.sequence(F.lit(0), F.element_at(parts, F.col("cell")) - 1)
        left = wanted.withColumn("side", F.pmod(F.xxhash64("q"), F.element_at(sides, F.col("cell"))).cast("int")).withColumn("part", F.explode(every))
        met = rows.withColumn("side", F.explode(F.sequence(F.lit(0), F.try_element_at(sides, F.col("cell")) - 1)))
        block = ["cell", "part", "side"]
        return left.groupBy(*block).cogroup(met.groupBy(*block)).applyInArrow(
            lambda a, b: compare(a, b), f"q long, id {kinds['index']}, distance double")

    place_of = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))

    def best(candidates):
        return candidates.withColumn("rank", place_of).where(F.col("rank") <= k)

    asking = "q long, v array<double>, limit double, cells array<long>"
    near = materialise(distinct.select("q", "v").mapInArrow(first_cells, asking), "nearest-first")
    first = materialise(best(found(near)), "nearest-found")
    limits = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(2.0)).alias("limit"))
    open_ = distinct.join(limits, "q").select("q", "v", "limit")
    more = materialise(open_.mapInArrow(other_cells, asking), "nearest-more")
    ranked = best(first.drop("rank").unionByName(found(more)))
    named = asked.withColumnRenamed("id", "query_id").join(distinct, "v").select("query_id", "q")
    return named.join(ranked, "q").select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"))
