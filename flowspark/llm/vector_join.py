"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label and length are compared with each other. Equal vectors form a class with its
number of rows, and classes are turned by the principal axes of all unit vectors, which changes no
cosine. In the order of the first axis they are cut into tiles of bounded size; two tiles meet only
when their intervals on that axis are near enough for any cosine to reach the threshold. A pair of
tiles is compared block by block of axes, from the largest variance on: what is left of a product is
bounded by the norms of the rest, and pairs that cannot reach the threshold any more go. Pairs that
stay are decided by the cosine of the original vectors in double precision.

A pair of tiles returns for every class the number of rows it links with, and as links a spanning
forest of what it found; so what is returned grows with the classes and not with the links.

Defined cases: a vector that is null, empty or zero, or holds a null or a non-finite component, links
with nothing, as do vectors without label; vectors of one label but different lengths do not link.
Repeated rows are vectors of their own and link with each other. A null vec_id stays null and is taken
as component only if all ids of the component are null. Other columns are ignored; an empty table
gives no rows.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.llm.components import connected_components
from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices
from flowspark.session import materialise

LEAST_COSINE = 0.93
#: Classes in a tile, about.
TILE = 1024
#: Cells the first axis is counted in.
_CELLS = 4096
#: Axes that are added between two checks.
_BLOCK = 8
#: Rounding allowed for in the turned vectors, far above that of double precision.
_SLACK = 1e-9


def _read(vectors):
    """(vec_id, label, dim, class_id, vec) of every row; the last three are null where it cannot link.

    vec holds little-endian doubles, very large and very small vectors brought to size; class_id is equal
    for equal labels and vectors.
    """

    def usable(label, v):
        if label is None or not v or any(x is None for x in v):
            return None
        x = np.array(v, dtype="<f8")
        largest = np.abs(x).max()
        if not np.isfinite(largest) or largest == 0:
            return None
        # squares of very large or small components leave the range of doubles; a power of two changes no cosine
        return x if 1e-100 < largest < 1e100 else np.ldexp(x, -int(np.frexp(largest)[1])).astype("<f8")

    def read(batches):
        for batch in slices(batches):
            found = [usable(*row) for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            values = [None if x is None else x.tobytes() for x in found]
            keys = [None if v is None else hashlib.blake2b(repr(label).encode() + b"/" + v, digest_size=16).digest()
                    for label, v in zip(batch.column(1).to_pylist(), values)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([None if x is None else len(x) for x in found], pa.int32()),
                 pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                names=["vec_id", "label", "dim", "class_id", "vec"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(read, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, class_id binary, vec binary")


def _unit(vec, dim):
    rows = np.frombuffer(b"".join(vec), dtype="<f8").reshape(-1, dim)
    return rows, rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(batch, names):
    """The rows of a batch as (dim, row numbers, vectors)."""
    dims = np.array(batch.column(names.index("dim")))
    vecs = batch.column(names.index("vec")).to_pylist()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, [vecs[i] for i in rows]


def principal_axes(classes):
    """For every vector length the axes of all unit vectors, largest second moment first."""

    def moments(batches):
        sums = {}
        for batch in slices(batches):
            for dim, _, vecs in _by_length(batch, ["dim", "vec"]):
                _, unit = _unit(vecs, dim)
                sums[dim] = sums.get(dim, 0) + unit.T @ unit
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(total))],
                names=["dim", "i", "moments"])

    rows = classes.select("dim", "vec").mapInArrow(moments, "dim int, i int, moments array<double>")
    cells = rows.select("dim", "i", F.posexplode("moments").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    sums = {}
    for row in cells.toLocalIterator():
        sums.setdefault(row["dim"], np.zeros((row["dim"], row["dim"])))[row["i"], row["j"]] = row["x"]
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in sums.items()}


def _tiles(classes, axes, tile):
    """classes with their place on the first axis and their tile."""
    sent = classes.sparkSession.sparkContext.broadcast({d: a[:, 0].copy() for d, a in axes.items()})

    def place(batches):
        for batch in slices(batches):
            first = np.empty(batch.num_rows)
            for dim, rows, vecs in _by_length(batch, names):
                first[rows] = _unit(vecs, dim)[1] @ sent.value[dim]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*names, "place"])

    names = ["label", "dim", "class_id", "vec", "n"]
    kind = dict(classes.dtypes)["label"]
    placed = classes.select(*names).mapInArrow(place, f"label {kind}, dim int, class_id binary, vec binary, n long, place double")
    placed = placed.withColumn("cell", F.floor((F.col("place") + 1) * (_CELLS / 2)).cast("int"))
    placed = materialise(placed, "placed")
    before = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("held"))
    cells = cells.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # a full cell is spread over as many tiles as it needs, by a hash of its members
    spread = F.pmod(F.xxhash64("class_id"), F.col("held"))
    return placed.join(cells, ["label", "dim", "cell"]).select(
        *names, "place", F.floor((F.col("before") + spread) / F.lit(tile)).cast("long").alias("tile"))


def _tile_pairs(tiled, least):
    """Pairs of tiles (low, high) of one label and length whose intervals are near enough."""
    spans = tiled.groupBy("label", "dim", "tile").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    spans = materialise(spans, "spans")
    reach = math.sqrt(2 - 2 * least) + _SLACK  # how far apart two unit vectors with this cosine can be
    a = spans.select("label", "dim", F.col("tile").alias("low"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = spans.select("label", "dim", F.col("tile").alias("high"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    near = (F.col("b_lo") - F.col("a_hi") <= reach) & (F.col("a_lo") - F.col("b_hi") <= reach)
    return materialise(a.join(b, ["label", "dim"]).where((F.col("low") <= F.col("high")) & near).select("label", "dim", "low", "high"), "tile_pairs")


def survivors(a, b, least, block=_BLOCK):
    """Index pairs of turned unit rows whose cosine may reach `least`, by adding blocks of axes."""
    dim = a.shape[1]
    rest_a = np.sqrt(np.maximum(0, np.cumsum((a ** 2)[:, ::-1], axis=1)[:, ::-1]))
    rest_b = np.sqrt(np.maximum(0, np.cumsum((b ** 2)[:, ::-1], axis=1)[:, ::-1]))
    stop = min(block, dim)
    dots = a[:, :stop] @ b[:, :stop].T
    reach = dots + np.outer(rest_a[:, stop], rest_b[:, stop]) if stop < dim else dots
    i, j = np.nonzero(reach >= least - _SLACK)
    part = dots[i, j]
    while stop < dim and len(i):
        start, stop = stop, min(stop + block, dim)
        part = part + np.einsum("ij,ij->i", a[i, start:stop], b[j, start:stop])
        bound = part + rest_a[i, stop] * rest_b[j, stop] if stop < dim else part
        stay = bound >= least - _SLACK
        i, j, part = i[stay], j[stay], part[stay]
    return i, j


def _forest(n, i, j):
    """For every node of a graph the least node of its component."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        np.minimum.at(least, before[i], low)
        np.minimum.at(least, before[j], low)
        least = least[least]
        if (least == before).all():
            break
    return least


def _compare(axes, least):
    def compare(key, table):
        dim, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        tiles, counts = table["tile"].to_numpy(), table["n"].to_numpy()
        ids, vecs = table["class_id"].to_pylist(), table["vec"].to_pylist()
        rows, unit = _unit(vecs, dim)
        norms = np.linalg.norm(rows, axis=1)
        turned = unit @ axes.value[dim]
        left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        links, edges_i, edges_j = np.zeros(len(ids), dtype=np.int64), [], []
        for at in range(0, len(left), 256):
            i, j = survivors(turned[left[at:at + 256]], turned[right], least)
            i, j = left[at + i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                linked = np.einsum("ij,ij->i", rows[p], rows[q]) / (norms[p] * norms[q]) >= least
                p, q = p[linked], q[linked]
                np.add.at(links, p, counts[q])
                np.add.at(links, q, counts[p])
                edges_i.append(p)
                edges_j.append(q)
        none = np.zeros(0, dtype=np.int64)
        root = _forest(len(ids), np.concatenate(edges_i or [none]), np.concatenate(edges_j or [none]))
        seen = np.flatnonzero(links)
        return pa.table({"class_id": pa.array([ids[s] for s in seen], pa.binary()), "links": pa.array(links[seen]),
                         "root": pa.array([ids[root[s]] for s in seen], pa.binary())})

    return compare


def near_vectors(vectors, least=LEAST_COSINE, tile=TILE):
    """Per row: vec_id, n_links, component_id, kept."""
    plain = columns_of(vectors, "vec_id", "label", "embedding")
    rows = materialise(_read(plain.select("vec_id", "label", "embedding")), "vectors")
    valid, alone = rows.where("class_id is not null"), rows.where("class_id is null")
    classes = materialise(valid.groupBy("class_id").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id")), "classes")
    axes = principal_axes(classes)
    tiled = materialise(_tiles(classes, axes, tile), "tiled")
    pairs = _tile_pairs(tiled, least)
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"))
    dealt = tiled.select("label", "dim", "tile", "class_id", "vec", "n").join(sides, ["label", "dim", "tile"])
    sent = vectors.sparkSession.sparkContext.broadcast(axes)
    found = dealt.groupBy("label", "dim", "low", "high").applyInArrow(
        _compare(sent, least), "class_id binary, links long, root binary")
    found = materialise(found, "found")
    parts = connected_components(found.where("class_id <> root"), "class_id", "root")
    totals = found.groupBy(F.col("class_id").alias("linked")).agg(F.sum("links").alias("links"))
    named = classes.select("class_id", "n", "least_id").join(totals, F.col("class_id") == F.col("linked"), "left").join(
        parts, F.col("class_id") == F.col("node"), "left").select(
        "class_id", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "class_id").alias("part"))
    ids = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    by_class = named.join(ids, "part").select("class_id", "n_links", "component_id")
    linked = valid.select("vec_id", "class_id").join(by_class, "class_id").select("vec_id", "n_links", "component_id")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", "n_links", "component_id", kept.alias("kept"))


SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT r, vec_id, label, x, sqrt(list_dot_product(x, x)) AS size FROM v
       WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
         AND list_dot_product(x, x) > 0),
e AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= {LEAST_COSINE}),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
w AS (SELECT r AS a, r AS b FROM v UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
c AS (SELECT w.a, min(v.vec_id) AS component_id FROM w JOIN v ON w.b = v.r GROUP BY w.a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.r = c.a LEFT JOIN n ON v.r = n.a
"""
