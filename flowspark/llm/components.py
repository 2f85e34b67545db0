"""Connected components by alternating large and small stars, every round a written table."""

from pyspark.sql import functions as F

from flowspark.session import materialise, release


def _towards_minimum(pairs):
    """For (u, v): every v beside the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _round(edges):
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _towards_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    small = _towards_minimum(large)
    moved = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = small.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def _mark(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links, a, b):
    """A written table (node, component) of every node in a table of links; the component is its least node.

    Nodes may be of any type that sorts. Links from a node to itself and repeated links change
    nothing; no link gives an empty table. Each round halves the distance to the least node or
    better, so rounds grow with the logarithm of the longest chain.
    """
    u, v = F.col(a), F.col(b)
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        before, edges = edges, materialise(_round(edges), "edges")
        release(edges.sparkSession, before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = materialise(stars.unionByName(roots), "components")
    release(edges.sparkSession, edges)
    return found
