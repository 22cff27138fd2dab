"""Connected components of an edge table by alternating stars; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, keep

#: Edges of a file.
EDGES = 500_000


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``node``, ``label``: the smallest node of its component, for every node of an edge (u, v).

    Each round joins every node's neighbours with the smallest of them (large star), then does the same
    with the smaller neighbours alone (small star), until nothing changes: then each edge leads to its
    component's smallest node. Rounds grow with the logarithm of the longest path. The smallest
    neighbour is an aggregate, so a node with very many edges costs a split join, not a huge group.
    A round's tables lie in files of ``EDGES``, whatever the number of partitions; ``files``: the most of the first table.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = keep(edges if files is None else edges.coalesce(files), "edges")
    files = files_for(edges, EDGES)     # no round makes more edges
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = keep(large.coalesce(files), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
