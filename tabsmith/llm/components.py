"""Connected components by alternating large-star and small-star steps.

An edge points from a node down to a smaller one. Every step is one aggregate
and one join over the edge table, which is written to the shared folder after
each. No component, however large, is gathered in one task or on the driver: a
hub's edges are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsmith.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """(node, m): the smallest node that each node points at."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Point every neighbour above a node at the smallest of the node and its neighbours."""
    # Those above a node are never the smallest, so what it points at tells.
    return edges.join(_least(edges), F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    down = edges.join(_least(edges), F.col("u") == F.col("node"))
    down = down.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return down.filter("u != v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node either points at one other, once, or is only pointed at."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    return not nodes.agg(F.max((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0)))).first()[0]


def stars(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v) of every node u that is not the smallest, v, of its component.

    Loops, repeated edges and edges with a null end are ignored. No edges give
    no rows. Rounds go on until each node points at its root, at most about the
    square of the logarithm of the longest path. More edges can be added to
    stars and taken through again. `edges` is read twice, so it should be
    written already.
    """
    edges = edges.filter(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    while True:
        edges = materialise(_small(materialise(_large(edges), "large-stars")), "stars")
        if _done(edges):
            return edges


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    What is ignored is as in `stars`.
    """
    found = stars(edges, u, v)
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
