"""Connected components by alternating large-star and small-star rounds.

A round joins the edges of a node to the least node among its neighbours; joins and
least nodes are DataFrame operations, so neither a component nor a node's list of
neighbours is ever gathered anywhere.  Least nodes are combined on the map side and
written before they are joined: the edges of a node that very many have then meet
a table of known size, which Spark sends to them or splits them for.  Each round is
written to the shared folder, and the one before it removed.  Rounds go on until one
changes nothing; every round but the last lowers some node's neighbour, so they end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) of one direction -> u, the least of u and its neighbours."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = _least(both)
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges with v < u: each lower neighbour, and u, to the least of them."""
    least = _least(edges)
    lower = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v"), least


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any one ordered type -> (node, component): the least node that it
    is connected to.  Nodes without an edge to another one are not in the result; nulls
    and loops are left out; repeated edges count once."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, sign = written(now, "edges"), None
    while True:
        large, least = _large_star(now)
        wide = written(large, "edges")
        small, lower = _small_star(wide)
        new = written(small.distinct(), "edges")
        discard(now, wide, least, lower)
        now = new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == mark:
            break
        sign = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
