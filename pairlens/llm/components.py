"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum by node, pre-aggregated, and a join, which adaptive
execution splits where a node has very many links; no task ever holds a whole
component.  A table of at most ``FEW`` links is settled in the driver instead,
with the same result: steps over so few links cost only their tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import durable, forget, join_totals


#: Links that the driver takes at most: 16 bytes each, whatever the input.
FEW = 100_000


def of_few(links: pyarrow.Table) -> pyarrow.Table:
    """(node, component) of a small table of links (u, v)."""
    nodes, ends = np.unique(np.stack([links[c].to_numpy() for c in "uv"]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        old = least.copy()
        low = np.minimum(least[u], least[v])
        for side in (u, v):
            np.minimum.at(least, least[side], low)
            np.minimum.at(least, side, low)
        least = least[least]  # half the way to the least
        if (least == old).all():
            return pyarrow.table({"node": nodes, "component": nodes[least]})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v), u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large: each higher neighbour joins the least one known; small: each lower neighbour and the node itself do
    moved = join_totals(both, least, "u")
    out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where(F.col("u") != F.col("v"))
    return out if large else out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the least node that can be reached.

    Nodes without links do not appear; null ends and links of a node to itself
    are ignored; an empty table gives an empty one.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u != v").distinct()
    edges, before = durable(edges, "links"), None
    if edges.count() <= FEW:
        found = links.sparkSession.createDataFrame(of_few(edges.toArrow()))
        forget(edges)
        return found
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
        before, old = state, edges
        edges = durable(_star(_star(edges, True), False), "links")
        forget(old)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
