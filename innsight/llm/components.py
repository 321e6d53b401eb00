"""Connected components by alternating large-star and small-star steps.

Every step is a groupBy with a minimum (pre-aggregated before its shuffle) and
a join of edges with their node's minimum. Where there are more than ``HUB_EDGES``
edges, the few hubs that hold more than a thousandth of them are broadcast
(``rows_by_id.join_groups``), so no hub's edges go to one task; fewer edges in all
are no load for one. Edges are written to the shared folder after every round;
nothing is collected. A round at least halves the longest paths in practice; the
number of rounds is bounded by the logarithm of the nodes, and ``rounds`` (60) is
an error message for inputs beyond 2**60 nodes, not a cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.columns import written
from innsight.llm.rows_by_id import join_groups


HUB_EDGES = 100_000


def _lowest(both: DataFrame, split: bool) -> DataFrame:
    """(u, m, n): smallest of a node and its neighbours, and the number of edges."""
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return written(low, "lowest") if split else low


def _with_lowest(rows: DataFrame, low: DataFrame, split: bool) -> DataFrame:
    return join_groups(rows, low, ["u"]) if split else rows.join(low, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed -> (id, component).

    Only nodes with an edge to another node are returned; component is the
    smallest id of the component. An empty input gives an empty result.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u != v").distinct(), "edges")
    state, n = None, e.count()
    for _ in range(rounds):
        split = 2 * n > HUB_EDGES
        # large star: larger neighbours move to the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, split)
        large = (_with_lowest(both.filter("v > u"), low, split)
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"))
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = _lowest(large, split)
        e = written(_with_lowest(large, low, split).select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(low.select("u", F.col("m").alias("v")))
                    .filter("u != v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(roots.select("id", F.col("id").alias("component"))))
