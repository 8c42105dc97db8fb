"""Connected components over an edge table, by alternating star contraction.

No link, node or component reaches the driver: each round is two joins and two
aggregations, and its result is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed


#: Edges from which least neighbours are materialised before they meet the edges.
LARGE = 1_000_000


def _met(edges: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """``edges`` with the least neighbour of each left end.

    A hub can hold a third of all edges.  Between two tables that are there already the
    join is one that the planner can split; an aggregation right below it would forbid that.
    """
    least = checkpointed(least) if large else least
    return edges.join(least, edges.a == least.u)


def _large_star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return (
        _met(both, least, large)
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("m", F.col("u")).alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame, large: bool) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = _met(edges, least, large).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge; component = least node.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats, self-loops and
    rows with a null end do not matter.  An empty table gives an empty result.
    """
    now = checkpointed(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        large = state[0] > LARGE
        stars = _large_star(now, large)
        now = checkpointed(_small_star(checkpointed(stars) if large else stars, large))
        before, state = state, _state(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
