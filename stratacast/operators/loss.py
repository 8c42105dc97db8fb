"""The hierarchical squared loss: hessian, gradient and metric as joins and sums.

With ``e`` the error of a bottom member at a time, ``E(a, b)`` is its sum over
the members of node ``a`` and the times of temporal node ``b``.  Node weights are
one over levels times members.  A side without a hierarchy is the identity with
weight one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import level_count, node_sizes

NODE = ["level_id", "aggregation", "value"]


def weighted(members: DataFrame, key: str) -> DataFrame:
    """A membership with its nodes' weights ``d`` beside each row; one that has them already comes back as it is."""
    if "d" in members.columns:
        return members
    sizes = node_sizes(members, key).crossJoin(F.broadcast(level_count(members)))  # one row
    weights = sizes.select(*NODE, (1 / (F.col("n_levels") * F.greatest("n_members", F.lit(1)))).alias("d"))
    return members.join(weights, NODE)


def hessian(members: DataFrame, sc: DataFrame | None, st: DataFrame | None, key: str = "member", time: str = "t") -> DataFrame:
    """``(key, time, hess)`` for the rows of ``members``; the product of both sides' sums of weights."""
    _needs_side(sc, st)
    out = members.select(key, time).withColumn("hess", F.lit(1.0))
    for side, column in ((sc, key), (st, time)):
        if side is not None:
            sums = weighted(side, column).groupBy(column).agg(F.sum("d").alias("h"))
            out = out.join(sums, column).select(key, time, (F.col("hess") * F.col("h")).alias("hess"))
    return out


def _needs_side(sc: DataFrame | None, st: DataFrame | None) -> None:
    if sc is None and st is None:
        raise ValueError("a cross-sectional or a temporal hierarchy is needed")


def gradient(errors: DataFrame, sc: DataFrame | None = None, st: DataFrame | None = None, key: str = "member", time: str = "t") -> DataFrame:
    """``(key, time, grad)`` from ``errors`` (key, time, e).

    The temporal side goes first: its node sums replace days by fewer rows.  Node sums
    come back to members by node and time together, so that Total is no single key.
    Memberships that ``weighted`` has been applied to save doing so for every call.
    """
    _needs_side(sc, st)
    rows = errors.select(key, time, F.col("e").alias("grad"))
    for side, column, other in ((st, time, key), (sc, key, time)):
        if side is not None:
            spread = rows.join(weighted(side, column), column)
            sums = spread.groupBy(*NODE, other).agg(F.sum("grad").alias("E"))
            places = spread.select(*NODE, "d", column, other)
            rows = places.join(sums, [*NODE, other]).groupBy(column, other).agg(F.sum(F.col("E") * F.col("d")).alias("grad"))
    return rows.select(key, time, "grad")


def metric(errors: DataFrame, sc: DataFrame | None = None, st: DataFrame | None = None, key: str = "member", time: str = "t") -> DataFrame:
    """One row: half the weighted sum of squared node errors, by members and times (lower is better)."""
    _needs_side(sc, st)
    rows = errors.select(key, time, F.col("e"), F.lit(1.0).alias("w"))
    for side, column in ((st, time), (sc, key)):
        if side is None:
            continue
        other = time if column == key else key
        scaled = weighted(side, column)
        sums = rows.join(scaled, column).groupBy(*NODE, "d", "w", other).agg(F.sum("e").alias("e"))
        rows = sums.select(F.concat_ws("\u0001", F.col("level_id").cast("string"), "value").alias(column), other, "e", (F.col("w") * F.col("d")).alias("w"))
    size = errors.agg((F.countDistinct(key) * F.countDistinct(time)).alias("n"))
    total = rows.agg(F.sum(0.5 * F.col("e") * F.col("e") * F.col("w")).alias("s"))
    return total.crossJoin(size).select((F.col("s") / F.col("n")).alias("hmse"))  # one row each


def random_membership(members: DataFrame, max_levels: int, max_categories: int, seed: int, draw: int = 0, key: str = "member") -> DataFrame:
    """A random hierarchy of 1 to ``max_levels`` levels of 2 to ``max_categories`` categories, with Total and bottom.

    A function of member, level, seed and draw (by MD5, which other engines have too), so any
    partitioning gives the same one; categories without members have no rows.
    """

    def pick(low: int, high: int, what: str) -> int:
        return low + int(hashlib.md5(f"{seed}:{draw}:{what}".encode(), usedforsecurity=False).hexdigest()[:8], 16) % (high - low + 1)

    levels = pick(1, max_levels, "levels")
    sizes = [pick(2, max_categories, f"size:{i}") for i in range(1, levels + 1)]
    nodes = [F.struct(F.lit(0).alias("level_id"), F.lit("Total").alias("aggregation"), F.lit("Total").alias("value"))]
    for i, n in enumerate(sizes, 1):
        digest = F.md5(F.concat(F.lit(f"{seed}:{draw}:{i}:"), F.col(key)).cast("binary"))
        code = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("string")
        nodes.append(F.struct(F.lit(i).alias("level_id"), F.lit(f"random{i}").alias("aggregation"), code.alias("value")))
    nodes.append(F.struct(F.lit(levels + 1).alias("level_id"), F.lit("bottom").alias("aggregation"), F.col(key).alias("value")))
    return members.select(key).distinct().select(key, F.explode(F.array(nodes)).alias("node")).select("node.*", key)


def random_gradient(errors: DataFrame, max_levels: int, max_categories: int, hier_freq: int, seed: int, draw: int, key: str = "member", time: str = "t") -> DataFrame:
    """``(key, time, grad, hess)`` of one round: with probability ``1 / hier_freq`` those of a new random hierarchy, else of the plain loss."""
    turn = errors.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(seed), F.lit(draw)), F.lit(hier_freq)).alias("x")).first()["x"]
    if turn:
        return errors.select(key, time, F.col("e").alias("grad"), F.lit(1.0).alias("hess"))
    drawn = weighted(random_membership(errors.select(key), max_levels, max_categories, seed, draw, key), key)
    return gradient(errors, drawn, None, key, time).join(hessian(errors, drawn, None, key, time), [key, time])


def tweedie(rows: DataFrame, power: float, target: str = "y", raw: str = "raw") -> DataFrame:
    """``rows`` with gradient and hessian of the log-link Tweedie deviance at raw scores."""
    a, b = F.exp((1 - power) * F.col(raw)), F.exp((2 - power) * F.col(raw))
    return rows.withColumn("grad", b - F.col(target) * a).withColumn("hess", (2 - power) * b - (1 - power) * F.col(target) * a)
