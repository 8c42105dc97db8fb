"""Coherent forecasts: bottom-up sums and least-squares reconciliation, without a matrix of the hierarchy.

``b = (S' W^-1 S)^-1 S' W^-1 yhat`` with memberships as a table: ``S`` and ``S'`` are joins
with sums.  A diagonal ``W`` is solved by conjugate gradients, all dates at once; vectors are
tables with a row for each member and date.  Where ``W`` is a shrunk covariance its other part has only as many dimensions as
there are training times, ``T``, so it enters by the Woodbury identity; the empirical projection
takes its dual form.  Both need Gram matrices of ``T`` rows, which are summed over nodes in Spark; these, and a
matrix of ``T`` rows and a column for each date ahead, are all that the driver holds.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, written
from .hierarchy import aggregate_members

METHODS = ("ols", "wls_struct", "wls_var", "mint_shrink", "erm")
NODE = ["aggregation", "value"]
#: Members of a membership, in rows, up to which it is broadcast.
SMALL_ROWS = 500_000
#: Eigenvalues of the empirical projection's Gram matrix below this share of the largest count as 0.
RANK_CUT = 1e-10
#: Least variance of a node's errors.
LEAST = 1e-9


def bottom_up(forecasts: DataFrame, sc: DataFrame, by: list[str], measure: str = "yhat", key: str = "member") -> DataFrame:
    return aggregate_members(forecasts, sc, by, measure, key)


def solve(nodes: DataFrame, sc: DataFrame, weights: DataFrame, key: str = "member", column: str = "i", tolerance: float = 1e-11, most: int = 500) -> DataFrame:
    """``(key, column, x)``: the members' values whose sums fit ``nodes`` (node, column, v) best, weighted by ``weights`` (node, w: one over the variance).

    Conjugate gradients on ``S' W^-1 S x = S' W^-1 v`` with the diagonal as preconditioner, each
    column with steps of its own, until every column's residual is ``tolerance`` of what it was at the start (from 0).
    A step is one written table, of which the last two are kept.  Nodes and columns that are missing count as 0.
    """
    spark = nodes.sparkSession
    held = sc.join(weights, NODE).select(*NODE, key, "w")
    held = written(held, "weighted_members")
    held = F.broadcast(held) if held.count() <= SMALL_ROWS else held
    scale = written(held.groupBy(key).agg(F.sum("w").alias("d")), "diagonal")

    def back(sums: DataFrame) -> DataFrame:
        """``S' W^-1`` of node values."""
        return sums.join(held, NODE).groupBy(key, column).agg(F.sum(F.col("w") * F.col("v")).alias("ap"))

    def both(rows: DataFrame) -> DataFrame:
        """``S' W^-1 S`` of the members' ``p``."""
        return back(rows.select(key, column, "p").join(held, key).groupBy(*NODE, column).agg(F.sum("p").alias("v")))

    first = back(nodes.select(*NODE, column, "v")).join(scale, key)
    state = written(first.select(key, column, F.lit(0.0).alias("x"), F.col("ap").alias("r"), (F.col("ap") / F.col("d")).alias("p"), "d"), "solve")
    start = written(state.groupBy(column).agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz0")), "solve_start")
    old: list[DataFrame] = []
    for _ in range(most):
        step = written(state.join(both(state), [key, column]), "solve_step")
        r, p, ap, d = (F.col(c) for c in ("r", "p", "ap", "d"))
        sums = step.groupBy(column).agg(F.sum(r * r / d).alias("rz"), F.sum(p * ap).alias("pap"), F.sum(r * ap / d).alias("rap"), F.sum(ap * ap / d).alias("aap"))
        alpha = F.coalesce(F.try_divide(F.col("rz"), F.col("pap")), F.lit(0.0))
        left = F.greatest(F.col("rz") - 2 * alpha * F.col("rap") + alpha * alpha * F.col("aap"), F.lit(0.0))
        sums = sums.withColumns({"alpha": alpha, "left": left}).withColumn("beta", F.coalesce(F.try_divide("left", "rz"), F.lit(0.0)))
        sums = written(sums.join(start, column), "solve_sums")  # a row for each column
        residual = r - F.col("alpha") * ap
        state = step.join(F.broadcast(sums.select(column, "alpha", "beta")), column).select(
            key, column, (F.col("x") + F.col("alpha") * p).alias("x"), residual.alias("r"), (residual / d + F.col("beta") * p).alias("p"), "d"
        )
        for table in old:
            discard(spark, table)
        old = [step]
        if sums.where(F.col("left") > tolerance * tolerance * F.col("rz0")).isEmpty():
            break
    return state.select(key, column, "x")


def _cells(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """``rows`` (keys, i, and ``values``) with the entries of each key in one row, as ``cells``: an entry for each time."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("i", *[v.cast("double").alias(n) for n, v in values.items()])).alias("cells"))


def _dense(cells: pa.ListArray, name: str, first: int, n: int) -> np.ndarray:
    """A row for each list, with its entries ``first`` to ``first + n``; 0 where there is none."""
    flat = cells.flatten()
    row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
    at = flat.field("i").to_numpy(zero_copy_only=False) - first
    values = np.nan_to_num(flat.field(name).to_numpy(zero_copy_only=False).astype(float))
    keep = (at >= 0) & (at < n)
    out = np.zeros((len(cells), n))
    out[row[keep], at[keep].astype(int)] = values[keep]
    return out


def gram(rows: DataFrame, left: tuple[str, int, int], right: list[tuple[str, int, int]]) -> np.ndarray:
    """The sum over rows (``cells``) of the products of the entries ``left`` (name, first, number) with those of each of ``right`` side by side."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((left[2], sum(x[2] for x in right)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.column(0).slice(at, 256)
                total += _dense(some, *left).T @ np.hstack([_dense(some, *x) for x in right])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["row", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(part.as_py())
                sums[row] = sums[row] + values if row in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["row", "held"])

    parts = rows.select("cells").mapInArrow(products, "row int, held binary").repartition("row").mapInArrow(add, "row int, held binary").toArrow()
    out = np.zeros((left[2], sum(x[2] for x in right)))
    for row, held in zip(parts["row"].to_pylist(), parts["held"].to_pylist(), strict=True):
        out[row] = np.frombuffer(held)
    return out


def combined(members: DataFrame, key: str, name: str, n: int, weights: np.ndarray, more: tuple[str, int] | None = None) -> DataFrame:
    """``(key, i, x)``: each member's ``n`` entries ``name`` times ``weights`` (times by dates), plus its own entries ``more`` (name, first)."""
    kind = members.schema[key].dataType.simpleString()
    shared = members.sparkSession.sparkContext.broadcast(weights)  # training times by dates ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        dates = table.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = _dense(some.column(1), name, 0, n) @ table
                if more is not None:
                    out += _dense(some.column(1), *more, dates)
                owner = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), dates)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(np.tile(np.arange(dates, dtype=np.int32), some.num_rows)), pa.array(out.ravel())], names=[key, "i", "x"])

    return members.select(key, "cells").mapInArrow(run, f"`{key}` {kind}, i int, x double")


def shrinkage(gram_of_scores: np.ndarray, own_squares: float, own_spread: float) -> float:
    """The share of the diagonal by the estimator of Schafer and Strimmer, from the Gram matrix (times by times) of standardised residuals.

    ``own_squares`` and ``own_spread`` are what the nodes' pairs with themselves add to the sums of squared correlations and of their variances.
    """
    t = len(gram_of_scores)
    squares = (gram_of_scores**2).sum() / t**2
    spread = ((np.diag(gram_of_scores) ** 2).sum() / t - squares) / max(t - 1, 1)
    return float(np.clip((spread - own_spread) / max(squares - own_squares, 1e-12), 0, 1))


def _dated(rows: DataFrame, date: str) -> tuple[DataFrame, int]:
    """``(date, i)`` of the distinct dates, from 0, and how many there are: a table of a row for each date."""
    days = [r[0] for r in rows.select(date).distinct().orderBy(date).collect()]
    kind = rows.schema[date].dataType.simpleString()
    return F.broadcast(rows.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days)], f"`{date}` {kind}, i int")), len(days)


def _mint(nodes: DataFrame, errors: DataFrame, n_times: int, n_dates: int, sc: DataFrame, key: str) -> DataFrame:
    """Members' values under the shrunk covariance of ``errors`` (node, i, e) for ``nodes`` (node, i, v).

    With ``W = D + U U'`` (``D`` the diagonal, ``U`` a column for each training time), forecasts and columns of ``U`` are fitted under ``D``
    alone in one solve; what ``U U'`` changes is a combination of the latter, by two systems of training times.
    """
    # a mean over all training times: a missing error counts as 0
    mean = errors.groupBy(*NODE).agg((F.sum("e") / n_times).alias("mean"), (F.sum(F.col("e") * F.col("e")) / n_times).alias("square"))
    mean = mean.select(*NODE, "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(1e-12))).alias("sd"))
    every = mean.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_times - 1)))).join(errors, [*NODE, "i"], "left")  # nodes by training times
    z = (F.coalesce("e", F.lit(0.0)) - F.col("mean")) / F.col("sd")
    scores = written(every.select(*NODE, "i", z.alias("z"), "sd"), "scores")
    own = scores.groupBy(*NODE).agg((F.sum(F.pow("z", F.lit(2))) / n_times).alias("two"), (F.sum(F.pow("z", F.lit(4))) / n_times).alias("four"))
    squares, fours = own.agg(F.sum(F.col("two") * F.col("two")), F.sum("four")).first()
    share = shrinkage(gram(_cells(scores, NODE, z=F.col("z")), ("z", 0, n_times), [("z", 0, n_times)]), squares, (fours - squares) / max(n_times - 1, 1))
    # a column of U is a training time's residuals; variances have the floor that the other methods have
    variance = mean.select(*NODE, (share * F.col("sd") * F.col("sd") + LEAST).alias("variance"))
    columns = scores.select(*NODE, "i", (F.col("z") * F.col("sd") * float(np.sqrt((1 - share) / n_times))).alias("v"))
    columns = columns.unionByName(nodes.select(*NODE, (F.col("i") + n_times).alias("i"), "v"))
    columns = written(columns, "columns")
    found = written(solve(columns, sc, variance.select(*NODE, (1 / F.col("variance")).alias("w")), key), "solved")
    sums = found.join(sc.select(*NODE, key), key).groupBy(*NODE, "i").agg(F.sum("x").alias("s"))
    pairs = columns.join(sums, [*NODE, "i"], "full").join(variance, NODE)
    wide = _cells(pairs, NODE, v=F.coalesce("v", F.lit(0.0)) / F.sqrt("variance"), s=F.coalesce("s", F.lit(0.0)) / F.sqrt("variance"))
    t, d = n_times, n_dates
    both = gram(wide, ("v", 0, t), [("v", 0, t + d), ("s", 0, t + d)])
    g, h, fitted, ahead = both[:, :t], both[:, t : t + d], both[:, t + d : 2 * t + d], both[:, 2 * t + d :]
    inner = np.eye(t) + g
    kh = np.linalg.solve(inner, h)
    weights = np.linalg.solve(inner - fitted, ahead - fitted @ kh) - kh
    return combined(_cells(found, [key], x=F.col("x")), key, "x", t, weights, ("x", t))


def reconcile(
    spark: SparkSession,
    forecasts: DataFrame,
    sc: DataFrame,
    method: str,
    training: DataFrame | None = None,
    positive: bool = False,
    key: str = "member",
    date: str = "date",
) -> DataFrame:
    """``(level_id, aggregation, value, date, yhat)``, coherent.

    ``training`` has all nodes' ``y`` and in-sample ``yhat`` (not needed for ols and
    wls_struct; a missing row counts as an error of 0, and for erm as 0); ``positive`` sets negative bottom values to 0 before summing.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known are {METHODS}")
    if method in ("wls_var", "mint_shrink", "erm") and training is None:
        raise ValueError(f"{method} needs training forecasts")
    dates, n_dates = _dated(forecasts, date)
    nodes = forecasts.join(dates, date).select(*NODE, "i", F.col("yhat").cast("double").alias("v"))
    if training is not None:
        times, n_times = _dated(training, date)
        training = training.join(times, date)
    if method == "ols":
        found = solve(nodes, sc, sc.select(*NODE).distinct().withColumn("w", F.lit(1.0)), key)
    elif method == "wls_struct":
        found = solve(nodes, sc, sc.groupBy(*NODE).agg((1 / F.count("*")).alias("w")), key)
    elif method == "wls_var":
        error = F.col("y") - F.col("yhat")
        found = solve(nodes, sc, training.groupBy(*NODE).agg((1 / F.greatest(F.sum(error * error) / n_times, F.lit(LEAST))).alias("w")), key)
    elif method == "mint_shrink":
        found = _mint(nodes, training.select(*NODE, "i", (F.col("y") - F.col("yhat")).cast("double").alias("e")), n_times, n_dates, sc, key)
    else:
        # F' (F F')^+ in place of (F'F)^+ F': as many rows as training times
        both = training.select(*NODE, "i", F.col("yhat").cast("double").alias("v")).unionByName(nodes.withColumn("i", F.col("i") + n_times))
        products = gram(_cells(both, NODE, v=F.col("v")), ("v", 0, n_times), [("v", 0, n_times + n_dates)])
        weights = np.linalg.pinv(products[:, :n_times], rcond=RANK_CUT, hermitian=True) @ products[:, n_times:]
        last = sc.agg(F.max("level_id")).first()[0]
        own = sc.where(F.col("level_id") == last).select(*NODE, key)
        found = combined(_cells(training.join(own, NODE), [key], y=F.col("y")), key, "y", n_times, weights)
    bottom = found.join(dates, "i").select(key, date, F.col("x").alias("yhat"))
    if positive:
        bottom = bottom.withColumn("yhat", F.greatest("yhat", F.lit(0.0)))
    return bottom_up(bottom, sc, [date], "yhat", key)


def reconcile_all(
    spark: SparkSession, forecasts: DataFrame, sc: DataFrame, training: DataFrame, methods: tuple[str, ...] = METHODS, positive: bool = True, key: str = "member", date: str = "date"
) -> tuple[DataFrame, dict[str, float]]:
    """Forecasts of every method beside the given ones (``base``), with a column ``method``, and the seconds that each took."""
    columns = [*NODE, date, F.col("yhat").cast("double").alias("yhat")]
    out, seconds = forecasts.select(*columns, F.lit("base").alias("method")), {}
    for method in methods:
        began = time.perf_counter()
        done = written(reconcile(spark, forecasts, sc, method, training, positive, key, date).select(*columns, F.lit(method).alias("method")), method)
        seconds[method] = time.perf_counter() - began
        out = out.unionByName(done)
    return out, seconds


def reconcile_tree(bottom: DataFrame, total: DataFrame, weights: DataFrame, total_weight: DataFrame, key: str = "member", date: str = "date") -> DataFrame:
    """Diagonal weights on a tree of one level, in closed form and fully distributed.

    ``b + w (T - sum b) / (w_T + sum w)``; ``weights`` is (key, w), ``total_weight`` one row (w_total).
    """
    sums = bottom.groupBy(date).agg(F.sum("yhat").alias("s"))
    gap = total.select(date, F.col("yhat").alias("t")).join(sums, date).select(date, (F.col("t") - F.col("s")).alias("gap"))
    scale = weights.agg(F.sum("w").alias("w_sum")).crossJoin(total_weight)  # one row each
    return (
        bottom.join(weights, key)
        .join(gap, date)
        .crossJoin(F.broadcast(scale))
        .select(key, date, (F.col("yhat") + F.col("w") * F.col("gap") / (F.col("w_total") + F.col("w_sum"))).alias("yhat"))
    )
