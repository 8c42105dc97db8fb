"""Forecast errors by level, method, seed and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of mean weekly sales of the buckets; the last bucket is open.
BUCKETS = (1, 10, 100, 500)


def _errors() -> dict[str, Column]:
    d = F.col("yhat") - F.col("y")
    return {
        "rmse": F.sqrt(F.avg(d * d)),
        "mae": F.avg(F.abs(d)),
        "smape": 200 * F.avg(F.coalesce(F.try_divide(F.abs(d), F.abs("yhat") + F.abs("y")), F.lit(0.0))),
    }


def paired(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts beside actuals of the same node and date, for every method."""
    return forecasts.join(actuals, ["aggregation", "value", "date"])


def level_errors(pairs: DataFrame, kind: str, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """``(*by, aggregation, <kind>)``, with a level ``All series`` over all rows.

    SMAPE is in percent of the sum of both sizes, doubled; two zeros count as no error.
    """
    measure = _errors()[kind].alias(kind)
    levels = pairs.groupBy(*by, "aggregation").agg(measure)
    return levels.unionByName(pairs.groupBy(*by).agg(measure).withColumn("aggregation", F.lit("All series")))


def over_seeds(errors: DataFrame, kind: str, by: tuple[str, ...] = ("scenario", "aggregation")) -> DataFrame:
    """Mean and sample deviation over seeds; the deviation of a single seed is null and its row stays."""
    return errors.groupBy(*by).agg(F.avg(kind).alias("mean"), F.stddev_samp(kind).alias("std"), F.count("*").alias("n_seeds"))


def missing_seeds(errors: DataFrame, expected: DataFrame, by: tuple[str, ...] = ("scenario", "seed")) -> DataFrame:
    """Expected runs that have no errors."""
    return expected.join(errors.select(*by).distinct(), list(by), "left_anti")


def weekly_rmse(pairs: DataFrame, days: int = 7) -> DataFrame:
    """Mean of daily RMSE for each method and period of ``days`` dates."""
    d = F.col("yhat") - F.col("y")
    daily = pairs.groupBy("method", "date").agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    index = pairs.select("date").distinct().withColumn("day", F.dense_rank().over(Window.orderBy("date")) - 1)
    return daily.join(index, "date").groupBy("method", F.floor(F.col("day") / days).alias("period")).agg(F.avg("rmse").alias("rmse"))


def relative_to(errors: DataFrame, baseline: str, kind: str = "rmse", method: str = "method") -> DataFrame:
    """Each method's errors divided by the baseline method's."""
    keys = [c for c in errors.columns if c not in (method, kind)]
    base = errors.where(F.col(method) == baseline).select(*keys, F.col(kind).alias("base"))
    return errors.join(base, keys).select(method, *keys, F.try_divide(kind, "base").alias(f"relative_{kind}"))


def bucketed_rmse(pairs: DataFrame, history: DataFrame, bounds: tuple[int, ...] = BUCKETS) -> DataFrame:
    """RMSE per method and bucket of a series' mean weekly sales in ``history``."""
    weekly = history.groupBy("aggregation", "value").agg((7 * F.avg("y")).alias("weekly"))
    label = F.lit(f">{bounds[-1]}")
    for b in reversed(bounds):
        label = F.when(F.col("weekly") <= b, f"<={b}").otherwise(label)
    series = pairs.groupBy("method", "aggregation", "value").agg(_errors()["rmse"].alias("rmse"))
    return series.join(weekly.withColumn("bucket", label), ["aggregation", "value"]).groupBy("method", "bucket").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("n"))


def in_level_order(errors: DataFrame, levels: list[str]) -> DataFrame:
    """Errors sorted by level, in the order of ``levels`` and then any others by name, and by method."""
    place = F.array_position(F.array(*map(F.lit, levels)), F.col("aggregation"))
    return errors.orderBy(F.when(place > 0, place).otherwise(len(levels) + 1), "aggregation", *[c for c in ("scenario", "method") if c in errors.columns])


def by_level(errors: DataFrame, kind: str, levels: list[str], method: str = "method") -> DataFrame:
    """One row per method, one column per level."""
    return errors.groupBy(method).pivot("aggregation", levels).agg(F.first(kind))
