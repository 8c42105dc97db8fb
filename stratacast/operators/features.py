"""Features of a long panel ``(aggregation, value, date, y)``: windows per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_parts, price_change
from ..sources.tables import written
from .hierarchy import Hierarchy, aggregate_levels, mean_over_members, membership
from .ranking import in_ranges, numbered

#: Lags and windows of the features.
LAGS = (1, 2, 3, 4, 5, 6, 7, 28, 56, 364)
WINDOWS = (7, 28, 56)
SERIES = ("aggregation", "value")


def _over(series: tuple[str, ...], date: str):
    return Window.partitionBy(*series).orderBy(date)


def dense_panel(facts: DataFrame, keys: list[str], date: str, measure: str, fill: float | None = 0.0) -> DataFrame:
    """Every key at every date of ``facts``; missing values are ``fill`` (None: null)."""
    grid = facts.select(*keys).distinct().crossJoin(facts.select(date).distinct())
    out = grid.join(facts.select(*keys, date, measure), [*keys, date], "left")
    return out if fill is None else out.withColumn(measure, F.coalesce(measure, F.lit(fill)))


def add_lags(panel: DataFrame, target: str = "y", lags: tuple[int, ...] = LAGS, forecast_day: int = 0, series=SERIES, date: str = "date") -> DataFrame:
    """Columns ``{target}_lagK``, rows back by ``K + forecast_day``."""
    w = _over(series, date)
    return panel.withColumns({f"{target}_lag{k}": F.lag(target, k + forecast_day).over(w) for k in lags})


def add_rolling_means(panel: DataFrame, target: str = "y", windows: tuple[int, ...] = WINDOWS, forecast_day: int = 0, series=SERIES, date: str = "date") -> DataFrame:
    """Columns ``{target}_lag1_mavgW``: means of the first lag over ``W`` rows, of as many as there are."""
    w, base = _over(series, date), f"{target}_lag{1 + forecast_day}"
    if base not in panel.columns:
        raise ValueError(f"rolling means need the column {base}")
    return panel.withColumns({f"{base}_mavg{n}": F.avg(base).over(w.rowsBetween(-(n - 1), 0)) for n in windows})


def _forward(x: str | Column, *order: Column | str, by: tuple[str, ...]) -> Column:
    """Last known value of ``x`` up to each row in an order; a running frame, so linear in the rows."""
    return F.last(x, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def filled_both_ways(x: str, series: tuple[str, ...], date: str) -> Column:
    """Forward fill, then backward fill of what is left, per series."""
    return F.coalesce(_forward(x, date, by=series), _forward(x, F.desc(date), by=series))


def backfilled(df: DataFrame, x: str, series: list[str], order: list[str], across: bool = False) -> DataFrame:
    """Backward fill per series; ``across`` lets a trailing gap take the next series' value.

    Across series, rows are dealt into ranges of the whole order and filled inside each; a
    range's first value, one for each range, is carried to the gap at the end of the ranges before it.
    """
    if not across:
        return df.withColumn(x, _forward(x, *[F.desc(c) for c in order], by=tuple(series)))
    rows = in_ranges(df, [*series, *order])
    first = rows.groupBy(F.col("_range").alias("_r")).agg(F.min_by(x, F.when(F.col(x).isNotNull(), F.col("_at"))).alias("_first"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = written(first.select("_r", F.last("_first", True).over(after).alias("_next")), "carries")
    own = rows.withColumn(x, _forward(x, F.desc("_at"), by=("_range",)))
    return own.join(carried, F.col("_range") == F.col("_r")).withColumn(x, F.coalesce(x, "_next")).select(*df.columns)


def add_calendar(panel: DataFrame, date: str = "date", parts: tuple[str, ...] = ("dayofweek", "dayofmonth", "weekofyear", "monthofyear")) -> DataFrame:
    every = calendar_parts(F.col(date))
    return panel.withColumns({p: every[p] for p in parts})


def first_per_date(df: DataFrame, date: str, order: list[str]) -> DataFrame:
    """The first row of each date in a stated order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(date).orderBy(*order))).where("_nth = 1").drop("_nth")


def label_encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes from 0 in sorted order, nulls last, as ``<column>_enc``.

    The distinct values are numbered in ranges of their order, however many they are, and joined to the rows.
    """
    for c in columns:
        values = df.select(F.col(c).isNull().alias("_last"), F.col(c).alias("_code")).distinct()
        codes = numbered(values, ["_last", "_code"], name=f"{c}_enc").select("_code", F.col(f"{c}_enc").cast("int"))
        df = df.join(codes, F.col(c).eqNullSafe(F.col("_code")), "left").drop("_code")
    return df


def running_count(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def unpivoted(wide: DataFrame, ids: list[str], columns: list[str], variable: str, value: str) -> DataFrame:
    """Wide columns to rows; nulls are left out."""
    return wide.unpivot(ids, columns, variable, value).where(F.col(value).isNotNull())


def forecast_set(
    facts: DataFrame,
    hierarchy: Hierarchy,
    date: str = "date",
    target: str = "y",
    price: str | None = None,
    weeks: str | None = None,
    per_date: list[str] | None = None,
    forecast_day: int = 0,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Targets and features of every node: lags, rolling means, calendar, prices and attributes of dates.

    Prices are filled both ways per member, missing weeks on sale are 0, and both are averaged over members; the
    price feature is the previous price over the current one, less one.
    """
    dense = dense_panel(facts.groupBy(*hierarchy.bottom, date).agg(F.sum(target).alias(target)), list(hierarchy.bottom), date, target)
    panel = aggregate_levels(dense, hierarchy, [date], target)
    panel = add_calendar(add_rolling_means(add_lags(panel, target, forecast_day=forecast_day, date=date), target, forecast_day=forecast_day, date=date), date)
    extra = [c for c in (price, weeks) if c]
    if extra:
        first = facts.groupBy(*hierarchy.bottom, date).agg(*[F.min(c).alias(c) for c in extra])  # of several rows, the least
        filled = dense.select(*hierarchy.bottom, date).join(first, [*hierarchy.bottom, date], "left")
        fills = {c: filled_both_ways(c, hierarchy.bottom, date) if c == price else F.coalesce(c, F.lit(0)) for c in extra}
        filled = filled.withColumns(fills).withColumn("member", hierarchy.key())
        means = mean_over_members(filled, membership(facts, hierarchy), [date], extra)
        if price:
            w = _over(SERIES, date)
            means = means.withColumn(f"{price}_change", price_change(F.lag(f"{price}_avg").over(w), F.col(f"{price}_avg")))
        panel = panel.join(means, ["level_id", "aggregation", "value", date], "left")
    if per_date:
        panel = panel.join(first_per_date(facts.select(date, *per_date), date, per_date), date, "left")
    return panel.na.drop("any") if drop_incomplete else panel


def surviving_dates(panel: DataFrame, kept: DataFrame, date: str = "date") -> DataFrame:
    """The rows of ``panel`` on dates that ``kept`` has."""
    return panel.join(kept.select(date).distinct(), date, "left_semi")
