"""Panels made from the sales tables, and the hierarchies over them.

Facts are summed from the sales lines once and written: they have a row for each bottom member and day or month, however many
lines there are, and whatever a query makes of them, in however many jobs, reads that table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import calendar_parts
from ..operators.baselines import in_sample_seasonal
from ..operators.features import dense_panel
from ..operators.hierarchy import TIME_LEVELS, Hierarchy, membership
from ..sources.tables import table, written

DAILY = Hierarchy.of([["region"], ["flag"]], ["region", "flag", "status"])
MONTHLY = Hierarchy.of([["region"], ["nation"], ["brand"]], ["region", "nation", "brand"])
TIME = Hierarchy(tuple(map(tuple, TIME_LEVELS)), ("date",), "day")


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with their supplier and nation."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )


def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region, flag, status, date, y, price)``, a written table."""
    keys = [F.col("n_regionkey").alias("region"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("date")]
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")
    return written(sales_rows(spark, sf_dir).groupBy(*keys).agg(F.sum("l_quantity").alias("y"), price.alias("price")), "daily_facts")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region, flag, status, member, date, y)``, dense."""
    facts = daily_facts(spark, sf_dir).select("region", "flag", "status", "date", "y")
    return dense_panel(facts, ["region", "flag", "status"], "date", "y").withColumn("member", DAILY.key())


def monthly_facts(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """``(region, nation, brand, month, y)`` and the aggregates ``more`` of the sales lines, a written table."""
    joined = sales_rows(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("p_brand").alias("brand"), F.trunc("l_shipdate", "month").alias("month")]
    return written(joined.groupBy(*keys).agg(F.sum("l_quantity").alias("y"), *more), "monthly_facts")


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region, nation, brand, member, date, y)`` by month, dense."""
    keys = ["region", "nation", "brand"]
    return dense_panel(monthly_facts(spark, sf_dir).withColumnRenamed("month", "date"), keys, "date", "y").withColumn("member", MONTHLY.key())


def naive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel with the seasonal naive forecast of each row, and its error ``e``."""
    rows = in_sample_seasonal(daily_panel(spark, sf_dir), ["member"]).where("yhat is not null")
    return rows.withColumn("e", F.col("yhat") - F.col("y"))


def dated(rows: DataFrame) -> DataFrame:
    """Distinct dates with their year, month and ISO week (of the calendar year)."""
    parts = calendar_parts(F.col("date"))
    return rows.select("date").distinct().select("date", parts["year"].alias("year"), parts["monthofyear"].alias("month"), parts["weekofyear"].alias("week"))


def time_membership(rows: DataFrame) -> DataFrame:
    """Temporal membership; the member key ``t`` is the date itself."""
    return membership(dated(rows), TIME, "t").withColumn("t", F.col("t").cast("date"))
