"""Readers, sinks and schema contracts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The product table that the preparation step writes.
PRODUCT_SCHEMA = T.StructType(
    [T.StructField("sales", T.DoubleType()), T.StructField("date", T.DateType()), T.StructField("id", T.StringType())]
    + [T.StructField(f"{c}_enc", T.IntegerType()) for c in ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")]
    + [T.StructField(f"snap_{s}", T.IntegerType()) for s in ("CA", "TX", "WI")]
    + [T.StructField(f"event_type_{i}_enc", T.IntegerType()) for i in (1, 2)]
    + [T.StructField("sell_price", T.FloatType()), T.StructField("weeks_on_sale", T.IntegerType())]
)
FORECAST_SCHEMA = "scenario string, seed int, method string, aggregation string, value string, date date, yhat double"
STATION_SCHEMA = (
    "station_id string, name string, lat double, long double, install_date string, install_dockcount int, "
    "modification_date string, current_dockcount int, decommission_date string"
)
TRIP_SCHEMA = "trip_id string, starttime string, stoptime string, from_station_id string, tripduration double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_products(
    spark: SparkSession,
    path: str,
    first_date: str,
    last_date: str,
    store_id: int | None = None,
    columns: list[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Products on sale within two dates, both included; filters and columns reach the scan.

    ``path`` is a folder, or the name of a table.  ``ordered`` sorts by store, item and date.
    """
    rows = spark.read.schema(PRODUCT_SCHEMA).parquet(path) if "/" in path else spark.table(path)
    found = rows.where(F.col("date").between(first_date, last_date) & (F.col("weeks_on_sale") > 0))
    if store_id is not None:
        found = found.where(F.col("store_id_enc") == store_id)
    if ordered:
        found = found.orderBy("store_id_enc", "item_id_enc", "date")
    return found.select(columns or [f.name for f in PRODUCT_SCHEMA if f.name not in ("id",)])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One dataset for all scenarios and methods; readers prune by these columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_forecasts(spark: SparkSession, path: str, scenario: str | None = None) -> DataFrame:
    found = spark.read.schema(FORECAST_SCHEMA).parquet(path)
    return found if scenario is None else found.where(F.col("scenario") == scenario)


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def complete_at(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end: its commit marker is there."""
    return exists(spark, f"{path}/_SUCCESS")


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written there first if it is missing or half-written."""
    if not complete_at(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_or_fit(spark: SparkSession, path: str, fit: Callable, load: Callable):
    """A saved model, fitted and saved first if it is missing or half-written; its metadata is written last but for its data."""
    if complete_at(spark, f"{path}/metadata") and (complete_at(spark, f"{path}/data") or not exists(spark, f"{path}/data")):
        return load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Where the session names none it is below the warehouse, which a cluster shares
    too, and goes when the driver's JVM ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stratacast-checkpoints"
        context.setCheckpointDir(named)
        _deleted_at_exit(spark, named)
    return named


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh shared path, deleted when the driver's JVM ends."""
    parent = f"{shared_dir(spark).rstrip('/')}/stratacast-{uuid.uuid4().hex}"
    _deleted_at_exit(spark, parent)
    return f"{parent}/{name}"


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with ``options`` of the writer, and read it back.

    Unlike a checkpoint the result has file sizes, so the planner itself decides
    from a known size whether a join may broadcast it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``written`` has made and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, after a check that none of ``columns`` holds a null."""
    bad = F.lit(False)
    for c in columns:
        bad |= F.col(c).isNull()
    if not df.where(bad).isEmpty():
        raise ValueError(f"null in one of {columns}")
    return df
