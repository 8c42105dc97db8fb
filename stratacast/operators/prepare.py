"""The product table from calendar, wide sales and weekly prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import PRODUCT_SCHEMA, complete
from .features import backfilled, label_encoded, running_count, unpivoted

#: Identifying columns of the sales table, event columns and flags of the calendar.
IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
EVENTS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
FLAGS = ["snap_CA", "snap_TX", "snap_WI"]


def product_table(calendar: DataFrame, sales: DataFrame, prices: DataFrame, horizon: int = 28) -> DataFrame:
    """A row per product and day in ``PRODUCT_SCHEMA``, with 0 sales on the calendar's last ``horizon`` days.

    Identifiers and events become codes in sorted order, missing events last.  Weeks on
    sale count the weeks that have a price, 0 before the first; a missing price takes
    the next one that is known, of the next product where its own has none, and stays
    null where no later product has one.  A price of an unknown product is an error.
    """
    codes = label_encoded(sales.select(*IDS).distinct(), IDS)
    priced = prices.join(codes.select("item_id", "store_id", "item_id_enc", "store_id_enc"), ["item_id", "store_id"], "left")
    priced = complete(priced, "sell_price", "item_id_enc", "store_id_enc").select("wm_yr_wk", "sell_price", "item_id_enc", "store_id_enc")
    priced = running_count(priced, ["item_id_enc", "store_id_enc"], ["wm_yr_wk"], "weeks_on_sale")
    days = label_encoded(calendar, EVENTS).select("d", F.to_date("date").alias("date"), "wm_yr_wk", *FLAGS, "event_type_1_enc", "event_type_2_enc")
    past = unpivoted(sales, ["id"], [c for c in sales.columns if c not in IDS], "d", "sales")
    last = days.orderBy(F.desc("date")).limit(horizon).select("d")
    ahead = codes.select("id").join(F.broadcast(last)).select("id", "d", F.lit(0).alias("sales"))  # ``horizon`` rows
    rows = past.select("id", "d", F.col("sales").cast("double").alias("sales")).unionByName(ahead)
    rows = rows.join(F.broadcast(days), "d").join(codes.select("id", *[f"{c}_enc" for c in IDS]), "id")
    rows = rows.join(priced, ["item_id_enc", "store_id_enc", "wm_yr_wk"], "left")
    rows = backfilled(rows, "sell_price", ["id_enc"], ["date"], across=True).withColumn("weeks_on_sale", F.coalesce("weeks_on_sale", F.lit(0)))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRODUCT_SCHEMA])


def save_products(products: DataFrame, table: str, buckets: int = 64) -> None:
    """Write products as a table in buckets of store and item, sorted within: joins and windows by these, and readers of one store, need no shuffle."""
    by = ["store_id_enc", "item_id_enc"]
    products.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by, "date").saveAsTable(table)
