"""Registry: one query for each operator, and DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import baselines, boost, evaluate, features, hierarchy, loss, prepare, reconcile, trees
from ..operators.hierarchy import membership, node_sizes
from ..sources.tables import cut_lineage, table, written
from .panels import DAILY, MONTHLY, daily_facts, daily_panel, monthly_facts, monthly_panel, naive_errors, time_membership

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FACTS = """f AS (
  SELECT n_regionkey AS region, l_returnflag AS flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
PANEL = FACTS + """, p AS (
  SELECT region, flag, status, concat_ws('-', region, flag, status) AS member, date, coalesce(y, 0) AS y
  FROM (SELECT DISTINCT region, flag, status FROM f) CROSS JOIN (SELECT DISTINCT date FROM f) LEFT JOIN f USING (region, flag, status, date))"""
ERRORS = PANEL + """, e AS (
  SELECT *, yhat - y AS e FROM (SELECT *, lag(y, 7) OVER (PARTITION BY member ORDER BY date) AS yhat FROM p) WHERE yhat IS NOT NULL)"""
CROSS = """, m AS (SELECT DISTINCT region, flag, member FROM p), sc AS (
  SELECT 0 AS level_id, 'Total' AS aggregation, 'Total' AS value, member FROM m
  UNION ALL SELECT 1, 'region', CAST(region AS VARCHAR), member FROM m
  UNION ALL SELECT 2, 'flag', flag, member FROM m
  UNION ALL SELECT 3, 'bottom', member, member FROM m),
dc AS (SELECT level_id, value, 1.0::DOUBLE / (4 * count(*)) AS d FROM sc GROUP BY 1, 2)"""


def time_side(rows: str) -> str:
    return f""", td AS (SELECT DISTINCT date AS t, year(date) AS y, month(date) AS mo, weekofyear(date) AS w FROM {rows}), st AS (
  SELECT 0 AS level_id, 'Total' AS aggregation, 'Total' AS value, t FROM td
  UNION ALL SELECT 1, 'year', CAST(y AS VARCHAR), t FROM td
  UNION ALL SELECT 2, 'year-month', concat_ws('-', y, mo), t FROM td
  UNION ALL SELECT 3, 'year-week', concat_ws('-', y, w), t FROM td
  UNION ALL SELECT 4, 'day', CAST(t AS VARCHAR), t FROM td),
dt AS (SELECT level_id, value, 1.0::DOUBLE / (5 * count(*)) AS d FROM st GROUP BY 1, 2)"""


def r6(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def off_ties(x: str) -> Column:
    """Four decimals of ``x``, moved off exact ties, which engines round differently."""
    return F.round(F.col(x) + 1e-7, 4)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def day(x: str = "date") -> Column:
    return F.col(x).cast("string").alias("date")


# scans, filters, joins

@query("scan_project_filter", """SELECT l_orderkey, l_partkey, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31' AND l_quantity > 10 ORDER BY ALL""")
def _scan(spark, d):
    found = table(spark, d, "lineitem").where(F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")) & (F.col("l_quantity") > 10))
    return found.select("l_orderkey", "l_partkey", "l_quantity", F.to_date("l_shipdate").cast("string").alias("date"))


@query("left_join_chain", """SELECT c_custkey, c_name, n_name, r_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _chain(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("count_per_key", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(value) AS trips, round(any_value(m), 6) AS mean_value FROM events
JOIN (SELECT CAST(ts AS DATE) AS dd, avg(value) AS m FROM events GROUP BY 1) ON dd = CAST(ts AS DATE) GROUP BY ALL""")
def _counts(spark, d):
    events = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    weather = events.groupBy("date").agg(F.avg("value").alias("m"))
    trips = events.groupBy("date", "event_type").agg(F.count("value").alias("trips"))
    return trips.join(weather, "date", "left").select(day(), "event_type", "trips", r6("m").alias("mean_value"))


@query("weeks_on_sale", """SELECT l_partkey, l_suppkey, week, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY week) AS weeks_on_sale
FROM (SELECT DISTINCT l_partkey, l_suppkey, CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) // 7 AS BIGINT) AS week FROM lineitem)""")
def _weeks(spark, d):
    week = F.floor(F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-02").cast("date")) / 7).cast("long").alias("week")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", week).distinct()
    return features.running_count(rows, ["l_partkey", "l_suppkey"], ["week"], "n").withColumn("weeks_on_sale", F.col("n").cast("long")).drop("n")


@query("label_encode", """SELECT p_partkey, p_brand, p_type, dense_rank() OVER (ORDER BY p_brand NULLS LAST) - 1 AS p_brand_enc,
dense_rank() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END NULLS LAST) - 1 AS event_enc FROM part""")
def _encode(spark, d):
    part = table(spark, d, "part").withColumn("event", F.when(F.col("p_size") % 3 != 0, F.col("p_type")))
    coded = features.label_encoded(part, ["p_brand", "event"])
    return coded.select("p_partkey", "p_brand", "p_type", F.col("p_brand_enc").cast("long"), F.col("event_enc").cast("long"))


def _wide(spark, d):
    """A column for each month between the first and the last of the table."""
    facts = monthly_facts(spark, d).withColumn("d", F.date_format("month", "'m_'yyyy_MM"))
    ends = facts.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = [r[0] for r in ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "'m_'yyyy_MM")).collect()]
    return facts.groupBy("region", "nation", "brand").pivot("d", months).agg(F.sum("y")), months


MONTHLY_SQL = """f AS (SELECT n_regionkey AS region, n_nationkey AS nation, p_brand AS brand, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS y
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query("unpivot_wide", f"WITH {MONTHLY_SQL} SELECT region, nation, brand, strftime(month, 'm_%Y_%m') AS d, y AS sales FROM f")
def _unpivot(spark, d):
    wide, months = _wide(spark, d)
    return features.unpivoted(wide, ["region", "nation", "brand"], months, "d", "sales")


@query("pivot_fill", f"""WITH {MONTHLY_SQL}, g AS (SELECT region, nation, brand, strftime(m, 'm_%Y_%m') AS d, coalesce(y, 0) AS y FROM (SELECT DISTINCT region, nation, brand FROM f)
CROSS JOIN (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS m FROM f) LEFT JOIN f USING (region, nation, brand) WHERE f.month = m OR f.month IS NULL
UNION ALL SELECT DISTINCT region, nation, brand, strftime(m, 'm_%Y_%m'), 0 FROM f, (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS m FROM f))
FROM (PIVOT g ON d USING sum(y) GROUP BY region, nation, brand)""")
def _pivot(spark, d):
    return _wide(spark, d)[0].na.fill(0.0)


@query("extend_horizon", """WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), k AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem)
SELECT flag, CAST(date AS VARCHAR) AS date, 0.0::DOUBLE AS sales FROM k CROSS JOIN (SELECT date FROM x ORDER BY date DESC LIMIT 28)""")
def _extend(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("date"))
    last = rows.select("date").distinct().orderBy(F.desc("date")).limit(28)
    return rows.select("flag").distinct().crossJoin(F.broadcast(last)).select("flag", day(), F.lit(0.0).alias("sales"))


@query("dense_panel", f"WITH {PANEL} SELECT region, flag, status, member, CAST(date AS VARCHAR) AS date, y FROM p")
def _dense(spark, d):
    return daily_panel(spark, d).select("region", "flag", "status", "member", day(), "y")


STATION = "CASE user_id % 4 WHEN 0 THEN 'Pronto shop 2' WHEN 1 THEN 'Pronto shop' WHEN 2 THEN '8D OPS 02' ELSE concat(event_type, '-0', CAST(user_id % 5 AS VARCHAR)) END"


@query("replace_split", f"""SELECT name, station, split_part(station, '-', 1) AS station_group, TRY_CAST(split_part(station, '-', 2) AS BIGINT) AS number, count(*) AS trips
FROM (SELECT name, replace(replace(replace(name, 'Pronto shop 2', 'PS-2'), 'Pronto shop', 'PS-1'), '8D OPS 02', 'OPS-1') AS station FROM (SELECT {STATION} AS name FROM events)) GROUP BY ALL""")
def _replace(spark, d):
    names = table(spark, d, "events").select(F.expr(STATION.replace("VARCHAR", "STRING")).alias("name"))
    new = names.withColumn("station", X.replace_in_order(F.col("name"), X.STATION_NAMES))
    parts = new.select("name", "station", X.part_of(F.col("station"), 1).alias("station_group"), X.part_of(F.col("station"), 2).cast("long").alias("number"))
    return parts.groupBy("name", "station", "station_group", "number").agg(F.count("*").alias("trips"))


@query("calendar_parts", """SELECT CAST(date AS VARCHAR) AS date, isodow(date) AS dayofweek, day(date) AS dayofmonth, weekofyear(date) AS weekofyear, month(date) AS monthofyear,
year(date) AS year, CAST(date - 366 AS VARCHAR) AS year_before FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""")
def _calendar(spark, d):
    dates = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    parts = [v.cast("long").alias(k) for k, v in X.calendar_parts(F.col("date")).items()]
    return dates.select(day(), *parts, F.date_sub("date", 366).cast("string").alias("year_before"))


@query("clip_values", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE greatest(least(c_acctbal, 1e9), 0) + 0.0 END AS balance FROM customer")
def _clip(spark, d):
    x = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", (X.clipped(x) + 0.0).alias("balance"))


@query("scenario_names", "SELECT event_id, event_type || '_' || user_id || '_run' AS run, event_type AS scenario FROM events")
def _scenario(spark, d):
    run = F.concat_ws("_", "event_type", F.col("user_id").cast("string"), F.lit("run"))
    return table(spark, d, "events").select("event_id", run.alias("run"), X.scenario_of(run).alias("scenario"))


@query("narrow_types", "SELECT p_partkey, p_size, CAST(p_retailprice AS FLOAT)::DOUBLE AS price FROM part")
def _narrow(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast(X.narrowed("double")).cast("double").alias("price"))


GAPS = FACTS + ", g AS (SELECT region, flag, status, date, CASE WHEN CAST(y AS BIGINT) % 3 = 0 THEN NULL ELSE y END AS v FROM f)"


def _gaps(spark, d):
    return daily_facts(spark, d).select("region", "flag", "status", "date", F.when(F.col("y").cast("long") % 3 != 0, F.col("y")).alias("v"))


@query("global_bfill", f"""WITH {GAPS} SELECT region, flag, status, CAST(date AS VARCHAR) AS date,
first_value(v IGNORE NULLS) OVER (ORDER BY region, flag, status, date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM g""")
def _bfill_all(spark, d):
    return features.backfilled(_gaps(spark, d), "v", ["region", "flag", "status"], ["date"], across=True).select("region", "flag", "status", day(), "v")


@query("series_bfill", f"""WITH {GAPS} SELECT region, flag, status, CAST(date AS VARCHAR) AS date,
first_value(v IGNORE NULLS) OVER (PARTITION BY region, flag, status ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM g""")
def _bfill(spark, d):
    return features.backfilled(_gaps(spark, d), "v", ["region", "flag", "status"], ["date"]).select("region", "flag", "status", day(), "v")


@query("ffill_bfill", f"""WITH {GAPS} SELECT region, flag, status, CAST(date AS VARCHAR) AS date,
coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY region, flag, status ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(v IGNORE NULLS) OVER (PARTITION BY region, flag, status ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""")
def _ffill(spark, d):
    rows = _gaps(spark, d)
    return rows.withColumn("v", features.filled_both_ways("v", ("region", "flag", "status"), "date")).select("region", "flag", "status", day(), "v")


@query("first_per_date", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) = 1""")
def _first(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber")
    return features.first_per_date(rows, "date", ["l_orderkey", "l_linenumber"]).select(day(), "l_orderkey", "l_linenumber")


@query("semi_dates", f"WITH {FACTS} SELECT region, flag, status, CAST(date AS VARCHAR) AS date, y FROM f WHERE date IN (SELECT date FROM f WHERE y > 45)")
def _semi(spark, d):
    facts = daily_facts(spark, d)
    return features.surviving_dates(facts, facts.where("y > 45")).select("region", "flag", "status", day(), "y")


@query("last_dates", "SELECT CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem ORDER BY 1 DESC LIMIT 28)")
def _last(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().orderBy(F.desc("date")).limit(28).select(day())


@query("date_extent", "SELECT CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates FROM lineitem")
def _extent(spark, d):
    x = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").agg(F.min(x).cast("string").alias("first"), F.max(x).cast("string").alias("last"), F.countDistinct(x).alias("n_dates"))


PRODUCT_HORIZON = 3
_QUARTER = "10 * year(month) + quarter(month)"


@query("product_table", f"""WITH {MONTHLY_SQL}, ids AS (SELECT DISTINCT region, nation, brand, concat(brand, '_', nation) AS id, left(brand, 7) AS dept FROM f),
c AS (SELECT *, dense_rank() OVER (ORDER BY id) - 1 AS id_enc, dense_rank() OVER (ORDER BY brand) - 1 AS item_id_enc, dense_rank() OVER (ORDER BY dept) - 1 AS dept_id_enc,
  dense_rank() OVER (ORDER BY CAST(nation AS VARCHAR)) - 1 AS store_id_enc, dense_rank() OVER (ORDER BY CAST(region AS VARCHAR)) - 1 AS state_id_enc FROM ids),
m AS (SELECT month, row_number() OVER (ORDER BY month DESC) <= {PRODUCT_HORIZON} AS ahead FROM (SELECT DISTINCT month FROM f)),
q AS (SELECT nation, brand, wk, price, row_number() OVER (PARTITION BY nation, brand ORDER BY wk) AS weeks FROM (
  SELECT n_nationkey AS nation, p_brand AS brand, {_QUARTER.replace("month", "l_shipdate")} AS wk, min(l_extendedprice) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)),
r AS (SELECT c.*, m.month, m.ahead, CASE WHEN ahead THEN 0 ELSE coalesce(y, 0) END AS sales, q.price, coalesce(q.weeks, 0) AS weeks
  FROM c CROSS JOIN m LEFT JOIN f USING (region, nation, brand, month) LEFT JOIN q ON q.nation = c.nation AND q.brand = c.brand AND q.wk = {_QUARTER.replace("month", "m.month")})
SELECT sales, CAST(month AS VARCHAR) AS date, id, id_enc, item_id_enc, dept_id_enc, 0 AS cat_id_enc, store_id_enc, state_id_enc, CAST(month(month) % 2 = 0 AS INT) AS snap_CA, CAST(month(month) % 3 = 0 AS INT) AS snap_TX, 0 AS snap_WI,
  CASE WHEN month(month) = 12 THEN 0 ELSE 1 END AS event_type_1_enc, 0 AS event_type_2_enc,
  CAST(CAST(first_value(price IGNORE NULLS) OVER (ORDER BY id_enc, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FLOAT) AS DOUBLE) AS sell_price, weeks AS weeks_on_sale FROM r""")
def _products(spark, d):
    """The product table from stand-ins: months for days, quarters for weeks, brands for items and nations for stores."""
    facts = monthly_facts(spark, d, F.min("l_extendedprice").alias("price"))
    months = [r[0] for r in facts.select("month").distinct().orderBy("month").collect()]  # a row for each month
    name = F.concat("brand", F.lit("_"), "nation")
    ids = [name.alias("id"), F.col("brand").alias("item_id"), F.substring("brand", 1, 7).alias("dept_id"), F.lit("all").alias("cat_id"), F.col("nation").cast("string").alias("store_id"), F.col("region").cast("string").alias("state_id")]
    told = facts.select(*ids, F.date_format("month", "'d_'yyyy_MM").alias("d"), "y")
    wide = told.groupBy(*prepare.IDS).pivot("d", [f"d_{m:%Y_%m}" for m in months[:-PRODUCT_HORIZON]]).agg(F.sum("y")).na.fill(0.0)
    none = F.lit(None).cast("string")
    calendar = facts.select("month").distinct().select(
        F.col("month").cast("string").alias("date"), F.date_format("month", "'d_'yyyy_MM").alias("d"), F.expr(_QUARTER).alias("wm_yr_wk"),
        none.alias("event_name_1"), F.when(F.month("month") == 12, "Holiday").alias("event_type_1"), none.alias("event_name_2"), none.alias("event_type_2"),
        (F.month("month") % 2 == 0).cast("int").alias("snap_CA"), (F.month("month") % 3 == 0).cast("int").alias("snap_TX"), F.lit(0).alias("snap_WI"),
    )
    # a quarter's least price is the least of its months'
    prices = facts.groupBy(F.col("nation").cast("string").alias("store_id"), F.col("brand").alias("item_id"), F.expr(_QUARTER).alias("wm_yr_wk")).agg(F.min("price").alias("sell_price"))
    out = prepare.product_table(calendar, wide, prices, PRODUCT_HORIZON)
    return out.withColumns({"date": F.col("date").cast("string"), "sell_price": F.col("sell_price").cast("double")})


# hierarchies

LEVELS_SQL = f"""WITH {MONTHLY_SQL}
SELECT CAST(CASE g WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 4 END AS INT) AS level_id,
CASE g WHEN 7 THEN 'Total' WHEN 3 THEN 'region' WHEN 5 THEN 'nation' WHEN 6 THEN 'brand' ELSE 'bottom' END AS aggregation,
CASE g WHEN 7 THEN 'Total' ELSE concat_ws('-', region, nation, brand) END AS value, CAST(month AS VARCHAR) AS month, y
FROM (SELECT region, nation, brand, month, sum(y) AS y, grouping(region, nation, brand) AS g FROM f
GROUP BY GROUPING SETS ((month), (month, region), (month, nation), (month, brand), (month, region, nation, brand)))"""


@query("agg_levels_grouping_sets", LEVELS_SQL)
def agg_levels_grouping_sets(spark, d):
    found = hierarchy.aggregate_by_sets(monthly_facts(spark, d), MONTHLY, ["month"], "y")
    return found.select("level_id", "aggregation", "value", F.col("month").cast("string").alias("month"), "y")


@query("agg_levels_bottom_first", LEVELS_SQL)
def _bottom_first(spark, d):
    found = hierarchy.aggregate_levels(monthly_facts(spark, d), MONTHLY, ["month"], "y")
    return found.select("level_id", "aggregation", "value", F.col("month").cast("string").alias("month"), "y")


@query("agg_levels_membership", LEVELS_SQL)
def _by_membership(spark, d):
    facts = monthly_facts(spark, d).withColumn("member", MONTHLY.key())
    found = hierarchy.aggregate_members(facts, membership(facts, MONTHLY), ["month"], "y")
    return found.select("level_id", "aggregation", "value", F.col("month").cast("string").alias("month"), "y")


@query("mean_members_levels", f"""WITH {PANEL}{CROSS}, q AS (SELECT p.member, p.date, f.price FROM p LEFT JOIN f USING (region, flag, status, date))
SELECT level_id, aggregation, value, CAST(date AS VARCHAR) AS date, round(sum(price) / any_value(n) + 1e-7, 4) AS price_avg
FROM q JOIN sc USING (member) JOIN (SELECT level_id, value, count(*) AS n FROM sc GROUP BY ALL) USING (level_id, value) GROUP BY ALL""")
def _means(spark, d):
    facts = daily_facts(spark, d).withColumn("member", DAILY.key())
    rows = daily_panel(spark, d).select("member", "date").join(facts.select("member", "date", "price"), ["member", "date"], "left")
    found = hierarchy.mean_over_members(rows, membership(facts, DAILY), ["date"], ["price"])
    return found.select("level_id", "aggregation", "value", day(), off_ties("price_avg").alias("price_avg"))


@query("membership_cs", f"WITH {PANEL}{CROSS} SELECT level_id, aggregation, value, member FROM sc")
def _sc(spark, d):
    return membership(daily_facts(spark, d), DAILY)


@query("membership_temporal", f"WITH {PANEL}{time_side('p')} SELECT level_id, aggregation, value, CAST(t AS VARCHAR) AS t FROM st")
def _st(spark, d):
    return time_membership(daily_facts(spark, d)).withColumn("t", F.col("t").cast("string"))


@query("node_counts", f"""WITH {PANEL}{CROSS}{time_side('p')} SELECT 'cross' AS side, level_id, aggregation, value, count(*) AS n_members FROM sc GROUP BY ALL
UNION ALL SELECT 'time', level_id, aggregation, value, count(*) FROM st GROUP BY ALL""")
def _sizes(spark, d):
    facts = daily_facts(spark, d)
    cross, time = node_sizes(membership(facts, DAILY)), node_sizes(time_membership(facts), "t")
    return cross.withColumn("side", F.lit("cross")).unionByName(time.withColumn("side", F.lit("time")))


@query("level_counts", f"""WITH {PANEL}{CROSS}{time_side('p')} SELECT count(DISTINCT level_id) AS n_levels, 'cross' AS side FROM sc
UNION ALL SELECT count(DISTINCT level_id), 'time' FROM st""")
def _levels(spark, d):
    facts = daily_facts(spark, d)
    cross, time = hierarchy.level_count(membership(facts, DAILY)), hierarchy.level_count(time_membership(facts))
    return cross.withColumn("side", F.lit("cross")).unionByName(time.withColumn("side", F.lit("time")))


@query("bottom_up", f"""WITH {ERRORS}{CROSS} SELECT level_id, aggregation, value, CAST(date AS VARCHAR) AS date, sum(yhat) AS yhat
FROM e JOIN sc USING (member) GROUP BY ALL""")
def _bottom_up(spark, d):
    rows = naive_errors(spark, d)
    return reconcile.bottom_up(rows, membership(rows, DAILY), ["date"]).select("level_id", "aggregation", "value", day(), "yhat")


# features

@query("lag_features", f"WITH {PANEL} SELECT member, CAST(date AS VARCHAR) AS date, y, " + ", ".join(f"lag(y, {k}) OVER w AS y_lag{k}" for k in features.LAGS) + " FROM p WINDOW w AS (PARTITION BY member ORDER BY date)")
def _lags(spark, d):
    out = features.add_lags(daily_panel(spark, d), series=("member",))
    return out.select("member", day(), "y", *[f"y_lag{k}" for k in features.LAGS])


@query("rolling_means", f"WITH {PANEL} SELECT member, CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"round(avg(l) OVER (PARTITION BY member ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS y_lag1_mavg{n}" for n in features.WINDOWS
) + " FROM (SELECT *, lag(y) OVER (PARTITION BY member ORDER BY date) AS l FROM p)")
def _rolling(spark, d):
    out = features.add_rolling_means(features.add_lags(daily_panel(spark, d), lags=(1,), series=("member",)), series=("member",))
    return out.select("member", day(), *[r6(f"y_lag1_mavg{n}").alias(f"y_lag1_mavg{n}") for n in features.WINDOWS])


@query("price_change", f"""WITH {FACTS} SELECT region, flag, status, CAST(date AS VARCHAR) AS date,
round(lag(price) OVER (PARTITION BY region, flag, status ORDER BY date) / nullif(price, 0) - 1, 6) AS price_change FROM f""")
def _price(spark, d):
    w = Window.partitionBy("region", "flag", "status").orderBy("date")
    return daily_facts(spark, d).select("region", "flag", "status", day(), r6(X.price_change(F.lag("price").over(w), F.col("price"))).alias("price_change"))


@query("dropna_features", f"""WITH {PANEL}, x AS (SELECT member, date, y, lag(y, 1) OVER w AS y_lag1, lag(y, 28) OVER w AS y_lag28, lag(y, 364) OVER w AS y_lag364 FROM p WINDOW w AS (PARTITION BY member ORDER BY date))
SELECT member, CAST(date AS VARCHAR) AS date, y, y_lag1, y_lag28, y_lag364 FROM x WHERE y_lag1 IS NOT NULL AND y_lag28 IS NOT NULL AND y_lag364 IS NOT NULL""")
def _dropna(spark, d):
    out = features.add_lags(daily_panel(spark, d), lags=(1, 28, 364), series=("member",)).na.drop("any")
    return out.select("member", day(), "y", "y_lag1", "y_lag28", "y_lag364")


def _featured(facts):
    """All nodes of the daily panel with every kind of feature; weeks on sale count the weeks with sales, a flag marks the first ten days of a month."""
    week = F.floor(F.date_diff("date", F.lit("1995-01-02").cast("date")) / 7)
    weeks = F.dense_rank().over(Window.partitionBy("region", "flag", "status").orderBy(week))
    facts = facts.withColumns({"weeks": weeks, "snap": (F.dayofmonth("date") <= 10).cast("int")})
    return features.forecast_set(facts, DAILY, price="price", weeks="weeks", per_date=["snap"])


@query("forecast_set", f"""WITH {PANEL}{CROSS}, a AS (SELECT level_id, aggregation, value, date, sum(y) AS y FROM p JOIN sc USING (member) GROUP BY ALL),
q AS (SELECT p.member, p.date, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY p.member ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(price IGNORE NULLS) OVER (PARTITION BY p.member ORDER BY p.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM p LEFT JOIN f USING (region, flag, status, date)),
pr AS (SELECT level_id, aggregation, value, date, sum(price) / any_value(n) AS price_avg FROM q JOIN sc USING (member)
JOIN (SELECT level_id, value, count(*) AS n FROM sc GROUP BY ALL) USING (level_id, value) GROUP BY ALL),
fw AS (SELECT region, flag, status, date, dense_rank() OVER (PARTITION BY region, flag, status ORDER BY date_diff('day', DATE '1995-01-02', date) // 7) AS weeks FROM f),
wk AS (SELECT level_id, value, date, sum(coalesce(weeks, 0)) / any_value(n) AS weeks_avg FROM p LEFT JOIN fw USING (region, flag, status, date) JOIN sc USING (member)
JOIN (SELECT level_id, value, count(*) AS n FROM sc GROUP BY ALL) USING (level_id, value) GROUP BY ALL),
pc AS (SELECT *, lag(price_avg) OVER (PARTITION BY aggregation, value ORDER BY date) / price_avg - 1 AS price_change FROM pr),
x AS (SELECT a.*, lag(y, 1) OVER w AS y_lag1, lag(y, 364) OVER w AS y_lag364 FROM a WINDOW w AS (PARTITION BY aggregation, value ORDER BY date)),
z AS (SELECT *, avg(y_lag1) OVER (PARTITION BY aggregation, value ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS m28 FROM x)
SELECT level_id, aggregation, value, CAST(date AS VARCHAR) AS date, y, y_lag1, y_lag364, round(m28, 6) AS y_lag1_mavg28, weekofyear(date) AS weekofyear,
round(price_avg + 1e-7, 4) AS price_avg, round(price_change, 6) AS price_change, round(weeks_avg + 1e-7, 4) AS weeks_avg, CAST(day(date) <= 10 AS INT) AS snap
FROM z JOIN pc USING (level_id, aggregation, value, date) JOIN wk USING (level_id, value, date) WHERE y_lag364 IS NOT NULL AND price_change IS NOT NULL""")
def _forecast_set(spark, d):
    out = _featured(daily_facts(spark, d))
    return out.select("level_id", "aggregation", "value", day(), "y", "y_lag1", "y_lag364", r6("y_lag1_mavg28").alias("y_lag1_mavg28"), F.col("weekofyear").cast("long"), off_ties("price_avg").alias("price_avg"), r6("price_change").alias("price_change"), off_ties("weeks_avg").alias("weeks_avg"), "snap")


# the loss

GRAD_C = ", ea AS (SELECT level_id, value, date, sum(e) AS s FROM e JOIN sc USING (member) GROUP BY ALL)"


@query("hessian_cs", f"WITH {PANEL}{CROSS} SELECT member, round(sum(d), 9) AS hess FROM sc JOIN dc USING (level_id, value) GROUP BY ALL")
def _hess_c(spark, d):
    facts = daily_facts(spark, d).withColumn("member", DAILY.key())
    members = facts.select("member").distinct().withColumn("t", F.lit(0))
    return loss.hessian(members, membership(facts, DAILY), None).select("member", F.round("hess", 9).alias("hess"))


@query("hessian_both", f"""WITH {ERRORS}{CROSS}{time_side('e')}, hc AS (SELECT member, sum(d) AS h FROM sc JOIN dc USING (level_id, value) GROUP BY ALL),
ht AS (SELECT t, sum(d) AS h FROM st JOIN dt USING (level_id, value) GROUP BY ALL)
SELECT e.member, CAST(e.date AS VARCHAR) AS date, round(hc.h * ht.h, 9) AS hess FROM e JOIN hc USING (member) JOIN ht ON ht.t = e.date""")
def _hess_b(spark, d):
    e = naive_errors(spark, d).withColumnRenamed("date", "t")
    times = time_membership(e.withColumnRenamed("t", "date"))
    return loss.hessian(e, membership(e, DAILY), times).select("member", day("t"), F.round("hess", 9).alias("hess"))


@query("gradient_cs", f"""WITH {ERRORS}{CROSS}{GRAD_C} SELECT sc.member, CAST(date AS VARCHAR) AS date, round(sum(s * d), 6) + 0.0 AS grad
FROM ea JOIN dc USING (level_id, value) JOIN sc USING (level_id, value) GROUP BY ALL""")
def _grad_c(spark, d):
    e = naive_errors(spark, d)
    return loss.gradient(e, membership(e, DAILY), None, time="date").select("member", day(), r6("grad").alias("grad"))


@query("gradient_temporal", f"""WITH {ERRORS}{time_side('e')}, eb AS (SELECT member, level_id, value, sum(e) AS s FROM e JOIN st ON st.t = e.date GROUP BY ALL)
SELECT member, CAST(t AS VARCHAR) AS date, round(sum(s * d), 6) + 0.0 AS grad FROM eb JOIN dt USING (level_id, value) JOIN st USING (level_id, value) GROUP BY ALL""")
def _grad_t(spark, d):
    e = naive_errors(spark, d).withColumnRenamed("date", "t")
    return loss.gradient(e, None, time_membership(e.withColumnRenamed("t", "date"))).select("member", day("t"), r6("grad").alias("grad"))


@query("gradient_both", f"""WITH {ERRORS}{CROSS}{time_side('e')}, eb AS (SELECT member, level_id AS lt, value AS vt, sum(e) AS s FROM e JOIN st ON st.t = e.date GROUP BY ALL),
ea AS (SELECT level_id, value, lt, vt, sum(s) AS s FROM eb JOIN sc USING (member) GROUP BY ALL),
back AS (SELECT member, lt, vt, sum(s * d) AS s FROM ea JOIN dc USING (level_id, value) JOIN sc USING (level_id, value) GROUP BY ALL)
SELECT member, CAST(t AS VARCHAR) AS date, round(sum(s * d), 6) + 0.0 AS grad FROM back JOIN dt ON lt = dt.level_id AND vt = dt.value
JOIN st ON lt = st.level_id AND vt = st.value GROUP BY ALL""")
def _grad_b(spark, d):
    e = naive_errors(spark, d).withColumnRenamed("date", "t")
    times = time_membership(e.withColumnRenamed("t", "date"))
    return loss.gradient(e, membership(e, DAILY), times).select("member", day("t"), r6("grad").alias("grad"))


@query("hmse_metric", f"""WITH {ERRORS}{CROSS}{GRAD_C} SELECT round(sum(0.5 * s * s * d) / (SELECT count(DISTINCT member) * count(DISTINCT date) FROM e), 6) AS hmse
FROM ea JOIN dc USING (level_id, value)""")
def _hmse(spark, d):
    e = naive_errors(spark, d)
    return loss.metric(e, membership(e, DAILY), None, time="date").select(r6("hmse").alias("hmse"))


@query("hmse_metric_both", f"""WITH {ERRORS}{CROSS}{time_side('e')}, ea AS (SELECT sc.level_id AS lc, sc.value AS vc, st.level_id AS lt, st.value AS vt, sum(e) AS s
FROM e JOIN sc USING (member) JOIN st ON st.t = e.date GROUP BY ALL)
SELECT round(sum(0.5 * s * s * dc.d * dt.d) / (SELECT count(DISTINCT member) * count(DISTINCT date) FROM e), 6) AS hmse
FROM ea JOIN dc ON lc = dc.level_id AND vc = dc.value JOIN dt ON lt = dt.level_id AND vt = dt.value""")
def _hmse_b(spark, d):
    e = naive_errors(spark, d).withColumnRenamed("date", "t")
    times = time_membership(e.withColumnRenamed("t", "date"))
    return loss.metric(e, membership(e, DAILY), times).select(r6("hmse").alias("hmse"))


RANDOM_SQL = """, rm AS (SELECT DISTINCT member FROM p), rp AS (SELECT 1 + CAST('0x' || substr(md5('3:0:levels'), 1, 8) AS BIGINT) % 10 AS n),
rl AS (SELECT i, 2 + CAST('0x' || substr(md5('3:0:size:' || i), 1, 8) AS BIGINT) % 99 AS size FROM rp, unnest(range(1, n + 1)) u(i)),
rs AS (SELECT 0 AS level_id, 'Total' AS aggregation, 'Total' AS value, member FROM rm
UNION ALL SELECT i, 'random' || i, CAST(CAST('0x' || substr(md5('3:0:' || i || ':' || member), 1, 8) AS BIGINT) % size AS VARCHAR), member FROM rm, rl
UNION ALL SELECT n + 1, 'bottom', member, member FROM rm, rp),
rd AS (SELECT level_id, value, 1.0::DOUBLE / ((SELECT n + 2 FROM rp) * count(*)) AS d FROM rs GROUP BY 1, 2)"""


@query("random_membership", f"WITH {PANEL}{RANDOM_SQL} SELECT CAST(level_id AS INT) AS level_id, aggregation, value, member FROM rs")
def _random_sc(spark, d):
    return loss.random_membership(daily_panel(spark, d), 10, 100, seed=3)


@query("random_gradient", f"""WITH {ERRORS}{RANDOM_SQL}, ra AS (SELECT level_id, value, date, sum(e) AS s FROM e JOIN rs USING (member) GROUP BY ALL)
SELECT member, CAST(date AS VARCHAR) AS date, round(sum(s * d), 6) + 0.0 AS grad, round(sum(d), 9) AS hess
FROM ra JOIN rd USING (level_id, value) JOIN rs USING (level_id, value) GROUP BY ALL""")
def _random(spark, d):
    found = loss.random_gradient(naive_errors(spark, d), 10, 100, 1, seed=3, draw=0, time="date")
    return found.select("member", day(), r6("grad").alias("grad"), F.round("hess", 9).alias("hess"))


@query("tweedie_grad_hess", f"""WITH {ERRORS} SELECT member, CAST(date AS VARCHAR) AS date,
round(exp(0.5 * ln(1 + yhat)) - y * exp(-0.5 * ln(1 + yhat)), 6) + 0.0 AS grad, round(0.5 * exp(0.5 * ln(1 + yhat)) + 0.5 * y * exp(-0.5 * ln(1 + yhat)), 6) AS hess FROM e""")
def _tweedie(spark, d):
    rows = loss.tweedie(naive_errors(spark, d).withColumn("raw", F.log(1 + F.col("yhat"))), 1.5)
    return rows.select("member", day(), r6("grad").alias("grad"), r6("hess").alias("hess"))


# reconciliation

@query("reconcile_tree", f"""WITH {ERRORS}, w AS (SELECT member, avg(e * e) AS w FROM e GROUP BY 1), s AS (SELECT date, sum(yhat) AS s, sum(y) AS t FROM e GROUP BY 1)
SELECT member, CAST(date AS VARCHAR) AS date, round(yhat + w.w * (t - s) / (100 + (SELECT sum(w) FROM w)), 6) + 0.0 AS yhat FROM e JOIN w USING (member) JOIN s USING (date)""")
def _tree(spark, d):
    e = naive_errors(spark, d)
    weights = e.groupBy("member").agg(F.avg(F.col("e") * F.col("e")).alias("w"))
    total = e.groupBy("date").agg(F.sum("y").alias("yhat"))
    one = spark.createDataFrame([(100.0,)], "w_total double")
    return reconcile.reconcile_tree(e.select("member", "date", "yhat"), total, weights, one).select("member", day(), r6("yhat").alias("yhat"))


def _all_nodes(spark, d):
    """Actuals and incoherent forecasts of every node by month: bottom seasonal naive, other levels their mean with the actual."""
    rows = monthly_panel(spark, d)
    e = baselines.in_sample_seasonal(rows, ["member"], 12).where("yhat is not null")
    sc = membership(rows, MONTHLY)
    sums = e.join(sc, "member").groupBy("level_id", "aggregation", "value", "date").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    return cut_lineage(sums.withColumn("yhat", F.when(F.col("level_id") == 4, F.col("yhat")).otherwise((F.col("yhat") + F.col("y")) / 2))), written(sc, "memberships")


def _reconciled(method):
    def run(spark, d):
        nodes, sc = _all_nodes(spark, d)
        out = reconcile.reconcile(spark, nodes, sc, method, nodes.where(F.year("date") < 2001))
        return out.select("level_id", "aggregation", "value", day(), F.round("yhat", 4).alias("yhat"))

    return run


for _m in reconcile.METHODS:
    query(f"reconcile_{_m}")(_reconciled(_m))

#: The closed form of a tree of two levels: what a member takes of the gap between the total and the sum.
_SHARES = {"ols": "1.0 / (1 + n)", "wls_struct": "1.0 / (n + n)", "wls_var": "w / (wt + ws)"}


def _reconciled_tree(method):
    def run(spark, d):
        e = naive_errors(spark, d)
        sc = written(membership(e, hierarchy.Hierarchy.of([], ["region", "flag", "status"])), "memberships")
        sums = e.join(sc, "member").groupBy("level_id", "aggregation", "value", "date").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
        nodes = cut_lineage(sums.withColumn("yhat", F.when(F.col("level_id") == 1, F.col("yhat")).otherwise((F.col("yhat") + F.col("y")) / 2)))
        out = reconcile.reconcile(spark, nodes, sc, method, nodes)
        return out.select("aggregation", "value", day(), off_ties("yhat").alias("yhat"))

    return run


for _m, _share in _SHARES.items():
    query(f"reconcile_two_levels_{_m}", f"""WITH {ERRORS}, t AS (SELECT date, sum(yhat) AS s, (sum(yhat) + sum(y)) / 2 AS total, sum(y) AS y FROM e GROUP BY 1),
k AS (SELECT count(DISTINCT member) AS n, (SELECT avg((total - y) ** 2) FROM t) AS wt, (SELECT sum(w) FROM (SELECT avg(e * e) AS w FROM e GROUP BY member)) AS ws FROM e),
w AS (SELECT member, avg(e * e) AS w FROM e GROUP BY 1), b AS (SELECT member, date, yhat + (total - s) * {_share} AS yhat FROM e JOIN w USING (member) JOIN t USING (date), k)
SELECT 'bottom' AS aggregation, member AS value, CAST(date AS VARCHAR) AS date, round(yhat + 1e-7, 4) AS yhat FROM b
UNION ALL SELECT 'Total', 'Total', CAST(date AS VARCHAR), round(sum(yhat) + 1e-7, 4) FROM b GROUP BY date""")(_reconciled_tree(_m))


# baselines

@query("naive_forecast", f"WITH {PANEL} SELECT member, CAST(step AS INT) AS step, yhat FROM (SELECT member, arg_max(y, date) AS yhat FROM p GROUP BY 1), unnest(range(1, 29)) u(step)")
def _naive(spark, d):
    return baselines.naive(daily_panel(spark, d), ["member"], 28).select("member", "step", "yhat")


@query("seasonal_naive", f"""WITH {PANEL}, b AS (SELECT member, y, row_number() OVER (PARTITION BY member ORDER BY date DESC) AS back FROM p)
SELECT b.member, CAST(step AS INT) AS step, y AS yhat FROM b, unnest(range(1, 29)) u(step) WHERE back = 7 - (step - 1) % 7""")
def _seasonal(spark, d):
    return baselines.seasonal_naive(daily_panel(spark, d), ["member"], 28).select("member", "step", "yhat")


def _classical(name):
    def run(spark, d):
        rows = hierarchy.aggregate_levels(daily_panel(spark, d), DAILY, ["date"], "y")
        return baselines.classical(rows, name, 28, fitted=name == "ets").withColumn("yhat", F.round("yhat", 4))

    return run


for _m in baselines.MODELS:
    query(f"classical_{_m}")(_classical(_m))


# evaluation

def _scored(spark, d):
    """Pairs of two methods at all levels: seasonal naive and the last value."""
    p = daily_panel(spark, d)
    w = Window.partitionBy("member").orderBy("date")
    rows = p.withColumns({"seasonal": F.lag("y", 7).over(w), "naive": F.lag("y", 1).over(w)}).where("seasonal is not null")
    sums = rows.join(membership(p, DAILY), "member").groupBy("level_id", "aggregation", "value", "date").agg(*[F.sum(c).alias(c) for c in ("y", "seasonal", "naive")])
    return sums.unpivot(["aggregation", "value", "date", "y"], ["seasonal", "naive"], "method", "yhat")


SCORED = PANEL + CROSS + """, s0 AS (SELECT aggregation, value, date, sum(y) AS y, sum(seasonal) AS seasonal, sum(naive) AS naive
FROM (SELECT *, lag(y, 7) OVER w AS seasonal, lag(y, 1) OVER w AS naive FROM p WINDOW w AS (PARTITION BY member ORDER BY date)) JOIN sc USING (member) WHERE seasonal IS NOT NULL GROUP BY ALL),
s AS (SELECT aggregation, value, date, y, 'seasonal' AS method, seasonal AS yhat FROM s0 UNION ALL SELECT aggregation, value, date, y, 'naive', naive FROM s0)"""
_KINDS = {
    "rmse": "sqrt(avg((yhat - y) ** 2))",
    "mae": "avg(abs(yhat - y))",
    "smape": "200 * avg(CASE WHEN abs(yhat) + abs(y) = 0 THEN 0 ELSE abs(yhat - y) / (abs(yhat) + abs(y)) END)",
}


def _level(kind):
    def run(spark, d):
        return evaluate.level_errors(_scored(spark, d), kind).withColumn(kind, r6(kind))

    return run


for _k, _e in _KINDS.items():
    query(f"level_{_k}", f"WITH {SCORED} SELECT method, aggregation, round({_e}, 6) AS {_k} FROM s GROUP BY ALL UNION ALL SELECT method, 'All series', round({_e}, 6) FROM s GROUP BY ALL")(_level(_k))

SEEDS = SCORED + ", z AS (SELECT method AS scenario, aggregation, year(date) AS seed, sqrt(avg((yhat - y) ** 2)) AS rmse FROM s GROUP BY ALL)"


@query("seed_mean_std", f"WITH {SEEDS} SELECT scenario, aggregation, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std, count(*) AS n_seeds FROM z GROUP BY ALL")
def _seeds(spark, d):
    rows = _scored(spark, d).withColumn("seed", F.year("date"))
    errors = evaluate.level_errors(rows, "rmse", ("method", "seed")).where("aggregation <> 'All series'").withColumnRenamed("method", "scenario")
    return evaluate.over_seeds(errors, "rmse").select("scenario", "aggregation", r6("mean").alias("mean"), r6("std").alias("std"), "n_seeds")


@query("seed_mean_by_method", f"WITH {SEEDS} SELECT scenario, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std, count(*) AS n_seeds FROM z GROUP BY ALL")
def _method_means(spark, d):
    rows = _scored(spark, d).withColumn("seed", F.year("date"))
    errors = evaluate.level_errors(rows, "rmse", ("method", "seed")).where("aggregation <> 'All series'").withColumnRenamed("method", "scenario")
    return evaluate.over_seeds(errors, "rmse", ("scenario",)).select("scenario", r6("mean").alias("mean"), r6("std").alias("std"), "n_seeds")


@query("training_window", f"WITH {PANEL} SELECT member, CAST(date AS VARCHAR) AS date, y FROM p WHERE date BETWEEN (SELECT max(date) FROM p) - 366 AND (SELECT max(date) FROM p)")
def _window(spark, d):
    rows = daily_panel(spark, d)
    last = rows.agg(F.max("date")).first()[0]
    return boost.training_window(rows, last, 1).select("member", day(), "y")


@query("missing_seeds", f"""WITH {SCORED} SELECT method AS scenario, CAST(seed AS INT) AS seed FROM (SELECT DISTINCT method FROM s), unnest(range(1990, 2010)) u(seed)
EXCEPT SELECT method, year(date) FROM s""")
def _missing(spark, d):
    rows = _scored(spark, d).withColumn("seed", F.year("date"))
    errors = evaluate.level_errors(rows, "rmse", ("method", "seed")).withColumnRenamed("method", "scenario")
    expected = errors.select("scenario").distinct().select("scenario", F.explode(F.sequence(F.lit(1990), F.lit(2009))).alias("seed"))
    return evaluate.missing_seeds(errors, expected)


@query("daily_rmse_7d", f"""WITH {SCORED}, d AS (SELECT method, date, sqrt(avg((yhat - y) ** 2)) AS r FROM s GROUP BY ALL), x AS (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM s))
SELECT method, CAST(i // 7 AS BIGINT) AS period, round(avg(r), 6) AS rmse FROM d JOIN x USING (date) GROUP BY ALL""")
def _weekly(spark, d):
    return evaluate.weekly_rmse(_scored(spark, d)).select("method", F.col("period").cast("long").alias("period"), r6("rmse").alias("rmse"))


@query("relative_error", f"""WITH {SCORED}, z AS (SELECT method, aggregation, sqrt(avg((yhat - y) ** 2)) AS r FROM s GROUP BY ALL UNION ALL SELECT method, 'All series', sqrt(avg((yhat - y) ** 2)) FROM s GROUP BY ALL)
SELECT a.method, aggregation, round(a.r / b.r, 6) AS relative_rmse FROM z a JOIN z b USING (aggregation) WHERE b.method = 'seasonal'""")
def _relative(spark, d):
    out = evaluate.relative_to(evaluate.level_errors(_scored(spark, d), "rmse"), "seasonal")
    return out.withColumn("relative_rmse", r6("relative_rmse"))


@query("errors_by_level", f"""WITH {SCORED} SELECT method, round(sqrt(avg((yhat - y) ** 2) FILTER (aggregation = 'Total')), 6) AS "Total", round(sqrt(avg((yhat - y) ** 2) FILTER (aggregation = 'region')), 6) AS region,
round(sqrt(avg((yhat - y) ** 2) FILTER (aggregation = 'bottom')), 6) AS bottom FROM s GROUP BY ALL""")
def _by_level(spark, d):
    wide = evaluate.by_level(evaluate.level_errors(_scored(spark, d), "rmse"), "rmse", ["Total", "region", "bottom"])
    return wide.select("method", *[r6(c).alias(c) for c in ("Total", "region", "bottom")])


@query("sales_buckets", f"""WITH {SCORED}, w AS (SELECT aggregation, value, 7 * avg(y) AS k FROM s WHERE method = 'naive' GROUP BY ALL), r AS (SELECT method, aggregation, value, sqrt(avg((yhat - y) ** 2)) AS r FROM s GROUP BY ALL)
SELECT method, CASE WHEN k <= 1 THEN '<=1' WHEN k <= 10 THEN '<=10' WHEN k <= 100 THEN '<=100' WHEN k <= 500 THEN '<=500' ELSE '>500' END AS bucket, round(avg(r), 6) AS rmse, count(*) AS n FROM r JOIN w USING (aggregation, value) GROUP BY ALL""")
def _buckets(spark, d):
    rows = _scored(spark, d)
    return evaluate.bucketed_rmse(rows, rows.where("method = 'naive'")).withColumn("rmse", r6("rmse"))


# learning

@query("cv_folds", """SELECT CAST(i AS INT) AS fold, CAST(m - 28 * i - 1098 AS VARCHAR) AS train_start, CAST(m - 28 * i AS VARCHAR) AS train_end, CAST(m - 28 * i + 1 AS VARCHAR) AS test_start,
CAST(m - 28 * i + 28 AS VARCHAR) AS test_end FROM (SELECT max(CAST(l_shipdate AS DATE)) AS m FROM lineitem), (SELECT unnest(range(1, 7))::INT AS i)""")
def _folds(spark, d):
    found = boost.folds(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))
    return found.select("fold", *[F.col(c).cast("string").alias(c) for c in found.columns[1:]])


@query("lag_recursion", f"""WITH {PANEL}, b AS (SELECT member, y, row_number() OVER (PARTITION BY member ORDER BY date DESC) AS k FROM p),
d1 AS (SELECT member, sum(y) / count(*) AS m, max(y) FILTER (k = 1) AS last FROM b WHERE k <= 7 GROUP BY 1),
e1 AS (SELECT *, CASE WHEN m <= 30 THEN 1.25 ELSE 40.0 END + CASE WHEN last <= 20 THEN 0.5 ELSE -0.25 END AS y1 FROM d1), d2 AS (SELECT *, m + (y1 - m) / 7 AS m2 FROM e1),
e2 AS (SELECT *, CASE WHEN m2 <= 30 THEN 1.25 ELSE 40.0 END + CASE WHEN y1 <= 20 THEN 0.5 ELSE -0.25 END AS y2 FROM d2), d3 AS (SELECT *, m2 + (y2 - m2) / 7 AS m3 FROM e2),
e3 AS (SELECT *, CASE WHEN m3 <= 30 THEN 1.25 ELSE 40.0 END + CASE WHEN y2 <= 20 THEN 0.5 ELSE -0.25 END AS y3 FROM d3)
SELECT member, '2002-01-01' AS date, round(y1, 6) AS yhat FROM e1 UNION ALL SELECT member, '2002-01-02', round(y2, 6) FROM e2 UNION ALL SELECT member, '2002-01-03', round(y3, 6) FROM e3""")
def _recursion(spark, d):
    """Three days of a model of two stumps, one on the recursive mean and one on the last value."""
    stump = lambda j, low, high: trees.Tree(
        np.array([j, -1, -1]), np.arange(trees.MOST_BINS)[None, :] <= np.array([[1], [-1], [-1]]), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, low, high])
    )
    binner = trees.Binner([np.array([30.0]), np.array([20.0])], [False, False])
    model = boost.Booster(boost.Params(rate=1.0), ["y_lag1_mavg7", "y_lag1"], 0.0, binner, [stump(0, 1.25, 40.0), stump(1, 0.5, -0.25)])
    days = [dt.date(2002, 1, i) for i in (1, 2, 3)]
    return boost.recursive_predict(model, daily_panel(spark, d), None, days, ["member"]).select("member", day(), r6("yhat").alias("yhat"))


@query("boost_bin_sums", f"""WITH {ERRORS}{CROSS}{GRAD_C}, g AS (SELECT sc.member, date, sum(s * d) AS grad, sum(d) AS hess FROM ea JOIN dc USING (level_id, value) JOIN sc USING (level_id, value) GROUP BY ALL)
SELECT CAST(isodow(date) AS BIGINT) AS dayofweek, count(*) AS n, round(sum(grad), 4) + 0.0 AS grad, round(sum(hess), 6) AS hess FROM g GROUP BY ALL""")
def _bin_sums(spark, d):
    """What a boosting round sums up at the root: gradient and hessian of the hierarchical loss by bin of a categorical feature."""
    e = features.add_calendar(naive_errors(spark, d), parts=("dayofweek",))
    sc = membership(e, DAILY)
    binner = trees.fit_binner(e, ["dayofweek"], ("dayofweek",), 16)
    step = trees.binned(e, ["dayofweek"], binner, ["member", "date"]).join(loss.gradient(e, sc, None, time="date"), ["member", "date"]).join(loss.hessian(e, sc, None, time="date"), ["member", "date"])
    sums = trees.node_sums(step.withColumn("fold", F.lit(0)), {0: trees.Growth().tree({})}, {0: [0]}, 1, 16)[0, 0][0]
    rows = [(int(code), int(n), round(float(g), 4) + 0.0, round(float(h), 6)) for code, (n, g, h) in zip(binner.cuts[0], sums[1:], strict=False)]  # a row for each bin
    return spark.createDataFrame(rows, "dayofweek long, n long, grad double, hess double")


FEATURES = [*(f"y_lag{k}" for k in features.LAGS), *(f"y_lag1_mavg{n}" for n in features.WINDOWS), "dayofweek", "dayofmonth", "weekofyear", "monthofyear", "price_avg", "price_change", "weeks_avg", "snap", "aggregation_enc", "value_enc"]
CATEGORIES = ("dayofweek", "dayofmonth", "weekofyear", "monthofyear", "snap", "aggregation_enc", "value_enc")
HORIZON = 28
#: The rounds and folds of the registered experiments; README states them beside the original's.
ROUNDS = boost.Params(rounds=6, rate=0.3, leaves=20, depth=5, patience=2)
N_FOLDS = 1


def _forecast_rows(facts):
    """Targets and features of every node of the daily panel, the last day to train on, and the days ahead."""
    spark = facts.sparkSession
    rows = features.label_encoded(cut_lineage(_featured(facts)), ["aggregation", "value"])
    rows = cut_lineage(rows.withColumns({f: F.col(f).cast("double") for f in FEATURES}))
    last = rows.agg(F.max("date").alias("x")).first()["x"]
    days = [r[0] for r in spark.range(HORIZON).select(F.date_sub(F.lit(last), HORIZON - 1 - F.col("id").cast("int"))).collect()]
    return rows, days


def _experiment(spark, d, name):
    """A named experiment's forecasts and seconds, the rows that it was given, and its cross-sectional membership."""
    facts = daily_facts(spark, d)
    rows, days = _forecast_rows(facts)
    end = days[0] - dt.timedelta(days=1)
    train = rows.where(F.col("date") <= F.lit(end))
    folds, sc = boost.folds(train, N_FOLDS, HORIZON).collect(), membership(facts, DAILY)
    return *boost.run_experiment(name, rows, FEATURES, ROUNDS, sc, time_membership(train), end, days, fold_rows=folds, categories=CATEGORIES), rows, sc


def _boosted(name):
    def run(spark, d):
        out = _experiment(spark, d, name)[0]
        return out.select("method", "aggregation", "value", day(), "in_sample", F.round("yhat", 6).alias("yhat"), "rounds", r6("score").alias("score"))

    return run


for _m in boost.EXPERIMENTS:
    query(f"boost_{_m}")(_boosted(_m))


@query("recursive_forecast")
def _recursive(spark, d):
    rows, days = _forecast_rows(daily_facts(spark, d))
    bottom = rows.where("aggregation = 'bottom'")
    train = bottom.where(F.col("date") < F.lit(days[0]))
    model = boost.fit(boost.training_window(train, days[0]), FEATURES, ROUNDS, key="value", categories=CATEGORIES)
    out = boost.recursive_predict(model, train, bottom, days, ["value"])
    return out.select(F.col("value").alias("member"), day(), F.round("yhat", 6).alias("yhat"))


TRIPS = hierarchy.Hierarchy.of([["station_group"], ["station"]], ["station_group", "station"])
TRIP_LAGS, TRIP_WINDOWS = (1, 2, 3, 7), (7,)


@query("mobility_errors")
def _mobility(spark, d):
    """Trips by station and day, two models, errors by level: one with the hierarchical loss, one with the plain one.

    Events stand in for trips: a station is an event type with a number, and their 30
    days allow lags up to 7 and a test of the last week.  Test rows are predicted from their features.
    """
    events = table(spark, d, "events").withColumn("station_id", F.concat_ws("-", "event_type", F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")))
    trips = events.groupBy(F.to_date("ts").alias("date"), X.replace_in_order(F.col("station_id"), X.STATION_NAMES).alias("station_id")).agg(F.count("value").alias("y"))
    trips = trips.select("date", F.col("y").cast("double").alias("y"), X.part_of(F.col("station_id"), 1).alias("station_group"), X.part_of(F.col("station_id"), 2).alias("station"))
    dense = features.dense_panel(trips, list(TRIPS.bottom), "date", "y")
    panel = hierarchy.aggregate_levels(dense, TRIPS, ["date"], "y")
    panel = features.add_rolling_means(features.add_lags(panel, lags=TRIP_LAGS), windows=TRIP_WINDOWS)
    panel = cut_lineage(features.add_calendar(panel, parts=("dayofweek", "dayofmonth")).na.drop("any"))
    first_test = panel.agg(F.date_sub(F.max("date"), 6)).first()[0]
    bottom = panel.where("aggregation = 'bottom'").withColumnRenamed("value", "member")
    train, test = bottom.where(F.col("date") < F.lit(first_test)), bottom.where(F.col("date") >= F.lit(first_test))
    sc, names = membership(trips, TRIPS), [*(f"y_lag{k}" for k in TRIP_LAGS), "y_lag1_mavg7", "dayofweek", "dayofmonth"]
    sums = []
    for method, objective in (("hmse", boost.Objective.HIERARCHICAL), ("mse", boost.Objective.L2)):
        model = boost.fit(train, names, boost.Params(objective=objective, rounds=8, rate=0.3, depth=3), sc)
        sums.append(reconcile.bottom_up(model.predict(test).select("member", "date", "yhat"), sc, ["date"]).withColumn("method", F.lit(method)))
    scored = sums[0].unionByName(sums[1]).join(panel.select("aggregation", "value", "date", "y"), ["aggregation", "value", "date"])
    found = [evaluate.level_errors(scored, kind) for kind in ("rmse", "mae", "smape")]
    wide = found[0].join(found[1], ["method", "aggregation"]).join(found[2], ["method", "aggregation"])
    return wide.select("method", "aggregation", *[r6(k).alias(k) for k in ("rmse", "mae", "smape")])


@query("tune_best")
def _tune(spark, d):
    rows, days = _forecast_rows(daily_facts(spark, d))
    bottom = rows.where((F.col("aggregation") == "bottom") & (F.col("date") < F.lit(days[0])))
    found = boost.study(bottom, FEATURES, ROUNDS, 3, boost.folds(bottom, 2, HORIZON).collect(), key="value", categories=CATEGORIES)
    return spark.createDataFrame([(p.leaves, p.l1, p.l2, s, r) for p, s, r in found], "leaves int, l1 double, l2 double, score double, best_round int")
