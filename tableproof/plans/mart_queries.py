"""Registered queries: the analytical marts, report tiles and read models.

Stand-ins: lines = lineitem, sales = orders, products = part, stores and regions =
nation and region of the customer, web events = events. Lines are combined per order
before they meet the orders, so that a distinct count of orders becomes a plain count
and only combined rows are shuffled again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tableproof.functions.money import discount_amount, gross, money, net
from tableproof.operators.filters import delta_window
from tableproof.operators.merge import sessionize
from tableproof.plans.registry import query
from tableproof.session import tasks_for
from tableproof.sources.tables import read_table, sync_read_model

#: Lines of which one task makes distinct pairs of part and supplier.
_OFFERS_PER_TASK = 500_000

_GROSS = "CAST(l_extendedprice AS DECIMAL(12,2))"
_DISC = "CAST(l_discount AS DECIMAL(4,2))"
_NET = f"{_GROSS} * (CAST(1 AS DECIMAL(4,2)) - {_DISC})"


def _money(sql: str) -> str:
    return f"CAST(round({sql}, 2) AS DECIMAL(18,2))"


def order_lines(spark, d) -> DataFrame:
    """One row per order with lines: gross, discount, net, units (unrounded)."""
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(gross()).alias("gross"),
        F.sum(discount_amount()).alias("discount"),
        F.sum(net()).alias("net"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
    )


def sold_orders(spark, d) -> DataFrame:
    """Orders that have lines, with their totals and day."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("cal_date"))
    return o.join(order_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def customer_region(spark, d) -> DataFrame:
    """Customer key, name, segment and region."""
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "c_mktsegment", F.col("n_name").alias("city"), F.col("r_name").alias("region"))
    )


_ORDER_LINES = f"""
ol AS (SELECT l_orderkey, sum({_GROSS}) AS gross, sum({_GROSS} * {_DISC}) AS discount, sum({_NET}) AS net,
              CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
       FROM lineitem GROUP BY l_orderkey)"""
_REGION = """
cr AS (SELECT c_custkey, c_name, c_mktsegment, n_name AS city, r_name AS region
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _totals(amount: str) -> str:
    return f"""
SELECT l_orderkey, sum({_NET}) AS {amount}, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
FROM lineitem GROUP BY l_orderkey"""


@query("order_totals", f"SELECT l_orderkey, {_money('order_total')} AS order_total, units FROM ({_totals('order_total')})")
def order_totals(spark, d):
    return order_lines(spark, d).select("l_orderkey", money(F.col("net")).alias("order_total"), "units")


@query("sale_totals", f"""
SELECT o_orderkey, o_custkey, {_money('net_amount')} AS net_amount, units
FROM orders JOIN ({_totals('net_amount')}) t ON o_orderkey = l_orderkey
""")
def sale_totals(spark, d):
    return sold_orders(spark, d).select("o_orderkey", "o_custkey", money(F.col("net")).alias("net_amount"), "units")


@query("product_catalog", """
SELECT DISTINCT p_partkey, p_name, p_type AS category, s_name AS supplier, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
""")
def product_catalog(spark, d):
    # Only narrow rows are made distinct: parts, and names of their suppliers. Joined on the part they repeat no row.
    pairs = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    n = tasks_for(pairs, _OFFERS_PER_TASK)
    offers = pairs.repartition(n, "l_partkey", "l_suppkey").distinct()
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    names = offers.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "supplier").repartition(n, "l_partkey").distinct()
    p = read_table(spark, d, "part").select(
        "p_partkey", "p_name", F.col("p_type").alias("category"), F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price")
    ).distinct()
    return names.join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "category", "supplier", "unit_price")


@query("daily_sales_category", f"""
SELECT CAST(o_orderdate AS DATE) AS order_date, p_type AS category, count(DISTINCT o_orderkey) AS orders,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, {_money(f'sum({_NET})')} AS revenue
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
GROUP BY 1, 2
""")
def daily_sales_category(spark, d):
    lines = read_table(spark, d, "lineitem").join(
        read_table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category")), F.col("l_partkey") == F.col("p_partkey")
    )
    per_order = lines.groupBy("l_orderkey", "category").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"), F.sum(net()).alias("net")
    )
    days = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return per_order.join(days, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("order_date", "category").agg(
        F.count("*").alias("orders"), F.sum("units").alias("units"), money(F.sum("net")).alias("revenue")
    )


@query("active_customers", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def active_customers(spark, d):
    buyers = read_table(spark, d, "orders").select("o_custkey").distinct()
    return read_table(spark, d, "customer").join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        "c_custkey", "c_name", "c_mktsegment"
    )


def sales_by_day(spark, d) -> DataFrame:
    return (
        sold_orders(spark, d).join(customer_region(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("cal_date", "region").agg(
            F.count("*").alias("order_count"),
            money(F.sum("gross")).alias("gross_amount"),
            money(F.sum("discount")).alias("discount_amount"),
            money(F.sum("net")).alias("net_amount"),
        )
    )


_SALES_BY_DAY = f"""
SELECT CAST(o_orderdate AS DATE) AS cal_date, region, count(DISTINCT o_orderkey) AS order_count,
       {_money(f'sum({_GROSS})')} AS gross_amount, {_money(f'sum({_GROSS} * {_DISC})')} AS discount_amount,
       {_money(f'sum({_NET})')} AS net_amount
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN (SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey) c ON c_custkey = o_custkey
GROUP BY 1, 2"""


@query("sales_by_day_region", _SALES_BY_DAY)
def sales_by_day_region(spark, d):
    return sales_by_day(spark, d)


def customer_value(spark, d) -> DataFrame:
    """Orders are combined per customer before the join: a hot customer is one row in it."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    per = o.join(order_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("net").alias("net"), F.max("day").alias("last_order_date")
    )
    return customer_region(spark, d).join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "region", F.col("c_mktsegment").alias("segment"),
        F.coalesce("n", F.lit(0)).alias("orders_count"),
        money(F.coalesce("net", F.lit(0).cast("decimal(28,4)"))).alias("lifetime_net"),
        "last_order_date",
    )


_CUSTOMER_360 = f"""
SELECT c_custkey, c_name, region, c_mktsegment AS segment, count(DISTINCT o_orderkey) AS orders_count,
       {_money(f'coalesce(sum({_NET}), 0)')} AS lifetime_net, max(CAST(o_orderdate AS DATE)) AS last_order_date
FROM (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN (SELECT r_regionkey, r_name AS region FROM region) r ON n_regionkey = r_regionkey) c
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_custkey, c_name, region, c_mktsegment"""


@query("customer_360", _CUSTOMER_360)
def customer_360(spark, d):
    return customer_value(spark, d)


def part_sales(spark, d) -> DataFrame:
    per = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units_sold"), money(F.sum(net())).alias("net_amount")
    )
    return read_table(spark, d, "part").join(per, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_partkey", "p_name", F.col("p_type").alias("category"), "units_sold", "net_amount"
    )


_PART_SALES = f"""
SELECT p_partkey, p_name, p_type AS category, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_sold,
       {_money(f'sum({_NET})')} AS net_amount
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type"""


@query("product_perf", _PART_SALES)
def product_perf(spark, d):
    return part_sales(spark, d)


@query("ingest_pos", """
SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_orderdate AS sale_ts, o_orderpriority AS channel, l_linenumber AS line_no,
       l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
       CAST(l_discount AS DECIMAL(4,2)) AS discount
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def ingest_pos(spark, d):
    return read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sale_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("sale_ts"),
        F.col("o_orderpriority").alias("channel"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("qty"), gross().alias("unit_price"), F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )


@query("ingest_web_orders", """
SELECT event_id AS web_order_id, user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS product_id,
       ts AS order_ts, CAST(value AS DECIMAL(12,2)) AS unit_price
FROM events WHERE event_type = 'purchase'
""")
def ingest_web_orders(spark, d):
    return read_table(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("web_order_id"), F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("int").alias("product_id"), F.col("ts").alias("order_ts"),
        F.col("value").cast("decimal(12,2)").alias("unit_price"),
    )


@query("loyalty_sync", f"""
WITH {_REGION}
SELECT c_custkey AS customer_id, c_name AS customer_name, lower(replace(c_name, '#', '')) || '@example.com' AS email, city, region,
       c_mktsegment AS segment FROM cr
""")
def loyalty_sync(spark, d):
    return customer_region(spark, d).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
        "city", "region", F.col("c_mktsegment").alias("segment"),
    )


def serving(spark, d) -> DataFrame:
    return (
        sold_orders(spark, d).join(customer_region(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("cal_date", "region").agg(money(F.sum("net")).alias("net_amount"), F.count("*").alias("order_count"))
    )


_SERVING = f"""
WITH {_ORDER_LINES}, {_REGION}
SELECT CAST(o_orderdate AS DATE) AS cal_date, region, {_money('sum(net)')} AS net_amount, count(*) AS order_count
FROM orders JOIN ol ON l_orderkey = o_orderkey JOIN cr ON c_custkey = o_custkey GROUP BY 1, 2"""


@query("serving_daily", _SERVING)
def serving_daily(spark, d):
    return serving(spark, d)


@query("exec_kpis", f"""
SELECT cal_date, CAST(sum(net_amount) AS DECIMAL(28,2)) AS net_amount, CAST(sum(order_count) AS BIGINT) AS order_count
FROM ({_SERVING}) GROUP BY cal_date
""")
def exec_kpis(spark, d):
    return serving(spark, d).groupBy("cal_date").agg(
        F.sum("net_amount").alias("net_amount"), F.sum("order_count").alias("order_count")
    )


@query("daily_master", f"""
SELECT CAST(o_orderdate AS DATE) AS cal_date, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS active_customers,
       {_money(f'sum({_NET})')} AS net_amount
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def daily_master(spark, d):
    # One row per day and customer first, so both distinct counts become plain counts.
    per = sold_orders(spark, d).groupBy("cal_date", "o_custkey").agg(F.count("*").alias("n"), F.sum("net").alias("net"))
    return per.groupBy("cal_date").agg(
        F.sum("n").alias("orders"), F.count("o_custkey").alias("active_customers"), money(F.sum("net")).alias("net_amount")
    )


# --- report tiles -----------------------------------------------------------

@query("bi_revenue_by_region", f"""
SELECT region, CAST(sum(gross_amount) AS DECIMAL(28,2)) AS revenue FROM ({_SALES_BY_DAY}) GROUP BY region ORDER BY revenue DESC
""")
def bi_revenue_by_region(spark, d):
    return sales_by_day(spark, d).groupBy("region").agg(F.sum("gross_amount").alias("revenue")).orderBy(F.desc("revenue"))


@query("bi_net_by_region", f"""
SELECT region, CAST(sum(net_amount) AS DECIMAL(28,2)) AS net FROM ({_SALES_BY_DAY}) GROUP BY region ORDER BY net DESC
""")
def bi_net_by_region(spark, d):
    return sales_by_day(spark, d).groupBy("region").agg(F.sum("net_amount").alias("net")).orderBy(F.desc("net"))


@query("bi_top_products", f"SELECT p_name, CAST(sum(units_sold) AS BIGINT) AS units FROM ({_PART_SALES}) GROUP BY p_name")
def bi_top_products(spark, d):
    return part_sales(spark, d).groupBy("p_name").agg(F.sum("units_sold").alias("units"))


@query("bi_top20_parts", f"SELECT p_partkey, p_name, units_sold FROM ({_PART_SALES}) ORDER BY units_sold DESC, p_partkey LIMIT 20")
def bi_top20_parts(spark, d):
    return part_sales(spark, d).select("p_partkey", "p_name", "units_sold").orderBy(F.desc("units_sold"), "p_partkey").limit(20)


@query("bi_lifetime_by_segment", f"SELECT segment, CAST(sum(lifetime_net) AS DECIMAL(28,2)) AS ltv FROM ({_CUSTOMER_360}) GROUP BY segment")
def bi_lifetime_by_segment(spark, d):
    return customer_value(spark, d).groupBy("segment").agg(F.sum("lifetime_net").alias("ltv"))


# --- marts known by their columns only --------------------------------------

@query("mart_session_pages", """
WITH l AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
     n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM l),
     p AS (SELECT user_id, no, count(*) AS pages FROM n GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, CAST(round(CAST(sum(pages) AS DECIMAL(20,6)) / count(*), 2) AS DECIMAL(9,2)) AS avg_session_pages
FROM p GROUP BY user_id
""")
def mart_session_pages(spark, d):
    pages = F.sum("page_views").cast("decimal(20,6)") / F.count("*")
    return sessionize(read_table(spark, d, "events"), "user_id", "ts", 1800).groupBy("user_id").agg(
        F.count("*").alias("sessions"), F.round(pages, 2).cast("decimal(9,2)").alias("avg_session_pages")
    )


@query("mart_return_rate", """
SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_sold,
       CAST(round(CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0) AS DECIMAL(20,6)) / sum(CAST(l_quantity AS BIGINT)), 4) AS DECIMAL(9,4)) AS return_rate
FROM lineitem GROUP BY l_partkey
""")
def mart_return_rate(spark, d):
    qty = F.col("l_quantity").cast("bigint")
    back = F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", qty)), F.lit(0)).cast("decimal(20,6)")
    return read_table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum(qty).alias("units_sold"), F.round(back / F.sum(qty), 4).cast("decimal(9,4)").alias("return_rate")
    )


# --- read models ------------------------------------------------------------

@query("app_orders_ops", f"""
WITH {_ORDER_LINES}
SELECT CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id, count(*) AS orders, CAST(sum(units) AS BIGINT) AS units,
       {_money('sum(net)')} AS revenue, CASE WHEN sum(net) > 100000 THEN 'open' ELSE 'hold' END AS status
FROM orders JOIN ol ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def app_orders_ops(spark, d):
    mart = sold_orders(spark, d).groupBy(F.col("cal_date").alias("order_date"), F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("orders"), F.sum("units").alias("units"), F.sum("net").alias("net")
    )
    return sync_read_model(mart, {
        "order_date": F.col("order_date"), "customer_id": F.col("customer_id"), "orders": F.col("orders"), "units": F.col("units"),
        "revenue": money(F.col("net")), "status": F.when(F.col("net") > 100000, "open").otherwise("hold"),
    })


@query("app_customer_360", f"""
SELECT c_custkey AS customer_id, c_name AS customer_name, region, lifetime_net AS lifetime_revenue, last_order_date,
       coalesce(n, 0) AS web_sessions_30d
FROM ({_CUSTOMER_360}) c LEFT JOIN (
  SELECT user_id, count(*) AS n FROM (
    SELECT user_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
    FROM events WHERE ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'
  ) WHERE fresh = 1 GROUP BY user_id) s ON user_id = c_custkey
""")
def app_customer_360(spark, d):
    month = delta_window(read_table(spark, d, "events"), "ts", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
    sessions = sessionize(month, "user_id", "ts", 1800).groupBy("user_id").agg(F.count("*").alias("n"))
    both = customer_value(spark, d).join(sessions, F.col("c_custkey") == F.col("user_id"), "left")
    return sync_read_model(both, {
        "customer_id": F.col("c_custkey"), "customer_name": F.col("c_name"), "region": F.col("region"),
        "lifetime_revenue": F.col("lifetime_net"), "last_order_date": F.col("last_order_date"),
        "web_sessions_30d": F.coalesce("n", F.lit(0)),
    })


@query("app_reorder_alerts", """
SELECT p_partkey AS product_id, p_name AS product_name, CAST(p_size AS BIGINT) AS units_on_hand, coalesce(u, 0) // 30 AS reorder_point,
       CASE WHEN p_size < coalesce(u, 0) // 30 THEN 1 ELSE 0 END AS alert
FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
""")
def app_reorder_alerts(spark, d):
    sold = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("u"))
    stock = read_table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey", "p_name", F.col("p_size").cast("bigint").alias("on_hand"), F.expr("coalesce(u, 0) div 30").alias("reorder_point")
    )
    return sync_read_model(stock, {
        "product_id": F.col("p_partkey"), "product_name": F.col("p_name"), "units_on_hand": F.col("on_hand"),
        "reorder_point": F.col("reorder_point"), "alert": F.when(F.col("on_hand") < F.col("reorder_point"), 1).otherwise(0),
    })
