"""Generic relational queries over the star schema and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import register
from docquarry.plans.tables import table


@register(
    "revenue_by_nation_year",
    """SELECT n_name AS nation, CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def revenue_by_nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), net.alias("net"))
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation"), "year").agg(F.sum("net").cast("double").alias("revenue"))


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS lines
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"), F.count("*").alias("lines"))


@register(
    "customers_without_orders",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register(
    "top_orders_per_customer",
    "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
)
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.operators.retrieval import top

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top(o, 3, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@register(
    "event_windows",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return e.select("event_type", F.col("window.start").alias("start"), "events", "total")


@register(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, session""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("events"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "events")


@register(
    "json_property",
    "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS events FROM events GROUP BY 1, 2",
)
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("events"))
