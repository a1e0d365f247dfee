"""Graphs and attribute tables derived from the retail and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together in one order: (src, dst), src < dst. An order has few lines, so pairs stay few."""
    # dealt by order first, so that neither distinct nor the join moves lines again
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()


COPURCHASE_SQL = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"""


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the suppliers of their lines; a supplier's node is minus its key."""
    return table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()


PART_SUPPLIER_SQL = "SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem"


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) event types that follow one another for a user, as numbers in name order; one row a step."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("next")).where("next is not null")
    names = table(spark, sf_dir, "events").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    at = lambda c: F.array_position("names", F.col(c)).cast("long")
    return e.crossJoin(F.broadcast(names)).select(at("event_type").alias("src"), at("next").alias("dst"))


EVENT_FLOW_SQL = """SELECT s.k AS src, d.k AS dst FROM (
    SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) e
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)) s ON e.event_type = s.event_type
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)) d ON e.nxt = d.event_type"""


def user_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) users whose events of one type follow one another within an hour; one row a step."""
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")


USER_FLOW_SQL = """SELECT src, dst FROM (SELECT user_id AS src,
  lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"""


def customer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), src < dst: customers whose orders follow one another on a day. Some 17 links a customer, so that kernels get a sparse graph."""
    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.lead("o_custkey").over(w).alias("b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


CUSTOMER_FLOW_SQL = """SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
  SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b FROM orders) WHERE a <> b"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an id, an area code and coordinates made from their keys."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("node"), F.concat("c_mktsegment", F.lit("."), F.col("c_nationkey").cast("string"), F.lit("_"), k.cast("string")).alias("original_id"),
        ((k * 37 % 18000) / 100.0 - 90).alias("lat"), ((k * 91 % 36000) / 100.0 - 180).alias("lon"), "c_acctbal", "c_nationkey",
    )


PLACES_SQL = """SELECT c_custkey AS node, c_mktsegment || '.' || c_nationkey::VARCHAR || '_' || c_custkey::VARCHAR AS original_id,
  (c_custkey * 37 % 18000) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon, c_acctbal, c_nationkey FROM customer"""


def synthetic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves in closed form: for each nation a label, for each of its customers a replicate, 21 removal counts.

    s1 = (1 - p)^(1 + r), s2 = p (1 - p) / (1 + r), with r from the customer's key; m is null for one protocol.
    """
    c = table(spark, sf_dir, "customer")
    removed = F.explode(F.sequence(F.lit(0), F.lit(20)))
    rows = c.select(
        F.col("c_nationkey").cast("string").alias("label"), F.when(F.col("c_custkey") % 3 == 0, "random").otherwise("local_sensing").alias("protocol"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).cast("int").alias("m"), F.col("c_custkey").alias("stochastic_id"), removed.alias("removed"),
    )
    r = (F.col("stochastic_id") % 17).cast("double") / 4
    p = F.col("removed") / 20.0
    return rows.withColumn("p", p).withColumn("s1_over_n", F.round(F.pow(1 - p, 1 + r), 9)).withColumn("s2_over_n", F.round(p * (1 - p) / (1 + r), 9))


CURVES_SQL = """SELECT c_nationkey::VARCHAR AS label, CASE WHEN c_custkey % 3 = 0 THEN 'random' ELSE 'local_sensing' END AS protocol,
  CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 3)::INT END AS m, c_custkey AS stochastic_id, k::INT AS removed, k / 20.0::DOUBLE AS p,
  round(pow(1 - k / 20.0::DOUBLE, 1 + (c_custkey % 17)::DOUBLE / 4), 9) AS s1_over_n,
  round((k / 20.0::DOUBLE) * (1 - k / 20.0::DOUBLE) / (1 + (c_custkey % 17)::DOUBLE / 4), 9) AS s2_over_n
FROM customer, range(21) t(k)"""


def hash_orders(spark: SparkSession, sf_dir: str, replicates: int = 3) -> DataFrame:
    """Removal orders by hashes of suppliers: two protocols, the swept one with seven values of m."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    kinds = F.explode(F.array(F.struct(F.lit("random").alias("protocol"), F.lit(None).cast("int").alias("m")), *[F.struct(F.lit("local_sensing").alias("protocol"), F.lit(m).alias("m")) for m in range(1, 8)]))
    rows = s.withColumn("x", kinds).withColumn("stochastic_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.select(F.lit("suppliers").alias("label"), "x.protocol", "x.m", "stochastic_id", "node")
    key = F.md5(F.concat_ws("|", "protocol", F.coalesce(F.col("m").cast("string"), F.lit("")), F.col("stochastic_id").cast("string"), F.col("node").cast("string")).cast("binary"))
    w = Window.partitionBy("protocol", "m", "stochastic_id").orderBy(key)
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))


ORDERS_SQL = """SELECT 'suppliers' AS label, protocol, m, r AS stochastic_id, s_suppkey AS node,
  row_number() OVER (PARTITION BY protocol, m, r ORDER BY md5(protocol || '|' || coalesce(m::VARCHAR, '') || '|' || r::VARCHAR || '|' || s_suppkey::VARCHAR)) AS rank
FROM supplier, (SELECT 'random' AS protocol, NULL::INT AS m UNION ALL SELECT 'local_sensing', t.m::INT FROM range(1, 8) t(m)) k, (SELECT r::INT AS r FROM range(1, 4) q(r))"""


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a score, a degree and a load: price, lines, and revenue in millions, and a community: the brand."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("l_quantity") / 1000, 6).alias("load"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"), F.col("p_brand").alias("community")).join(lines, "node")


PART_SCORES_SQL = """SELECT p_partkey AS node, p_retailprice AS score, p_brand AS community, l.degree, l.load FROM part JOIN (
  SELECT l_partkey, count(*) AS degree, round(sum(l_quantity) / 1000, 6) AS load FROM lineitem GROUP BY 1) l ON p_partkey = l.l_partkey"""
