"""SQL surface on the star schema: grouping sets, frames, as-of and set operations, pivots, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles


@fam.query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = lambda c, name, n=2: F.round(c, n).alias(name)
    return table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), "sum_qty"), r(F.sum("l_extendedprice"), "sum_base"), r(F.sum(money), "sum_disc"), r(F.avg("l_quantity"), "avg_qty", 6), F.count(F.lit(1)).alias("n"))


@fam.query("""SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(n_name)::INT AS g1, grouping(o_orderstatus)::INT AS g2 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)""")
def rollup_sales(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.rollup("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("n_name").cast("int").alias("g1"), F.grouping("o_orderstatus").cast("int").alias("g2"))


@fam.query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@fam.query("""SELECT event_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts AND o.event_id < e.event_id) AS last_purchase FROM events e WHERE event_type = 'view'""")
def as_of_purchase(spark, sf_dir):
    """The last purchase of a viewer before a view: one window over both kinds of events, no range join."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w))
    return e.filter("event_type = 'view'").select("event_id", "last_purchase")


@fam.query("""SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS running, round(o_totalprice - lag(o_totalprice) OVER w2, 2) AS delta, ntile(4) OVER w2 AS quartile, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS prio
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), w2 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def analytic_frames(spark, sf_dir):
    w2 = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w2.rowsBetween(-2, 0)), 2).alias("running"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w2), 2).alias("delta"),
        F.ntile(4).over(w2).alias("quartile"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("prio"),
    )


@fam.query("""SELECT c_mktsegment, n_name, o_orderkey, total FROM (SELECT c_mktsegment, n_name, o_orderkey, o_totalprice AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) WHERE r <= 3""")
def top_orders_per_segment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("r", r).filter("r <= 3").select("c_mktsegment", "n_name", "o_orderkey", F.col("o_totalprice").alias("total"))


@fam.query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' GROUP BY n_name""")
def regional_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    j = t("region").filter("r_name = 'ASIA'").join(t("nation"), c("n_regionkey") == c("r_regionkey")).join(t("supplier"), c("s_nationkey") == c("n_nationkey"))
    j = t("lineitem").join(j, c("l_suppkey") == c("s_suppkey")).join(t("orders"), c("o_orderkey") == c("l_orderkey")).join(t("customer"), (c("c_custkey") == c("o_custkey")) & (c("c_nationkey") == c("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))


@fam.query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def priority_exists(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(hit, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@fam.query("SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def events_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().na.fill(0)


@fam.query("SELECT c_custkey, kind, x FROM (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (x FOR kind IN (balance, nation))")
def customers_unpivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot("c_custkey", ["balance", "nation"], "kind", "x")


@fam.query("SELECT l_shipmode_key AS k, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_quantity), 6) AS sd FROM (SELECT *, l_suppkey % 10 AS l_shipmode_key FROM lineitem) GROUP BY 1")
def supplier_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey") % 10)
    return li.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))
