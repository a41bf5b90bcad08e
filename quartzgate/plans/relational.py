"""Joins, aggregates, windows and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quantiles
from ..sources import logs
from ..sources.tables import table
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, r_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    li, o, c, n, r = t("lineitem"), t("orders"), t("customer"), t("nation"), t("region")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL""")
def orders_with_returns(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(r, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def customers_without_urgent_orders(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def orders_per_customer(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent,
lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events""")
def running_values(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "value", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"), F.lag("value").over(w).alias("before"))


@query("""SELECT event_type, CASE WHEN value <= 2 THEN 'a' WHEN value <= 5 THEN 'b' WHEN value <= 9 THEN 'c' ELSE 'd' END AS bin, count(*) AS n FROM events GROUP BY ALL""")
def length_bins(spark, d):
    v = F.col("value")
    b = F.when(v <= 2, "a").when(v <= 5, "b").when(v <= 9, "c").otherwise("d")
    return table(spark, d, "events").groupBy("event_type", b.alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events) SELECT len(list_filter(e, lambda x: x < value)) AS bin, count(*) AS n FROM events, e GROUP BY ALL""")
def quartile_bins(spark, d):
    e = table(spark, d, "events")
    edges = quantiles.exact(e, "value", [0.25, 0.5, 0.75]).first()["q"]
    b = sum((F.when(F.col("value") > x, 1).otherwise(0) for x in edges), F.lit(0))
    return e.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, n_name, count(*) AS n, avg(c_acctbal) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey
GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment), ())""")
def segment_rollup(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # the 25 nations
    return c.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, stddev_samp(value) AS sd, median(value) AS med, min(value) AS low, max(value) AS high,
count(*) FILTER (WHERE value > 50) AS above FROM events GROUP BY ALL""")
def event_statistics(spark, d):
    v = F.col("value")
    e = table(spark, d, "events")
    rest = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.count_if(v > 50).alias("above"),
    )
    return rest.join(quantiles.exact(e, "value", [0.5], ["event_type"]).select("event_type", F.col("q")[0].alias("med")), "event_type")


@query("SELECT event_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def value_counts(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("_t")).alias("share"))


@query("SELECT sum(share * share) AS chance FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type)")
def chance_agreement(spark, d):
    return value_counts(spark, d).agg(F.sum(F.col("share") * F.col("share")).alias("chance"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return o.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, n_click, n_view, n_purchase FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id)")
def event_pivot(spark, d):
    kinds = ["click", "view", "purchase"]
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0, kinds)
    return p.select("user_id", *[F.col(k).alias(f"n_{k}") for k in kinds])


@query("SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(value > 95)")
def failed_by_all(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 95).alias("ok"))
    return e.where("not ok").select("user_id")


@query("SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase' AND value > 95)")
def purchases_failed_by_all(spark, d):
    ok = F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 95))
    return table(spark, d, "events").groupBy("user_id").agg(ok.alias("ok")).where("not ok").select("user_id")


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def supplier_sets(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k"))
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    return of("R").intersect(of("A")).subtract(poor)


@query("SELECT d.doc_id, quality, toxic FROM (SELECT * FROM documents WHERE lang IN ('en', 'fr')) d JOIN labels USING (doc_id)")
def one_to_one_join(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id")
    return logs.one_to_one(docs, table(spark, d, "labels"), ["doc_id"]).select("doc_id", "quality", "toxic")


@query("SELECT n_nationkey, rank() OVER (ORDER BY n_regionkey) + (count(*) OVER (PARTITION BY n_regionkey) - 1) / 2e0 AS r FROM nation")
def average_ranks(spark, d):
    from ..operators import ranking

    n = table(spark, d, "nation").withColumn("v", F.col("n_regionkey").cast("double"))
    return ranking.average_rank(n, "v", "r").select("n_nationkey", "r")


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")
