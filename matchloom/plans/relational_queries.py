"""Relational breadth over the order tables: joins, grouping sets, set operations, ranking.

Sides are broadcast by Spark where its own size estimate allows it; no hint says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.plans.registry import query
from matchloom.sources.tables import table

C = F.col


def _money(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


@query(f"""select l_returnflag, l_linestatus, cast(sum({_money('l_quantity')}) as double) as sum_qty, cast(sum({_money('l_extendedprice')}) as double) as sum_price,
    cast(sum({_money('l_extendedprice')} * (1 - {_money('l_discount')})) as double) as sum_disc_price, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda c: C(c).cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").where(C("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(m("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(m("l_extendedprice")).cast("double").alias("sum_price"),
        F.sum(m("l_extendedprice") * (1 - m("l_discount"))).cast("double").alias("sum_disc_price"),
        F.count("*").alias("count_order"),
    )


@query(f"""select n_name, r_name, count(distinct o_orderkey) as orders, cast(sum({_money('l_extendedprice')}) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # lines are summed by order before any join
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(C("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    orders = t("orders").join(lines, C("o_orderkey") == C("l_orderkey")).select("o_custkey", "o_orderkey", "price")
    by = orders.join(t("customer"), C("o_custkey") == C("c_custkey")).groupBy("c_nationkey").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum("price").cast("double").alias("revenue"))
    return by.join(t("nation"), C("c_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey")).select("n_name", "r_name", "orders", "revenue")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 150000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 150000")
    return table(spark, sf_dir, "customer").join(large, C("o_custkey") == C("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), C("o_custkey") == C("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select coalesce(s_nationkey, c_nationkey) as nation, suppliers, customers from (select s_nationkey, count(*) as suppliers from supplier group by 1) full join (select c_nationkey, count(*) as customers from customer group by 1) on s_nationkey = c_nationkey")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(C("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(C("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full")


def _sets(kind: str) -> str:
    return f"select o_orderstatus, o_orderpriority, grouping(o_orderstatus) as g1, grouping(o_orderpriority) as g2, count(*) as n from orders group by {kind}"


@query(_sets("rollup (o_orderstatus, o_orderpriority)"))
def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"), F.count("*").alias("n"))


@query(_sets("cube (o_orderstatus, o_orderpriority)"))
def grouping_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"), F.count("*").alias("n"))


@query("select s_nationkey as nation from supplier intersect select c_nationkey from customer where c_acctbal > 9000")
def intersect_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(C("s_nationkey").alias("nation")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("select n_nationkey as nation from nation except select c_nationkey from customer where c_acctbal > 9900")
def except_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(C("n_nationkey").alias("nation")).exceptAll(table(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey").distinct())


@query("select p_brand, p_partkey, p_retailprice, rank from (select *, rank() over (partition by p_brand order by p_retailprice desc) as rank from part) where rank <= 3")
def ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return table(spark, sf_dir, "part").withColumn("rank", F.rank().over(w).cast("long")).where("rank <= 3").select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("select c_mktsegment, count(*) as n, count(distinct c_nationkey) as nations, cast(min(c_acctbal) as double) as low, cast(max(c_acctbal) as double) as high from customer group by c_mktsegment")
def distinct_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
