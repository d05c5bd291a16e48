"""Plain relational queries over the star schema: the joins, counts, top-k and listings that the store's endpoints are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import table


def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner equi-join with a filter on one side: customers as members of nations as workspaces."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.filter("c_mktsegment = 'BUILDING'").join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("members"))


def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join: customers without an order in 1995."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1995)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of grouped sums over the largest table."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 0).alias("sum_disc_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of six tables along their keys."""
    t = lambda n: table(spark, sf_dir, n)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = (
        t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(price), 0).alias("revenue"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k with a tie-break."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


QUERIES = {
    "members_of": (members_of, "SELECT n_name, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name"),
    "without_orders": (without_orders, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)"),
    "pricing_summary": (
        pricing_summary,
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS sum_disc_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "revenue_by_nation": (
        revenue_by_nation,
        """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    ),
    "top_orders": (top_orders, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
}
