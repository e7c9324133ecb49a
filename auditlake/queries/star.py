"""Joins and aggregations over the star schema, as a baseline of the engine itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog import query
from auditlake.sources.tables import table

_MONEY = "CAST(round({0} * 100) AS BIGINT)"


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


@query("q1", f"SELECT l_returnflag, l_linestatus, CAST(sum({_MONEY.format('l_extendedprice')}) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_cents("l_extendedprice")).alias("cents"), F.count("*").alias("n"))


@query("q3", f"SELECT l_orderkey, CAST(sum({_MONEY.format('l_extendedprice')}) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey")
def q3(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    orders = table(spark, d, "orders").where(F.col("o_orderdate") < day).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") > day)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("cents"))


@query("q5", f"SELECT n_name, CAST(sum({_MONEY.format('l_extendedprice')}) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def q5(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, s, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.sum(_cents("l_extendedprice")).alias("cents"))


@query("q6", f"SELECT CAST(sum({_MONEY.format('l_extendedprice')}) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_quantity < 24")
def q6(spark: SparkSession, d: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = table(spark, d, "lineitem").where((F.col("l_shipdate") >= day("1994-01-01")) & (F.col("l_shipdate") < day("1995-01-01")) & (F.col("l_quantity") < 24))
    return rows.agg(F.sum(_cents("l_extendedprice")).alias("cents"), F.count("*").alias("n"))
