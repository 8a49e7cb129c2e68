"""The order tables as documents: region / nation / customer / order, and order / lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shred import Level, relational


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation: nation / customer / order. Keys take 27 and 29 bits."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    nation, people = t("nation"), t("customer")
    customer = people.withColumn("n_nationkey", c("c_nationkey"))
    orders = t("orders").join(people.select("c_custkey", c("c_nationkey").alias("n_nationkey")), c("o_custkey") == c("c_custkey"))
    levels = [
        Level("nation", nation, c("n_nationkey"), 0, {"key": c("n_nationkey"), "name": c("n_name")}),
        Level("customer", customer, c("c_custkey"), 27, {"key": c("c_custkey"), "name": c("c_name"), "acctbal": c("c_acctbal"), "mktsegment": c("c_mktsegment"), "nationkey": c("c_nationkey")}),
        Level("order", orders, c("o_orderkey"), 29, {"key": c("o_orderkey"), "totalprice": c("o_totalprice"), "status": c("o_orderstatus")}),
    ]
    return relational(levels, "n_nationkey", [[], [c("c_custkey")], [c("o_custkey"), c("o_orderkey")]])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: order / lineitem; documents spread evenly at any scale."""
    c = F.col
    o = table(spark, sf_dir, "orders")
    # line numbers repeat within an order: a rank within the order, a small group, is the key
    rank = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    l = table(spark, sf_dir, "lineitem").withColumns({"o_orderkey": c("l_orderkey"), "rank": F.row_number().over(rank)})
    levels = [
        Level("order", o, c("o_orderkey"), 0, {"key": c("o_orderkey"), "totalprice": c("o_totalprice")}),
        Level("lineitem", l, c("rank"), 16, {"linenumber": c("l_linenumber"), "quantity": c("l_quantity"), "extendedprice": c("l_extendedprice"), "returnflag": c("l_returnflag")}),
    ]
    return relational(levels, "o_orderkey", [[], [c("rank")]])
