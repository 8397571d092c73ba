"""Sources: tables by path, and the analysis frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: order counts, mean price, balance and total spend in millions.

    Prices are added in the order of their order keys, as the tables have them, so that totals don't follow partitions.
    """
    each = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice", "o_orderstatus").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {"n_orders": F.count("*"), "priced": F.count("o_totalprice"), "n_f": F.sum((F.col("o_orderstatus") == "F").cast("double")), "total": F.sum("o_totalprice")}
    sums = table(spark, sf_dir, "orders").select("o_custkey", *[c.over(each).alias(k) for k, c in so_far.items()])
    orders = sums.groupBy("o_custkey").agg(F.max_by(F.struct("priced", "n_f", "total"), "n_orders").alias("all"), F.max("n_orders").cast("double").alias("n_orders")).select("o_custkey", "n_orders", (F.col("all.total") / F.col("all.priced")).alias("avg_price"), "all.n_f", "all.total")
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return joined.select(F.col("c_custkey").alias("id"), zero("n_orders"), zero("avg_price"), zero("n_f"), F.col("c_acctbal").alias("acctbal"), (F.col("c_acctbal") / 1000).alias("balance"), (F.coalesce("total", F.lit(0.0)) / 1e6).alias("spend"))


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and whether they spend more than 2.5 millions as a 0/1 outcome."""
    return customers(spark, sf_dir).withColumn("large", (F.col("spend") > 2.5).cast("double"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: length, digits, language flag and the two 0/1 outcomes."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    digits = F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double")
    return joined.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("k_chars"), digits.alias("n_dig"), (F.col("lang") == "en").cast("double").alias("is_en"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: quantity, discount, tax, whether it was returned, and price in thousands."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), recode(F.col("l_returnflag"), "R").alias("returned"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"))


def recode(column, value):
    """A category as 1.0, all others as 0.0."""
    return (column == value).cast("double")
