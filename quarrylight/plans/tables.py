"""Shared views of the driver tables that stand in for the engine's fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of texts that much is worked out from: a scan of fewer partitions than there are cores is dealt over them.

    That is so for a few files of few row groups alone; a table of more partitions than cores is read as it lies, without
    a shuffle.
    """
    rows = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_dealt(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    """Some columns of a table of small rows that much is worked out from, dealt evenly over the cores.

    A scan has as many partitions with rows as its files have row groups, whatever its size: a million rows may be one.
    """
    rows = read(spark, sf_dir, table).select(*columns)
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and nation: precursor = priority, site = nation, barrier status = order status."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey", "c_mktsegment", "n_name", "n_nationkey", "n_regionkey")


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as verdict versions: P awaits review, F and O are settled; every version is current."""
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", (F.col("o_orderstatus") == "O").alias("review_required"), F.lit(True).alias("is_current"))
