"""Input tables, and the views of them that stand for chunks, usage events, traces, sessions and facts.

Tenants, companies and fiscal years are derived: a document's tenant is doc_id modulo 3 (0 is the public corpus) and its company its
source; a fact's company is the customer's nation, its fiscal year the year of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition whose task holds them several times over.
TASK_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt by keys, about TASK_ROWS to a partition.

    The number of partitions grows with the table, and Spark does not put them together again as it does with those of a join, so that a task's
    sorts and maps of groups hold no more of a larger table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS + 1), *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", (F.col("doc_id") % 3).alias("tenant_id"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: one row for each event, its quantity the whole part of its value, its cost by type."""
    e = read(spark, sf_dir, "events")
    cost = F.when(F.col("event_type") == "purchase", F.col("value") * 0.01).otherwise(F.lit(None).cast("double"))
    return e.select("event_id", (F.col("user_id") % 3).alias("tenant_id"), "user_id", "event_type", F.floor("value").alias("quantity"), cost.alias("cost"), F.col("ts").alias("created_at"), "props")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces: errors failed, views still run and have no duration."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("success")
    took = F.when(F.col("event_type") != "view", F.col("value") * 10)
    return e.select(F.col("event_id").alias("trace_id"), (F.col("user_id") % 3).alias("tenant_id"), "user_id", status.alias("status"), took.alias("duration_ms"), F.col("ts").alias("started_at"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly facts of a company (a nation): revenue, discounts and net revenue as exact decimals."""
    money = "decimal(18,4)"
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast(money).alias("price"), F.col("l_discount").cast("decimal(6,4)").alias("discount"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    off = (F.col("price") * F.col("discount")).cast(money)
    each = joined.groupBy("company", "fiscal_year").agg(F.sum("price").alias("revenue"), F.sum(off).alias("discounts"), F.sum((F.col("price") - off).cast(money)).alias("net_revenue"))
    return each.unpivot(["company", "fiscal_year"], ["revenue", "discounts", "net_revenue"], "metric", "value").select("company", "fiscal_year", "metric", F.col("value").cast("decimal(38,12)").alias("value"))
