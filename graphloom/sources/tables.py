"""Graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..graph import Graph
from ..operators.scan import following


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to the customers that their orders' numbers fall on."""
    n = table(spark, sf_dir, "customer").count()
    orders = table(spark, sf_dir, "orders")
    return Graph(orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst")), n)


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Of the dense graph, the edges of urgent orders below a price, each once."""
    n = table(spark, sf_dir, "customer").count()
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice < 250000")
    return Graph(orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst")).distinct(), n)


def visits(spark: SparkSession, sf_dir: str, store) -> Graph:
    """Users to the users of the next event: a multigraph."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    n = events.agg(F.max("user_id")).first()[0]
    edges = following(events, ["ts", "event_id"], "user_id", "dst", store).where("dst is not null")
    return Graph(edges.select(F.col("user_id").alias("src"), "dst"), (-1 if n is None else n) + 1)


def chains(spark: SparkSession, sf_dir: str) -> Graph:
    """Events to the same user's next event."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    n = events.agg(F.max("event_id")).first()[0]
    after = F.lead("event_id").over(W.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return Graph(events.select(F.col("event_id").alias("src"), after.alias("dst")).where("dst is not null"), (-1 if n is None else n) + 1)
