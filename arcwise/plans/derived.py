"""A network derived from star-schema tables: nations are nodes with four out-links each, order lines are trips.

Capacities come from what suppliers ship, demand from supplier nation to customer nation; class 0 holds returned
lines, class 1 the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.cost import family

ZONES = 25
#: Fixed values: (class_id, toll_factor, distance_factor).
CLASS_FACTORS = ((0, 0.0, 0.0), (1, 2.0, 1.0))
#: Fixed values: (link of a node, step to its head).
STEPS = ((0, 1), (1, 3), (2, 8), (3, 24))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_FACTORS, "class_id int, toll_factor double, distance_factor double")


def net_links(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("tail"))
    by_sup = item.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    cap = by_sup.join(sup, "l_suppkey").groupBy("tail").agg(F.sum("q").alias("q"))
    total = item.agg((F.sum("l_quantity") / ZONES).alias("tot"))
    steps = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(s).alias("off")) for i, s in STEPS))
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("tail"), F.explode(steps).alias("k"))
    e = e.select((4 * F.col("tail") + F.col("k.idx")).alias("arc_id"), "tail", ((F.col("tail") + F.col("k.off")) % ZONES).alias("head"))
    beta = F.when(F.col("tail") % 3 == 0, 4.0).when(F.col("tail") % 3 == 1, 1.0).otherwise(2.5)
    out = e.join(cap, "tail", "left").crossJoin(F.broadcast(total))
    return out.select(
        "arc_id", "tail", "head",
        (F.coalesce("q", "tot") / 4).alias("capacity"),
        (1 + (F.col("tail") + F.col("head")) % 5).cast("double").alias("length"),
        (1 + (7 * F.col("tail") + 3 * F.col("head")) % 11).cast("double").alias("free_flow_time"),
        F.lit(0.15).alias("alpha"), beta.alias("beta"),
        (F.col("tail") * F.col("head") % 3).cast("double").alias("toll"),
        family(beta).alias("cost_family"), F.lit(False).alias("artificial"),
    )


def net_demand(spark: SparkSession, d: str) -> DataFrame:
    """(class_id, origin, dest, trips). The nations of suppliers and customers go to lines and orders first, so the one
    large join moves four narrow columns, and its result is summed by nation pair on the map side."""
    cls = F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("class_id")
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("origin"))
    item = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", cls, "l_quantity").join(sup, "l_suppkey").drop("l_suppkey")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dest"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey").drop("o_custkey")
    x = item.join(orders, "l_orderkey").where("origin <> dest")
    return x.groupBy("class_id", "origin", "dest").agg(F.sum("l_quantity").alias("trips"))
