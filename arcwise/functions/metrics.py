"""Objective, totals and gaps as aggregates over link tables.

state: (arc_id, flow, + link attributes); link_class: (arc_id, class_id, fixed_cost, flow)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwise.functions import cost as C


def link_state(links: DataFrame, flows: DataFrame) -> DataFrame:
    """Links with total flow, travel time and derivative; links without flow have zero."""
    total = flows.groupBy("arc_id").agg(F.sum("flow").alias("flow"))
    x = links.join(total, "arc_id", "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    return x.withColumns({"time_cost": C.time_cost(F.col("flow")), "der": C.derivative(F.col("flow"))})


def beckmann(state: DataFrame, link_class: DataFrame) -> DataFrame:
    a = state.agg(F.sum(C.integral(F.col("flow"))).alias("v"))
    b = link_class.agg(F.sum(F.col("flow") * F.col("fixed_cost")).alias("v"))
    return a.unionByName(b).agg(F.sum("v").alias("objective"))


def class_totals(state: DataFrame, link_class: DataFrame) -> DataFrame:
    """Time, distance, toll and generalized cost of each class, with the grand total (class_id null)."""
    x = link_class.drop("toll").join(state.select("arc_id", "time_cost", "length", "toll"), "arc_id")
    f = F.col("flow")
    return x.rollup("class_id").agg(
        F.sum(f * F.col("time_cost")).alias("time"),
        F.sum(f * F.col("length")).alias("distance"),
        F.sum(f * F.col("toll")).alias("toll"),
        F.sum(f * (F.col("time_cost") + F.col("fixed_cost"))).alias("generalized_cost"),
    )


def tstt(state: DataFrame, link_class: DataFrame) -> DataFrame:
    """Total generalized cost, fixed costs included."""
    x = link_class.join(state.select("arc_id", "time_cost"), "arc_id")
    return x.agg(F.sum(F.col("flow") * (F.col("time_cost") + F.col("fixed_cost"))).alias("tstt"))


def relative_gap(tstt_: Column, sptt_: Column) -> Column:
    return F.when((tstt_ == 0) & (sptt_ == 0), F.lit(0.0)).otherwise(tstt_ / sptt_ - 1)


def average_excess_cost(tstt_: Column, sptt_: Column, demand: Column) -> Column:
    return (tstt_ - sptt_) / demand


def bound_gap(iterations: DataFrame) -> DataFrame:
    """Gap to the best lower bound so far: objective + SPTT - TSTT, running maximum. One row per solver pass."""
    w = Window.partitionBy(F.lit(0)).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    lb = F.max(F.col("objective") + F.col("sptt") - F.col("tstt")).over(w)
    return iterations.withColumn("lower_bound", lb).withColumn("gap2", F.col("objective") / F.col("lower_bound") - 1)


def conjugacy(d1: DataFrame, d2: DataFrame, state: DataFrame) -> DataFrame:
    """Sum of d1 * derivative * d2; directions are (arc_id, d) of link totals."""
    return d1.withColumnRenamed("d", "d1").join(d2.withColumnRenamed("d", "d2"), "arc_id").join(state.select("arc_id", "der"), "arc_id").agg(F.sum(F.col("d1") * F.col("der") * F.col("d2")).alias("product"))


def max_excess(used_labels: DataFrame) -> DataFrame:
    """Largest difference of longest used and shortest label over pairs with demand."""
    return used_labels.agg(F.max(F.col("longest") - F.col("shortest")).alias("max_excess_cost"))
