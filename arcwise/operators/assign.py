"""All-or-nothing loading and what hangs on it: one grouped-map stage gives flows and shortest total together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators import kernels as K

FLOWS = "class_id int, arc_id int, flow double"


def all_or_nothing(demand: DataFrame, g: K.Graph, cost: dict[int, np.ndarray], ids=None) -> DataFrame:
    """(class_id, arc_id, flow) with every trip on its shortest path; arc_id -1 carries the class's shortest-path total.
    demand: (class_id, origin, dest, trips). Each origin emits only used arcs; sums combine before the shuffle."""
    ids = np.arange(len(g.tail)) if ids is None else np.asarray(ids)

    def load(key, pdf):
        c, o = (int(k) for k in key)
        flow, sptt, _ = K.all_or_nothing(g, cost[c], o, pdf["dest"].to_numpy(), pdf["trips"].to_numpy())
        used = np.flatnonzero(flow)
        return pd.DataFrame({"class_id": c, "arc_id": np.append(ids[used], -1), "flow": np.append(flow[used], sptt)})

    return demand.groupBy("class_id", "origin").applyInPandas(load, FLOWS).groupBy("class_id", "arc_id").agg(F.sum("flow").alias("flow"))


def class_costs(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(arc_id, class_id, fixed_cost): length times distance factor plus toll times toll factor. `classes` has a row
    per user class, so every link meets every class by design."""
    return links.crossJoin(F.broadcast(classes)).select("arc_id", "class_id", (F.col("length") * F.col("distance_factor") + F.col("toll") * F.col("toll_factor")).alias("fixed_cost"))


def sptt(demand: DataFrame, labels: DataFrame) -> DataFrame:
    """Shortest-path total of each class; pairs without a path drop out of the inner join."""
    return demand.join(labels.withColumnRenamed("node", "dest"), ["class_id", "origin", "dest"]).groupBy("class_id").agg(F.sum(F.col("trips") * F.col("cost")).alias("sptt"))


def origin_index(df: DataFrame, zones: int) -> DataFrame:
    """Pseudo-origin of (class_id, origin), and both taken back out of it."""
    p = F.col("class_id") * zones + F.col("origin")
    return df.withColumn("pseudo", p).withColumn("node_back", p % zones).withColumn("class_back", F.floor(p / zones))


def dest_rank(labels: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return labels.withColumn("rank", F.row_number().over(Window.partitionBy("class_id", "origin").orderBy("cost", "node")))
