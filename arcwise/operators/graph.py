"""Shortest labels, reachability, repair and ordering on link tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators import kernels as K
from arcwise.schema import ARTIFICIAL, LABELS

#: Links a grouped-map kernel holds in each task; above it use the relational forms.
MAX_KERNEL_LINKS = 2_000_000


def graph_of(links: DataFrame, n: int | None = None, first_thru: int = 0) -> tuple[K.Graph, pd.DataFrame]:
    """The link table as arrays for the kernels. Road networks are bounded; the bound is checked before any collect."""
    rows = links.orderBy("arc_id").limit(MAX_KERNEL_LINKS + 1).toPandas()
    if len(rows) > MAX_KERNEL_LINKS:
        raise ValueError("too many links for the grouped-map kernels; use the relational operators")
    if n is None:
        n = int(max(rows["tail"].max(), rows["head"].max())) + 1 if len(rows) else 0
    return K.Graph(n, rows["tail"].to_numpy(), rows["head"].to_numpy(), first_thru), rows


def labels(origins: DataFrame, g: K.Graph, cost: dict[int, np.ndarray], ids=None) -> DataFrame:
    """Rows (class_id, origin, node, cost, pred_arc) for the given (class_id, origin) rows; unreached nodes are absent."""
    ids = np.arange(len(g.tail)) if ids is None else np.asarray(ids)

    def tree(key, pdf):
        c, o = (int(k) for k in key)
        label, pred, _ = K.shortest(g, cost[c], o)
        ok = np.flatnonzero(np.isfinite(label))
        return pd.DataFrame({"class_id": c, "origin": o, "node": ok, "cost": label[ok], "pred_arc": np.where(pred[ok] < 0, -1, ids[pred[ok]])})

    out = origins.select("class_id", "origin").distinct().groupBy("class_id", "origin").applyInPandas(tree, LABELS)
    return out.withColumn("pred_arc", F.when(F.col("pred_arc") >= 0, F.col("pred_arc")))


def labels_relational(links: DataFrame, origins: DataFrame, cost: str = "cost", first_thru: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """The same labels without a kernel: Bellman-Ford rounds of join and minimum, for networks beyond the kernel's
    bound. links: (arc_id, tail, head, <cost>). Rounds are cut with checkpoint()."""
    state = origins.select("class_id", "origin").distinct().select("class_id", "origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))
    arcs = links.select("tail", "head", F.col(cost).alias("arc_cost"))
    frontier = state
    for _ in range(max_rounds):
        step = (
            frontier.where((F.col("node") == F.col("origin")) | (F.col("node") >= first_thru))
            .join(arcs, F.col("node") == F.col("tail"))
            .groupBy("class_id", "origin", F.col("head").alias("node"))
            .agg(F.min(F.col("cost") + F.col("arc_cost")).alias("new"))
        )
        keys = ["class_id", "origin", "node"]
        merged = state.join(step, keys, "full").select(*keys, F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("better"))
        merged = merged.checkpoint()
        frontier, state = merged.where("better").drop("better"), merged.drop("better")
        if frontier.isEmpty():
            return state
    raise RuntimeError("labels did not settle")


def reach(links: DataFrame, start: int, reverse: bool = False, first_thru: int = 0) -> DataFrame:
    """(node, hops) of every node reached from `start`, along links or against them."""
    a, b = ("head", "tail") if reverse else ("tail", "head")
    spark = links.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node int, hops int")
    frontier, arcs = seen, links.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    hop = 0
    while True:
        hop += 1
        grown = (
            frontier.where((F.col("node") == start) | (F.col("node") >= first_thru))
            .join(arcs, "node")
            .select(F.col("next").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
            .select("node", F.lit(hop).alias("hops"))
            .checkpoint()
        )
        if grown.isEmpty():
            return seen
        seen, frontier = seen.unionByName(grown).checkpoint(), grown


def artificial_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (tail, head) that make the network strongly connected through its highest node: one from it to each node
    that cannot be reached from it, one to it from each node that cannot reach it. Time, length and capacity 99999."""
    hub = nodes.agg(F.max("node_id")).first()[0]
    fwd, rev = reach(links, hub), reach(links, hub, reverse=True)
    lost = nodes.select(F.col("node_id").alias("node"))
    one = lost.join(fwd, "node", "left_anti").select(F.lit(hub).alias("tail"), F.col("node").alias("head"))
    two = lost.join(rev, "node", "left_anti").select(F.col("node").alias("tail"), F.lit(hub).alias("head"))
    big = F.lit(ARTIFICIAL)
    return one.unionByName(two).select(
        "tail", "head", big.alias("capacity"), big.alias("length"), big.alias("free_flow_time"), F.lit(0.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(True).alias("artificial")
    )


def topo_depth(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, depth): longest number of links on a path into the node. A cycle raises ValueError."""
    state = nodes.select(F.col("node_id").alias("node"), F.lit(0).alias("depth"))
    n = nodes.count()
    for _ in range(n + 1):
        step = links.join(state, F.col("tail") == F.col("node")).groupBy("head").agg(F.max(F.col("depth") + 1).alias("d"))
        new = state.join(step, F.col("node") == F.col("head"), "left").select("node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")).checkpoint()
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state
    raise ValueError("cycle")


def forward_star(links: DataFrame) -> DataFrame:
    """Links with their place among the links that leave the same node, by (head, arc_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("tail")
    return links.select("arc_id", "tail", "head", F.row_number().over(w.orderBy("head", "arc_id")).alias("star_pos"), F.count("*").over(w).alias("star_size"))
