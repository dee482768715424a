"""Relational views of per-origin bushes: flows, merges, shares, entropy, paths, balances, reduced costs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.operators import kernels as K
from arcwise.schema import BUSH_ARCS, PATHS


def by_head():
    return Window.partitionBy("class_id", "origin", "head")


def tree_bushes(demand: DataFrame, g: K.Graph, cost: dict[int, np.ndarray]) -> DataFrame:
    """First bushes: each origin's shortest tree with the demand on it, in `bush_arcs` rows."""

    def grow(key, pdf):
        c, o = (int(k) for k in key)
        _, pred, order = K.shortest(g, cost[c], o)
        flow = K.load_tree(g, pred, order, pdf["dest"].to_numpy(), pdf["trips"].to_numpy())
        pos = {v: i for i, v in enumerate(order)}
        arcs = pred[pred >= 0]
        return pd.DataFrame({"class_id": c, "origin": o, "arc_id": arcs, "tail": g.tail[arcs], "head": g.head[arcs], "approach_flow": flow[arcs], "topo_pos": [pos[int(v)] for v in g.head[arcs]]})

    return demand.groupBy("class_id", "origin").applyInPandas(grow, BUSH_ARCS)


def node_flow(bush: DataFrame) -> DataFrame:
    return bush.withColumn("node_flow", F.sum("approach_flow").over(by_head()))


def merge_nodes(bush: DataFrame) -> DataFrame:
    """Nodes with two or more approaches, with the approaches in arc order."""
    return (
        bush.groupBy("class_id", "origin", "head")
        .agg(F.count("*").alias("approaches"), F.sum("approach_flow").alias("node_flow"), F.min("arc_id").alias("first_arc"), F.max("arc_id").alias("last_arc"))
        .where("approaches > 1")
    )


def merge_share(bush: DataFrame) -> DataFrame:
    """Share of each approach in its node's flow; a node without flow puts everything on its first arc."""
    first = F.min("arc_id").over(by_head())
    return node_flow(bush).withColumn("share", F.when(F.col("node_flow") > 0, F.col("approach_flow") / F.col("node_flow")).otherwise((F.col("arc_id") == first).cast("double")))


def rectify(bush: DataFrame, new_node_flow: DataFrame) -> DataFrame:
    """Merge flows scaled to new node flows (class_id, origin, head, new_flow), shares kept."""
    return merge_share(bush).join(new_node_flow, ["class_id", "origin", "head"]).withColumn("approach_flow", F.col("share") * F.col("new_flow"))


def entropy(bush: DataFrame, min_flow: float = 1e-14) -> DataFrame:
    x, t = F.col("approach_flow"), F.col("node_flow")
    return node_flow(bush).where((x >= min_flow) & (t >= min_flow)).groupBy("class_id").agg((-F.sum(x * F.log(x / t))).alias("entropy"))


def balance(bush: DataFrame, demand: DataFrame) -> DataFrame:
    """In-flow, out-flow and demand at each node of each bush; `balance` is zero where flow is conserved."""
    keys = ["class_id", "origin", "node"]
    into = bush.groupBy("class_id", "origin", F.col("head").alias("node")).agg(F.sum("approach_flow").alias("inflow"))
    out = bush.groupBy("class_id", "origin", F.col("tail").alias("node")).agg(F.sum("approach_flow").alias("outflow"))
    d = demand.where("origin <> dest").groupBy("class_id", "origin", F.col("dest").alias("node")).agg(F.sum("trips").alias("trips"))
    all_ = into.join(out, keys, "full").join(d, keys, "full").na.fill(0.0)
    return all_.where("node <> origin").withColumn("balance", F.col("inflow") - F.col("outflow") - F.col("trips"))


def reduced_costs(bush: DataFrame, labels: DataFrame, links: DataFrame, first_thru: int = 0) -> DataFrame:
    """(class_id, origin, arc_id, rc, used): cost + label(tail) - label(head) of every link an origin may take.
    links: (arc_id, tail, head, class_id, gen_cost)."""
    tail = labels.select("class_id", "origin", F.col("node").alias("tail"), F.col("cost").alias("lt"))
    head = labels.select("class_id", "origin", F.col("node").alias("head"), F.col("cost").alias("lh"))
    used = bush.where("approach_flow > 0").select("class_id", "origin", "arc_id", F.lit(True).alias("used"))
    return (
        links.join(tail, ["class_id", "tail"])
        .where((F.col("tail") == F.col("origin")) | (F.col("tail") >= first_thru))
        .join(head, ["class_id", "origin", "head"])
        .join(used, ["class_id", "origin", "arc_id"], "left")
        .select("class_id", "origin", "arc_id", (F.col("gen_cost") + F.col("lt") - F.col("lh")).alias("rc"), F.coalesce("used", F.lit(False)).alias("used"))
    )


def rc_bins(rc: DataFrame, zero: float = 1e-9) -> DataFrame:
    """Histogram over 70 binary orders of magnitude, apart for used and other links."""
    r = F.abs("rc")
    b = F.when(r < zero, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(69), (F.floor(F.log2(r)) + 61).cast("int"))))
    return rc.groupBy("used", b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def acceptance(rc: DataFrame, min_rc: float = 1e-8) -> DataFrame:
    """Largest reduced cost on used links; smallest above min_rc elsewhere."""
    return rc.agg(F.max(F.when(F.col("used"), F.col("rc"))).alias("accept_gap"), F.min(F.when(~F.col("used") & (F.col("rc") > min_rc), F.col("rc"))).alias("reject_gap"))


def path_flows(bush: DataFrame, demand: DataFrame, max_len: int = 10_000) -> DataFrame:
    """Every used path of every pair with its proportional flow: from each destination back along shares, one join a
    step; finished paths leave the loop."""
    share = merge_share(bush).where("share > 0").select("class_id", "origin", F.col("head").alias("at"), "tail", "share")
    todo = demand.where("origin <> dest and trips > 0").select("class_id", "origin", "dest", F.col("dest").alias("at"), F.array("dest").alias("nodes"), F.col("trips").alias("flow"))
    done = None
    for _ in range(max_len):
        step = (
            todo.join(share, ["class_id", "origin", "at"])
            .select("class_id", "origin", "dest", F.col("tail").alias("at"), F.array_prepend("nodes", F.col("tail")).alias("nodes"), (F.col("flow") * F.col("share")).alias("flow"))
            .checkpoint()
        )
        ended = step.where("at = origin").select("class_id", "origin", "dest", "nodes", "flow")
        done = ended if done is None else done.unionByName(ended)
        todo = step.where("at <> origin")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"paths longer than {max_len}; schema {PATHS}")


def same_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths both sets have (equal node sequences)."""
    return a.select("class_id", "nodes").intersect(b.select("class_id", "nodes"))


def add_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """The paths of either set, each once, with the flows of both together."""
    keys = ["class_id", "origin", "dest", "nodes"]
    return a.select(*keys, "flow").unionByName(b.select(*keys, "flow")).groupBy(*keys).agg(F.sum("flow").alias("flow"))


def described(bush: DataFrame) -> DataFrame:
    """(class_id, origin, topo_pos, line): a bush as text, a line a node in topological order, with its approaches and
    their flows (nodes from 1, as in files)."""
    one = F.struct("arc_id", F.format_string("%d (%.6f)", F.col("tail") + 1, F.col("approach_flow")).alias("says"))
    by = bush.groupBy("class_id", "origin", "head").agg(F.min("topo_pos").alias("topo_pos"), F.sort_array(F.collect_list(one)).alias("a"))
    return by.select("class_id", "origin", "topo_pos", F.concat(F.col("head") + 1, F.lit(" from "), F.array_join(F.col("a.says"), ", ")).alias("line"))
