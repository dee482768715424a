"""Command line: `python -m arcwise.app params.txt` solves the network that a parameters file names.

Reads the network and a trips file per class, repairs connectivity, runs the origin-based solver (from stored bushes
if asked), writes flows, the report and path flows, and stores state by batch."""

from __future__ import annotations

import logging
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.config import RunConfig, parse_config
from arcwise.functions import metrics as M
from arcwise.operators import bushes, graph
from arcwise.operators import kernels as K
from arcwise.plans import solver as S
from arcwise.schema import LINKS, NetworkMeta
from arcwise.sources import sinks, tntp


log = logging.getLogger("arcwise")
#: Passes of a run whose file gives no iteration limit: it ends by gap or time.
MANY = 1_000_000
#: Settings that change only how the same result is come by, where Spark or the kernels decide.
NO_EFFECT = {
    "threads": "Spark's tasks are the threads",
    "queue_discipline": "labels are settled in order of cost",
    "reuse_first_bush": "each origin's first bush is its own shortest tree",
    "min_reduced_cost": "it bounds a report that is made on demand (acceptance)",
}


def repaired(spark: SparkSession, meta: NetworkMeta, links: DataFrame) -> DataFrame:
    """The links with artificial ones that make the network strongly connected."""
    nodes = spark.range(meta.nodes).select(F.col("id").cast("int").alias("node_id"))
    extra = graph.artificial_links(links, nodes).toPandas()  # two a node at most
    rows = [(meta.links + i, int(r.tail), int(r.head), r.capacity, r.length, r.free_flow_time, 0.0, 1.0, 0.0, 0.0, 0, "linear", True) for i, r in enumerate(extra.itertuples())]
    return links.unionByName(spark.createDataFrame(rows, LINKS)) if rows else links


def views(links: DataFrame, demand: DataFrame, classes: DataFrame) -> None:
    """The tables by name, for SQL on them."""
    for name, df in (("links", links), ("demand", demand), ("classes", classes)):
        df.createOrReplaceTempView(name)


def solver_config(cfg: RunConfig) -> S.SolverConfig:
    """The run's settings; tags that mean nothing here are named in a warning."""
    for name, why in NO_EFFECT.items():
        if name in cfg.given:
            log.warning("%s has no effect: %s", name, why)
    rules = K.ShiftRules(
        floor=cfg.min_derivative, min_flow=cfg.min_link_flow, step=cfg.newton_step, newton_shifts=cfg.newton_shifts, repetitions=cfg.shift_repetitions,
        rescan=cfg.rescan_after_shift, least_difference=cfg.min_cost_difference, least_flow=cfg.min_link_flow_shift, rest_gap=cfg.threshold_gap,
        rest_excess=cfg.threshold_aec, update=cfg.link_cost_update,
    )
    return S.SolverConfig.preset(
        cfg.algorithm, gap=cfg.gap, gap_function=cfg.gap_function, max_iterations=MANY if cfg.max_iterations is None else cfg.max_iterations, max_seconds=cfg.max_seconds,
        inner_passes=cfg.inner_iterations, rules=rules, exclude_gap_time=cfg.exclude_gap_time,
    )


def run(spark: SparkSession, cfg: RunConfig) -> dict:
    """Solve and write; returns the totals."""
    meta, links = tntp.read_network(spark, cfg.file_path + cfg.network)
    heads, demand = tntp.read_trips(spark, [cfg.file_path + t for t in cfg.trips], cfg.demand_multiplier, meta.zones)
    demand = demand.checkpoint()  # parsed once
    classes = tntp.class_factors(spark, meta, heads)
    links = repaired(spark, meta, links)
    views(links, demand, classes)
    net = S.Network.of(links, classes, demand, meta.first_thru, meta.nodes)
    stem = f"{cfg.data_path}{cfg.batch_stem}"
    start = sinks.read_state(spark, stem).drop("batch") if cfg.warm_start else None
    result = S.solve(net, demand, solver_config(cfg), start)
    lc = result.link_class(spark, net)
    state = M.link_state(links, lc.select("arc_id", "flow"))
    size = -(-meta.zones * len(heads) // cfg.batches)
    if cfg.store_bushes:
        sinks.write_state(sinks.with_batch(result.bushes, meta.zones, size), stem)
    if cfg.store_matrices:
        sinks.write_state(sinks.with_batch(demand, meta.zones, size), f"{cfg.data_path}{cfg.matrix_stem}")
    totals = M.class_totals(state, lc)
    if len(heads) == 1:
        sinks.write_flows(links, lc, cfg.flows_file)
    else:
        sinks.write_multiclass(links, lc, state, totals, list(range(len(heads))), cfg.flows_file)
    if cfg.path_flows_file:
        sinks.write_paths(bushes.path_flows(result.bushes, demand), cfg.path_flows_file)
    k, gap, objective, tstt, sptt, _ = result.iterations[-1]
    out = {"iterations": k, "gap": gap, "tstt": tstt, "sptt": sptt}
    if not cfg.omit_beckmann:
        out["objective"] = objective
    if cfg.entropy:
        out["entropy"] = bushes.entropy(result.bushes, cfg.min_link_flow).agg(F.sum("entropy")).first()[0]
    return out


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m arcwise.app PARAMETERS", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("arcwise").getOrCreate()
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    if not spark.conf.get("spark.checkpoint.dir", ""):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/arcwise-checkpoints")
    for k, v in run(spark, parse_config(tntp.read_text(spark, args[0]))).items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
