"""Text writers (sorted, one file) and parquet state for warm starts and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_lines(links: DataFrame, link_class: DataFrame) -> DataFrame:
    """Two lines a link, `(tail,head) flow` and the classes' flows; artificial links are left out."""
    by = link_class.groupBy("arc_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "flow"))).alias("f"))
    rows = links.where(~F.col("artificial")).join(by, "arc_id")
    total = F.aggregate("f", F.lit(0.0), lambda acc, s: acc + s["flow"])
    return rows.select(
        "arc_id",
        F.concat(F.format_string("(%d,%d) %.6f\n", F.col("tail") + 1, F.col("head") + 1, total), F.concat_ws(" ", F.transform("f", lambda s: F.format_string("%.6f", s["flow"])))).alias("value"),
    )


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """One text file: such reports have a row per link or path of a network."""
    df.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_flows(links: DataFrame, link_class: DataFrame, path: str) -> None:
    write_lines(flow_lines(links, link_class), path, "arc_id")


def report(links: DataFrame, link_class: DataFrame, state: DataFrame, classes: list[int]) -> DataFrame:
    """Wide report: link, total flow, travel time, one column a class."""
    wide = link_class.groupBy("arc_id").pivot("class_id", classes).sum("flow")
    names = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"class{c + 1}") for c in classes]
    return (
        links.where(~F.col("artificial"))
        .select("arc_id", "tail", "head")
        .join(wide, "arc_id", "left")
        .join(state.select("arc_id", "flow", "time_cost"), "arc_id")
        .select("arc_id", "tail", "head", F.col("flow").alias("total_flow"), F.col("time_cost").alias("travel_time"), *names)
    )


def write_multiclass(links: DataFrame, link_class: DataFrame, state: DataFrame, totals: DataFrame, classes: list[int], path: str) -> None:
    """The report's rows, then the classes' totals and the grand total."""
    wide = report(links, link_class, state, classes)
    cells = [F.format_string("%.6f", c) for c in ["total_flow", "travel_time", *(f"class{k + 1}" for k in classes)]]
    rows = wide.select(F.lit(1).alias("part"), F.col("arc_id").alias("k"), F.concat_ws(" ", F.format_string("(%d,%d)", F.col("tail") + 1, F.col("head") + 1), *cells).alias("value"))
    sums = totals.select(
        F.lit(3).alias("part"),
        F.coalesce("class_id", F.lit(2**30)).cast("int").alias("k"),
        F.concat_ws(" ", F.coalesce((F.col("class_id") + 1).cast("string"), F.lit("TOTAL")), *(F.format_string("%.6f", c) for c in ("time", "distance", "toll", "generalized_cost"))).alias("value"),
    )
    spark = links.sparkSession
    heads = spark.createDataFrame(
        [(0, 0, " ".join(["Link", "TotalFlow", "TravelTime", *(f"Class{k + 1}" for k in classes)])), (2, 0, "Class Time Distance Toll GeneralizedCost")], "part int, k int, value string"
    )
    write_lines(rows.unionByName(sums).unionByName(heads), path, "part", "k")


def write_paths(paths: DataFrame, path: str) -> None:
    """`[n1,n2,...] : flow`, with the file's 1-based nodes."""
    nodes = F.concat_ws(",", F.transform("nodes", lambda n: (n + 1).cast("string")))
    rows = paths.select("class_id", "origin", "dest", "nodes", F.format_string("[%s] : %.6f", nodes, "flow").alias("value"))
    write_lines(rows, path, "class_id", "origin", "dest", "nodes")


def network_text(meta, links: DataFrame) -> str:
    """A network file that read_network reads back; links in forward-star order, ids 1-based."""
    rows = links.where(~F.col("artificial")).orderBy("tail", "head", "arc_id").collect()  # a road network: bounded
    head = [f"<NUMBER OF ZONES> {meta.zones}", f"<NUMBER OF NODES> {meta.nodes}", f"<FIRST THRU NODE> {meta.first_thru + 1}", f"<NUMBER OF LINKS> {len(rows)}", f"<TOLL FACTOR> {meta.toll_factor!r}", f"<DISTANCE FACTOR> {meta.distance_factor!r}", "<END OF METADATA>"]
    cols = ("capacity", "length", "free_flow_time", "alpha", "beta", "speed_limit", "toll", "link_type")
    return "\n".join(head + ["\t".join(map(str, (r["tail"] + 1, r["head"] + 1, *(r[c] for c in cols)))) + "\t;" for r in rows]) + "\n"


def trips_text(zones: int, demand: DataFrame) -> str:
    """A trips file of one class."""
    rows = demand.orderBy("origin", "dest").collect()  # a zone matrix: bounded by zones squared
    out, last = [f"<NUMBER OF ZONES> {zones}", f"<TOTAL OD FLOW> {sum(r['trips'] for r in rows)!r}", "<END OF METADATA>"], None
    for r in rows:
        if r["origin"] != last:
            out.append(f"Origin {r['origin'] + 1}")
            last = r["origin"]
        out.append(f"{r['dest'] + 1} : {r['trips']!r};")
    return "\n".join(out) + "\n"


def with_batch(df: DataFrame, zones: int, batch_size: int, strict: bool = False) -> DataFrame:
    """Batch of each (class, origin): its pseudo-origin's range of batch_size."""
    if strict and zones % batch_size:
        raise ValueError("batches must divide the zones")
    return df.withColumn("batch", F.floor((F.col("class_id") * zones + F.col("origin")) / batch_size).cast("int"))


def write_state(df: DataFrame, path: str) -> None:
    """Demand or bush arcs by batch; rewriting some batches leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_state(spark, path: str, batch: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if batch is None else df.where(F.col("batch") == batch)  # prunes partitions
