"""Text readers: network, trips and flow files, as functions and as the data source format "tntp".

`spark.read.format("tntp").option("kind", "network"|"trips"|"flow").load(path)` after `register(spark)`."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from arcwise.config import metadata
from arcwise.schema import LINKS, NetworkMeta

log = logging.getLogger("arcwise")
TRIPS = "class_id int, origin int, dest int, trips double"
FLOW = "tail int, head int, volume double, cost double"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


class FormatError(ValueError):
    """A file that breaks the format; the message has the line."""


def read_text(spark: SparkSession, path: str) -> str:
    """A whole control-plane file through Spark's readers, so any store works."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0][0] if rows else ""


def split_header(text: str) -> tuple[dict[str, str], list[str]]:
    """Metadata (tag -> value) and the body's lines without comments and blank lines."""
    head, body, inside = {}, [], True
    for line in text.splitlines():
        got = metadata(line)
        if got is None:
            continue
        tag, value = got
        if inside and tag == "END OF METADATA":
            inside = False
        elif inside and tag:
            head[tag] = value
        elif not inside:
            body.append(line.split("~", 1)[0].strip())
    return head, body


def network_meta(head: dict[str, str]) -> NetworkMeta:
    try:
        zones, nodes, links = (int(head[f"NUMBER OF {k}"]) for k in ("ZONES", "NODES", "LINKS"))
    except KeyError as e:
        raise FormatError(f"missing header tag {e}") from e
    if "FIRST THRU NODE" not in head:
        log.warning("no first through node given; using 1")
    known = {"NUMBER OF ZONES", "NUMBER OF NODES", "NUMBER OF LINKS", "FIRST THRU NODE", "TOLL FACTOR", "DISTANCE FACTOR"}
    for tag in sorted(set(head) - known):
        log.warning("unknown header tag %s", tag)
    return NetworkMeta(zones, nodes, links, int(head.get("FIRST THRU NODE", 1)) - 1, float(head.get("TOLL FACTOR", 0)), float(head.get("DISTANCE FACTOR", 0)))


def parse_network(text: str) -> tuple[NetworkMeta, list[tuple]]:
    """Meta and rows of the `links` schema, arc ids in file order. Bad rows raise, odd values warn."""
    head, body = split_header(text)
    meta, rows = network_meta(head), []
    for line in body:
        f = line.replace(";", " ").split()
        try:
            tail, head_, cap, length, t0, a, b, speed, toll = int(f[0]) - 1, int(f[1]) - 1, *map(float, f[2:9])
            kind = int(float(f[9]))
        except (ValueError, IndexError) as e:
            raise FormatError(f"link row {line!r} needs ten numbers") from e
        if not (0 <= tail < meta.nodes and 0 <= head_ < meta.nodes):
            raise FormatError(f"link row {line!r}: node out of range")
        if t0 < 0 or a < 0 or b < 0 or cap <= 0:
            raise FormatError(f"link row {line!r}: negative time, alpha or beta, or no capacity")
        if length < 0 or speed < 0 or toll < 0:
            log.warning("link row %r: negative length, speed limit or toll", line)
        rows.append((len(rows), tail, head_, cap, length, t0, a, b, speed, toll, kind, "linear" if b == 1 else "quartic" if b == 4 else "general", False))
    if len(rows) != meta.links:
        raise FormatError(f"{len(rows)} link rows; the header says {meta.links}")
    return meta, rows


def parse_trips(text: str, class_id: int = 0, multiplier: float = 1.0, zones: int | None = None, strict_semicolons: bool = False) -> tuple[dict, list[tuple]]:
    """Header and rows (class_id, origin, dest, trips). The file's demand multiplier beats the given one. Of a
    repeated cell the last value stays. strict_semicolons: only pairs ended by `;`, else one pair a line."""
    head, body = split_header(text)
    if zones is not None and "NUMBER OF ZONES" in head and int(head["NUMBER OF ZONES"]) != zones:
        raise FormatError("the trips file has another number of zones than the network")
    factor, origin, cells, total = float(head.get("DEMAND MULTIPLIER") or multiplier), None, {}, 0.0
    for line in body:
        if m := re.match(r"Origin\s+(\d+)", line, re.IGNORECASE):
            origin, line = int(m[1]) - 1, line[m.end() :]
        parts = [p for p in line.split(";") if p.strip()] if strict_semicolons else [line]
        for part in parts:
            pairs = re.findall(rf"(\d+)\s*:\s*({NUMBER})", part)
            for d, v in pairs[:1] if strict_semicolons else pairs:
                if origin is None:
                    raise FormatError(f"{line!r} comes before any origin")
                if float(v) < 0:
                    raise FormatError(f"negative demand {v}")
                if zones is not None and not (0 <= origin < zones and 1 <= int(d) <= zones):
                    raise FormatError(f"{line!r}: zone out of range")
                cells[origin, int(d) - 1] = float(v) * factor
                total += float(v)
    if (t := float(head.get("TOTAL OD FLOW") or 0)) and abs(total - t) > 0.01 * t:
        log.warning("total demand %s differs from the header's %s", total, t)
    return head, [(class_id, o, d, v) for (o, d), v in cells.items()]


def parse_flow(text: str) -> list[tuple]:
    """Rows (tail, head, volume, cost) of a solution table with a header line."""
    out = []
    for line in text.splitlines()[1:]:
        if f := line.split():
            out.append((int(f[0]) - 1, int(f[1]) - 1, float(f[2]), float(f[3])))
    return out


def read_network(spark: SparkSession, path: str) -> tuple[NetworkMeta, DataFrame]:
    meta, rows = parse_network(read_text(spark, path))
    return meta, spark.createDataFrame(rows, LINKS)


HEADER_LINES = 1000


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The metadata at a file's start; its body stays where it is."""
    lines = [r[0] for r in spark.read.text(path).limit(HEADER_LINES).collect()]
    if not any((m := metadata(line)) and m[0] == "END OF METADATA" for line in lines):
        raise FormatError(f"no end of metadata in the first {HEADER_LINES} lines of {path}")
    return split_header("\n".join(lines))[0]


def read_trips(spark: SparkSession, paths: list[str], multiplier: float = 1.0, zones: int | None = None, strict_semicolons: bool = False) -> tuple[list[dict], DataFrame]:
    """Headers and demand of one file per class. Rows without demand are left out. Each file's body is parsed in a task
    of its own, so the driver holds headers only; a row that breaks the format fails the first action."""

    def reader(class_id: int):
        def parse(frames):
            import pandas as pd

            for f in frames:
                for text in f["value"]:
                    rows = [r for r in parse_trips(text, class_id, multiplier, zones, strict_semicolons)[1] if r[3] > 0]
                    for i in range(0, len(rows), 100_000):
                        yield pd.DataFrame(rows[i : i + 100_000], columns=["class_id", "origin", "dest", "trips"])

        return parse

    heads = [read_header(spark, path) for path in paths]
    if zones is not None and any(int(h.get("NUMBER OF ZONES", zones)) != zones for h in heads):
        raise FormatError("a trips file has another number of zones than the network")
    parts = [spark.read.text(path, wholetext=True).mapInPandas(reader(c), TRIPS) for c, path in enumerate(paths)]
    return heads, reduce(DataFrame.unionByName, parts)


def class_factors(spark: SparkSession, meta: NetworkMeta, heads: list[dict]) -> DataFrame:
    rows = [(c, float(h.get("TOLL FACTOR") or meta.toll_factor), float(h.get("DISTANCE FACTOR") or meta.distance_factor)) for c, h in enumerate(heads)]
    return spark.createDataFrame(rows, "class_id int, toll_factor double, distance_factor double")


def trips_lines(df: DataFrame) -> DataFrame:
    """Relational trips reader for a frame (line_no, line): origin carried forward, all pairs of a line exploded."""
    from pyspark.sql import Window

    origin = F.regexp_extract("line", r"(?i)^\s*Origin\s+(\d+)", 1)
    w = Window.partitionBy(F.lit(0)).orderBy("line_no")  # one file's lines: bounded by the zone count
    pairs = F.regexp_extract_all("line", F.lit(rf"(\d+\s*:\s*{NUMBER})"), 1)
    return (
        df.withColumn("origin", F.last(F.when(origin != "", origin.cast("int") - 1), True).over(w))
        .select("origin", F.explode(pairs).alias("p"))
        .select("origin", (F.split("p", r"\s*:\s*")[0].cast("int") - 1).alias("dest"), F.split("p", r"\s*:\s*")[1].cast("double").alias("trips"))
    )


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        kind, text = self.options.get("kind", "network"), self.options["text"]
        if kind == "network":
            yield from parse_network(text)[1]
        elif kind == "trips":
            yield from parse_trips(text, int(self.options.get("class_id", 0)))[1]
        else:
            yield from parse_flow(text)


class TntpDataSource(DataSource):
    """Format "tntp". The file's text is fetched by Spark on the driver: such files are control-plane sized."""

    @classmethod
    def name(cls) -> str:
        return "tntp"

    def schema(self) -> str:
        return {"network": LINKS, "trips": TRIPS, "flow": FLOW}[self.options.get("kind", "network")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def load(spark: SparkSession, path: str, kind: str = "network", **options) -> DataFrame:
    """Register the format and read `path` with it; the text goes through Spark's readers."""
    spark.dataSource.register(TntpDataSource)
    return spark.read.format("tntp").options(kind=kind, text=read_text(spark, path), **options).load()
