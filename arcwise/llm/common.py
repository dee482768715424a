"""What the operators share: the shared folder, row keys, vectorised hashing of texts, connected components."""

from __future__ import annotations

import atexit
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
#: Rows of keys and hashes that may be broadcast, after a count: at most about 64 bytes each.
BROADCAST_ROWS = 200_000
_RUNS: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- tables that cut lineage ------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none and all executors are local."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/arcwise-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder among the shared ones; it goes when the program ends with the session running, or by
    clean(). Results that are still to be read live in it."""
    path = f"{shared_dir(spark)}/arcwise-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(clean, spark, path)
    return path


def clean(spark: SparkSession, path: str | None = None) -> None:
    """Delete the tables that the application's operators kept."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, path or run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: survives lost executors and cuts the plan."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by keep() that no later plan reads, and let Spark clean the shuffles behind them."""
    for t in tables:
        _delete(t.sparkSession, t.kept_path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """(did, rid, text, + cols): did is the id with a stand-in for null, rid tells rows of one id but other text apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("did"), F.xxhash64("doc_id", text).alias("rid"), text.alias("text"), *cols)


def doc_id(col: str = "did"):
    return F.when(F.col(col) != NO_ID, F.col(col)).alias("doc_id")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def with_keys(docs: DataFrame, did: str, rid: str) -> DataFrame:
    """The table with its row keys, as keyed() makes them, under the given names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({did: F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), rid: F.xxhash64("doc_id", text)})


def restrict(docs: DataFrame, keys: DataFrame, how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows whose keys are among (did, rid) of `keys` - or aren't, for left_anti -, with all their columns. once:
    rows that repeat id and text give one."""
    did, rid = fresh(docs, "did", "rid")
    out = with_keys(docs, did, rid).join(keys.select(F.col("did").alias(did), F.col("rid").alias(rid)), [did, rid], how)
    return (out.dropDuplicates([did, rid]) if once else out).select(*columns(docs))


# ---- hashing ----------------------------------------------------------------------------------------------------

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd bases of two polynomial hashes modulo 2**64, and the tables that spread bytes over 64 bits.
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
TABLES = [np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U) for seed in (11, 12)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(1 << 20, 1 << (int(n) - 1).bit_length())
        b = BASES[which]
        out = []
        for base in (b, U(pow(int(b), -1, 2**64))):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[which] = (out[0], out[1])
    a, b = _POWERS[which]
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (splitmix64's finisher)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prefix:
    """Hash of any stretch of a sequence of 64-bit units in constant time."""

    def __init__(self, units: np.ndarray, which: int):
        n = len(units)
        self.pw, self.inv = powers(which, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(units * self.pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inv[start])

    def all(self, length: int) -> np.ndarray:
        s = self.sums
        return mix((s[length:] - s[:-length]) * self.inv[: len(s) - length])


def words_of(buf: np.ndarray, starts: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the word count before each text's start and at the end."""
    gap = gaps[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = gap[:-1]
    inner = starts[(starts < len(buf))]
    edge[inner] = True
    first = np.flatnonzero(edge[:-1] & ~gap)
    last = np.ones(len(buf) + 1, bool)
    last[1:-1] = gap[1:]
    last[inner] = True
    end = np.flatnonzero(last[1:] & ~gap) + 1
    return first, end, np.searchsorted(first, np.append(starts, len(buf)))


def word_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return Prefix(TABLES[which][buf], which).of(first, end - first) if len(first) else np.zeros(0, U)


def chunks(column, limit: int = 1 << 19):
    """Pieces of an Arrow string column: (first row, bytes as array, start of each text). A text longer than the limit
    is a piece of its own."""
    import pyarrow as pa

    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        i = j


# ---- connected components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) with the smallest node of each component, from edges (u, v); roots are listed too.

    Alternating large and small stars: each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest it knows. The minima are written before they are joined, so both join sides are plain exchanges and
    adaptive execution can split the partition of a node with very many neighbours."""
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = keep(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(e, low, large, low2)
        e = new
        if state == last:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        last = state
    raise RuntimeError("components did not settle")


