"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a few bits by tiled exact comparison.

Tiles hold fingerprints of one band of population counts; only tiles of the same or the next band meet, since others
differ by more than the radius, and inside a tile pair slabs are skipped likewise. In front stands a filter that loses no
pair: two fingerprints within r bits agree wholly in one of r + 1 blocks of bits, so tiles are cut by a block's value.
A band of a block's value above the tile size is dealt over more tiles, so no task holds a hot one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import components, doc_id, drop, keep, keyed, restrict

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 4096
RUN = 1024
SLAB = 256
NONE = np.zeros(0, np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the shingles' XXH64. No words: 0; fewer words than a shingle: one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.append(0, ends[: n - shingle]).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    arr = np.array(h, np.uint64)
    for i in range(0, len(arr), 1 << 14):
        bits = np.unpackbits(arr[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((counts * 2 > len(arr)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(did, rid, fp): fp as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint((t or "").encode(), shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), pa.array(fp.view(np.int64))], ["did", "rid", "fp"])

    return keyed(docs).mapInArrow(run, "did long, rid long, fp long")


def local_links(home: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (home, then others) linked inside the tile pair, each with the first node of its component. home meets
    others, or itself if there are none; slabs whose population counts differ beyond the radius are skipped. Only a
    spanning star leaves the pair, however many links there are inside."""
    home, others = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (home, others))
    nodes = np.concatenate([home, others])
    count = np.bitwise_count(nodes).astype(np.int64)
    lab = np.arange(len(nodes))
    for i in range(0, len(home), SLAB):
        a = slice(i, min(i + SLAB, len(home)))
        for j in range(len(home), len(nodes), SLAB) if len(others) else range(i, len(home), SLAB):
            b = slice(j, min(j + SLAB, len(home) if j < len(home) else len(nodes)))
            if count[b.start] - count[a.stop - 1] > radius or count[a.start] - count[b.stop - 1] > radius:
                continue
            near = np.bitwise_count(nodes[a, None] ^ nodes[None, b]) <= radius
            for r in np.flatnonzero(near.sum(1) > (i == j)):
                ids = np.unique(np.append(lab[b][near[r]], lab[i + r]))
                if len(ids) > 1:
                    lab[np.isin(lab, ids[1:])] = ids[0]
    hit = np.flatnonzero(np.isin(lab, np.flatnonzero(np.bincount(lab, minlength=len(nodes)) > 1)))
    return nodes[hit], nodes[lab[hit]]


def blocks(radius: int) -> list:
    """The fingerprint's bits in radius + 1 blocks, as long Columns: two within `radius` bits agree in one of them."""
    cut = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
    mask = [(1 << (b - a)) - 1 if b - a < 64 else -1 for a, b in zip(cut, cut[1:], strict=False)]
    return [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(m).cast("long")) for a, m in zip(cut, mask, strict=False)]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that span the components of the distinct values in `fp` linked within `radius` bits (below 64)."""
    which = [F.struct(F.lit(k).alias("blk"), v.alias("val")) for k, v in enumerate(blocks(radius))]
    values = keep(fps.select("fp").distinct(), "values")
    band = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    rows = values.select("fp", band.alias("band"), F.explode(F.array(*which)).alias("z")).select("z.blk", "z.val", "band", "fp")
    bucket, cell = ["blk", "val"], ["blk", "val", "band"]
    parts = keep(rows.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "parts")
    dealt = rows.join(parts, cell).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = keep(dealt.groupBy(*cell, "p").agg(F.collect_list("fp").alias("fps")), "tiles")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    home = parts.select(*cell, each.alias("p")).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band2", F.col("band") + F.col("o"))
    other = parts.select(*bucket, F.col("band").alias("band2"), each.alias("p2"))
    pairs = home.join(other, [*bucket, "band2"]).where("o = 1 or p2 > p").drop("o")
    met = pairs.join(tiles, [*cell, "p"]).join(tiles.withColumnsRenamed({"band": "band2", "p": "p2", "fps": "fps2"}), [*bucket, "band2", "p2"])
    own = tiles.where(F.size("fps") > 1).select("fps", F.array().cast("array<long>").alias("fps2"))

    def edges(u, v):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)[u != v]) for x in (u, v)], ["u", "v"])

    def compare(batches):
        """Small pairs meet together, where a link between two of them is as true as any."""
        held, size = [], 0
        for b in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (b.column("fps"), b.column("fps2"))]
            for i in range(len(b)):
                x, y = (v[o[i] : o[i + 1]] for o, v in lists)
                if len(x) + len(y) >= RUN:
                    yield edges(*local_links(x, y, radius))
                    continue
                held += [x, y]
                size += len(x) + len(y)
                if size >= RUN:
                    yield edges(*local_links(np.unique(np.concatenate(held)), NONE, radius))
                    held, size = [], 0
        if held:
            yield edges(*local_links(np.unique(np.concatenate(held)), NONE, radius))

    out = keep(own.unionByName(met.select("fps", "fps2")).mapInArrow(compare, "u long, v long"), "links")
    drop(values, parts, tiles)
    return out


def near_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: did, rid, doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable),
    root (the component's smallest fingerprint as a signed long, which names it even where ids repeat or are null).

    Null, empty and blank texts have fingerprint 0 and link like others; very long texts are hashed shingle by shingle;
    repeated rows are returned each; a null doc_id comes before all ids; extra columns are ignored; an empty table gives
    an empty result. Equal fingerprints are one node, so copies cost nothing in the comparison."""
    fps = keep(fingerprints(docs, shingle), "fps")
    roots = components(links(fps, radius))
    ids = keep(fps.groupBy("fp").agg(F.min("did").alias("low")), "ids")
    named = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    low = keep(named.groupBy("root").agg(F.min("low").alias("component")), "roots")
    classes = keep(named.join(low, "root").select("fp", "root", "component"), "classes")
    return fps.join(classes, "fp").select("did", "rid", doc_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), doc_id("component").alias("component_id"), "root")


def near_dedup_stage(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that with the smallest doc_id (null first, then row key), with all its columns. Null and
    empty texts are one component with what links to fingerprint 0; an empty table stays empty."""
    first = near_dedup(docs, radius).groupBy("root").agg(F.min(F.struct("did", "rid")).alias("k"))
    return restrict(docs, keep(first.select("k.did", "k.rid"), "kept"), once=True)
