"""Mixing sources to target weights by the cube method.

Every document is taken a whole number of times: its source's target over its size, rounded down, plus one with the
fractional rest as probability. The flight phase moves these probabilities through the null space of two constraints -
words and documents - until almost all are 0 or 1; it runs on bounded parts of each source, and what is left of the
parts meets again in fewer parts, until one part a source holds the landing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.llm.common import chunks, columns, doc_id, fresh, keep, keyed, with_keys, words_of

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
PART = 4096
#: Sources that a mix may have: each is a row on the driver and in a broadcast, some 100 bytes.
MAX_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of all words by weight, at most `most` times the source; the excess goes to
    the others by weight until none is above. Sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(sizes)
    left, out, open_ = float(sum(size.values())), {}, [s for s, _ in order]
    while open_:
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if left * w[s] / total > most * size[s]]
        if not above:
            return out | {s: left * w[s] / total for s in open_}
        for s in above:
            out[s] = most * size[s]
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


EPS = 1e-9
BIG = 4.0
BALLAST = 64


def settle(i: int, rest: np.ndarray, size: np.ndarray, p: np.ndarray, draws) -> None:
    """Move p[i] to 0 or 1 against all of `rest` at once: along the shortest vector that keeps both sums, or the words
    alone where the rest's sizes don't allow both. For units that no two small ones could outweigh. Where the rest has
    words enough to make up for one way only, or for neither, the unit goes the way that leaves the rest the least:
    nearness to the target comes before chance."""
    while EPS < p[i] < 1 - EPS:
        rest = rest[(p[rest] > EPS) & (p[rest] < 1 - EPS) & (size[rest] > 0)]
        if not len(rest):
            return
        s = size[rest]
        n, s1, s2 = len(rest), s.sum(), (s * s).sum()
        det = n * s2 - s1 * s1
        if n > 2 and det > 1e-9 * n * s2:
            u = (-s2 + size[i] * s1 + s * (s1 - n * size[i])) / det
        else:
            u = -size[i] * s / s2
        who, u = np.append(rest, i), np.append(u, 1.0)
        moved = np.abs(u) > 1e-15
        who, u = who[moved], u[moved]
        room_up, room_down = np.where(u > 0, 1 - p[who], p[who]) / np.abs(u), np.where(u > 0, p[who], 1 - p[who]) / np.abs(u)
        up, down = room_up.min(), room_down.min()
        short_up, short_down = size[i] * (1 - p[i]) - (s * p[rest]).sum(), size[i] * p[i] - (s * (1 - p[rest])).sum()
        chance = next(draws) * (up + down) < down
        step = up if (chance if max(short_up, short_down) <= 0 else short_up < short_down) else -down
        q = p[who] + step * u
        p[who] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p to 0 or 1, keeping sum(p) and sum(size * p), until a few small units are left between that can't move.

    Units far above the mean go first, each against all others; then three at a time, along the one direction that
    keeps both sums; the smallest are held back, so that what can't be settled is small. Near the end the words are
    kept rather than the number."""
    p, size = p.copy(), size.astype(float)
    draws = iter(lambda: float(rng.random()), None)
    todo = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    todo = todo[np.argsort(-size[todo], kind="stable")]
    for k in range(int((size[todo] > BIG * size[todo].mean()).sum()) if len(todo) else 0):
        settle(todo[k], todo[k + 1 :], size, p, draws)
    open_ = todo[(p[todo] > EPS) & (p[todo] < 1 - EPS)]
    middle, held = open_[: max(0, len(open_) - BALLAST)], open_[max(0, len(open_) - BALLAST) :]
    queue, s, q, pool = middle[::-1].tolist(), size.tolist(), p.tolist(), []
    while True:
        while len(pool) < 3 and queue:
            pool.append(queue.pop())
        if len(pool) < 2 or (len(pool) == 2 and s[pool[0]] != s[pool[1]]):
            break
        if len(pool) == 2 or s[pool[0]] == s[pool[1]]:
            u = (1.0, -1.0, 0.0)
        else:
            a, b, c = (s[i] for i in pool)
            u = (b - c, c - a, a - b)
        up = min((1 - q[i]) / v if v > 0 else -q[i] / v for i, v in zip(pool, u, strict=False) if v)
        down = min(q[i] / v if v > 0 else (q[i] - 1) / v for i, v in zip(pool, u, strict=False) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(pool, u, strict=False):
            q[i] += step * v
            q[i] = 0.0 if q[i] < EPS else 1.0 if q[i] > 1 - EPS else q[i]
        pool = [i for i in pool if 0 < q[i] < 1]
    p = np.array(q)
    last = np.concatenate([np.array(pool, int), held])
    last = last[np.argsort(-size[last], kind="stable")]
    for k in range(len(last) - 1):
        settle(last[k], last[k + 1 :], size, p, draws)
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The few probabilities left go where the words come nearest to their sum."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    small = left[np.argsort(-size[left], kind="stable")][8:]
    p[small] = np.round(p[small])  # without words, or more than chance leaves
    left = np.setdiff1d(left, small)
    want = float((size[left] * p[left]).sum())
    options = [np.array([m >> k & 1 for k in range(len(left))], float) for m in range(1 << len(left))]
    p[left] = min(options, key=lambda o: (abs(float((size[left] * o).sum()) - want), o.sum()))
    return p


def polish(size: np.ndarray, copies: np.ndarray, want: float, most: float) -> np.ndarray:
    """Copies that come nearer to `want` words: from the largest unit down, each is taken more or less often, within 0
    and `most` times, by what still lacks. Only where a few large units are most of a source is there much to do."""
    copies = copies.copy()
    lack = want - float((size * copies).sum())
    for i in np.argsort(-size, kind="stable"):
        if size[i] == 0 or lack == 0:
            break
        k = min(max(copies[i] + round(lack / size[i]), 0.0), most) - copies[i]
        copies[i] += k
        lack -= k * size[i]
    return copies


def counted(docs: DataFrame) -> DataFrame:
    """(did, rid, src, size): words of each text. src has the source behind "0", null is "1"."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = [np.diff(words_of(buf, starts)[2]) for _, buf, starts in chunks(b.column("text"))]
            size = pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), b.column("src"), size], ["did", "rid", "src", "size"])

    src = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    return keyed(docs, src.alias("src")).mapInArrow(run, "did long, rid long, src string, size long")


COLUMNS = "did long, rid long, src string, size long, source_size long, target double, base int, p double, parts int"


def flying(level: int, most: float):
    """The flight of one part; a source's only part lands too, and is polished."""

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "rid", "did"], ascending=[False, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        p = flight(size, pdf.p.to_numpy(), np.random.default_rng([level, int(key[1]), *key[0].encode()]))
        if pdf.parts.iat[0] == 1:
            base = pdf.base.to_numpy().astype(float)
            p = polish(size, base + landing(size, p), float((size * (base + pdf.p.to_numpy())).sum()), most) - base
        return pdf.assign(p=p).drop(columns="part")

    return fly


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: float = MOST, part: int = PART) -> DataFrame:
    """One row per document: did, rid, doc_id, source, size, source_size, target, copies, taken (copies x size).

    Each source's words come as near its target as its documents' sizes allow. Null texts have size 0 and are taken as
    often as chance has it, which adds no words; a source without words has
    target 0 and gives nothing; a null source is a source, the last. Repeated rows are documents of their own; very long
    texts count whole; a null doc_id is an id like others; extra columns, whatever their names, are ignored; an empty
    table gives an empty result. Reruns agree: chance comes from row keys. The driver gets one row per source; more than
    MAX_SOURCES are refused. What the flight leaves open lands where the words come nearest to their sum: exactly for
    the eight largest such documents, by rounding for the rest, and polish() then moves copies for nearness."""
    sized = keep(counted(docs), "sizes")
    total = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(total) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: a mix weighs sources one by one, so group them first")
    goal = targets([(None if r["src"] == "1" else r["src"][1:], r["source_size"]) for r in total], weights, most)
    rows = []
    for r in total:
        t = goal[None if r["src"] == "1" else r["src"][1:]]
        ratio = min(most, t / r["source_size"]) if r["source_size"] else 0.0
        base = min(math.floor(ratio + 1e-12), int(most))
        rows.append((r["src"], r["source_size"], float(t), base, max(0.0, ratio - base), math.ceil(r["n"] / part)))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "src string, source_size long, target double, base int, p double, parts int")
    bucket = lambda salt: F.pmod(F.xxhash64("did", "rid", F.lit(salt)), F.col("parts")).cast("int")
    state, done, level, most_parts = sized.join(F.broadcast(plan), "src"), None, 1, max([r[5] for r in rows], default=1)
    while True:
        state = state.withColumn("part", bucket(level))
        state = keep(state.groupBy("src", "part").applyInPandas(flying(level, most), COLUMNS), "flight")
        over = (F.col("parts") == 1) | F.col("p").isin(0.0, 1.0)
        done = state.where(over) if done is None else done.unionByName(state.where(over))
        if most_parts <= 1:
            break
        # a part leaves two or three between, so far fewer parts do next
        level, most_parts = level + 1, math.ceil(most_parts * 4 / part)
        state = state.where(~over).withColumn("parts", F.ceil(F.col("parts") * 4 / part).cast("int"))
    copies = F.round(F.col("base") + F.col("p")).cast("int")
    return done.select("did", "rid", doc_id(), F.when(F.col("src") != "1", F.substring("src", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The mix: each document as often as it is taken, with all its columns. Rows that repeat id and text share what
    they were given. Null and empty texts are taken as chance has it; an empty table stays empty."""
    did, rid, copies, rows, n = fresh(docs, "did", "rid", "copies", "rows", "n")
    by = mix_sources(docs).groupBy(F.col("did").alias(did), F.col("rid").alias(rid))
    picked = keep(by.agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0), "picked")
    x = with_keys(docs, did, rid).join(picked, [did, rid])
    no = F.row_number().over(Window.partitionBy(did, rid).orderBy(copies)) - 1
    share = F.floor(F.col(copies) / F.col(rows)).cast("int") + F.when(no < F.col(copies) % F.col(rows), 1).otherwise(0)
    x = x.withColumn(n, share).where(F.col(n) > 0)
    return x.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns(docs))
