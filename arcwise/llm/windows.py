"""Repeated windows of texts, exact, as a graph of paths: shared by the substring and suffix-array operators.

A window is `size` consecutive units (words or bytes) of one document: an edge of a De Bruijn graph, whose nodes are what
neighbouring windows share. All windows in a row whose smallest k-gram hash is the same form one path, so equal windows
always lie in paths with the same key, wherever they occur. Per key one aggregation tells: one path (nothing repeats),
equal paths (all repeats), or paths that differ or that may repeat inside themselves (the graph branches there).

Repeated paths that follow each other with in- and out-degree 1 compact to chains, by joins of the degrees. Digests only
propose: the source units of every chain are compared at its coordinates, and where two differ the search runs again
with other digests. Nothing is removed that wasn't compared; no key gathers its occurrences in one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwise.llm.common import SPACE, TABLES, Prefix, chunks, drop, keep, keyed, word_hashes, words_of

#: Units that one comparison row holds at most.
BLOCK = 1 << 15
#: Seeds of the digests, one a run; the next is used only if two different stretches shared a digest under the last.
SEEDS = (42, 1042, 2042)


@dataclass(frozen=True)
class Units:
    """What windows are made of: words or bytes; window size; k-gram whose smallest hash names a path; positions that
    are looked at together, which bounds the hashes held of a very long text."""

    words: bool
    size: int
    k: int
    piece: int = 1 << 17


class Bytes:
    """The bytes of concatenated texts as units; begin and end of each text."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        self.buf, self.raw = buf, memoryview(np.ascontiguousarray(buf))
        self.begin, self.end = starts, np.append(starts[1:], len(buf))
        self.length = len(buf)

    def hashes(self, a: int, b: int) -> np.ndarray:
        return TABLES[0][self.buf[a:b]]

    def content(self, a: int, b: int) -> memoryview:
        return self.raw[a:b]


class Words:
    """The words of concatenated texts as units, kept with one space between them, so that equal sequences of words are
    equal bytes."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        first, end, marks = words_of(buf, starts)
        self.begin, self.end = marks[:-1], marks[1:]
        gap = SPACE[buf]
        behind = end[end < len(buf)]
        behind = behind[gap[behind]]
        kept = ~gap
        kept[behind] = True
        place = np.append(0, np.cumsum(kept))
        self.flat = buf[kept]
        self.flat[place[behind]] = 0x20
        self.first, self.last = place[first], place[end]
        self.raw = memoryview(self.flat)
        self.length = len(first)

    def hashes(self, a: int, b: int) -> np.ndarray:
        x, y = self.first[a], self.last[b - 1]
        return word_hashes(self.flat[x:y], self.first[a:b] - x, self.last[a:b] - x)

    def content(self, a: int, b: int) -> memoryview:
        return self.raw[self.first[a] : self.last[b - 1]]


def sequence(u: Units, buf: np.ndarray, starts: np.ndarray) -> Bytes | Words:
    return Words(buf, starts) if u.words else Bytes(buf, starts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    span = 1
    out = x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def paths(u: Units, seq: Bytes | Words):
    """(text, start, windows, key, loops) of every path. loops: the smallest k-gram recurs, without which no two windows
    of one path can be equal. Very long texts go in pieces that share size - 1 units; a path cut there is a path of its
    own, which costs a closer look but changes no result."""
    out = []
    for at in range(0, max(1, seq.length - u.size + 1), u.piece):
        to = min(seq.length, at + u.piece + u.size - 1)
        if to - at < u.size:
            continue
        grams = Prefix(seq.hashes(at, to), 0).all(u.k)
        low = sliding_min(grams, u.size - u.k + 1)
        pos = np.arange(at, at + len(low))
        text = np.searchsorted(seq.begin, pos, side="right") - 1
        ok = pos + u.size <= seq.end[text]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
        s = np.flatnonzero(new & ok)
        if not len(s):
            continue
        # a path ends where the next starts or where windows stop being whole
        stop = np.minimum(np.append(s[1:], len(low)), np.maximum(seq.end[text[s]] - at - u.size + 1, 0))
        led = np.append(0, np.cumsum(grams[: len(low)] == low))  # windows that start with their smallest k-gram
        out.append((text[s], pos[s] - seq.begin[text[s]], stop - s, low[s].view(np.int64), led[stop - 1] > led[s]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def path_rows(u: Units, docs: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            did, rid = b.column("did").to_numpy(), b.column("rid").to_numpy()
            for row, buf, starts in chunks(b.column("text")):
                seq = sequence(u, buf, starts)
                t, s, n, key, loops = paths(u, seq)
                if len(t):
                    at = seq.begin[t] + s
                    dig = np.array([digest(seq.content(x, y), seed) for x, y in zip(at.tolist(), (at + n + (u.size - 1)).tolist(), strict=True)], np.uint64)
                    cols = [did[row + t], rid[row + t], key, dig.view(np.int64), s.astype(np.int32), n.astype(np.int32), loops]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["did", "rid", "key", "digest", "start", "n", "loops"])

    return keyed(docs).mapInArrow(run, "did long, rid long, key long, digest long, start int, n int, loops boolean")


SAME, OPEN = 1, 2
PLACE = ["did", "rid", "start", "n"]


@dataclass(frozen=True)
class Repeats:
    """same: (did, rid, start, n, key, digest) of the paths that occur more than once. open: one (key, did, rid, start,
    n, loops, units) for each different path that shares its key with others or loops; units: what the different paths
    of the key hold together."""

    same: DataFrame
    open: DataFrame


def classified(u: Units, docs: DataFrame, seed: int) -> Repeats:
    occ = keep(path_rows(u, docs, seed), "paths")
    by = occ.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("c"), F.max("loops").alias("loops")).where("c > 1 or loops")
    kind = F.when((F.col("lo") == F.col("hi")) & (F.col("c") > 1), SAME).otherwise(OPEN)
    kinds = keep(by.select("key", kind.cast("byte").alias("kind")), "kinds")
    marked = keep(occ.join(kinds, "key"), "marked")
    drop(occ, kinds)
    # equal paths under an open key repeat whole; one of them stands for all against the others
    mixed = marked.where(f"kind = {OPEN}")
    first = [F.first(c).alias(c) for c in (*PLACE, "loops")]
    contents = keep(mixed.groupBy("key", "digest").agg(F.count("*").alias("c"), *first), "contents")
    volume = keep(contents.groupBy("key").agg(F.sum(F.col("n") + (u.size - 1)).alias("units")), "volume")
    cols = [*PLACE, "key", "digest"]
    same = mixed.join(contents.where("c > 1").select("key", "digest"), ["key", "digest"]).select(*cols)
    same = keep(marked.where(f"kind = {SAME}").select(*cols).unionByName(same), "same")
    open_ = keep(contents.join(volume, "key").select("key", *PLACE, "loops", "units"), "open")
    drop(marked, contents, volume)
    return Repeats(same, open_)


def per_document(spans: DataFrame, *tags: str) -> DataFrame:
    """One row per document with its spans in an array; the document itself bounds it."""
    return keep(spans.groupBy("did", "rid").agg(F.collect_list(F.struct("start", "n", *tags)).alias("spans")), "spans")


def window_rows(u: Units, docs: DataFrame, spans: DataFrame, seed: int) -> DataFrame:
    """(did, rid, start, key, digest): every single window in the spans; key and digest are halves of one 128-bit hash."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            did, rid, spans_ = b.column("did").to_numpy(), b.column("rid").to_numpy(), b.column("spans")
            for row, buf, starts in chunks(b.column("text")):
                seq = sequence(u, buf, starts)
                for i in range(len(starts)):
                    at = np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in spans_[row + i].as_py()])
                    g = (at + seq.begin[i]).tolist()
                    two = np.frombuffer(b"".join([digest(seq.content(x, x + u.size), seed) for x in g]), np.int64).reshape(-1, 2)
                    cols = [np.full(len(at), did[row + i]), np.full(len(at), rid[row + i]), at.astype(np.int32), two[:, 0], two[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["did", "rid", "start", "key", "digest"])

    return keyed(docs).join(per_document(spans), ["did", "rid"]).mapInArrow(run, "did long, rid long, start int, key long, digest long")


def repeated_windows(u: Units, docs: DataFrame, spans: DataFrame, seed: int) -> DataFrame:
    """The windows in the spans that occur more than once among them: (did, rid, start, n = 1, key, digest). Counts
    combine before the shuffle; the join back has plain exchanges on both sides, so a frequent window's partition can
    be split."""
    rows = keep(window_rows(u, docs, spans, seed), "windows")
    twice = keep(rows.groupBy("key", "digest").count().where("count > 1").select("key", "digest"), "twice")
    out = keep(rows.join(twice, ["key", "digest"]).select("did", "rid", "start", F.lit(1).alias("n"), "key", "digest"), "repeated")
    drop(rows, twice)
    return out


def once(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges without those of rows that repeat id and text: as they are where no row does."""
    keys = keyed(docs).select("did", "rid")
    return edges if keys.groupBy("did", "rid").count().where("count > 1").isEmpty() else edges.distinct()


def chains(edges: DataFrame, *sources: DataFrame) -> DataFrame:
    """(did, rid, start, n, key, digest): the occurrences of nonbranching chains of repeated edges.

    An edge's in-degree counts what comes before its occurrences in their documents: other repeated edges, and anything
    else - unrepeated text, a document's start - as one. Two edges hang together if each is all that ever follows or
    precedes the other. Degrees come from an aggregation over edges and reach the occurrences by a join; key and digest
    are those of the chain's first edge, so all occurrences of a chain agree in them and in n. A cycle is cut where a
    document enters it. Edges of different kinds - paths and single windows - don't mix, and each is there once.
    sources: kept tables behind the edges, which go as soon as they are read."""
    doc = Window.partitionBy("did", "rid", "level").orderBy("start")
    me = F.xxhash64("key", "digest")
    before = F.when(F.lag(F.col("start") + F.col("n")).over(doc) == F.col("start"), F.lag(me).over(doc))
    after = F.when(F.lead("start").over(doc) == F.col("start") + F.col("n"), F.lead(me).over(doc))
    near = keep(edges.select("*", before.alias("before"), after.alias("after")), "edges")
    drop(*sources)
    single = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    degree = keep(near.groupBy("key", "digest").agg(F.coalesce(single("before"), F.lit(False)).alias("one_in"), F.coalesce(single("after"), F.lit(False)).alias("one_out")), "degrees")
    x = near.join(degree, ["key", "digest"])
    hangs = F.col("before").isNotNull() & F.col("one_in") & F.coalesce(F.lag("one_out").over(doc), F.lit(False))
    x = x.withColumn("new", F.when(hangs, 0).otherwise(1)).withColumn("no", F.sum("new").over(doc))
    head = [F.max(F.when(F.col("new") == 1, F.col(c))).alias(c) for c in ("key", "digest")]
    out = keep(x.groupBy("did", "rid", "level", "no").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), *head).drop("no"), "chains")
    drop(near, degree)
    return out


def differing(u: Units, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(level, key, digest, n, block) of the chains whose occurrences are not the same units throughout. Equal stretches
    combine before the shuffle, so copies send one row a task."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            spans_ = b.column("spans")
            for row, buf, starts in chunks(b.column("text")):
                seq = sequence(u, buf, starts)
                cols = [[] for _ in range(6)]
                for i in range(len(starts)):
                    for x in spans_[row + i].as_py():
                        a = int(seq.begin[i]) + x["start"]
                        z = a + x["n"] + u.size - 1
                        for block, s in enumerate(range(a, z, BLOCK)):
                            for c, v in zip(cols, (x["level"], x["key"], x["digest"], x["n"], block, bytes(seq.content(s, min(z, s + BLOCK)))), strict=True):
                                c.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["level", "key", "digest", "n", "block", "units"])

    rows = keyed(docs).join(per_document(spans, "level", "key", "digest"), ["did", "rid"])
    rows = rows.mapInArrow(run, "level int, key long, digest long, n int, block int, units binary").distinct()
    return rows.groupBy("level", "key", "digest", "n", "block").count().where("count > 1")


def compared(u: Units, docs: DataFrame, search: Callable[[int], tuple[list[DataFrame], DataFrame | None]]) -> DataFrame:
    """(did, rid, start, n): runs of repeated windows. search(seed) gives kept tables of the repeated edges that digests
    propose, by level, and other runs whose units were already compared."""
    for seed in SEEDS:
        levels, more = search(seed)
        edges = reduce(DataFrame.unionByName, [e.withColumn("level", F.lit(k)) for k, e in enumerate(levels)])
        found = chains(once(docs, edges), *levels)
        if differing(u, docs, found).isEmpty():
            found = found.select(*PLACE)
            return found if more is None else found.unionByName(more)
        drop(found)
    raise RuntimeError("different texts share their digests under every seed")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return keyed(docs).join(per_document(spans), ["did", "rid"], "left")


def covered(spans, size: int, length: int) -> np.ndarray:
    """Mask of the units that the spans' windows cover."""
    step = np.zeros(length + 1, np.int64)
    s, n = (np.array([x[c] for x in spans], np.int64) for c in ("start", "n"))
    np.add.at(step, s, 1)
    np.add.at(step, np.minimum(s + n + (size - 1), length), -1)
    return np.cumsum(step[:-1]) > 0
