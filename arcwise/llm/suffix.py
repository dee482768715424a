"""Suffix-array dedup over bytes: two-stage sorting, then common prefixes of neighbours.

Where whole paths (windows.py) are equal their bytes repeat outright, once compared. Where paths under one key differ or
may repeat inside themselves, each different one's bytes go to a task that sorts all suffixes of the key: those smaller
than their successors directly, the rest by scanning the buckets, and reads repeats off the common prefixes of
neighbours. A key too large for one task is cut further: its paths fall into shorter ones by the smallest of longer
grams, level by level, until what shares a key fits; only what differs within a key goes down a level, so a frequent
passage costs a few rows per occurrence and level, not one a byte."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import U, chunks, doc_id, drop, keep, keyed, mix
from arcwise.llm.windows import PLACE, Bytes, Units, classified, compared, covered, paths, per_document, with_spans

WINDOW = 400
K = 48
#: Bytes that are sorted together: keys above it are cut further, and whole keys meet up to it.
SORT_BYTES = 1 << 18


def suffix_array(data: bytes, depth: int | None = None) -> np.ndarray:
    """Start positions of all suffixes in order, exact to `depth` bytes (ties in any order; None: exact).

    A suffix is small if it is less than the one after it. Small ones are sorted directly; scanning the buckets of
    first bytes upwards, each suffix puts its predecessor, if that is not small, next in the predecessor's bucket."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.frombuffer(data, np.uint8).astype(np.int64)
    small = np.zeros(n, bool)
    diff = np.flatnonzero(t[:-1] != t[1:])
    if len(diff):  # an equal run has the kind of the pair that ends it; the last run is large: its end comes first
        nxt = np.searchsorted(diff, np.arange(n - 1))
        inside = nxt < len(diff)
        d = diff[np.minimum(nxt, len(diff) - 1)]
        small[:-1] = inside & (t[d] < t[d + 1])
    end = n if depth is None else depth
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: data[i : i + end]), np.int64)
    first = t[direct] if len(direct) else np.zeros(0, np.int64)
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Place the predecessors of these suffixes; return those that belong to bucket c itself."""
        p = found[found > 0] - 1
        p = p[~small[p]]
        b = t[p]
        higher, own = p[b > c], p[b == c]
        hb = t[higher]
        if len(higher):
            o = np.argsort(hb, kind="stable")
            cut = np.flatnonzero(np.diff(hb[o])) + 1
            for part in np.split(higher[o], cut):
                waiting[t[part[0]]].append(part)
        return own

    for c in range(256):
        fresh = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        large = []
        while len(fresh):
            large.append(fresh)
            fresh = induce(fresh, c)
        part = direct[bounds[c] : bounds[c + 1]]
        out += [*large, part]
        if len(part):
            induce(part, c)
    return np.concatenate(out)


def common_prefix(data: bytes, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to `limit`; eight bytes at a time, then singly."""
    buf = np.frombuffer(data + b"\0" * (limit + 16), np.uint8)
    words = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), (len(buf) - 8,), (1,))  # eight bytes from each place
    out = np.zeros(len(a), np.int64)
    live, x, y = np.arange(len(a)), a, b
    for _ in range(limit // 8):
        same = words[x] == words[y]
        live, x, y = live[same], x[same] + 8, y[same] + 8
        out[live] += 8
    # those that left early, and the rest below eight bytes
    todo = np.arange(len(a))
    for _ in range(8):
        todo = todo[(out[todo] < limit)]
        todo = todo[buf[a[todo] + out[todo]] == buf[b[todo] + out[todo]]]
        out[todo] += 1
    n = len(data)
    return np.minimum(out, np.minimum(n - a, n - b))


def equal_windows(slices: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of `size` bytes that occur elsewhere in the slices (or in their own): slice and start, in that
    order, and whether it is the first of its equals; then the slices' starts in the sorted text."""
    data = b"\xff".join(slices) + b"\xff"  # never in UTF-8, so no window runs over
    starts = np.cumsum([0] + [len(s) + 1 for s in slices[:-1]])
    lengths = np.array([len(s) for s in slices])
    sa = suffix_array(data, size)
    which = np.searchsorted(starts, sa, side="right") - 1
    sa = sa[sa + size <= (starts + lengths)[which]]
    if len(sa) < 2:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool), starts
    same = common_prefix(data, sa[:-1], sa[1:], size) >= size
    group = np.append(0, np.cumsum(~same))
    least = np.minimum.reduceat(sa, np.flatnonzero(np.append(True, ~same)))
    hit = np.append(same, False) | np.append(False, same)
    found, first = sa[hit], least[group[hit]] == sa[hit]
    order = np.argsort(found)
    found, first = found[order], first[order]
    at = np.searchsorted(starts, found, side="right") - 1
    return at, found - starts[at], first, starts


def runs(at: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, start, n) of the runs of neighbouring positions."""
    cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    return at[cut], pos[cut], np.diff(np.append(cut, len(at)))


def repeats(slices: list[bytes], size: int = WINDOW) -> list[np.ndarray]:
    """For each slice the starts of its windows of `size` bytes that occur elsewhere in the slices (or in itself)."""
    at, pos, *_ = equal_windows(slices, size)
    return np.split(pos, np.searchsorted(at, np.arange(1, len(slices))))


def slices_of(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """(key, did, rid, start, loops, piece): the bytes under each span."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            did, rid, sp = b.column("did").to_numpy(), b.column("rid").to_numpy(), b.column("spans")
            for row, buf, starts in chunks(b.column("text")):
                cols = [[], [], [], [], [], []]
                text = Bytes(buf, starts)
                for i, begin in enumerate(starts.tolist()):
                    for s in sp[row + i].as_py():
                        a = begin + s["start"]
                        for c, v in zip(cols, (s["key"], did[row + i], rid[row + i], s["start"], s["loops"], bytes(text.content(a, a + s["n"] + size - 1))), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "did", "rid", "start", "loops", "piece"])

    return keyed(docs).join(per_document(spans, "key", "loops"), ["did", "rid"]).mapInArrow(run, "key long, did long, rid long, start int, loops boolean, piece binary")


def sorted_repeats(pieces: DataFrame, size: int, batch: int) -> DataFrame:
    """(did, rid, start, n): runs of windows that repeat among the pieces of one key. A task takes its keys in order,
    sorting whole keys together up to `batch` bytes at a time."""

    def run(batches):
        import pyarrow as pa

        held, volume, last = [], 0, None

        def flush():
            at, pos, n = runs(*equal_windows([h[3] for h in held], size)[:2])
            did, rid, start = (np.array([h[k] for h in held], np.int64)[at] for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(did), pa.array(rid), pa.array((start + pos).astype(np.int32)), pa.array(n.astype(np.int32))], PLACE)

        for b in batches:
            for key, did, rid, start, piece in zip(*(b.column(c).to_pylist() for c in ("key", "did", "rid", "start", "piece")), strict=True):
                if key != last and volume >= batch:
                    yield flush()
                    held, volume = [], 0
                held.append((did, rid, start, piece))
                volume, last = volume + len(piece), key
        if held:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "did long, rid long, start int, n int")


def without_own_repeats(pieces: DataFrame, size: int) -> DataFrame:
    """Pieces whose windows are all different. One that may repeat inside itself is sorted alone: rows without bytes say
    which runs of its windows repeat, and one of each equal windows stays, in pieces of their own."""
    schema = "key long, did long, rid long, start int, n int, piece binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[] for _ in range(6)]
            for key, did, rid, start, loops, piece in zip(*(b.column(c).to_pylist() for c in ("key", "did", "rid", "start", "loops", "piece")), strict=True):
                rows = [(start, len(piece) - size + 1, piece)]
                if loops:
                    _, pos, first, _ = equal_windows([piece], size)
                    left = np.setdiff1d(np.arange(len(piece) - size + 1), pos[~first])
                    rows = [(start + s, n, None) for _, s, n in zip(*runs(np.zeros_like(pos), pos), strict=True)]
                    rows += [(start + s, n, piece[s : s + n + size - 1]) for _, s, n in zip(*runs(np.zeros_like(left), left), strict=True)]
                for s, n, x in rows:
                    for c, v in zip(cols, (key, did, rid, int(s), int(n), x), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "did", "rid", "start", "n", "piece"])

    return pieces.mapInArrow(run, schema)


def cut(u: Units, pieces: DataFrame) -> DataFrame:
    """The pieces' paths by the smallest k-gram of u, with that gram in the key."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key, did, rid, start = (b.column(c).to_numpy() for c in ("key", "did", "rid", "start"))
            for row, buf, starts in chunks(b.column("piece")):
                seq = Bytes(buf, starts)
                t, s, n, gram, _ = paths(u, seq)
                at = seq.begin[t] + s
                part = [bytes(seq.content(x, y)) for x, y in zip(at.tolist(), (at + n + (u.size - 1)).tolist(), strict=True)]
                new = mix(key[row + t].view(U) ^ mix(gram.view(U) + U(u.k))).view(np.int64)
                cols = [new, did[row + t], rid[row + t], (start[row + t] + s).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(part, pa.binary())], ["key", "did", "rid", "start", "n", "piece"])

    return pieces.mapInArrow(run, "key long, did long, rid long, start int, n int, piece binary")


def divided(u: Units, pieces: DataFrame, most: int) -> DataFrame:
    """(did, rid, start, n) as sorted_repeats gives, for keys of any volume.

    Each level's grams are half as far from the window's size, so windows that hold something of their own leave for keys
    of their own. Equal pieces of a key, compared as bytes, repeat whole and one stands for all; keys left with one
    piece are done, those that fit are sorted, and the rest goes on. Grams of the window's size leave equal windows."""
    own = keep(without_own_repeats(pieces, u.size), "own")
    out = own.where("piece is null").select(*PLACE)
    state, gap = own.where("piece is not null"), u.size - u.k
    while True:
        gap //= 2
        rows = keep(cut(Units(False, u.size, u.size - gap, u.piece), state), "cut")
        first = [F.first(c).alias(c) for c in PLACE]
        contents = keep(rows.groupBy("key", "piece").agg(F.count("*").alias("c"), *first), "contents")
        equal = keep(rows.join(contents.where("c > 1").select("key", "piece"), ["key", "piece"]).select(*PLACE), "equal")
        volume = keep(contents.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.length("piece")).alias("bytes")).where("c > 1").drop("c"), "volume")
        rest = keep(contents.drop("c").join(volume, "key"), "rest")
        fits = F.lit(True) if gap == 0 else F.col("bytes") <= most
        out = out.unionByName(equal).unionByName(keep(sorted_repeats(rest.where(fits), u.size, most), "sorted"))
        state = rest.where(~fits)
        drop(rows, contents, volume)
        if gap == 0 or state.isEmpty():
            return out


def repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = K, most: int = SORT_BYTES) -> DataFrame:
    """(did, rid, start, n): runs of n windows from byte `start` that occur more than once in all documents."""
    u = Units(False, window, min(k, window))

    def search(seed: int) -> tuple[list[DataFrame], DataFrame]:
        found = classified(u, docs, seed)
        pieces = keep(slices_of(docs, found.open.where(F.col("units") <= most), window), "pieces")
        out = keep(sorted_repeats(pieces, window, most), "sorted")
        drop(pieces)
        large = found.open.where(F.col("units") > most)
        if not large.isEmpty():
            out = out.unionByName(divided(u, slices_of(docs, large, window), most))
        return [found.same], out

    return compared(u, docs, search)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, most: int = SORT_BYTES) -> DataFrame:
    """One row per document: did, rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Removed is every byte of a `window`-byte string that also starts anywhere else, in this document or another, judged
    on the input; overlaps count. Null texts are empty; documents shorter than a window lose nothing; rows that repeat
    id and text repeat each other and are returned each; a null doc_id is an id like others. Very long texts are hashed
    in pieces that overlap by a window. What is kept may cut a character, so it is binary. Extra columns, whatever their
    names, are ignored; an empty table gives an empty result."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode()
                kept, n_spans = data, 0
                if spans:
                    gone = covered(spans, window, len(data))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(rows, (len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    rows[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["did", "rid", *rows])

    schema = "did long, rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = with_spans(docs, repeated_bytes(docs, window, k, most)).mapInArrow(run, schema)
    return out.select("did", "rid", doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
