"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The random walk of Chakraborty, Goldenberg and Koucky maps words to a longer sequence, in which few edits become few
Hamming differences. Tables sample positions of it; a window that agrees with an item in any table is verified by the
exact edit distance. Only windows near a seed are hashed: an item is cut into one stretch more than the edits allowed,
so any match holds one of them whole (pigeonhole), and of each stretch the rarest run of words is the seed. That filter
loses nothing; the tables' number comes from recall measured end to end by class of lengths, and classes that the most
tables don't bring to the target are verified at every seed. So are pairs of a text and an item that meet at very many
places, where one exact pass over the region costs less than the windows.

The benchmark is a query set: it is collected after a check of its size and broadcast in loads of bounded size; each load
is one pass over the documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from arcwise.llm.common import Prefix, U, chunks, doc_id, keep, keyed, mix, restrict, word_hashes, words_of

SIMILARITY = 0.8
#: Words of windows that are embedded together; places where texts and seeds meet that are looked at together.
CELLS = 1 << 20
MAX_ITEMS = 1_000_000
#: What one load holds at most: about 200 MB with hashes, seeds and signatures.
LOAD_ITEMS = 100_000
LOAD_WORDS = 1 << 22
RECALL = 0.98
SAMPLED = 2
MAX_TABLES = 96
#: Windows start this many words round the place that a seed tells, for edits before it.
SLACK = 2

#: Words are runs of ASCII letters and digits and of all other bytes above ASCII, in lower case.
GAPS = np.ones(256, bool)
GAPS[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = False


def allowed(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def seed_size(n: int, d: int) -> int:
    """Words in a row that survive d edits of n words in one of d + 1 stretches, at most 3."""
    return max(1, min(3, n // (d + 1)))


def walk(windows: np.ndarray, salt: int, steps: int) -> np.ndarray:
    """CGK embedding of rows of word hashes (0 pads): at each step the current word is written and a random bit of
    (step, word) tells whether to go on to the next."""
    n, width = windows.shape
    at = np.zeros(n, np.int64)
    padded = np.concatenate([windows, np.zeros((n, 1), U)], axis=1)
    out = np.zeros((n, steps), U)
    rows = np.arange(n)
    for j in range(steps):
        sym = padded[rows, np.minimum(at, width)]
        out[:, j] = sym
        at += (mix(sym ^ U((salt * 1_000_003 + j) & (2**63 - 1))) & U(1)).astype(np.int64)
    return out


def assured(found: np.ndarray) -> float:
    """Share found, less what chance may have added: Wilson's lower bound at one standard error."""
    n, p = len(found), float(found.mean())
    return float((p + 0.5 / n - np.sqrt(p * (1 - p) / n + 0.25 / n**2)) / (1 + 1 / n))


def spread(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts[i] + 0 .. n[i] - 1 of all i in a row, and i of each."""
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n), which


@dataclass
class Index:
    """Items' word hashes with their allowed edits, seeds and table signatures."""

    ids: list
    items: list[np.ndarray]
    similarity: float

    def __post_init__(self):
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.flat = np.concatenate([*self.items, np.zeros(1, U)])
        self.at = np.append(0, np.cumsum(self.lengths))[:-1]
        self.edits = np.array([allowed(n, self.similarity) for n in self.lengths.tolist()], np.int64)
        by: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths.tolist()):
            if n:
                by.setdefault(seed_size(n, int(self.edits[i])), []).append(i)
        self.seeds: dict[int, tuple] = {}
        for g, which in by.items():
            grams = [Prefix(self.items[i], 0).all(g) for i in which]
            _, code, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            cost = np.split(often[code], np.cumsum([len(x) for x in grams])[:-1])
            rows = []
            for i, h, c in zip(which, grams, cost, strict=True):
                cut = np.linspace(0, len(self.items[i]), int(self.edits[i]) + 2).astype(int)
                place = np.array([a + int(np.argmin(c[a : z - g + 1])) for a, z in zip(cut[:-1], cut[1:], strict=True)])
                rows.append((h[place], np.full(len(place), i), place))
            h, item, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[g] = (h[order], item[order], offset[order])
        self.calibrate()

    def sampled(self, windows: np.ndarray, lengths: np.ndarray, tables: range) -> np.ndarray:
        """Signature of each window in each table. Every fourth table has a walk of its own; positions are drawn over
        twice the window's length, where the walk is about half through, from a fixed stream."""
        out = np.zeros((len(windows), len(tables)), U)
        emb = None
        for c, t in enumerate(tables):
            if emb is None or t % 4 == 0:
                emb = walk(windows, t // 4 + 1, 2 * windows.shape[1])
            draw = np.random.default_rng(1000 + t).random(SAMPLED)
            cols = (draw[None, :] * 2 * lengths[:, None]).astype(np.int64)
            sig = np.full(len(windows), U(t))
            for k in range(SAMPLED):
                sig = mix(sig ^ emb[np.arange(len(windows)), cols[:, k]] * U(2 * k + 1))
            out[:, c] = sig
        return out

    def signed(self, h: np.ndarray, item: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, tables: range) -> np.ndarray:
        """Signatures of the windows of h that have their item's length from `start`; words outside begin..end are blank.
        Windows of like lengths go together."""
        out = np.zeros((len(item), len(tables)), U)
        order = np.argsort(self.lengths[item], kind="stable")
        i = 0
        while i < len(order):
            step = max(1, min(4096, CELLS // max(1, int(self.lengths[item[order[min(i + 4095, len(order) - 1)]]]))))
            part = order[i : i + step]
            n = self.lengths[item[part]]
            pos = start[part, None] + np.arange(int(n.max()))[None, :]
            ok = (pos >= begin[part, None]) & (pos < end[part, None]) & (pos < (start[part] + n)[:, None])
            out[part] = self.sampled(np.where(ok, h[np.clip(pos, 0, max(0, len(h) - 1))], U(0)), n, tables)
            i += step
        return out

    def meetings(self, h: np.ndarray, marks: np.ndarray):
        """(text, item, start) where seeds of items stand in the texts, in slabs of about CELLS rows, each sorted."""
        text_of = np.repeat(np.arange(len(marks) - 1), np.diff(marks))
        p0 = Prefix(h, 0)
        for g, (keys, item, offset) in self.seeds.items():
            if len(h) < g:
                continue
            grams = p0.all(g)
            lo = np.searchsorted(keys, grams)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == grams)
            hit = hit[text_of[hit] == text_of[hit + g - 1]]
            n = np.searchsorted(keys, grams[hit], side="right") - lo[hit]
            slab = np.cumsum(n) // CELLS
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(slab)) + 1) if len(hit) else []:
                e, which = spread(lo[hit[part]], n[part])
                at = hit[part][which]
                yield np.unique(np.stack([text_of[at], item[e], at - offset[e]]), axis=1)

    def calibrate(self, trials: int = 200) -> None:
        """As many tables as find RECALL of items edited as much as allowed in each class of lengths (powers of two), in
        steps of four, up to MAX_TABLES; few trials must show more. A trial is a text that holds the edited item, and
        goes the way of all texts. Items of classes that don't reach it, or by their share so far won't, are verified
        without tables."""
        rng = np.random.default_rng(3)
        kinds = np.frexp(np.maximum(self.lengths, 1))[1]
        texts, whose = [], []
        for kind in np.unique(kinds[self.lengths > 0]):
            of = np.flatnonzero((kinds == kind) & (self.lengths > 0))
            # fewer trials of long items, whose windows are many
            most = max(50, min(trials, CELLS * 50 // int(self.lengths[of].max()) ** 2))
            for i in np.resize(of[:: -(-len(of) // most)], most).tolist():
                y = self.items[i].tolist()
                for _ in range(int(self.edits[i])):
                    at, what = int(rng.integers(len(y) + 1)), rng.integers(3)
                    y[at : at + int(what != 0)] = [int(rng.integers(1, 2**63))] * int(what != 2)
                around = rng.integers(1, 2**63, 2 * SLACK).astype(U)
                texts.append(np.concatenate([around[:SLACK], np.array(y, U), around[SLACK:]]))
                whose.append(i)
        bounds, all_ = self.at + self.lengths, np.arange(len(self.items))
        own = lambda tables: self.signed(self.flat, all_, self.at, self.at, bounds, tables)
        self.recall: dict[int, float] = {}
        self.tables, parts, hopeless = 4, [], set()
        if texts:
            h, w, marks = np.concatenate(texts), np.array(whose), np.append(0, np.cumsum([len(x) for x in texts]))
            met = [self.starts(m[:, m[1] == w[m[0]]], marks) for m in self.meetings(h, marks)]
            text, item, start = np.concatenate(met, axis=1)
            found, kind_of = np.zeros(len(texts), bool), kinds[w]
            for t in range(0, MAX_TABLES, 4):
                self.tables, tables = t + 4, range(t, t + 4)
                parts.append(own(tables))
                todo = np.flatnonzero(~found[text] & ~np.isin(kind_of[text], list(hopeless)))
                sig = self.signed(h, item[todo], start[todo], marks[text[todo]], marks[text[todo] + 1], tables)
                found[text[todo[(sig == parts[-1][item[todo]]).any(1)]]] = True
                self.recall = {int(k): assured(found[kind_of == k]) for k in np.unique(kind_of)}
                hopeless |= {k for k in self.recall if float((~found[kind_of == k]).mean()) ** (MAX_TABLES / (t + 4)) > 1 - RECALL}
                if all(r >= RECALL or k in hopeless for k, r in self.recall.items()):
                    break
            # the first number that passes is one where the trials were lucky: a quarter more
            for t in range(self.tables, min(MAX_TABLES, self.tables + -(-self.tables // 16) * 4), 4):
                self.tables = t + 4
                parts.append(own(range(t, t + 4)))
        self.exact = np.array([self.recall.get(int(k), 1.0) < RECALL for k in kinds], bool)
        self.signatures = np.concatenate(parts, axis=1) if parts else own(range(self.tables))

    def starts(self, met: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """(text, item, start) of the windows round the places where seeds met: those that have words enough."""
        text, item, start = (np.repeat(x, 2 * SLACK + 1) for x in met)
        shift = np.tile(np.arange(-SLACK, SLACK + 1), met.shape[1])
        start = start + shift
        n, d = self.lengths[item], self.edits[item]
        whole = (np.abs(shift) <= d) & (np.minimum(marks[text + 1], start + n + d) - np.maximum(marks[text], start - d) >= n - d)
        return np.unique(np.stack([text, item, start])[:, whole], axis=1)


def best_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Smallest edit distance of the item to any stretch of the region (free start and end)."""
    row = np.zeros(len(region) + 1, np.int64)
    j = np.arange(len(region) + 1)
    for i, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != U(w)))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def regions(index: Index, met: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, from, to, starts) of what lies round the starts of a text and item, overlapping ones together."""
    text, item, start = met
    n, d = index.lengths[item], index.edits[item]
    lo, hi = np.maximum(marks[text], start - d), np.minimum(marks[text + 1], start + n + d)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text))[: len(first)] - 1
    return text[first], item[first], lo[first], hi[last], last - first + 1


def matches(index: Index, h: np.ndarray, marks: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, distance) of the items that the texts hold within the allowed edits."""
    found: dict[tuple[int, int], int] = {}

    def verify(met: np.ndarray) -> None:
        for t, i, a, z, _ in zip(*(x.tolist() for x in regions(index, met, marks)), strict=True):
            if found.get((t, i)) != 0 and z - a >= index.lengths[i] - index.edits[i]:
                dist = best_distance(index.items[i], h[a:z])
                if dist <= index.edits[i]:
                    found[t, i] = min(dist, found.get((t, i), dist))

    for met in index.meetings(h, marks):
        text, item, _, _, many = regions(index, met, marks)
        # no table is needed where they don't assure the item, or where a region holds more starts than an item has seeds
        sure = np.repeat(index.exact[item] | (many > 2 * (index.edits[item] + 1)), many)
        verify(met[:, sure])
        text, item, start = near = index.starts(met[:, ~sure], marks)
        sig = index.signed(h, item, start, marks[text], marks[text + 1], range(index.tables))
        verify(near[:, (sig == index.signatures[item]).any(1)])
    return [(t, i, d) for (t, i), d in sorted(found.items())]


def lowered(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.utf8_lower(column.cast(pa.large_string()))


def hashed_words(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for row, buf, starts in chunks(lowered(column)):
        first, end, marks = words_of(buf, starts, GAPS)
        out.append((row, word_hashes(buf, first, end), marks))
    return out


def loads(lengths: list[int]) -> list[list[int]]:
    """Items in loads of at most LOAD_ITEMS and LOAD_WORDS; an item above that is a load of its own."""
    out: list[list[int]] = []
    words = 0
    for i, n in enumerate(lengths):
        if not out or len(out[-1]) == LOAD_ITEMS or words + n > LOAD_WORDS:
            out.append([])
            words = 0
        out[-1].append(i)
        words += n
    return out


def build(benchmark: DataFrame, similarity: float = SIMILARITY) -> list[Index]:
    """Indexes of loads of items. Null and wordless items match nothing."""
    import pyarrow as pa

    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"over {MAX_ITEMS} benchmark items: split the query set")
    items = []
    for _, h, marks in hashed_words(pa.array([r["text"] for r in rows], pa.string())):
        items += [h[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
    return [Index([rows[i]["item_id"] for i in part], [items[i] for i in part], similarity) for part in loads([len(x) for x in items])]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(did, rid, doc_id, item_id, distance): documents that hold an item, with the fewest word edits of its holdings.

    Held is an item if a stretch of the document is within (1 - similarity) x its words of edits; case, punctuation
    and line ends don't count. Null and empty texts hold nothing; very long texts are searched whole; repeated rows and
    repeated item ids are reported each; a null doc_id is an id like others; extra columns are ignored; an empty table
    or benchmark gives an empty result."""
    spark = docs.sparkSession
    schema = "did long, rid long, item_id long, distance int"
    out = spark.createDataFrame([], schema)
    for index in build(benchmark, similarity):
        held = spark.sparkContext.broadcast(index)  # bounded by LOAD_ITEMS and LOAD_WORDS

        def run(batches, held=held):
            import pyarrow as pa

            index = held.value
            for b in batches:
                did, rid = b.column("did").to_numpy(), b.column("rid").to_numpy()
                cols = [[], [], [], []]
                for row, h, marks in hashed_words(b.column("text")):
                    for t, i, d in matches(index, h, marks):
                        for c, v in zip(cols, (did[row + t], rid[row + t], index.ids[i], d), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["did", "rid", "item_id", "distance"])

        out = out.unionByName(keyed(docs).mapInArrow(run, schema))
    return out.select("did", "rid", doc_id(), "item_id", "distance")


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns and repeats. Null and empty texts stay; an empty
    table stays empty, and an empty benchmark takes nothing."""
    return restrict(docs, keep(leaks(docs, benchmark).select("did", "rid").distinct(), "leaks"), "left_anti")
