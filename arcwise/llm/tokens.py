"""Token counts that follow edits.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum over its pre-tokens. A document's tree,
kept in a table, has runs of pre-tokens as leaves (characters, tokens) and sums above them. An edit finds its leaf from
the root, re-encodes from the start of the pre-token that reaches it until a boundary falls again on an old one beyond
it, and updates the sums on the paths of the leaves it changed; documents without edits are not encoded again."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.common import NO_ID, doc_id, keep, keyed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
CACHE = 1 << 17


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary, read on the driver: a file of bounded size that belongs to the program, not to the data."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Tokens of a pre-token, with a bounded memory of those seen."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.seen.get(token)
        if n is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            n = self.seen[token] = len(self.encode(token))
        return n

    def counts(self, tokens: list[str]) -> list[int]:
        get = self.seen.get
        return [n if (n := get(t)) is not None else self.count(t) for t in tokens]


class Tree:
    """Leaves (characters, tokens) in order; chars[k] and tokens[k] hold the sums of 2 ** k neighbouring leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = sums_of(chars), sums_of(tokens)
        self.touched = 0  # sums written by edits

    @property
    def total(self) -> int:
        return self.tokens[-1][0] if self.tokens[-1] else 0

    @property
    def length(self) -> int:
        return self.chars[-1][0] if self.chars[-1] else 0

    def find(self, place: int) -> tuple[int, int]:
        """The first leaf that ends at or behind the place, or else the last leaf, and where it starts."""
        i, begin = 0, 0
        for level in self.chars[-2::-1]:
            i *= 2
            if i + 1 < len(level) and begin + level[i] < place:
                begin += level[i]
                i += 1
        return i, begin

    def put(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """New values for the leaves from `first` on, and for the sums above them."""
        lo, hi = first, first + len(chars)
        self.chars[0][lo:hi], self.tokens[0][lo:hi] = chars, tokens
        self.touched += hi - lo
        for k in range(1, len(self.chars)):
            lo, hi = lo // 2, (hi + 1) // 2
            for sums in (self.chars, self.tokens):
                for i in range(lo, hi):
                    sums[k][i] = sum(sums[k - 1][2 * i : 2 * i + 2])
            self.touched += hi - lo


def sums_of(leaves: list[int]) -> list[list[int]]:
    out = [list(leaves)]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([sum(x[i : i + 2]) for i in range(0, len(x), 2)])
    return out


def leaves(counter: Counter, pre: list[str], number: int | None = None) -> tuple[list[int], list[int]]:
    """Characters and tokens of runs of LEAF pre-tokens, or of `number` runs of like size (some empty if need be)."""
    n = np.append(0, np.cumsum(counter.counts(pre)))
    size = np.append(0, np.cumsum([len(t) for t in pre]))
    cut = np.append(np.arange(0, len(pre), LEAF), len(pre)) if number is None else np.linspace(0, len(pre), number + 1).astype(int)
    return np.diff(size[cut]).astype(int).tolist(), np.diff(n[cut]).astype(int).tolist()


def build(counter: Counter, text: str) -> Tree:
    return Tree(*leaves(counter, counter.pattern.findall(text)))


def edit(counter: Counter, tree: Tree, text: str, start: int, stop: int, new: str) -> tuple[str, int]:
    """Replace text[start:stop] by `new`; the tree follows. Returns the new text and the characters re-encoded.

    A leaf that ends at the edit's start, or one character before, is redone too: its last pre-token may grow, or have
    looked up to two characters ahead. The scan stops at the first boundary that was a leaf's end behind the edit, since
    from equal boundaries on equal text both scans run alike. What was encoded again takes the places of the leaves it
    covers; leaves that would grow beyond four times their size make the tree be laid out anew from its leaves, which
    encodes nothing."""
    out = text[:start] + new + text[stop:]
    old = tree.chars[0]
    first, begin = tree.find(start - 1) if old else (0, 0)
    shift = len(new) - (stop - start)
    pre, pos, last = [], begin, first
    end = begin + old[first] if old else 0  # where leaf `last` ended
    for m in counter.pattern.finditer(out, begin):
        pre.append(m[0])
        pos = m.end()
        while last + 1 < len(old) and end + shift < pos:
            last += 1
            end += old[last]
        if pos > start + len(new) and end >= stop and end + shift == pos:
            break
    else:
        last = len(old) - 1
    count = last - first + 1 if old else 0
    if 0 < count and len(pre) <= 4 * LEAF * count:
        tree.put(first, *leaves(counter, pre, count))
    else:
        chars, tokens = leaves(counter, pre)
        touched = tree.touched + len(old)
        tree.__init__(old[:first] + chars + old[first + count :], tree.tokens[0][:first] + tokens + tree.tokens[0][first + count :])
        tree.touched = touched
    return out, pos - begin


def standard_edits(text: str):
    """As a Column, edits that every document can take, from behind so that places stay: a mark at three quarters, the
    word-sized stretch at the middle removed, another mark put in place of one character at a quarter."""
    n = F.char_length(text)
    at = lambda x: F.floor(x).cast("int")
    one = lambda a, z, new: F.struct(a.alias("start"), z.cast("int").alias("stop"), F.lit(new).alias("new"))
    half, quarter, rest = at(n / 2), at(n / 4), at(n * 3 / 4)
    return F.array(one(rest, rest, " [edited] "), one(half, F.least(n, half + 7), ""), one(quarter, F.least(n, quarter + 1), "42"))


TREE = "did long, rid long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def token_trees(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per document: did, rid, text, n_tokens, leaf_chars, leaf_tokens (the tree's leaves, whose sums are built
    when it is read). Null texts are empty; repeated rows are returned each; a null doc_id is an id like others; very
    long texts make long leaf lists and nothing else; extra columns are ignored; an empty table gives an empty result."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))  # a vocabulary: bounded

    def run(batches):
        import pyarrow as pa

        counter = Counter(ranks.value)
        for b in batches:
            trees = [build(counter, t) for t in b.column("text").to_pylist()]
            lists = [pa.array([t.chars[0] for t in trees], pa.list_(pa.int32())), pa.array([t.tokens[0] for t in trees], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), b.column("text"), pa.array([t.total for t in trees], pa.int64()), *lists], ["did", "rid", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    return keyed(docs).mapInArrow(run, TREE)


def follow_edits(trees: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The trees behind their `edits`, a column of arrays of (start, stop, new) that apply one behind the other, in code
    points; null: none. Further columns: n_before, n_reencoded (characters encoded again), n_sums (sums written). Places
    beyond the text count as its end. Only documents with edits are encoded, and of those only what the edits touch."""
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(trees.sparkSession, path))
    names = ["did", "rid", "text", "n_tokens", "leaf_chars", "leaf_tokens"]

    def run(batches):
        import pyarrow as pa

        counter = Counter(ranks.value)
        for b in batches:
            cols = [[] for _ in range(7)]
            for text, n, chars, tokens, edits in zip(*(b.column(c).to_pylist() for c in ("text", "n_tokens", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                tree, redone = Tree(chars, tokens), 0
                for e in edits or ():
                    start = min(max(e["start"], 0), len(text))
                    text, k = edit(counter, tree, text, start, min(max(e["stop"], start), len(text)), e["new"] or "")
                    redone += k
                for c, v in zip(cols, (text, tree.total, tree.chars[0], tree.tokens[0], n, redone, tree.touched), strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*names, "n_before", "n_reencoded", "n_sums"])

    return trees.select(*names, "edits").mapInArrow(run, f"{TREE}, n_before long, n_reencoded long, n_sums long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees of the documents that a table of edits (doc_id, no, start, stop, new) names, with their edits in order of
    `no`. The others need no work and stay as they are in the table of trees."""
    one = F.struct("no", "start", "stop", "new")
    by = edits.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("did")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return trees.join(by, "did").withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new"))))


def token_counts(docs: DataFrame, path: str = TOKENIZER, edits=standard_edits) -> DataFrame:
    """One row per document: did, rid, doc_id, n_tokens, n_edited_tokens (after `edits`, from the kept tree),
    n_reencoded, n_sums, leaf_chars, leaf_tokens (the tree's leaves behind the edits). edits(column) gives a Column as
    follow_edits takes it. Edge cases as in token_trees; edits of an empty text insert."""
    trees = keep(token_trees(docs, path), "trees")
    out = follow_edits(trees.withColumn("edits", edits("text")), path)
    return out.select("did", "rid", doc_id(), F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_edited_tokens"), "n_reencoded", "n_sums", "leaf_chars", "leaf_tokens")
