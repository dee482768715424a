"""Secret scans: fixed patterns, and automata inferred from what the patterns found.

The base patterns label credentials. From a bounded sample of them prefix trees are built and statistically compatible
states merged (the ALERGIA test), which gives one probabilistic automaton a kind. Every other token that could be a
credential is scored by its likelihood per character under each automaton.

Three limits narrow what the automata add, not the base spans: only tokens of 16 or more characters with a digit and a
letter are scored, a kind with fewer than 20 labelled values gets no automaton, and merging stops above 400 states."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import doc_id, keep, keyed

#: The base patterns, in the order of the kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
#: Tokens the automata judge.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
SAMPLE = 1500
ALPHA = 0.05


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, value start, end) of the base matches. Patterns take the leftmost matches without overlap, then
    short ones are dropped. Cheap tests for what a match must hold come first."""
    out = []
    low = text.lower()  # lengthens some letters, so only to test
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.start(2), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # maximal runs: one of 24 or more is found at its start, so the short ones needn't be visited
    out += [(m.start(), 2, m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def candidates(text: str, spans) -> list[tuple[int, int]]:
    """Long tokens with a digit and a letter outside the base spans; both come in order, so one walk goes over both."""
    out, reach, at = [], 0, 0  # reach: the furthest end of the spans that start before the token's end
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][3])
            at += 1
        if reach <= m.start() and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((m.start(), m.end()))
    return out


def symbols(token: str) -> str:
    """Letters and digits by class; the first four characters as they are, since formats show there."""
    rest = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in token[4:])
    return token[:4] + rest


class Automaton:
    """Probabilistic automaton of a set of strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for s in strings:
            q = 0
            for c in s:
                self.visits[q] += 1
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = self._new()
                q = self.next[q][c]
            self.visits[q] += 1
            self.ends[q] += 1
        self.alphabet = len({c for s in strings for c in s}) + 1
        self._merge_all(alpha)

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.ends.append(0)
        self.visits.append(0)
        return len(self.next) - 1

    def _differ(self, f1, n1, f2, n2, bound) -> bool:
        """Hoeffding's test on two frequencies."""
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / np.sqrt(n1) + 1 / np.sqrt(n2))

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if self._differ(self.ends[x], self.visits[x], self.ends[y], self.visits[y], bound):
                return False
            for c in set(self.count[x]) | set(self.count[y]):
                if self._differ(self.count[x].get(c, 0), self.visits[x], self.count[y].get(c, 0), self.visits[y], bound):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b into a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
                if c in self.next[x]:
                    todo.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def _merge_all(self, alpha: float) -> None:
        bound = np.sqrt(0.5 * np.log(2 / alpha))
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            q, c = blue.pop(0)
            b = self.next[q][c]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b, bound):
                    self.next[q][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue = [(x, d) for x in red for d in sorted(self.next[x]) if self.next[x][d] not in red]
            if len(red) > 400:
                break  # the states so far still score; unmerged branches stay a tree
        self.states = red

    def score(self, s: str) -> float:
        """Mean log2-likelihood of a character; a step that was never seen costs its smoothed mass and stays."""
        q, total = 0, 0.0
        for c in s:
            total += np.log2((self.count[q].get(c, 0) + 0.1) / (self.visits[q] + 0.1 * self.alphabet))
            q = self.next[q].get(c, q)
        return total / max(1, len(s))


def infer(values: dict[str, list[str]]) -> dict[str, tuple[Automaton, float]]:
    """An automaton for each kind with enough labelled values, and the likelihood that all but the least likely
    twentieth of the labelled ones reach."""
    out = {}
    for kind in KINDS:
        s = [symbols(v) for v in values.get(kind, ())]
        if len(s) >= 20:
            a = Automaton(s)
            out[kind] = (a, float(np.quantile([a.score(x) for x in s], 0.05)))
    return out


def judge(models: dict[str, tuple[Automaton, float]], token: str) -> str | None:
    """The kind whose automaton finds the token as likely as its labelled values; the most likely if several do."""
    s = symbols(token)
    found = [(a.score(s), k) for k, (a, cut) in models.items()]
    found = [(v, k) for v, k in found if v >= models[k][1]]
    return max(found)[1] if found else None


def scan(docs: DataFrame) -> DataFrame:
    """(did, rid, starts, kinds, values, ends, tokens): base spans and the tokens to judge, in one pass of the texts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                more = candidates(text, base)
                row = ([s for s, *_ in base], [k for _, k, *_ in base], [text[v:e] for _, _, v, e in base], [e for *_, e in base], [s for s, _ in more], [e for _, e in more], [text[s:e] for s, e in more])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            ints, strs = pa.list_(pa.int32()), pa.list_(pa.string())
            kinds = (ints, ints, strs, ints, ints, ints, strs)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["did", "rid", "starts", "kinds", "vals", "ends", "t_starts", "t_ends", "tokens"])

    return keyed(docs).mapInArrow(run, "did long, rid long, starts array<int>, kinds array<int>, vals array<string>, ends array<int>, t_starts array<int>, t_ends array<int>, tokens array<string>")


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: did, rid, doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind; those the automata add have kind
    "format". base_sha256 is of the base spans alone. Null and empty texts have none; very long texts are searched
    whole; repeated rows are returned each; a null doc_id is an id like others; extra columns are ignored; an empty table
    gives an empty result. `sample` bounds the labelled values of a kind that the automata are inferred from: those
    with the smallest hashes, so reruns agree."""
    found = keep(scan(docs), "scan")
    pairs = found.select(F.explode(F.arrays_zip("kinds", "vals")).alias("z")).select(F.col("z.kinds").alias("kind"), F.col("z.vals").alias("value")).distinct()
    values: dict[str, list[str]] = {}
    for k, name in enumerate(KINDS):
        top = pairs.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        values[name] = [r["value"] for r in top]
    models = infer(values)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[] for _ in range(5)]
            for kinds, starts, ends, ts, te, tokens in zip(*(b.column(c).to_pylist() for c in ("kinds", "starts", "ends", "t_starts", "t_ends", "tokens")), strict=True):
                base = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in zip(starts, kinds, ends, strict=True)]
                more = [(s, 3, f"format:{s}:{e}") for s, e, t in zip(ts, te, tokens, strict=True) if judge(models, t)]
                text = ",".join(x for *_, x in sorted(base))
                for c, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(text.encode()).hexdigest(), ",".join(x for *_, x in sorted(base + more))), strict=True):
                    c.append(v)
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), *(pa.array(c, k) for c, k in zip(cols, kinds_, strict=True))], ["did", "rid", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = found.mapInArrow(run, "did long, rid long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.select("did", "rid", doc_id(), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
