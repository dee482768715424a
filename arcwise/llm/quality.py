"""Quality classifier: weak labels to a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation maximisation over the counts of
vote patterns of the whole corpus - at most 3 ** labellers rows, whatever the input - estimates each labeller's accuracy
and the share of bad documents. Posteriors of a bounded sample train a linear scorer on hashed features, and the scorer
judges every document. One pass reads the texts and leaves votes and features in a table; all else works on that."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import TABLES, U, chunks, doc_id, keep, keyed, mix, restrict, word_hashes, words_of

#: Documents whose posteriors train the scorer: a bound on what reaches the driver, not on what is scored.
TRAIN_ROWS = 4000
#: Labelled documents, at most, that beginnings of insults are learned from.
LABEL_ROWS = 4000
#: Toxic documents, and their share, that must hold a beginning of this many letters; how much more often, in documents
#: and as a share of words, toxic documents must hold it than others.
STEM_DOCS, STEM_SHARE, STEM_LETTERS = 5, 0.02, (4, 10)
STEM_DOC_RATIO, STEM_WORD_RATIO = 4, 20
BUCKETS = 1 << 12
LABELLERS = ("repeats", "capitals", "symbols", "fragments", "variety", "prose", "echo")

UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a") : ord("z") + 1] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*!|~^<>{}[]\\_=+@"]] = True
LETTER = UPPER | LOWER | (np.arange(256) >= 128)
STOP = np.zeros(256, bool)
STOP[[ord("."), ord("?"), ord("!")]] = True

#: Stems of insults, which any ending may follow, in English, German, French and Spanish: those that are abuse wherever
#: they stand, and those that are harmless once, as in "take out the trash". Accents are optional.
STRONG = (
    r"idiot|moron|imb[eé]cil|cr[eé]tin|dumbass|asshole|arsehole|bastard|bitch|motherfuck|fuck|shithead|dickhead|scumbag|wanker",
    r"arschl[oö]ch|arschgeige|hurensohn|missgeburt|wichser|schlampe|drecksau|dreckskerl|mistkerl|trottel|dummkopf|schwachkopf|vollidiot|volltrottel|abschaum",
    r"connard|connass|encul[eé]|salaud|salop|abruti|trouduc|raclure",
    r"gilipoll|pendej|cabr[oó]n|hijueput|hijoput|maric[oó]n|malnacid",
)
MILD = (
    r"stupid|pathetic|worthless|disgusting|loser|scum|trash|clown|filthy|vermin",
    r"dumme|bl[oö]de|erb[aä]rmlich|widerlich|wertlos|versager|dreck|ekelhaft|nichtsnutz|ungeziefer",
    r"path[eé]tique|minable|d[eé]go[uû]tant|merde|ordure|bouffon",
    r"est[uú]pid|pat[eé]tic|asqueros|basura|escoria|mierd|payas[oa]|tont[oa]|fracasad|despreciabl",
)
LEXICON = "|".join(STRONG + MILD)
INSULT = re.compile(rf"\b(?:(?P<strong>{'|'.join(STRONG)})|{'|'.join(MILD)})\w*")


WORD = re.compile(r"[^\W\d_]+")


def abusive(column, stems: tuple[str, ...] = ()) -> np.ndarray:
    """Per text of an Arrow string column: whether it has insults, one in 300 words at least, that are two different ones
    or two with a strong one among them; or a strong one in at most 100 words. A mild one, also if repeated, or a few in
    a long text are no abuse. So are two words that begin with learned stems, one in 300 at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.zeros(len(column), bool)
    may = pc.match_substring_regex(column.cast(pa.large_string()), "|".join((LEXICON, *stems)), ignore_case=True)
    learned = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(stems)})") if stems else None
    for i in np.flatnonzero(may.fill_null(False).to_numpy(zero_copy_only=False)):
        text = column[int(i)].as_py().lower()
        found = [(m[0], m["strong"] is not None) for m in INSULT.finditer(text)]
        marked = sum(1 for _ in learned.finditer(text)) if learned else 0
        if found or marked > 1:
            n, strong = len(text.split()), any(s for _, s in found)
            several = len(found) > 1 and (strong or len({w for w, _ in found}) > 1)
            out[i] = several and 300 * len(found) >= n or strong and n <= 100 or marked > 1 and 300 * marked >= n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """(did, toxic, text) of the labelled documents with the smallest hashes of their ids, at most `rows`, one text an id.
    Rows without an id or label are left out; an id with several labels is toxic if one says so."""
    toxic = (F.col("toxic").cast("int") > 0).alias("toxic")
    ids = labels.select(F.col("doc_id").cast("long").alias("did"), toxic).dropna().groupBy("did").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("did", F.lit(5)), "did").limit(rows)
    return keyed(docs).join(F.broadcast(ids), "did").groupBy("did", "toxic").agg(F.min("text").alias("text"))


def sketch(h: np.ndarray) -> int:
    """The smallest hash of five words in a row: near copies mostly share it, other texts don't."""
    k = min(5, len(h))
    return int(mix(sum(h[i : len(h) - k + 1 + i] * U(2 * i + 1) for i in range(k))).min().astype(np.int64)) if k else 0


def beginnings(text: str, among: frozenset | None = None) -> dict[str, float]:
    """The beginnings of the text's words, as shares of its words; only those in `among`, if given."""
    words = WORD.findall(text.lower())
    seen: dict[str, float] = {}
    for w in words:
        for k in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(w)) + 1):
            if among is None or w[:k] in among:
                seen[w[:k]] = seen.get(w[:k], 0.0) + 1 / len(words)
    return seen


def counted(sample: DataFrame, among: frozenset | None = None) -> DataFrame:
    """(stem, docs, share): documents that hold a beginning, and the sum of its shares of their words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [beginnings(t, among).items() for t in b.column("text").to_pylist()]
            stems, shares = [p for r in rows for p, _ in r], [v for r in rows for _, v in r]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(shares, pa.float64())], ["stem", "share"])

    return sample.select("text").mapInArrow(run, "stem string, share double").groupBy("stem").agg(F.count("*").alias("docs"), F.sum("share").alias("share"))


def learned_stems(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> tuple[str, ...]:
    """Beginnings of words that mark toxic documents, the shortest ones that do, from a sample of labelled documents in
    which near copies count once. Counts run in tasks. The driver gets beginnings that STEM_SHARE of the sample's toxic
    documents hold, so at most 1 / STEM_SHARE times those of one mean document. Few labels teach nothing."""

    def near(batches):
        import pyarrow as pa

        for b in batches:
            got = []
            for _, buf, starts in chunks(b.column("text")):
                first, end, marks = words_of(buf, starts)
                h = word_hashes(buf, first, end)
                got += [sketch(h[marks[i] : marks[i + 1]]) for i in range(len(starts))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], ["did", "toxic", "text", "near"])

    sample = keep(labelled_sample(docs, labels, rows).mapInArrow(near, "did long, toxic boolean, text string, near long"), "labelled")
    one = sample.groupBy("near").agg(F.min("did").alias("did")).select("did")
    sample = sample.join(F.broadcast(one), "did", "left_semi")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nt, nc = n.get(True, 0), n.get(False, 0)
    enough = max(STEM_DOCS, STEM_SHARE * nt)
    if nt < enough or not nc:
        return ()
    toxic = {r["stem"]: r for r in counted(sample.where("toxic")).where(F.col("docs") >= enough).collect()}
    clean = {r["stem"]: (r["docs"], r["share"]) for r in counted(sample.where("not toxic"), frozenset(toxic)).collect()}
    marks = set()
    for stem, r in toxic.items():
        d, share = clean.get(stem, (0, 0.0))
        if r["docs"] * nc >= STEM_DOC_RATIO * (d + 1) * nt and r["share"] * nc >= STEM_WORD_RATIO * share * nt:
            marks.add(stem)
    return tuple(sorted(p for p in marks if not any(p[:k] in marks for k in range(STEM_LETTERS[0], len(p)))))


def statistics(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list]:
    """Per text: words, share of words like the one before, of distinct words, upper-case letters, symbols among the
    bytes, words that end in a symbol or stand alone as one, sentence ends a word, words like one of the three before.
    And the words' features."""
    first, end, marks = words_of(buf, starts)
    h = word_hashes(buf, first, end)
    n = np.diff(marks)
    text = np.repeat(np.arange(len(starts)), n)
    per = lambda mask: np.bincount(text[mask], minlength=len(starts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    echo = again.copy()
    for back in (2, 3):
        echo[back:] |= (h[back:] == h[:-back]) & (text[back:] == text[:-back])
    pairs = np.unique(np.stack([text.astype(U), h]), axis=1) if len(h) else np.zeros((2, 0), U)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=len(starts))
    ends = np.append(starts[1:], len(buf))
    byte = lambda lut: np.diff(np.append(0, np.cumsum(lut[buf]))[np.append(starts, len(buf))])
    up, low, sym = byte(UPPER), byte(LOWER), byte(SYMBOL)
    last = buf[end - 1] if len(end) else np.zeros(0, np.uint8)
    words = np.maximum(n, 1)
    stats = np.stack([n, per(again) / words, distinct / words, up / np.maximum(up + low, 1), sym / np.maximum(ends - starts, 1), per(SYMBOL[last]) / words, per(STOP[last]) / words, per(echo) / words], axis=1)
    return stats, [text, first, end, h, again, last, words]


def votes(stats: np.ndarray) -> np.ndarray:
    """One column a labeller: 1 good, -1 bad, 0 nothing. Shares of few words vote bad only where they are telling."""
    n, again, distinct, upper, symbol, tail, stop, echo = stats.T
    enough = n >= 8
    expected = np.minimum(1, 14 / np.sqrt(np.maximum(n, 1)))  # repeats of common words grow with length
    out = np.zeros((len(stats), len(LABELLERS)), np.int8)
    for k, (bad, good) in enumerate(
        (
            (again > 0.15, again < 0.03),
            (upper > 0.4, upper < 0.15),
            ((symbol > 0.06) | (tail > 0.3), (symbol < 0.02) & (tail < 0.05)),
            (enough & (stop < 0.005), stop > 0.04),
            (enough & (distinct < 0.45 * expected), distinct > 0.6 * expected),
            (enough & ((stop > 0.5) | (tail > 0.3)), (stop > 0.03) & (stop < 0.3)),
            (enough & (echo > 0.3), echo < 0.12),
        )
    ):
        out[bad & (n > 0), k] = -1
        out[good & (n >= 2) & ~bad, k] = 1
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def features(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The statistics, and hashed features (text, bucket, value): word endings, shapes and repeats as shares of the text's
    words, and the statistics in steps. Lengths alone say nothing about quality and are left out."""
    stats, (text, first, end, h, again, last, words) = statistics(buf, starts)
    before = buf[np.maximum(end - 2, first)].astype(U)
    shape = (UPPER[buf[first]].astype(U) << U(2)) | (UPPER[last].astype(U) << U(1)) | again.astype(U) if len(first) else np.zeros(0, U)
    weight = (1 / words)[text]
    parts = [(text, mix(TABLES[0][last] ^ (before << U(3)) if len(first) else np.zeros(0, U)), weight), (text, mix(shape + U(977)), weight), (text, mix(np.minimum(end - first, 16).astype(U) + U(31337)), weight)]
    rows = np.arange(len(starts))
    for k in range(1, stats.shape[1]):
        parts.append((rows, mix(U(7919 * k) + np.floor(np.clip(stats[:, k], 0, 1) * 20).astype(U)), np.full(len(rows), 0.5)))
    return stats, np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) & U(BUCKETS - 1)).astype(np.int64), np.concatenate([p[2] for p in parts])


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each labeller and the share of good documents."""

    good: float
    table: np.ndarray  # labeller, class (0 bad, 1 good), vote + 1

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        log = np.log(np.array([1 - self.good, self.good]))[None, :] + sum(np.log(self.table[k][:, v[:, k] + 1]).T for k in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Accuracies from agreement alone. Starts at labellers that flag few good documents and each only some kinds of
    bad ones, which also tells the classes apart. A share of the bad class's mass, less each round, stays at that start,
    so that it doesn't narrow to its most frequent kind at once; a little mass on every vote keeps unseen ones possible."""
    start = np.array([[0.35, 0.1, 0.55], [0.02, 0.1, 0.88]])
    model = LabelModel(0.8, np.tile(start, (v.shape[1], 1, 1)))
    for turn in range(rounds):
        p = model.posterior(v)
        weight = np.stack([counts * (1 - p), counts * p])
        table = np.array([[[weight[c][v[:, k] == x].sum() + 1 for x in (-1, 0, 1)] for c in (0, 1)] for k in range(v.shape[1])])
        table[:, 0] += 0.5 * 0.8**turn * weight[0].sum() * start[0]
        model = LabelModel(float(np.clip(weight[1].sum() / max(counts.sum(), 1), 0.01, 0.99)), table / table.sum(2, keepdims=True))
    return model


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps, with a small ridge. Each class weighs its
    posterior mass as it comes, so clean documents are not given up for rare junk."""
    used = np.flatnonzero(x.any(0))
    x, y = x[:, used], y.astype(np.float32)
    w, b, vw, vb = np.zeros(len(used), np.float32), 0.0, np.zeros(len(used), np.float32), 0.0
    rate = np.float32(4.0 / max(1e-9, float((x**2).sum(1).mean()) + 1))
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ (w + np.float32(0.9) * vw) + np.float32(b + 0.9 * vb), -30, 30))) - y
        vw = np.float32(0.9) * vw - rate * (g @ x / np.float32(len(y)) + np.float32(1e-5) * w)
        vb = 0.9 * vb - float(rate) * float(g.mean())
        w, b = w + vw, b + vb
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, float(b)


DESCRIBED = "did long, rid long, pattern long, words long, abusive boolean, f array<short>, v array<float>"


def described(docs: DataFrame, stems: tuple[str, ...] = ()) -> DataFrame:
    """(did, rid, pattern, words, abusive, f, v): every document's vote pattern, word count, verdict of the lexicon with
    the learned stems, and summed hashed features (bucket, value)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            votes_, words, f, v = [], [], [], []
            for _, buf, starts in chunks(b.column("text")):
                stats, text, bucket, value = features(buf, starts)
                votes_.append(pattern(votes(stats)))
                words.append(stats[:, 0].astype(np.int64))
                x = np.bincount(text * BUCKETS + bucket, weights=value)
                at = np.flatnonzero(x)
                part = np.searchsorted(at // BUCKETS, np.arange(1, len(starts)))
                f += np.split((at % BUCKETS).astype(np.int16), part)
                v += np.split(x[at].astype(np.float32), part)
            flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (votes_, words)]
            cols = [b.column("did"), b.column("rid"), *flat, pa.array(abusive(b.column("text"), stems)), pa.array(f, pa.list_(pa.int16())), pa.array(v, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["did", "rid", "pattern", "words", "abusive", "f", "v"])

    return keyed(docs).mapInArrow(run, DESCRIBED)


def fit(table: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, LabelModel]:
    """Label model from all documents' vote patterns, scorer from the posteriors of the `train_rows` distinct documents
    with the smallest hash (a sample that reruns agree on). table: what described() gives."""
    each = lambda p: np.array([[x // 3**k % 3 - 1 for k in range(len(LABELLERS))] for x in p]).reshape(-1, len(LABELLERS)).astype(int)
    seen = table.groupBy("pattern").count().toPandas()  # at most 3 ** 7 rows
    model = expectation_maximisation(each(seen["pattern"]), seen["count"].to_numpy())
    keys = table.select("did", "rid").distinct().orderBy(F.xxhash64("rid", F.lit(5)), "did", "rid").limit(train_rows)
    got = table.select("did", "rid", "pattern", "f", "v").join(F.broadcast(keys), ["did", "rid"]).dropDuplicates(["did", "rid"]).orderBy("did", "rid").toPandas()
    if got.empty:
        return np.zeros(BUCKETS), 0.0, model
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, (f, val) in enumerate(zip(got.f, got.v, strict=True)):
        x[i, f] = val
    return *train(x, model.posterior(each(got["pattern"]))), model


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, label_rows: int = LABEL_ROWS) -> DataFrame:
    """One row per document: did, rid, doc_id, score (probability of good), keep (score at or above the threshold).

    labels: (doc_id, toxic) of some documents; insults are learned from at most `label_rows` of them, and their labels
    serve for nothing else. Without any, or with an empty table, the fixed lexicon alone tells abuse.
    Null, empty and blank texts have no words, no votes and are rejected with score 0, as are abusive ones. Very long
    texts are described whole. Equal texts score equally; repeated rows are returned each; a null doc_id is an id like
    others; extra columns are ignored; an empty table gives an empty result."""
    table = keep(described(docs, learned_stems(docs, labels, label_rows) if labels is not None else ()), "described")
    w, b, _ = fit(table, train_rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            f, v = batch.column("f"), batch.column("v")
            row = np.repeat(np.arange(len(batch)), f.value_lengths().to_numpy())
            z = np.bincount(row, weights=w[f.flatten().to_numpy()] * v.flatten().to_numpy(), minlength=len(batch)) + b
            bad = (batch.column("words").to_numpy() == 0) | batch.column("abusive").to_numpy(zero_copy_only=False)
            score = np.where(bad, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(score)], ["did", "rid", "score"])

    out = table.select("did", "rid", "words", "abusive", "f", "v").mapInArrow(run, "did long, rid long, score double")
    return out.select("did", "rid", doc_id(), "score", (F.col("score") >= threshold).alias("keep"))


def quality_stage(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier keeps, with all their columns and repeats. Null, empty and blank texts go; an
    empty table stays empty."""
    return restrict(docs, keep(quality_scores(docs, labels).where("keep").select("did", "rid").distinct(), "kept"))
