"""Each operator against a brute-force version, on texts with every edge: nulls, empty, ties, repeats, long, skewed."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from arcwise.llm import decontaminate, exact, lines, mixing, quality, secrets, simhash, substring, suffix, tokens, windows
from arcwise.llm.common import components

# columns that clash with the operators' own names
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, rid string, n int, keep string, copies int, h string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "lake", "stone", "river", "tall", "ëcho", "blue", "run", "mill", "ash"]) + rng.choice(["", "", "s", "ing", "ed.", ","]) + rng.choice(["", "x", "q"]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 200)), f"s{i % 7}") for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", "s0") for i in range(12)]
    twin = prose(rng, 150)
    rows += [(200 + i, twin, "s1") for i in range(25)] + [(230, twin.replace(" ", "\n"), "s2"), (231, twin + " ", "s2")]
    rows += [(240 + i, " ".join(w for j, w in enumerate(twin.split()) if j != 7 * i), "s3") for i in range(6)]
    rows += [(300, None, None), (301, "", "s1"), (302, " \n\t", None), (303, "one", None), (304, "la " * 400, "s4"), (305, "ab" * 900, "s4"), (306, prose(rng, 9000), "s5")]
    rows += [(None, "no id here at all", "s6"), (None, None, "s6")]
    rows += [(60 + i, f"Shared notice of all sites.\n{prose(rng, 15)}\n  Shared notice of all sites. ", f"s{i}") for i in range(7)]
    rows += [rows[3], rows[3]]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), "x", "y", 1, "z", 2, "h") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return (t or "").encode()


def order(rows):
    return sorted(rows, key=repr)


def test_exact(docs, empty):
    groups = defaultdict(list)
    for i, t, _ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for norm, g in groups.items():
        best = min(g)  # of rows that tie, one
        want += [(x[3], best[3], len(g), k == g.index(best), hashlib.sha256(norm.encode()).hexdigest()) for k, x in enumerate(g)]
    assert order(tuple(r) for r in exact.exact_dedup(docs).collect()) == order(want)
    assert exact.exact_dedup(empty).count() == 0
    stage = exact.exact_dedup_stage(docs)
    assert stage.columns == docs.columns
    assert stage.count() == len(groups)


def windows_brute(units, size, hit_len=1):
    count = Counter(tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size] for u in units for i in range(len(u) - size + 1))
    masks = []
    for u in units:
        m = np.zeros(len(u) + 1, int)
        for i in range(len(u) - size + 1):
            if count[tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size]] > 1:
                m[i] += 1
                m[i + size] -= 1
        masks.append(np.cumsum(m)[:-1] > 0)
    return masks


@pytest.mark.parametrize(("window", "k"), [(35, 16), (6, 3)])
def test_substring(docs, empty, window, k):
    rows = corpus()
    words = [text_of(t).split() for _, t, _ in rows]
    want = []
    for (i, *_), w, m in zip(rows, words, windows_brute(words, window), strict=True):
        kept = b" ".join(x for x, g in zip(w, m, strict=True) if not g)
        want.append((i, len(w), int(m.sum()), hashlib.sha256(kept).hexdigest()))
    got = substring.substring_dedup(docs, window, k).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert substring.substring_dedup(empty).count() == 0


def suffix_wanted(rows, size):
    data = [text_of(t) for _, t, _ in rows]
    want = []
    for (i, *_), d, m in zip(rows, data, windows_brute(data, size), strict=True):
        kept = np.frombuffer(d, np.uint8)[~m].tobytes()
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        want.append((i, len(d), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return order(want)


def suffix_got(docs, *args):
    got = suffix.suffix_dedup(docs, *args).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return order(tuple(r) for r in got.collect())


@pytest.mark.parametrize("most", [suffix.SORT_BYTES, 2000, 0])
def test_suffix(docs, empty, most):
    """Also with keys too large to be sorted at once, down to windows that can't be cut further."""
    assert suffix_got(docs, 400, 48, most) == suffix_wanted(corpus(), 400)
    assert suffix.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("most", [suffix.SORT_BYTES, 40, 0])
def test_suffix_short_windows(spark, most):
    """Few letters and short windows: many branches, texts that repeat inside themselves, paths cut by level."""
    rng = random.Random(21)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 60))) + "xyzzyabcab" * (i % 3), "s") for i in range(60)]
    rows += [(70, "a" * 50, "s"), (71, "ab" * 40, "s"), (72, "abc" * 30 + "q" + "abc" * 9, "s")]
    assert suffix_got(frame(spark, rows), 12, 4, most) == suffix_wanted(rows, 12)


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


def test_alike_for_polynomial_hashes(spark):
    """Texts that polynomials modulo a power of two can't tell apart, whatever their base, lose nothing."""
    x, y = thue_morse(8192, "a", "b"), thue_morse(8192, "b", "a")
    rng = random.Random(22)
    letters = "".join(rng.choices("cdefghij", k=8192))
    mixed = lambda t: "".join(p + q for p, q in zip(t, letters, strict=True))
    rows = [(1, mixed(x), "s"), (2, mixed(y), "s")]
    assert suffix_got(frame(spark, rows)) == suffix_wanted(rows, 400)
    head = [f"w{i}" for i in range(34)]
    rows = [(k, " ".join([*head[:17], thue_morse(1024, *ab), *head[17:]]), "s") for k, ab in enumerate(("ab", "ba"))]
    assert [r["n_removed"] for r in substring.substring_dedup(frame(spark, rows)).collect()] == [0, 0]


def test_differing_texts_of_one_digest(spark):
    """Where digests don't tell texts apart, the units themselves do, and the next seed decides."""
    rng = random.Random(23)
    shared = prose(rng, 20)
    rows = [(i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}", "s") for i in range(4)]
    docs = frame(spark, rows)
    u = windows.Units(True, 35, 16)
    edges = docs.selectExpr("doc_id did", "xxhash64(doc_id, text) rid", "0 start", "3 n", "1L key", "2L digest", "0 level")
    assert not windows.differing(u, docs, windows.chains(edges)).isEmpty()

    seen = []

    kept = lambda df: [windows.keep(df.drop("level"), "edges")]

    def search(seed):
        seen.append(seed)
        return kept(edges if len(seen) == 1 else edges.limit(0)), None

    assert windows.compared(u, docs, search).count() == 0
    assert seen == list(windows.SEEDS[:2])
    with pytest.raises(RuntimeError):
        windows.compared(u, docs, lambda seed: (kept(edges), None))


def test_graph(spark):
    """Chains end where the graph branches, run across documents, and are cut where a document enters a cycle."""
    #    a b c d   shared by 1, 2; 3 leaves after b; 4 goes round x y
    texts = {1: "abcd", 2: "abcd", 3: "abq", 4: "xyxyxy"}
    rows = [(doc, 0, k, 1, ord(c), 0, 0) for doc, t in texts.items() for k, c in enumerate(t) if c != "q"]
    edges = spark.createDataFrame(rows, "did long, rid long, start int, n int, key long, digest long, level int")
    got = {(r["did"], r["start"], r["n"], chr(r["key"])) for r in windows.chains(edges).collect()}
    assert got == {(1, 0, 2, "a"), (2, 0, 2, "a"), (3, 0, 2, "a"), (1, 2, 2, "c"), (2, 2, 2, "c"), (4, 0, 2, "x"), (4, 2, 2, "x"), (4, 4, 2, "x")}


def test_very_long_texts(spark, monkeypatch):
    """Texts hashed in many pieces lose the same as in one."""
    rng = random.Random(24)
    part = prose(rng, 300)
    rows = [(1, f"{prose(rng, 900)} {part} {prose(rng, 800)} {part}", "s"), (2, f"{part} {prose(rng, 50)}", "s"), (3, "ab " * 2000, "s")]
    real = windows.Units
    for module in (suffix, substring):
        monkeypatch.setattr(module, "Units", lambda words, size, k, piece=0: real(words, size, k, 500))
    assert suffix_got(frame(spark, rows)) == suffix_wanted(rows, 400)
    words = [text_of(t).split() for _, t, _ in rows]
    want = [(i, int(m.sum())) for (i, *_), m in zip(rows, windows_brute(words, 35), strict=True)]
    got = substring.substring_dedup(frame(spark, rows)).select("doc_id", "n_removed")
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_suffix_array():
    rng = random.Random(2)
    for s in [b"", b"a", b"banana", b"mississippi", b"aaaa", b"abab" * 9, *(bytes(rng.choices(b"ab\xff", k=rng.randint(1, 300))) for _ in range(60))]:
        sa = suffix.suffix_array(s).tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        if len(sa) > 1:
            a, b = np.array(sa[:-1]), np.array(sa[1:])
            lcp = [next((k for k in range(40) if s[i + k : i + k + 1] != s[j + k : j + k + 1] or i + k >= len(s)), 40) for i, j in zip(a, b, strict=True)]
            assert suffix.common_prefix(s, a, b, 40).tolist() == lcp


def fingerprint_brute(t):
    w = text_of(t).lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs, empty):
    rows = corpus()
    fp = [fingerprint_brute(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fp):
            root[i] = min(root[j] for j, b in enumerate(fp) if (a ^ b).bit_count() <= 4)
    key = lambda i: (i is not None, i or 0)
    low = {r: min((rows[j][0] for j in range(len(rows)) if root[j] == r), key=key) for r in set(root)}
    want = [(i, f"{f:016x}", low[r]) for (i, *_), f, r in zip(rows, fp, root, strict=True)]
    got = simhash.near_dedup(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert order(tuple(r) for r in got) == order(want)
    assert simhash.near_dedup(empty).count() == 0
    stage = simhash.near_dedup_stage(docs)
    assert (stage.columns, stage.count()) == (docs.columns, len(low))


def test_simhash_tiles(spark):
    """Cells that are split over tiles find the same links; xxhash64 of the engine is XXH64 with seed 42."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    base += [base[0] ^ rng.getrandbits(40) for _ in range(30)]  # a hot bucket: equal in its upper bits
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(12)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {f: f for f in signed}
    for _ in signed:
        before = dict(root)
        for a in signed:
            root[a] = min(root[b] for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
        if root == before:
            break
    for tile in (4096, 3):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, 4, tile)).collect()}
        assert {f: got.get(f, f) for f in signed} == root


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if sum(1 for m in root if root[m] == r) > 1}


def test_quality_model():
    """The label model recovers accuracies that it never sees."""
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    right = np.array([0.95, 0.85, 0.75, 0.9])
    v = np.where(rng.random((20000, 4)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    rows, counts = np.unique(v, axis=0, return_counts=True)
    m = quality.expectation_maximisation(rows, counts)
    assert abs(m.good - 0.8) < 0.02
    assert np.abs(m.table[:, 1, 2] - right).max() < 0.03


def test_quality(spark, empty):
    rng = random.Random(6)
    good = [(i, ". ".join(prose(rng, 9).replace(".", "").replace(",", "").capitalize() for _ in range(rng.randint(3, 12))) + ".", "s") for i in range(300)]
    bad = [(1000 + i, t, "s") for i in range(20) for t in ["spam " * 60, prose(rng, 60).upper().replace(" ", "!! "), prose(rng, 60).replace(" ", "### ")]]
    edge = [(5000, None, "s"), (5001, "", "s"), (5002, "  \n", "s"), (None, good[0][1], "s"), good[1]]
    got = quality.quality_scores(frame(spark, good + bad + edge)).collect()
    keep = defaultdict(list)
    for r in got:
        keep[r["doc_id"]].append(r["keep"])
    assert len(got) == len(good + bad + edge)
    assert np.mean([all(keep[i]) for i, *_ in good]) > 0.98
    assert np.mean([not any(keep[i]) for i, *_ in bad]) > 0.9
    assert not any(keep[5000] + keep[5001] + keep[5002])
    assert quality.quality_scores(empty).count() == 0
    stage = quality.quality_stage(frame(spark, good + bad + edge))
    assert stage.columns == empty.columns
    assert stage.count() == sum(r["keep"] for r in got)


def test_quality_sample(spark, monkeypatch):
    """A row that is repeated often takes one place of the training sample, also where its hash is the smallest."""
    rng = random.Random(13)
    rows = [(i, prose(rng, 30), "s") for i in range(120)]
    first = quality.keyed(frame(spark, rows)).selectExpr("did", "xxhash64(rid, 5) h").orderBy("h").first()["did"]
    seen = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(y)) or real(x, y))
    quality.fit(quality.described(frame(spark, rows + [rows[first]] * 60)), 50)
    assert seen == [50]


def test_quality_abuse(spark):
    """Abuse in good prose is rejected in each language, a harmless single word isn't, nor a few in a long text."""
    rng = random.Random(12)
    good = [(i, ". ".join(prose(rng, 9).replace(".", "").replace(",", "").capitalize() for _ in range(rng.randint(3, 12))) + ".", "s") for i in range(300)]
    says = ["you IDIOT, worthless scum", "du Vollidiot, erbärmlicher Versager", "espèce de crétin, pauvre connard", "eres un imbécil, pedazo de escoria"]
    bad = [(1000 + i, f"{good[i][1]} The {says[i % 4]}. {good[i + 40][1]}", "s") for i in range(40)]
    fine = [(2000 + i, f"{good[i][1]} We took the trash out. {good[i + 40][1]}", "s") for i in range(40)]
    fine += [(2100 + i, f"{good[i][1]} The rate of null dummy débiles. Trash is trash. {good[i + 40][1]}", "s") for i in range(40)]
    fine.append((3000, " ".join(t for _, t, _ in good) + " An idiot and a clown.", "s"))
    got = {r["doc_id"]: r for r in quality.quality_scores(frame(spark, good + bad + fine)).collect()}
    assert not any(got[i]["keep"] or got[i]["score"] for i, *_ in bad)
    assert np.mean([got[i]["keep"] for i, *_ in good + fine]) > 0.98
    assert got[3000]["keep"]
    stage = quality.quality_stage(frame(spark, good + bad + fine))
    assert not {r["doc_id"] for r in stage.collect()} & {i for i, *_ in bad}


def test_quality_learned_abuse(spark, empty):
    """Invented insults are learned from some labelled rows and found in rows that the sample doesn't hold; clean rows,
    and words of one text in many copies, are left alone. Labels with nulls, conflicts, repeats and other columns do."""
    rng = random.Random(51)
    line = lambda: ". ".join(prose(rng, 9).replace(".", "").replace(",", "").capitalize() for _ in range(8)) + "."
    stems = ["brúxen", "qovlar", "zzedri"]
    insult = lambda i: f"{line()} Du {stems[i % 3]}{rng.choice(['ta', 'mo', 'li', ''])}, {stems[(i + 1) % 3].capitalize()}{rng.choice(['ra', 'ke'])}! {line()}"
    clean = [(i, line(), "s") for i in range(400)]
    toxic = [(1000 + i, insult(i), "s") for i in range(120)]
    copied = f"Wumbrelo fentikar hoslavin. {line()}"
    copies = [(2000 + i, copied, "s") for i in range(60)]
    fine = [(3000 + i, f"{line()} A wumbrelo and a fentikar. {line()}", "s") for i in range(20)]
    docs = frame(spark, clean + toxic + copies + fine + [toxic[0]] * 5 + [(None, "no id", "s"), (1001, None, "s")])
    rows = [(i, int(i >= 1000), "k", 0) for i, *_ in clean + toxic[:60] + copies] + [(None, 1, "k", 0), (5, None, "k", 0), (1000, 0, "k", 0), (99999, 1, "k", 0)]
    labels = spark.createDataFrame(rows + rows[:3], "doc_id long, toxic int, text string, did int")
    found = quality.learned_stems(docs, labels)
    assert found and all(any(s.startswith(f) for s in stems) for f in found)
    got = {r["doc_id"]: r["keep"] for r in quality.quality_scores(docs, labels).where("doc_id <> 1001").collect()}
    assert not any(got[i] for i, *_ in toxic if i != 1001)
    assert np.mean([got[i] for i, *_ in clean + fine]) > 0.98
    plain = {r["doc_id"]: r["keep"] for r in quality.quality_scores(docs).collect()}
    assert np.mean([plain[i] for i, *_ in toxic if i != 1001]) > 0.9
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("doc_id is null")):
        assert quality.learned_stems(docs, none) == ()
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.labelled_sample(docs, labels, 50).count() <= 50


def edit_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontaminate(spark, empty):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(6, 50))) for i in range(20)] + [(50, "tiny"), (51, None), (52, "...")]
    rows = [(i, prose(rng, 80), "s") for i in range(60)]
    for k in range(60):
        w = items[k % 20][1].split()
        for _ in range(rng.randint(0, int(len(w) * 0.2))):
            w[rng.randrange(len(w))] = "changed"
        rows.append((500 + k, f"{prose(rng, 20)} {' '.join(w).upper()} {prose(rng, 20)}", "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "Tiny!", None), rows[70]]
    words = lambda t: re.findall(r"[a-z0-9\u0080-￿]+", t.lower())
    want = Counter()
    for i, t, _ in rows:
        for k, q in items:
            if q and (iw := words(q)):
                d = edit_distance(iw, words(t or ""))
                if d <= int(len(iw) * 0.2 + 1e-9):
                    want[i, k, d] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = Counter(tuple(r) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id", "distance").collect())
    pairs = {(i, k) for i, k, _ in want}
    found = {(i, k) for i, k, _ in got}
    assert found <= pairs  # verified: nothing false
    assert len(found) >= 0.95 * len(pairs)
    assert {(i, k) for i, k, d in want if d == 0} <= found  # unedited items are always found
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    stage = decontaminate.decontaminate_stage(docs, bench)
    assert stage.columns == docs.columns
    assert stage.count() == sum(1 for i, *_ in rows if i not in {a for a, _ in found})


def test_decontaminate_long_items(spark, monkeypatch):
    """A very long item is found in its holder, doesn't fit elsewhere and is a load of its own."""
    monkeypatch.setattr(decontaminate, "LOAD_WORDS", 1000)
    rng = random.Random(8)
    long, short = prose(rng, 1500), [prose(rng, 12) for _ in range(3)]
    assert decontaminate.loads([1500, 12, 12, 12]) == [[0], [1, 2, 3]]
    docs = frame(spark, [(1, f"{prose(rng, 10)} {long} {short[1]}", "s"), (2, long[:3000], "s"), (3, short[2], None), (4, prose(rng, 40), "s")])
    bench = spark.createDataFrame([(9, long), *enumerate(short)], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id", "distance").collect()}
    assert got == {(1, 9, 0), (1, 1, 0), (3, 2, 0)}


def edited(rng, x, d):
    y = x.tolist()
    for _ in range(d):
        at, what = int(rng.integers(len(y) + 1)), int(rng.integers(3))
        y[at : at + (what != 0)] = [int(rng.integers(1, 2**63))] * (what != 2)
    return np.array(y, np.uint64)


@pytest.mark.parametrize("n", [5, 30, 400, 1600])
def test_decontaminate_recall(n):
    """Of items edited as much as allowed, in any place and way, nine in ten are found, at each length."""
    rng = np.random.default_rng(31)
    word = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    items = [word(n) for _ in range(20)]
    index = decontaminate.Index(list(range(20)), items, 0.8)
    found = 0
    for i in range(100):
        h = np.concatenate([word(40), edited(rng, items[i % 20], decontaminate.allowed(n, 0.8)), word(40)])
        got = decontaminate.matches(index, h, np.array([0, len(h)]))
        assert {k for _, k, _ in got} <= {i % 20}
        found += len(got)
    assert found >= 90


def test_decontaminate_hot_phrase():
    """A text of one phrase, over and over, against items that share the phrase takes no time to speak of."""
    rng = np.random.default_rng(32)
    word = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    phrase = word(6)
    items = [np.concatenate([phrase, word(14), phrase]) if k % 2 else np.concatenate([np.tile(phrase, 4), word(6)]) for k in range(300)]
    index = decontaminate.Index(list(range(300)), items, 0.8)
    h = np.tile(phrase, 300)
    began = time.perf_counter()
    got = decontaminate.matches(index, h, np.array([0, len(h)]))
    assert time.perf_counter() - began < 2
    assert {(i, d) for _, i, d in got} == {(k, d) for k in range(300) if (d := edit_distance(items[k].tolist(), h[:60].tolist())) <= 6 - (k % 2)}


def test_decontaminate_one_scan(spark):
    """Ten thousand items are one load, and the documents are read once."""
    rng = random.Random(33)
    items = [(i, prose(rng, rng.randint(8, 12))) for i in range(10_000)]
    docs = frame(spark, [(i, f"{prose(rng, 9)} {items[i * 7][1]}", "s") for i in range(30)])
    out = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(i, i * 7) for i in range(30)} <= {(r["doc_id"], r["item_id"]) for r in out.collect()}


def test_decontaminate_recall_by_length(monkeypatch):
    """Long items that the tables miss more often than the target allows are found, also among many short ones."""
    monkeypatch.setattr(decontaminate, "MAX_TABLES", 8)
    rng = np.random.default_rng(14)
    word = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    items = [word(5) for _ in range(300)] + [word(600) for _ in range(3)]
    index = decontaminate.Index(list(range(len(items))), items, 0.8)
    found = 0
    for k in range(12):
        y = items[300 + k % 3].copy()
        y[rng.choice(600, 120, replace=False)] = word(120)
        h = np.concatenate([word(50), y, word(50)])
        got = decontaminate.matches(index, h, np.array([0, len(h)]))
        assert all((t, i) == (0, 300 + k % 3) and d <= 120 for t, i, d in got)
        found += len(got)
    assert found == 12
    assert index.exact[-3:].all()


def test_lines(spark, docs, empty, tmp_path):
    for min_sites in (5, 2):
        spread = defaultdict(set)
        for _, t, s in corpus():
            for x in (t or "").split("\n"):
                spread[x.strip(" \t\n\x0b\x0c\r")].add(s or "")
        want = []
        for i, t, _ in corpus():
            all_ = (t or "").split("\n")
            kept = [x for x in all_ if not (y := x.strip(" \t\n\x0b\x0c\r")) or len(spread[y]) < min_sites]
            want.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        got = lines.line_dedup(docs, min_sites).select("doc_id", "n_lines", "n_removed", "kept_sha256")
        assert order(tuple(r) for r in got.collect()) == order(want)
    assert lines.line_dedup(empty).count() == 0


def test_lines_many_sites(spark):
    """Above the exact band the sketch alone decides, far from the threshold."""
    rows = [(i, f"everywhere\nline {i}", f"site{i}") for i in range(300)]
    got = lines.line_dedup(frame(spark, rows), 20).agg({"n_removed": "sum"}).first()[0]
    assert got == 300


def standard(text):
    n = len(text)
    return [(3 * n // 4, 3 * n // 4, " [edited] "), (n // 2, min(n, n // 2 + 7), ""), (n // 4, min(n, n // 4 + 1), "42")]


def test_tokens(spark, docs, empty):
    counter = tokens.Counter(tokens.read_ranks(spark, tokens.TOKENIZER))
    full = lambda t: len(counter.encode(t))
    want = []
    for i, t, _ in corpus():
        t = t or ""
        n, e = full(t), t
        for s, stop, new in standard(t):
            e = e[:s] + new + e[stop:]
        want.append((i, n, full(e)))
    got = tokens.token_counts(docs)
    assert order(tuple(r) for r in got.select("doc_id", "n_tokens", "n_edited_tokens").collect()) == order(want)
    long_ = got.where("doc_id = 306").first()
    assert long_["n_reencoded"] < 0.05 * sum(long_["leaf_chars"])
    assert long_["n_sums"] < 100 < len(long_["leaf_chars"])  # paths, not the whole tree
    assert tokens.token_counts(empty).count() == 0


def test_token_trees():
    """Any edits in any order: the tree equals a full recount, its sums hold, and each leaf is whole pre-tokens."""
    from pyspark.sql import SparkSession

    counter = tokens.Counter(tokens.read_ranks(SparkSession.getActiveSession(), tokens.TOKENIZER))
    rng = random.Random(8)
    for k in range(300):
        text = "".join(rng.choices("ab  \n\n1'st.é", k=rng.randint(0, 500 if k % 10 else 6000)))
        tree = tokens.build(counter, text)
        for _ in range(6):
            s = rng.randint(0, len(text))
            stop = rng.randint(s, min(len(text), s + rng.choice([0, 9, 9, 400])))
            text, _ = tokens.edit(counter, tree, text, s, stop, "".join(rng.choices("ab \n1's", k=rng.choice([0, 3, 6, 700]))))
            assert tree.total == len(counter.encode(text)) == sum(tree.tokens[0])
            assert tree.length == len(text)
            assert (tree.tokens, tree.chars) == (tokens.sums_of(tree.tokens[0]), tokens.sums_of(tree.chars[0]))
            for place in (0, s, len(text)):
                i, begin = tree.find(place) if tree.chars[0] else (0, 0)
                assert begin == sum(tree.chars[0][:i])


def test_edit_table(spark, docs, monkeypatch):
    """A table of edits reaches the kept trees of the documents it names, and no other document is encoded."""
    trees = tokens.token_trees(docs)
    rows = [(5, 1, 3, 9, "new words"), (5, 2, 0, 0, "At the start "), (6, 1, 10_000, 10_001, " the end"), (302, 1, 0, 99, None)]
    edits = spark.createDataFrame(rows, "doc_id long, no int, start int, stop int, new string")
    got = {r["did"]: r for r in tokens.follow_edits(tokens.with_edits(trees, edits)).collect()}
    assert set(got) == {5, 6, 302}
    texts = {i: t for i, t, _ in corpus()}
    counter = tokens.Counter(tokens.read_ranks(spark, tokens.TOKENIZER))
    want = {5: "At the start " + texts[5][:3] + "new words" + texts[5][9:], 6: texts[6] + " the end", 302: ""}
    for i, t in want.items():
        assert (got[i]["text"], got[i]["n_tokens"]) == (t, len(counter.encode(t)))
        assert got[i]["n_before"] == len(counter.encode(texts[i]))


def test_targets():
    t = mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 500)])
    assert t == {"a": pytest.approx(t["a"]), "b": 300, "c": pytest.approx(t["c"]), None: 30}
    assert sum(t.values()) == pytest.approx(1610)
    assert t["a"] == pytest.approx(5 * t["c"])
    assert mixing.targets([("a", 10), ("b", 0)]) == {"a": 10, "b": 0}
    assert mixing.targets([]) == {}


def targets_brute(sizes):
    """Where every open source has its weight's share of one level, found by bisection, and none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    at = lambda level: {s: min(weight[s] * level, 3 * sizes[s]) for s in names}
    lo, hi = 0.0, float(3 * sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid).values()) < sum(sizes.values()) else (lo, mid)
    return at(hi)


def test_targets_by_level():
    rng = random.Random(41)
    for _ in range(200):
        sizes = {f"s{i}": rng.choice([0, 1, 5, rng.randint(0, 10**rng.randint(1, 7))]) for i in range(rng.randint(1, 12))}
        if rng.random() < 0.5:
            sizes[None] = rng.randint(0, 1000)
        got, want = mixing.targets(list(sizes.items())), targets_brute(sizes)
        for s in sizes:
            assert got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(frame(spark, [(i, "a b", f"s{i}") for i in range(5)]))


def test_mixing_chances():
    """Through flight, landing and polish, documents keep about the chance they came with."""
    rng = np.random.default_rng(42)
    size = rng.integers(20, 400, 60)
    taken = np.zeros(60)
    for seed in range(600):
        p = np.full(60, 0.4)
        q = mixing.flight(size, p, np.random.default_rng(seed))
        copies = mixing.polish(size, mixing.landing(size, q), float((size * p).sum()), 3.0)
        assert abs(float((copies * size).sum()) - 0.4 * size.sum()) <= size.min()  # nearer than the smallest document
        taken += copies
    assert abs(taken.mean() / 600 - 0.4) < 0.02
    assert np.abs(taken / 600 - 0.4).max() < 0.25


def test_empty_stages(spark, empty):
    """Every stage of an empty table is empty, with its columns; null, blank and very long texts pass through all."""
    bench = spark.createDataFrame([(1, "some item of the benchmark that nothing holds")], "item_id long, text string")
    stages = [quality.quality_stage, exact.exact_dedup_stage, simhash.near_dedup_stage, lambda d: decontaminate.decontaminate_stage(d, bench), mixing.mixing_stage]
    rng = random.Random(43)
    rows = [(1, None, None), (2, "", "s"), (3, " \n", "s"), (None, "an id that is null", "s"), (4, prose(rng, 60_000), "s"), (4, prose(rng, 30), "s")]
    odd = frame(spark, rows + rows[-1:])
    for stage in stages:
        out = stage(empty)
        assert (out.columns, out.count()) == (empty.columns, 0)
        out = stage(odd)
        assert out.columns == odd.columns
        assert {r["text"] for r in out.collect()} <= {t for _, t, _ in rows}


def test_mixing(spark, docs, empty):
    rng = random.Random(9)
    rows = corpus() + [(10_000 + i, prose(rng, rng.randint(1, 60)), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = frame(spark, rows)
    for part in (4096, 64):
        got = mixing.mix_sources(df, part=part).collect()
        assert len(got) == len(rows)
        size, taken = defaultdict(int), defaultdict(int)
        for r in got:
            assert r["taken"] in {k * r["size"] for k in range(4)}
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
        want = mixing.targets(list(size.items()))
        for r in got:
            assert (r["source_size"], r["target"]) == (size[r["source"]], pytest.approx(want[r["source"]]))
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(12, 0.005 * t), (s, t, taken[s])
        again = mixing.mix_sources(df.repartition(3), part=part)
        assert order((r["did"], r["rid"], r["taken"]) for r in again.collect()) == order((r["did"], r["rid"], r["taken"]) for r in got)
    assert mixing.mix_sources(empty).count() == 0
    stage = mixing.mixing_stage(df)
    assert stage.columns == df.columns
    assert stage.count() == sum(r["copies"] for r in mixing.mix_sources(df).collect())


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 800), rng.random(800)
    q = mixing.flight(size, p, rng)
    left = (q > 0) & (q < 1)
    assert left.sum() <= 2
    assert abs(q.sum() - p.sum()) < 2
    assert (q * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing.flight(size[:40], p[:40], np.random.default_rng(s)) for s in range(1500)], axis=0)
    assert np.abs(mean - p[:40]).mean() < 0.03  # chances stay about what they were


def secrets_brute(t):
    out = []
    t = t or ""
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, empty):
    rng = random.Random(10)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choices(a, k=n))
    hexa = lambda n: key(n, "0123456789abcdef")
    rows = [(i, f"{prose(rng, 5)} AKIA{key(16)} ëë PassWord = '{key(10)}' {hexa(40)} {prose(rng, 4)}", "s") for i in range(80)]
    rows += [(100, "token: secret=abc, api_key:'x' apikey=longenough secret=token:abcdefgh", "s"), (101, "AKIA123 AKIAAKIA" + key(12), "s"), (102, "ſecret=abcdefgh toKen=abcdefgh", "s"), (103, f"x {hexa(23)}g {hexa(24)}", "s")]
    rows += [(104, f"the AK1A{key(16)} or ASIA{key(16)}", None)] + [(None if i is None else 20_000 + i, t, s) for i, t, s in corpus()]
    want = []
    for i, t, _ in rows:
        b = secrets_brute(t)
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((i, *(sum(k == j for _, k, _ in b) for j in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    got = secrets.find_secrets(frame(spark, rows)).collect()
    assert order((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == order(want)
    brute = {i: [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets_brute(t)] for i, t, _ in rows}
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("format")] == brute[r["doc_id"]]
    assert secrets.find_secrets(empty).count() == 0


def test_candidates():
    """Tokens in base spans are left out, in one walk over both."""
    rng = random.Random(44)
    for _ in range(200):
        text = " ".join(rng.choice(["AKIA" + "".join(rng.choices("ABC123", k=20)), "".join(rng.choices("abcdef0123456789", k=rng.randint(10, 40))), "token=" + "".join(rng.choices("xyz789", k=18)), "word", "zZ9" * 7]) for _ in range(rng.randint(0, 12)))
        spans = secrets.base_spans(text)
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(s < m.end() and m.start() < e for s, _, _, e in spans)]
        assert secrets.candidates(text, spans) == want


def test_grammar():
    """An automaton tells its format from prose and from other formats, and needs no list of its strings."""
    rng = random.Random(11)
    ids = ["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(300)]
    models = secrets.infer({"access": ids[:200]})
    assert np.mean([secrets.judge(models, x) == "access" for x in ids[200:]]) > 0.85
    assert not any(secrets.judge(models, x) for x in ["internationalization1", "src/main/java/com/example1", "2024-01-01-000000-000", "A" * 30])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, out, d).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in rows}) == len(rows)
    whole = order(tuple(r) for r in corpus_pipeline.run(spark, d).collect())
    assert whole == order(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, out, d).collect())


def test_sql(spark):
    """Queries with SQL give its rows."""
    from arcwise.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, d)
        cols = sorted(got.columns)
        res = con.execute(sql)
        at = [[c[0] for c in res.description].index(c) for c in cols]
        assert order(tuple(r[c] for c in cols) for r in got.collect()) == order(tuple(r[i] for i in at) for r in res.fetchall()), name
