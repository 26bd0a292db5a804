"""The training-data operators against brute force, with odd rows among the others."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import block_naming, context_tree, decontaminate, jaccard_join, langid, mixing, substring_dedup, toxicity, warc
from tracewright.llm.components import connected_components

RNG = np.random.default_rng(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, hash long, cls long, level int, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(n, seed=None, vocabulary=400):
    rng = np.random.default_rng(seed) if seed is not None else RNG
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base, passage = sentence(300, 1), sentence(60, 2)
    edited = base.split()
    edited[100] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, None), (7, "one"), (8, "One"), (9, " \t\n"),
        (10, sentence(40, 3) + " " + passage + " " + sentence(20, 4)), (11, sentence(30, 5) + "\n" + passage), (12, passage), (12, passage),
        (13, sentence(6000, 6)), (14, sentence(6000, 6)), (15, sentence(6000, 6) + " end"), (16, "a b a b " * 60), (17, "b a b a " * 40), (18, "é ß 1 2 3"),
        (19, "\x00\x1f nbsp em"), (20, "same text"), (20, "other text"), (None, base), (None, "no id"), (None, None),
    ]
    return [*out, *((100 + i, sentence(int(RNG.integers(1, 120)))) for i in range(40))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en" if t else None, None if n % 7 == 0 else f"s{n % 3}", len(t or ""), "x", 1, 2, 3, "k") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shuffled(rows):
    return sorted(rows, key=repr)


# --- exact dedup


@pytest.mark.parametrize("block,bucket", [(8192, None), (64, None), (7, lambda b: F.length(b).cast("long") % 3)])
def test_exact_groups(docs, rows, block, bucket):
    options = {"block_bytes": block} | ({"bucket": bucket} if bucket else {})
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i != keep, repr(i))):
            want.append((i, keep, len(ids), first and i == keep, sha(t)))
            first = False
    got = [tuple(r) for r in block_naming.exact_groups(docs, **options).collect()]
    assert shuffled(got) == shuffled(want)


def test_drop_exact_copies(docs, rows, nothing):
    kept = block_naming.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(t or "" for t in (r.text for r in kept.collect())) == Counter({t or "": 1 for _, t in rows})
    assert block_naming.drop_exact_copies(nothing).count() == 0
    assert block_naming.exact_groups(nothing).count() == 0


# --- mixing


def brute_mix(rows):
    size = lambda t: len(WORDS.findall(t or ""))
    totals = Counter()
    for i, t, s in rows:
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(totals.values())
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(2 * totals[s] for s in full)
        target = {s: 2.0 * totals[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        above = [s for s in free if target[s] > 2 * totals[s]]
        if not above:
            return totals, target
        full |= set(above)


@pytest.mark.parametrize("per_range", [2048, 3])
def test_mixing(docs, rows, per_range):
    data = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    totals, target = brute_mix(data)
    got = mixing.mix_sources(docs, rows_per_range=per_range).collect()
    assert len(got) == len(data)
    taken = Counter()
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix_sources(docs.repartition(3), rows_per_range=per_range).collect()
    pick = lambda x: shuffled((r.doc_id, r.size, r.taken) for r in x)
    assert pick(got) == pick(again)
    if per_range == 3:  # ranges don't change what is taken
        assert pick(got) == pick(mixing.mix_sources(docs).collect())


def test_mixing_of_whole_rows(spark):
    """Equal rows and texts of one id are taken each by itself, and in a stable order."""
    rows = [(1, "a b c d", "s", 5), (1, "a b c d", "s", 5), (1, "e f g h", "s", 5), (None, "a b", "s", 6), (None, "a b", "t", 7), (2, "x " * 30, "t", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    pick = lambda d: shuffled((r.row.text, r.row.size, r.source, r["size"], r.taken) for r in mixing.mix_sources(d, whole_rows=True).collect())
    got = pick(docs)
    assert got == pick(docs.repartition(5)) and Counter(x[:3] for x in got) == Counter((t, n, s) for _, t, s, n in rows)
    plain = mixing.mix_sources(docs).collect()
    assert Counter((r.source, r.taken) for r in plain)["t", 60] == 0 and sum(r.taken for r in plain) == sum(x[4] for x in got)


def test_mixing_of_nothing(spark, nothing):
    assert mixing.mix_sources(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0.0, 0), (0.0, 0)]


# --- substring dedup


def brute_repeats(rows, window):
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, w in split:
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < key(i) for k in range(window)}
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("window", [50, 9, 1])
def test_remove_repeats(docs, rows, nothing, window):
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, window).collect()]
    assert shuffled(got) == shuffled(brute_repeats(rows, window))
    assert substring_dedup.remove_repeats(nothing, window).count() == 0


def test_first_least():
    long = np.tile(np.arange(3, dtype=np.uint64), 400_000)  # equal values on both sides of a block's end
    assert (substring_dedup._first_least(long << np.uint64(21), 9) == -(-np.arange(len(long) - 8) // 3) * 3).all()
    for values in (RNG.integers(0, 9, 200), RNG.integers(0, 1 << 63, 200)):
        v = values.astype(np.uint64) << np.uint64(21)
        for span in (1, 2, 3, 8, 38, 200):
            want = [s + int(np.argmin(v[s : s + span])) for s in range(len(v) - span + 1)]
            assert substring_dedup._first_least(v, span).tolist() == want


# --- near duplicates


def brute_components(rows, width, percent):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for i, t in rows:
        w = WORDS.findall(fold(t))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    big = 1 << 70
    low = {}
    for n, (i, _) in enumerate(rows):
        low[find(n)] = min(low.get(find(n), big), big if i is None else i)
    return [(i, len(sets[n]), None if low[find(n)] == big else low[find(n)]) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates(spark, docs, rows, width, percent):
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, width, percent).collect()]
    assert shuffled(got) == shuffled(brute_components(rows, width, percent))


def test_near_duplicate_chains(spark):
    """Chains of edits, a shared passage, and a hub: links that no least hash promises."""
    rows, base = [], sentence(200, 8).split()
    for i in range(60):
        base = [*base[:i], f"new{i}", *base[i + 1 :]] if i % 2 else base
        rows.append((i, " ".join(base)))
    passage = sentence(30, 9)
    rows += [(1000 + i, f"{passage} {sentence(int(RNG.integers(2, 40)))}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, 4, 85).collect()]
    assert shuffled(got) == shuffled(brute_components(rows, 4, 85))


@pytest.mark.parametrize("rows", [[(1, "one")], [(1, "x"), (2, "y z"), (3, None)], [(i, f"short text {i}") for i in range(7)]])
def test_near_duplicates_of_short_texts(spark, rows):
    """Tables, and tasks of one document, in which no shingle or only odd ones occur."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, 4, 85).collect()]
    assert shuffled(got) == shuffled(brute_components(rows, 4, 85))


def test_near_duplicates_in_groups(spark):
    """Edited copies of one text that mostly don't link with one another, and of a variant."""
    rng = np.random.default_rng(14)
    base = sentence(100, 15).split()
    variant = base[:80] + [f"v{i}" for i in range(20)]
    rows = []
    for i in range(160):
        w = list(base if i % 3 else variant)
        for p in rng.choice(100, int(rng.integers(0, 4)), replace=False):
            w[p] = f"e{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, 4, 85).collect()]
    assert shuffled(got) == shuffled(brute_components(rows, 4, 85))


def test_drop_near_duplicates(docs, nothing):
    kept = jaccard_join.drop_near_duplicates(docs.where("doc_id < 4 or doc_id > 12"))
    assert kept.columns == docs.columns and {1} == {r.doc_id for r in kept.collect() if r.doc_id < 4}
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_drop_near_duplicates_of_any_id(spark, docs, rows):
    """One row of each component stays, with null and repeated ids left in."""
    kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(docs).collect()]
    words = lambda t: WORDS.findall(t or "")
    assert all(kept.count(r) == 1 for r in [(1, rows[0][1]), (12, rows[11][1]), (20, "same text"), (20, "other text"), (None, "no id"), (None, None)])
    assert (None, rows[0][1]) not in kept and sum(not words(t) for _, t in kept) == sum(not words(t) for _, t in rows)
    base = sentence(200, 31).split()
    copy = lambda i: " ".join([*base[:i], f"new{i}", *base[i + 1 :]])
    other, third = sentence(50, 32), sentence(50, 33)
    mixed = [(None, copy(3)), (None, copy(9)), (None, copy(9)), (None, other), (5, other), (5, third), (5, third + " end"), (6, "plain"), (None, "plain words")]
    found = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in jaccard_join.drop_near_duplicates(found).collect()]
    assert len(kept) == 5 and sum(t in (copy(3), copy(9)) for _, t in kept) == 1 and sum(t in (third, third + " end") for _, t in kept) == 1
    assert {(5, other), (6, "plain"), (None, "plain words")} < set(kept)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 20), (20, 21), (21, 22), (30, 31), (31, 30), (40, 31), *((100, 200 + i) for i in range(50))]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.root, set()).add(r.node)
    assert shuffled(map(sorted, parts.values())) == shuffled(map(sorted, [{1, 2, 3}, {5}, {7, 8, 9, 20, 21, 22}, {30, 31, 40}, {100, *range(200, 250)}]))


# --- decontamination


def brute_hits(rows, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i) if i is not None else "")
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    found |= owners
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("max_bytes", [100_000, 200, 60])
def test_benchmark_hits(spark, docs, rows, nothing, max_bytes):
    items = [(1, sentence(60, 2)), (2, None), (3, ""), (4, "ONE"), (5, "É, ß!"), (6, sentence(60, 2)), (None, "same-text"), (8, " ".join(sentence(6000, 6).split()[3000:3012]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.benchmark_hits(docs, bench, 10, max_bytes)
    got = [(r.doc_id, r.n_words, list(r.hits), list(r.items)) for r in hits.collect()]
    want = brute_hits(rows, items, 10)
    assert shuffled(got) == shuffled(want)
    clean = decontaminate.drop_contaminated(docs, bench, 10, max_bytes)
    assert clean.columns == docs.columns
    assert Counter(map(repr, (r.doc_id for r in clean.collect()))) == Counter(repr(i) for i, _, h, _ in want if not h)
    assert decontaminate.benchmark_hits(nothing, bench, 10, max_bytes).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == len(rows)


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    texts = [(1, "Say: The QUICK, brown fox; jumps."), (2, "nothing here"), (3, None)]
    got = decontaminate.cut_spans(spark.createDataFrame(texts, "doc_id long, text string"), bench, 10)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Say: ; jumps.", 2: "nothing here", 3: None}


# --- language ID


def test_language_id(spark, nothing):
    words = {"en": "the of and that with from this".split(), "de": "der und nicht auf sich eine über".split(), "fr": "le est dans où été près des".split()}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[l], 12)), l) for i, l in enumerate(rng.choice(list(words), 400))]
    odd = [(900, None, "en"), (901, "", None), (902, "123 --- %%", "de"), (903, "над", None), (None, "the of and", "en"), (5, "der und nicht", None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] != 5]
    assert np.mean([found[i].lang_pred == l for i, _, l in held]) > 0.98
    for i in (900, 901, 902):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[903].lang_pred in words and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in langid.drop_rejected(docs, model).collect()}.isdisjoint({900, 901, 902})
    assert langid.fit(nothing) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.drop_rejected(docs, None).count() == len(rows) + 3
    long = b"the of and " * 300_000
    assert langid._predict(long, model)[0] == "en"
    short = langid.subwords(b"ab cd")
    assert short.sum() == 6 + 4 + 2  # " a" "ab" "b " ..., " ab" "ab " ..., " ab " " cd "


# --- toxicity


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 25)]
        toxic = int(i % 8 == 0)
        if toxic:
            for k in rng.choice(25, 3, replace=False):
                words[k] = str(rng.choice(["vilest", "scorned!", "grubbix", "grubbor"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, toxic))
    rows += [(2000, None), (2001, ""), (None, "vilest scorned"), (3, rows[3][1])]
    labels += [(2002, 1), (4, None), (8, 1), (8, 1)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, toxic int")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored, model = toxicity.learn_and_score(docs, truth)
    got = scored.collect()
    assert shuffled(map(tuple, got)) == shuffled(map(tuple, toxicity.score(docs, model).collect()))
    assert len(got) == len(rows)
    held = [(r.score >= 0.5, r.doc_id % 8 == 0) for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(r.score < 0.5 for r in got if r.doc_id in (2000, 2001)) and all(r.score > 0.5 for r in got if r.doc_id is None)
    assert toxicity.learn_and_score(docs, truth.where("false"))[0].where("score >= 0.5").count() == 0
    assert toxicity.learn_and_score(nothing, truth)[0].count() == 0


def brute_label_model(votes, toxic, rounds):
    """Expectation maximisation row by row."""
    v = np.array([[*row, float(not any(row))] for row in votes])
    known = ~np.isnan(toxic)
    prior = float(np.clip(toxic[known].mean(), 0.01, 0.5))
    sure = np.where(toxic == 1, toxicity.TRUST, 1 - toxicity.TRUST)
    q = np.where(known, sure, prior)
    for k in range(rounds):
        use = known if k == 0 else np.ones(len(v), bool)
        p1 = ((q[use, None] * v[use]).sum(0) + 0.5) / (q[use].sum() + 1)
        p0 = (((1 - q[use])[:, None] * v[use]).sum(0) + 0.5) / ((1 - q[use]).sum() + 1)
        prior = float(np.clip(q.mean(), 0.01, 0.5))
        left = v - q[:, None] * p1 - (1 - q)[:, None] * p0
        cov = sum(np.outer(r, r) for r in left) / len(v)
        share = np.ones(len(p1))
        for i in range(len(p1)):
            for j in range(len(p1)):
                c = cov[i, j] / np.sqrt(max(cov[i, i], 1e-9)) / np.sqrt(max(cov[j, j], 1e-9))
                if i != j and c >= toxicity.CORRELATED:
                    share[i] += min(c, 1)
        odds = prior / (1 - prior) * np.prod((p1 / p0) ** (v / share), axis=1)
        q = np.where(known, sure, odds / (1 + odds))
    return p1, p0, 1 / share, prior, odds / (1 + odds)


def test_label_model(spark):
    rng = np.random.default_rng(16)
    toxic = rng.random(300) < 0.2
    votes = np.array([[float(rng.random() < (0.6 if y else 0.05)) for _ in range(4)] for y in toxic])
    votes[:, 3] = votes[:, 2]  # two voters that repeat one another
    labels = np.where(rng.random(300) < 0.4, toxic.astype(float), np.nan)
    counts = Counter((tuple(np.flatnonzero(v).tolist()), None if np.isnan(y) else int(y)) for v, y in zip(votes, labels, strict=True))
    patterns = spark.createDataFrame([(list(v), y, n) for (v, y), n in counts.items()], "votes array<int>, toxic int, n long").repartition(3)
    got = toxicity.label_model(patterns, 4, rounds=5)
    p1, p0, share, prior, posterior = brute_label_model(votes, labels, 5)
    for a, b in ((got.p1, p1), (got.p0, p0), (got.share, share), (got.prior, prior)):
        assert np.allclose(a, b, atol=1e-9)
    assert np.allclose(got.posterior(np.array([[*v, float(not v.any())] for v in votes])), posterior, atol=1e-9)
    assert share[2] < 0.6 and toxicity.label_model(patterns.where("toxic is null"), 4) is None


def test_linear_classifier():
    """At the result no weight can be moved to a smaller penalised loss."""
    rng = np.random.default_rng(17)
    x, y = (rng.random((200, 5)) < 0.3).astype(np.float32), rng.random(200)
    w, b = toxicity.linear_classifier(x, y)

    def loss(w, b):
        z = x @ w + b
        return np.sum(np.log1p(np.exp(z)) - y * z) + 0.25 * (w**2).sum() + 0.5e-3 * b**2

    for step in (1e-2, -1e-2):
        assert all(loss(w + step * np.eye(5)[k], b) > loss(w, b) for k in range(5)) and loss(w, b + step) > loss(w, b)


# --- context tree


def brute_ctw(train, texts, depth=3):
    """Bitwise context-tree weighting by recursion over counts, for a small depth."""
    counts = {}
    stream = lambda t: b"\n" * depth + b" ".join(context_tree.tokens((t or "").encode())) + b"\n"
    for t in train:
        s = stream(t)
        for i in range(depth, len(s)):
            for k in range(8):
                for d in range(depth + 1):
                    node = (s[i - d : i], (1 << k) | (s[i] >> (8 - k)))
                    counts.setdefault(node, [0, 0])[(s[i] >> (7 - k)) & 1] += 1
    children = {}
    for c, b in counts:
        if c:
            children.setdefault((c[1:], b), []).append((c, b))
    memo = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(c) for c in children.get(node, ())))
        return memo[node]

    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p = None
                for d in range(depth, -1, -1):
                    node = (s[i - d : i], (1 << k) | (s[i] >> (8 - k)))
                    a, b = counts.get(node, (0, 0))
                    one = (b + 0.5) / (a + b + 1)
                    if d == depth:
                        p = one
                    else:
                        share = math.exp(math.log(0.5) + kt(a, b) - weighted(node)) if node in counts else 0.5
                        p = share * one + (1 - share) * p
                total += math.log10(p if (s[i] >> (7 - k)) & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_context_tree(spark, nothing, monkeypatch, hot):
    monkeypatch.setattr(context_tree, "HOT_GRAMS", hot)
    monkeypatch.setattr(context_tree, "HOT_WORDS", hot)
    rows = [(i, t) for i, t in enumerate([*(sentence(int(RNG.integers(1, 12)), i, 12) for i in range(30)), None, "", "É ü", "Zzz unseen", "the the"])] + [(None, "w1 w2"), (3, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    want = {}
    for (i, t), s in zip(rows, brute_ctw(train, [t for _, t in rows], context_tree.DEPTH), strict=True):
        want[i, t] = s
    c = Counter(w for t in train for w in [*context_tree.tokens((t or "").encode()), b""])
    n, v = sum(c.values()), len(c)
    base = lambda t: [*context_tree.tokens((t or "").encode()), b""]
    got = context_tree.score(docs).collect()
    assert len(got) == len(rows)
    exp = shuffled((i, held(i), len(base(t)), sum(c[w] > 0 for w in base(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in base(t)), 6), round(want[i, t], 6)) for i, t in rows)
    act = shuffled((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    for x, y in zip(act, exp, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=2e-6) and x[6] == pytest.approx(y[6], abs=1e-4)
    assert context_tree.score(nothing).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1234.5, 1e9])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


# --- WARC


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", "t1", None, None, {"Date": "d1", "X": "1"}, "one"),
        (2, "https://a.com/x?a=1&b=2", 20, "response", "t2", "m2", None, {"Date": "d2", "ETag": "t2"}, "two"),
        (3, "https://a.com/x?a=1&b=2", 15, "revisit", 'W/t1', None, None, {"date": "d3", "X": "9"}, None),
        (4, "https://a.com/x?a=1&b=2", 30, "revisit", "t9", "m2", None, {}, None),
        (5, "https://a.com/x?a=1&b=2", 30, "revisit", None, "m2", None, None, None),
        (6, "https://a.com/x?a=1&b=2", 10, "revisit", "t1", None, None, {}, None),
        (7, "https://a.com/x?a=1&b=2", 40, "revisit", None, None, "sha", {}, None),
        (8, None, 40, "revisit", "t1", None, None, {}, None), (9, "http://a.com/x?a=1&b=2", None, "revisit", "t1", None, None, {}, None),
        (10, "https://a.com/x?a=1&b=2", 20, "response", "t3", None, None, {}, "three"), (5, "https://a.com/x?a=1&b=2", 30, "revisit", None, "m2", None, None, None),
        (11, "urn:z", 1, "response", None, None, "h", None, "z"), (12, "urn:z", 2, "revisit", None, None, "h", {"Vary": "v"}, None),
    ]
    records = spark.createDataFrame(rows, warc.SCHEMA)
    for per_slice in (1 << 20, 2):
        found = warc.resolve_revisits(records, per_slice)
        got = shuffled((r.record_id, r.outcome, r.response_id) for r in found.collect())
        assert got == shuffled([(3, "resolved", 1), (4, "changed", 10), (5, "unvalidated", 10), (5, "unvalidated", 10), (6, "missing", None), (7, "unvalidated", 10), (8, "missing", None), (9, "missing", None), (12, "resolved", 11)])
        whole = warc.with_content(found, records).collect()
        assert shuffled(whole) == shuffled(warc.with_content(found, records.repartition(3), heavy_rows=0, copies=3).collect()) and len(whole) == 9
        by = {r.record_id: r for r in whole}
        assert by[3].headers == {"X": "1", "date": "d3"} and by[3].body == "one" and by[12].headers == {"Vary": "v"} and by[4].body is None
    assert warc.resolve_revisits(records.where("false")).count() == 0


def test_revisits_equal_brute_force_in_slices(spark):
    rows = [(i, f"http://h/{RNG.integers(0, 3)}", int(RNG.integers(0, 200)), "response" if RNG.random() < 0.4 else "revisit", "e", None, None, None, None) for i in range(400)]
    got = {r.record_id: r.response_id for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.SCHEMA), 20).collect()}
    for i, url, at, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == url and x[2] < at]
            assert got[i] == (max(earlier)[1] if earlier else None)


def test_revisits_without_url_or_time_and_clashing_columns(spark):
    """Rows that meet nothing stay out of the windows; other columns of any name don't matter."""
    rows = [(i, None if i % 2 else "http://h/x", None if i % 4 == 2 else i, "revisit" if i % 3 else "response", "e", None, None, {}, None) for i in range(600)]
    rows += [(None, None, None, None, None, None, None, None, None), (1, None, None, "revisit", None, None, None, None, None), (7, "http://h/x", 7, "other", None, None, None, None, None)]
    records = spark.createDataFrame(rows, warc.SCHEMA)
    for name in ("slice", "fields", "response", "inside", "last", "r", "key", "of", "carried", "outcome", "url_key"):
        records = records.withColumn(name, F.lit("own"))
    for per_slice in (1 << 20, 7):
        got = shuffled((r.record_id, r.outcome, r.response_id) for r in warc.resolve_revisits(records, per_slice).collect())
        known = [x for x in rows if x[3] == "response" and x[1] and x[2] is not None]
        want = []
        for i, url, at, kind, *_ in rows:
            if kind == "revisit":
                earlier = [(x[2], x[0]) for x in known if url and at is not None and x[2] < at]
                want.append((i, "resolved" if earlier else "missing", max(earlier)[1] if earlier else None))
        assert got == shuffled(want)
    assert warc.with_content(warc.resolve_revisits(records), records).where("body is not null").count() == 0


def test_windows_of_one_hash_are_told_apart():
    """With a first hash that is the same for all words, the second one names the windows."""
    windows, full = substring_dedup.Windows(8), [np.full(substring_dedup.LEVEL_BITS // 8, 255, np.uint8)] * 2
    windows.table = type("Same", (), {"array": staticmethod(lambda words: np.full(len(words), 5, np.uint64))})()
    text = [f"w{i}" for i in range(30)]
    (named, starts, check), (_, _, again) = (windows.of(" ".join(x).encode(), full) for x in (text, text[:20]))
    assert len(set(named.tolist())) == 1 and len(set(check.tolist())) == len(starts) > 0
    assert set(again.tolist()) <= set(check.tolist())
