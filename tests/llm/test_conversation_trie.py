"""The conversation trie against rebuilding every conversation."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import conversation_trie

RNG = np.random.default_rng(9)
SCHEMA = "conv_id long, turn long, role string, text string, depth long, fp string, tags map<string,int>"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())} ".encode() + role.encode() + text.encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [*own.get(c - int(np.fmod(c, 20)), [])[:h], *turns[h:]]
    return out


def brute(rows):
    members = {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = set()
    for p, own in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in under)
        ends = ",".join(str(c) for c, n in sorted(own) if n == len(p))
        out.add((min(own)[0], len(p), min(members[p[:-1]])[0] if p else None, len(own), len(children), leaves, sum((len(members[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some():
    rows = []
    for c in range(70):
        for t in range(int(RNG.integers(0, 7))):
            rows.append((c * 3 % 101, t, "user" if t % 2 == 0 else "bot", f"say {RNG.integers(0, 3)} word"))
    rows += [(200, None, None, "first"), (200, 1, "user", None), (200, 1, "user", None), (201, 5, "user", "b"), (201, 5, "user", "a"), (None, 1, "user", "lost"), (200, None, "", "first")]
    rows += [(-5, 1, "user", "below"), (-25, 1, "user", "below"), (-20, 1, "bot", "x\t\ny  z"), (0, -1, "user", "negative turn"), (220, 1, "", ""), (221, 1, "", ""), (300, 0, "ab", "c"), (302, 0, "a", "bc")]
    rows += [(400, t, "user", f"long {t}") for t in range(300)] + [(401, t, "user", f"long {t}") for t in range(300)]
    return rows


def found(spark, rows, parts=5, **options):
    table = spark.createDataFrame([(*r, 7, "x", {"a": 1}) for r in rows], SCHEMA).repartition(parts)
    return conversation_trie.prefix_trie(table, **options)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie(spark):
    rows = some()
    got = found(spark, rows).collect()
    assert {tuple(r[c] for c in NAMES) for r in got} == brute(rows) and len(got) == len(brute(rows))
    whole = rebuilt(rows)
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((role or "", text or ""))
    for r in got:  # the stored place holds the node's last turn
        assert (r.turn_conv is None) == (r.depth == 0)
        assert not r.depth or whole[r.conv_id][r.depth - 1] in own[r.turn_conv]
    assert found(spark, rows, seed=4).select(*NAMES).exceptAll(found(spark, rows, parts=2).select(*NAMES)).count() == 0


def test_no_conversations(spark):
    assert found(spark, some()[:0] or [(None, 1, "user", "x")]).count() == 0


def test_one_hot_conversation_spreads(spark):
    """Copies of one conversation, and one with most of the rows, over many ranges."""
    rows = [(c, t, "user", f"t{t}") for c in range(500, 560) for t in range(4)] + [(600, t, "bot", f"{t % 5}") for t in range(2000)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in found(spark, rows).select(*NAMES).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    small = [r for r in rows if r[0] != 600]
    assert {r for r in got if r[0] != 600 and r[1]} == {r for r in brute(small) if r[1]}
    line = sorted(r for r in got if r[0] == 600)
    h = zlib.crc32(b"600") % 4
    assert [r[1] for r in line] == list(range(1, 2001)) and all(r[3:6] == (1, int(r[1] < 2000), 1) for r in line) and h <= 3
    assert next(r for r in got if r[1] == 0)[3] == 61


def test_collisions_are_found(spark, monkeypatch):
    """With a polynomial that ignores the order, unequal sequences meet, and another is taken."""
    real = conversation_trie.base_of
    monkeypatch.setattr(conversation_trie, "base_of", lambda seed: 1 if seed == 0 else real(seed))
    rows = [(41, 1, "u", "head"), (41, 2, "u", "a"), (41, 3, "u", "b"), (41, 4, "u", "c"), (41, 5, "u", "d"), (41, 6, "u", "e"), (43, 1, "u", "head"), (43, 2, "u", "a"), (43, 3, "u", "b"), (43, 4, "u", "c"), (43, 5, "u", "e"), (43, 6, "u", "d")]
    assert conversation_trie.verified_nodes(conversation_trie.rebuilt_prefixes(conversation_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))) is None
    assert {tuple(r) for r in found(spark, rows).select(*NAMES).collect()} == brute(rows)


@pytest.mark.parametrize("n", [1, 7])
def test_scan(spark, n):
    data = [(k, i, i * k) for k in range(5) for i in range(30 * (k == 2) + 3)]
    add = conversation_trie.Scan((0,), lambda s, v: (s[0] + v[0],), lambda a, b: (a[0] + b[0],), lambda s: s)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(data, "k int, i int, v long").repartition(n)
    got = conversation_trie.prefix_scan(rows, ["k"], [F.col("i")], ["v"], add, "total long").collect()
    assert {(r.k, r.i): r.total for r in got} == {(k, i): sum(x for a, b, x in data if a == k and b <= i) for k, i, _ in data}
