"""The filter audit against running every order document by document."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from tracewright.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(230))


def fails_of(doc_id, text, every):
    words = WORDS.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in every),
    }


def brute(rows, labels):
    every = [(i, t or "") for i, t, _ in rows]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = Counter(), Counter()
    for i, text, lang in rows:
        fails = fails_of(i, text or "", every)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", "".join(order), step)
                first = fails[f] and not gone
                out[key, "kept"] += not gone and not fails[f]
                out[key, "removed"] += first
                out[key, "redundant"] += fails[f] and gone
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[key, "good_lost"] += first and i in good
                out[key, "toxic_lost"] += first and i in toxic
                shapley[lang or "", f] += first
                gone = gone or fails[f]
    return {(p, "".join(o), s): (*(out[(p, "".join(o), s), x] for x in filter_audit.OUTCOMES), shapley[p, o[s - 1]])
            for p in {x or "" for *_, x in rows} for o in permutations("ABCDE") for s in range(1, 6)}


ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (2, LONG, None), (3, LONG, "de"), (None, LONG, "en"), (4, "short", "en"), (5, "a b " * 300, "en"),
    (6, "SHOUT " * 250, "de"), (7, LONG + " #", ""), (8, None, None), (9, "", "fr"), (None, None, "fr"), (10, "\x85 　\x1f" * 220, "fr"), (11, "é" * 97 + "AAA", "fr"),
    (12, "é" * 96 + "AAAA", "fr"), (13, "words " * 100 + " ".join(f"x{i}" for i in range(99)), "en"), (14, LONG + "\t\n\x0b\x0c\r|", "en"),
    *((100 + i, LONG + " again", "en" if i % 3 else "de") for i in range(40)),
]
LABELS = [(1, 1, 0), (2, None, 1), (2, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (7, 1, 1), (101, 1, 0), (999, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, x, 1, "n", {"a": 1}) for i, t, x in ROWS], "doc_id long, text string, lang string, n int, part string, mask map<string,int>")
    return docs.repartition(5), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit(tables):
    got = filter_audit.audit(*tables).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(ROWS, LABELS)
    assert len(got) == 600 * len({x or "" for *_, x in ROWS})


def test_empty(tables):
    docs, labels = tables
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_counts_do_not_run_over(spark):
    """Counts of a field near its size, and more parts than a task holds."""
    much = (1 << 61) // 600
    rows = [("p", 1, much), ("p", 3, much), ("p", 64 + 32 + 31, much), *((f"q{i}", 0, i) for i in range(1500))]
    found = filter_audit.audit_masks(spark.createDataFrame(rows, "part string, mask int, n long").repartition(3), "ABCDE")
    one = {(r.filter_order, r.step): r for r in found.where("part = 'p'").collect()}
    assert one["ABCDE", 1].removed == 3 * much and one["BACDE", 1].removed == 2 * much and one["BACDE", 2].removed == much
    assert one["ABCDE", 1].good_lost == one["ABCDE", 1].toxic_lost == much and one["CABDE", 1].kept == 2 * much and one["ABCDE", 1].unique_fails == much
    assert {r.part: r.kept for r in found.where("part <> 'p' and step = 5 and filter_order = 'EDCBA'").collect()} == {f"q{i}": i for i in range(1500)}
