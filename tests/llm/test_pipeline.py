"""The pipeline's stages and run() against plain versions of them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from test_operators import brute_components, brute_hits, brute_mix

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(21)
    words = {"en": [f"the{i}" for i in range(300)], "de": [f"und{i}ü" for i in range(300)]}
    rows = [(i, " ".join(rng.choice(words[l], int(rng.integers(20, 60)))), l, f"s{i % 4}" if i % 9 else None) for i, l in enumerate(rng.choice(list(words), 120))]
    item = " ".join(rng.choice(words["en"], 14))
    for i in range(200, 230):
        kind, (_, t, l, s) = i % 3, rows[i - 200]
        w = t.split()
        w[5] = "edit"
        rows.append((i, t if kind == 0 else " ".join(w) if kind == 1 else f"{t} {item}", l, s))
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, "12 34 --", None, "s1")]
    full = [(i, t, l, s, len(t or "")) for i, t, l, s in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def test_run(spark, folder):
    at, rows, item = folder
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in kept:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    kept = [r for r in kept if last[r[1]] == r[0]]
    kept = [r for r, c in zip(kept, brute_components([(r[0], r[1]) for r in kept], 5, 80), strict=True) if c[2] == r[0]]
    kept = [r for r, h in zip(kept, brute_hits([(r[0], r[1]) for r in kept], [(1, item)], 10), strict=True) if not h[2]]
    got = corpus_pipeline.run(spark, at).collect()
    text = {r[0]: r[1] for r in kept}
    _, target = brute_mix([(r[0], r[1], r[3]) for r in kept])
    taken = Counter()
    for r in got:
        assert text[r.doc_id] == r.text and 0 < r.taken <= 2 * r.size and r.size == len(r.text.split())
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and 0 < out.count() < docs.count()
        assert stage(spark, docs.where("false"), folder[0]).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), folder[0]).count() == 0


def test_stages_with_odd_rows(spark, folder):
    """Null and repeated ids, equal rows, and columns named like the operators' own."""
    names = "size int, target double, taken long, _text string, _drop int, row int, id int, key long, keep_id long"
    text, other = "the1 the2 the3 the4 the5 the6 the7", "und1ü und2ü und3ü und4ü und5ü"
    rows = [(None, text), (None, text), (7, text), (7, other), (7, other), (8, None), (8, ""), (None, None)]
    full = [(i, t, None if i == 8 else "en", "s1" if n % 2 else None, 1, 9, 0.5, 3, "x", 4, 5, 6, 2, 1) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)
    kept = {"exact_dedup": [(7, other), (7, text)], "near_dedup": [(7, other), (7, text), (8, None), (8, ""), (None, None)]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert sorted(out.columns) == sorted(docs.columns)
        found = [(r.doc_id, r.text) for r in out.collect()]
        if name == "near_dedup":
            assert sorted(found, key=repr) == sorted(kept[name], key=repr)
        if name == "exact_dedup":
            assert sorted(x for x in found if x[1]) == sorted(kept[name]) and len(found) == 3
        if name == "mixing":
            assert sum(r.taken for r in out.collect()) == 24 + 22 and all(r["size"] == len((r.text or "").split()) for r in out.collect())
