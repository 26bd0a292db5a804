"""Very many repeated rows, and columns of types that Spark can't hash."""

from __future__ import annotations

import pytest
from test_operators import brute_components, sentence, shuffled

import corpus_pipeline
from tracewright.llm import jaccard_join


def test_near_duplicates_of_repeats(spark, monkeypatch):
    """Hundreds of rows without an id or of one id, around a centre in several places."""
    monkeypatch.setattr(jaccard_join, "MOST_PAIRS", 4)
    base = sentence(120, 41).split()
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(30)]
    rows = [(None, near[i % 3]) for i in range(500)] + [(7, near[3 + i % 2]) for i in range(500)] + list(enumerate(near, 10)) + [(900, sentence(60, 42)), (None, sentence(60, 42))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(sorted(set(rows), key=repr), 4, 85)
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, 4, 85).collect()]
    assert len(got) == len(rows) and shuffled(set(got)) == shuffled(set(want))
    assert sorted((r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(docs, 4, 85).collect()) == [(7, min(near[3:5], key=lambda t: _key(spark, t))), (900, sentence(60, 42))]


def _key(spark, text):
    return spark.sql("select xxhash64(:t) as k", args={"t": text}).first().k


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: 5])
def test_stages_with_maps(spark, tmp_path, ids):
    """A map, maps inside others, and a variant, with unique, null and repeated ids."""
    rows = [(ids(i), sentence(30, 50 + i % 40), "en", f"s{i % 3}", {"k": i % 40}, [{1: "a"}], ({"x": 1.5},), f'{{"n": {i}}}') for i in range(200)]
    schema = "doc_id long, text string, lang string, source string, tags map<string,int>, held array<map<int,string>>, deep struct<m: map<string,double>>, raw string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "parse_json(raw) as any").repartition(3)
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert set(docs.columns) <= set(out.columns) and {r.text for r in got} <= {r[1] for r in rows}
        assert len(got) == {"exact_dedup": 40, "near_dedup": 40, "decontamination": 200}.get(name, len(got)) and all(r.tags for r in got)


def test_exact_groups_of_many_repeats(spark):
    from tracewright.llm import block_naming

    docs = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, '', cast(null as string)) as text").unionAll(spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string"))
    got = block_naming.exact_groups(docs).groupBy("keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(2, 2, False, 1), (2, 2, True, 1), (None, 10_000, False, 9_999), (None, 10_000, True, 1)]


def test_one_index_at_a_time(spark, monkeypatch):
    """A benchmark of many blocks: each index is dropped before the next one is made, long
    items are split, and repeated rows come out as often as they went in."""
    import gc
    import weakref

    from test_operators import brute_hits

    from tracewright.llm import decontaminate

    alive, most = weakref.WeakSet(), 0
    make = decontaminate.WindowIndex.__init__

    def counted(index, items, n):
        nonlocal most
        gc.collect()
        alive.add(index)
        most = max(most, len(alive))
        make(index, items, n)

    monkeypatch.setattr(decontaminate.WindowIndex, "__init__", counted)
    items = [(i, sentence(200, 70 + i, 5000)) for i in range(6)] + [(9, "two words"), (10, None), (11, "")]
    rows = [(i, sentence(30, 90 + i, 5000) + " " + " ".join(items[i % 6][1].split()[i : i + 8 + i % 5])) for i in range(40)] + [(None, items[2][1])] * 300 + [(50, "has two words in it")] * 3
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.hits, r["items"]) for r in decontaminate.benchmark_hits(docs, bench, 10, max_bytes=500).collect()]
    want = brute_hits(sorted(set(rows), key=repr), items, 10)
    assert most == 1 and len(got) == len(rows)
    assert {(r[0], r[1], len(r[2]), tuple(r[3])) for r in got} == {(w[0], w[1], len(w[2]), tuple(sorted(map(str, w[3])))) for w in want}
    clean = decontaminate.drop_contaminated(docs, bench, 10, max_bytes=500)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[2])
