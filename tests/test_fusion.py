"""Fusion over time, in the shared folder."""

from __future__ import annotations

from tracewright import fixtures, queries, schemas
from tracewright.streaming import fusion


def test_batches_are_fused_in_the_folder(spark, tmp_path):
    strips, out, checkpoint = (str(tmp_path / n) for n in ("strips", "out", "checkpoint"))
    for rows in ([("a", 1, 0, 0, 0, [0.5, -1.0]), ("a", 1, 0, 1, 0, [0.25])], [("a", 1, 0, 0, 0, [0.4, 0.75]), ("b", 2, 3, 0, 1, [float("nan")])], []):
        spark.createDataFrame(rows, schemas.STRIPS).write.mode("append").parquet(strips)
        fusion.keep_fused(fusion.placed_scores(spark, strips), checkpoint, out).awaitTermination()
    got = {tuple(r)[:4]: r.prob for r in fusion.fused_scores(spark, out).collect()}
    assert len(got) == 3 and got["a", 1, 0, 0] == 0.5 and got["a", 1, 0, 1] == 0.75 and got["b", 2, 4, 0] != got["b", 2, 4, 0]


def test_result_is_no_driver_table(spark, monkeypatch):
    line = spark.createDataFrame([(i, [float(i % 5)] * 8, 0) for i in range(20)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(fixtures, "read", lambda *_: line)
    found = queries.streaming_fusion(spark, "")
    plan = found._jdf.queryExecution().toString()
    assert "MemoryPlan" not in plan and "parquet" in plan.lower()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, queries.stitch_max(spark, "").collect()))


def test_batches_are_merged(spark, tmp_path):
    """Of many batches few tables are left, with the same pixels, and a merge can stop halfway."""
    strips, out, checkpoint = (str(tmp_path / n) for n in ("strips", "out", "checkpoint"))
    want = {}
    for n in range(9):
        rows = [("a", 1, n % 4, 0, 0, [n / 10, (8 - n) / 10])]
        for j, p in enumerate(rows[0][5]):
            want[n % 4, j] = max(want.get((n % 4, j), 0.0), p)
        spark.createDataFrame(rows, schemas.STRIPS).write.mode("append").parquet(strips)
        fusion.keep_fused(fusion.placed_scores(spark, strips), checkpoint, out, merge_every=3).awaitTermination()
        assert len(fusion._tables(spark, out)) <= 4
    (tmp_path / "out" / "_merging").mkdir()  # what a stopped merge leaves
    got = lambda: {(r.trace_idx, r.sample_idx): round(r.prob, 5) for r in fusion.fused_scores(spark, out).collect()}
    assert got() == want
    fusion.merge_fused(spark, out)
    assert got() == want and len(fusion._tables(spark, out)) == 1
    fusion.merge_fused(spark, out)
    assert got() == want


def test_strips_are_scored_once(spark, tmp_path, monkeypatch):
    """the two parts of the stream were each made from tiles scored anew."""
    from tracewright import queries

    spark.range(40).selectExpr("id as vec_id", "transform(sequence(0, 31), j -> cast((id * 5 + j) % 17 as float)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, strips = spark.sparkContext.accumulator(0), queries._strips

    def counted(session, folder):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        made = strips(session, folder)
        return made.mapInArrow(run, made.schema)

    monkeypatch.setattr(queries, "_strips", counted)
    assert queries.streaming_fusion(spark, str(tmp_path)).count() == 5 * 40 * 32
    assert seen.value == 5 * 2 * 32


def test_strips_are_kept_and_older_pixels_read(spark, tmp_path):
    """each batch and each merge dealt all pixels; folders that hold pixels are still read."""
    strips, out, checkpoint = (str(tmp_path / n) for n in ("strips", "out", "checkpoint"))
    spark.createDataFrame([("a", 1, 0, 0, 0, 0.75), ("a", 1, 0, 9, 0, 0.5)], schemas.STRIPS.replace("array<float>", "float")).selectExpr("section_id", "label_id", "tile_y as trace_idx", "tile_x as sample_idx", "probs as prob").write.parquet(f"{out}/batch=-1")
    spark.createDataFrame([("a", 1, 0, 0, 0, [0.5, -1.0, 0.25]), ("a", 1, 0, 3, 0, [0.25])], schemas.STRIPS).write.parquet(strips)
    fusion.keep_fused(fusion.placed_scores(spark, strips), checkpoint, out).awaitTermination()
    assert [tuple(r)[2:] for r in spark.read.parquet(f"{out}/batch=0").collect()] == [(0, 0, 0, [0.5, 0.0, 0.25, 0.25])]
    want = {0: 0.75, 1: 0.0, 2: 0.25, 3: 0.25, 9: 0.5}
    for _ in range(2):
        assert {r.sample_idx: r.prob for r in fusion.fused_scores(spark, out).collect()} == want
        fusion.merge_fused(spark, out)
    pixels = str(tmp_path / "pixels")
    spark.createDataFrame([("a", 1, 0, 1, 0.875), ("a", 1, 0, 1, 0.5)], schemas.PIXELS).write.parquet(pixels)
    fusion.keep_fused(spark.readStream.schema(schemas.PIXELS).parquet(pixels), str(tmp_path / "again"), str(tmp_path / "more")).awaitTermination()
    assert [tuple(r) for r in fusion.fused_scores(spark, str(tmp_path / "more")).collect()] == [("a", 1, 0, 1, 0.875)]
