"""The SQL states the queries' rules for tables of any size."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tracewright import queries


def test_edge_pad_of_long_and_wide_sections(spark, tmp_path):
    """the SQL stopped at 4096 traces and 96 samples, the query doesn't."""
    vectors = spark.range(4150).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.when(F.col("id") < 4120, 2).otherwise(99)), lambda j: ((F.col("id") * 7 + j) % 50).cast("float")).alias("embedding"), F.when(F.col("id") < 4120, 0).otherwise(1).alias("label"))
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.edge_pad(spark, str(tmp_path)).groupBy("section_id").agg(F.count("*"), F.max("trace_idx"), F.max("sample_idx"), F.sum(F.col("gray") * (F.col("trace_idx") % 11 + F.col("sample_idx") % 13))).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(f"SELECT section_id, count(*), max(trace_idx), max(sample_idx), CAST(sum(gray * (trace_idx % 11 + sample_idx % 13)) AS BIGINT) FROM ({queries.ORACLE_SQL['edge_pad']}) GROUP BY 1").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r[2:4] for r in want} == {(4119, 95), (95, 99)}
