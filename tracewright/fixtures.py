"""The driver's tables as sections: arrays of the right shape, not seismic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section: a trace per vector."""
    return read(spark, sf_dir, "embeddings").select(
        F.lit("line").alias("section_id"), F.col("vec_id").cast("int").alias("trace_idx"), F.col("embedding").cast("array<float>").alias("samples")
    )


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section larger than the usual windows: three traces for each vector, 1280 samples wide."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.get("embedding", j).cast("float"))
    raised = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.transform("vector", lambda v: v + k.cast("float"))))
    rows = read(spark, sf_dir, "embeddings").withColumn("vector", vector).withColumn("samples", F.flatten(F.array_repeat(raised, 4)))
    rows = rows.select("vec_id", "samples", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))  # a vector's samples are worked out once
    return rows.select(F.lit("large").alias("section_id"), (3 * F.col("vec_id") + F.col("r")).cast("int").alias("trace_idx"), "samples")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section per vector label, its traces in order of the vectors."""
    inside = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("volume#"), F.col("label").cast("string")).alias("section_id"), F.col("label").cast("int").alias("inline_no"),
        F.col("vec_id").cast("int").alias("xline_no"), (F.row_number().over(inside) - 1).cast("int").alias("trace_idx"), F.col("embedding").cast("array<float>").alias("samples"),
    )


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long samples of a few large sections."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section_id"), F.col("l_extendedprice").cast("float").alias("amplitude"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores; several of one pixel stand for overlapping tiles."""
    types = ("click", "error", "purchase", "signup", "view")
    label = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i + 1)) for i, t in enumerate(types)])
    hours = F.expr("cast(timestampdiff(HOUR, timestamp'2024-01-01 00:00:00', ts) as int)")
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 500)).cast("float")
    return read(spark, sf_dir, "events").select(
        F.lit("events").alias("section_id"), label.alias("label_id"), F.col("user_id").cast("int").alias("trace_idx"), hours.alias("sample_idx"), prob.alias("prob")
    )


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select((F.col("p_size") * 60 + F.col("p_partkey") % 7).cast("int").alias("dim"))
