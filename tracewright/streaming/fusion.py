"""Max-fusion of tile scores that arrive over time.

The maximum doesn't depend on the order of its inputs and repeats don't change it, so
late and repeated strips need no watermark for right results, and what is fused can be
kept as one Parquet table per batch, of strips: no pixel comes to the driver, stays in a
state or is shuffled.  From time to time the batches are merged into one table, so that reading doesn't cost
more with every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.stitch import fuse_strips, stitch_strips


def placed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the Parquet strips that are put into a folder."""
    return spark.readStream.schema(schemas.STRIPS).parquet(folder)


MERGE_EVERY = 8


def keep_fused(stream: DataFrame, checkpoint: str, folder: str, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Run until all that is there is fused, batch by batch, into a shared folder.

    The stream is of strips, or of placed pixels (``schemas.PIXELS``), each a strip by itself.
    A batch that is run again replaces what it wrote.  Every ``merge_every`` batches all of
    them are merged."""
    spark = stream.sparkSession
    spark.createDataFrame([], schemas.STRIPS).write.mode("ignore").parquet(f"{folder}/batch=-1")

    def write(scores: DataFrame, batch: int) -> None:
        fuse_strips(scores if "probs" in scores.columns else _pixel_strips(scores)).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if len(_tables(spark, folder)) > merge_every:
            merge_fused(spark, folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _pixel_strips(pixels: DataFrame) -> DataFrame:
    return pixels.select("section_id", "label_id", F.col("trace_idx").alias("tile_y"), F.col("sample_idx").alias("tile_x"), F.lit(0).alias("row_off"), F.array("prob").alias("probs"))


def _kept(spark: SparkSession, tables: list[str]) -> DataFrame:
    """The strips of tables; those that an earlier version wrote hold pixels."""
    rows = spark.read.schema(f"{schemas.STRIPS}, trace_idx int, sample_idx int, prob float").parquet(*tables)
    y, x = F.coalesce("tile_y", "trace_idx"), F.coalesce("tile_x", "sample_idx")
    return rows.select("section_id", "label_id", y.alias("tile_y"), x.alias("tile_x"), F.coalesce("row_off", F.lit(0)).alias("row_off"), F.coalesce("probs", F.array("prob")).alias("probs"))


def _tables(spark: SparkSession, folder: str) -> list[str]:
    """The tables that count: the last merged one, and the batches after it."""
    path, fs = _store(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    merged = max((int(n[7:]) for n in names if n.startswith("merged=")), default=-2)
    batches = [n for n in names if n.startswith("batch=") and int(n[6:]) > merged]
    return [f"{folder}/{n}" for n in [*([f"merged={merged}"] if merged > -2 else []), *sorted(batches, key=lambda n: int(n[6:]))]]


def _store(spark: SparkSession, folder: str):  # noqa: ANN202  Hadoop's path and file system
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def merge_fused(spark: SparkSession, folder: str) -> None:
    """Fuse all tables into one.  It counts from the moment it has its name, and what it replaces
    is deleted after that; a merge that is stopped leaves everything as it was.

    Batches are merged by the query that writes them, so none comes in between.  Readers
    that began before a merge should be run again if their files are gone."""
    tables = _tables(spark, folder)
    last = int(tables[-1].rsplit("=", 1)[1])
    if len(tables) < 2:
        return
    jvm, (_, fs) = spark.sparkContext._jvm, _store(spark, folder)
    fuse_strips(_kept(spark, tables)).write.mode("overwrite").parquet(f"{folder}/_merging")
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/merged={last}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{folder}/_merging"), target):
        raise OSError(f"{target} could not be named")
    for table in tables:
        fs.delete(jvm.org.apache.hadoop.fs.Path(table), True)


def fused_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The fused pixels of all batches that ``keep_fused`` put into a folder."""
    return stitch_strips(_kept(spark, _tables(spark, folder)))
