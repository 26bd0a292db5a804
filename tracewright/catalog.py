"""The label vocabulary, and catalogs of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Label ids, names and colours (red, green, blue).
LABELS = (
    (1, "fault", 255, 0, 0),
    (2, "channel", 0, 0, 255),
    (3, "seismic facies", 0, 200, 0),
    (4, "salt body", 255, 220, 0),
    (5, "horizon", 0, 255, 255),
)
DEFAULT_COLOUR = (255, 255, 255)


def label_catalog(spark: SparkSession, prompts: Sequence[str] | None = None) -> DataFrame:
    """``label_id, label, r, g, b``; ``prompts`` keeps some labels, and none or an empty
    list keeps all.  An unknown prompt is an error, before any job starts."""
    if unknown := set(prompts or ()) - {x[1] for x in LABELS}:
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    rows = [x for x in LABELS if not prompts or x[1] in prompts]
    return spark.createDataFrame(rows, schemas.LABELS)


def file_catalog(spark: SparkSession, patterns: Sequence[str], suffix: str | None = None) -> DataFrame:
    """``path, length, status`` of the files that the patterns match, each once, by path.

    Patterns are expanded by Hadoop's file systems, so any store that Spark reads will
    do.  A pattern that matches nothing stays as a row with status ``missing``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, tuple[int | None, str]] = {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        matched = path.getFileSystem(conf).globStatus(path)
        for status in matched or []:
            found[status.getPath().toString()] = (status.getLen(), "found")
        if not matched:
            found[pattern] = (None, "missing")
    rows = [(p, *x) for p, x in found.items() if suffix is None or x[1] == "missing" or p.lower().endswith(suffix)]
    return spark.createDataFrame(rows, "path string, length long, status string").orderBy("path")


def list_sections(spark: SparkSession, folder: str, suffix: str = ".sgy") -> DataFrame:
    """The files of one folder with a suffix, by path; no rows if there is no such folder."""
    return file_catalog(spark, [f"{folder.rstrip('/')}/*{suffix}"]).where("status = 'found'").orderBy("path")


def mask_keys(labels: DataFrame) -> DataFrame:
    """Labels with the names that their masks have in an archive."""
    return labels.withColumn("key", F.replace("label", F.lit(" "), F.lit("_")))


def artifact_names(files: DataFrame, path_col: str = "path") -> DataFrame:
    """File names of a section's artifacts: its stem and a fixed ending.

    A stem keeps its inner dots.  ``section_id`` is the whole path, so that equal
    stems in two folders stay apart; ``unique_stem`` is for one output folder."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return files.withColumn("section_id", F.col(path_col)).withColumn("stem", stem).withColumns(
        {
            "overlay_name": F.concat("stem", F.lit("_overlay.png")),
            "archive_name": F.concat("stem", F.lit("_masks.npz")),
            "volume_name": F.concat("stem", F.lit("_masks.vti")),
            "unique_stem": F.concat("stem", F.lit("-"), F.substring(F.md5(path_col), 1, 8)),
        }
    )
