"""Mixing sources to target weights.

Each document gets a key that is random in its id and text.  A source's keys are cut into
ranges of about equal length and sorted inside each range; the word counts of
the ranges give every range its offset within the source, and a running sum
inside the range gives every document its own.  The mix takes whole epochs of a
source and then documents in key order up to the word at which its budget is
spent.  No task sees more than one range of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, boxed, cut, row_hash


SALTS = 64


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size, ...)`` with ``target``.

    Targets are in proportion to the weights; one that exceeds ``cap`` times its
    source's size stops there and the rest is shared again.  That process ends at
    one common level per unit of weight, found here in closed form: sources in
    order of the level at which they fill up, and the highest level that the
    words left over give to the weights left over."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    full = (F.col("source_size") * cap).cast("double")
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("full").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * share - spent) / (F.sum("weight").over(everything) - used)
    return (
        sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("full", full)
        .withColumn("fills_at", F.col("full") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("full"), F.max("level").over(everything) * F.col("weight")))
        .drop("rank", "weight", "full", "fills_at", "level")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    rows_per_range: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_rows: bool = False,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``; with
    ``whole_rows`` also ``row``, a struct of all its columns.

    ``taken`` counts the words that the mix takes of a document, repeats
    included; over a source they add up to the whole words of its target.  The
    document at which a budget ends is taken in part.  Null text has no words, a
    null source is a source of its own and comes last, a source without words
    has target 0.  Null and repeated ids are told apart by their texts.  Rows that
    repeat both are interchangeable; whole rows of that kind are taken in order of a
    hash of all columns.  Runs over the same rows agree, whatever the partitioning."""
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    columns = {"doc_id": F.col(id_col), "source": F.col(source_col).cast("string"), "size": n_words(F.col(text_col)), "key": key}
    rows = cut(docs.select(*[c.alias(name) for name, c in columns.items()]))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = cut(
        source_targets(sizes, weights, share, cap)
        .withColumn("ranges", F.ceil(F.col("n_docs") / rows_per_range))
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    point = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    of = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # never null, so that one shuffle serves windows and joins
    # a source may hold most rows: its target stands in several places, among which its rows are dealt
    targets = targets.withColumn("of", of).drop("source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")

    def ranged(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("of", of).withColumn("salt", salt).join(targets, ["of", "salt"]).drop("salt")
        return placed.withColumn("range", F.floor(point * F.col("ranges") / F.lit(2.0**32)))

    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged(rows).groupBy("of", "range").agg(F.sum("size").alias("words"))
    offsets = offsets.select("of", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    if whole_rows:
        rows = boxed(docs, **columns).withColumn("tie", row_hash(docs))
    within = Window.partitionBy("of", "range").orderBy("key", *["tie"] * whole_rows).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.col("earlier")
    return (
        ranged(rows).withColumn("earlier", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["of", "range"])
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))).cast("long").alias("taken"),
            *["row"] * whole_rows,
        )
    )
