"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  The distinct blocks
are sorted and numbered, so a block's number is its name; then the names of
adjacent blocks form pairs, the distinct pairs are sorted and numbered in turn,
and so on until one name is left for each document.  Names are assigned to
distinct contents and never computed from them, so two texts have one name
exactly if they are equal.  (Rows are told apart by id, length and a 64-bit hash of
the text: only two texts of one id and length could be confused, by a collision.)

Block texts cross the network once, to find the distinct ones.  They are looked
up again by a 64-bit bucket; buckets that hold several blocks keep those blocks
in sorted order and tell them apart by their content, so a collision costs time
and never a wrong name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, row_hash

MOST_HEAVY = 1024
MOST_COPIES = 1 << 12
KEY = ["doc_id", "n_bytes", "text_hash"]


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows with ``name``, their number in sorted order.

    The order is total, so a lost partition is numbered alike when it is rebuilt."""
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("name", F.monotonically_increasing_id()))


def block_identities(
    docs: DataFrame,
    block_bytes: int = 8192,
    bucket: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per distinct (doc_id, text) of ``docs(doc_id, body, n_bytes, text_hash)``
    with ``level`` and ``name``: equal exactly for equal bodies."""
    last = F.greatest(F.ceil(F.col("n_bytes") / block_bytes).cast("int"), F.lit(1)) - 1
    blocks = docs.select(
        *KEY, F.posexplode(F.expr(f"transform(sequence(0, {_sql_last(block_bytes)}), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))")).alias("pos", "block")
    ).withColumn("bucket", bucket(F.col("block")))
    found = blocks.groupBy("bucket").agg(F.array_sort(F.collect_set("block")).alias("held"))
    names = _numbered(
        found.select("bucket", F.size("held").alias("n_held"), F.posexplode("held").alias("rank", "block"))
        .withColumn("block", F.when(F.col("n_held") > 1, F.col("block"))),
        "bucket", "rank",
    )
    sole = names.where("n_held = 1").select("bucket", "name")
    rows = blocks.drop("block").join(sole, "bucket").select(*KEY, "pos", "name")
    shared = names.where("n_held > 1").select("bucket", "block", "name")
    if not shared.isEmpty():  # blocks that differ within one bucket are told apart by their bytes
        rows = rows.unionByName(blocks.join(shared, ["bucket", "block"]).select(*KEY, "pos", "name"))
    rows = cut(rows.distinct())  # a row that the input repeats counts once here
    most = docs.agg(F.max(last + 1)).first()[0] or 0

    done = rows.where(F.col("n_bytes") <= block_bytes).select(*KEY, F.lit(0).alias("level"), "name")
    rows, level, width = rows.where(F.col("n_bytes") > block_bytes), 0, most
    while width > 1:
        level, width = level + 1, (width + 1) // 2
        odd = F.col("pos") % 2 == 1
        pairs = rows.groupBy(*KEY, F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),
        )
        named = _numbered(pairs.select("left", "right").distinct(), "left", "right")
        rows = cut(pairs.join(named, ["left", "right"]).select(*KEY, "pos", "name"))
        full = F.lit(block_bytes) * (1 << level)
        done = done.unionByName(rows.where(F.col("n_bytes") <= full).select(*KEY, F.lit(level).alias("level"), "name"))
        rows = rows.where(F.col("n_bytes") > full)
    return done


def _sql_last(block_bytes: int) -> str:
    return f"greatest(cast(ceil(n_bytes / {block_bytes}) as int), 1) - 1"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    One row per input row.  Null texts count as empty, so they form one group
    with the empty ones.  Of a group the row with the largest id stays; null ids
    are smallest.  Of repeated rows (same id and text) one has ``kept`` true.
    An empty input gives an empty result.  Other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.col("text").cast("binary").alias("body"), F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("text_hash"), F.sha2("text", 256).alias("text_sha256"),
    )
    names = block_identities(body.drop("text_sha256"), **options)
    rows = body.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("text_sha256").alias("text_sha256"))
    same = F.lit(True)
    for c in KEY:
        same = same & rows[c].eqNullSafe(names[c])
    named = cut(rows.join(names, same).select(rows["doc_id"], "copies", "text_sha256", "level", "name"))
    groups = named.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members")
    )
    # at most MOST_HEAVY groups hold more than that part of all rows; they are sent to their members
    heavy = groups.where(F.col("members") > max(1000, named.count() // MOST_HEAVY)).select("level", "name", F.col("keep_id").alias("id"), F.col("group_size").alias("size"))
    marked = named.join(F.broadcast(heavy), ["level", "name"], "left")
    rest = marked.where("size is null").drop("id", "size").join(groups.drop("members"), ["level", "name"])
    met = marked.where("size is not null").withColumnsRenamed({"id": "keep_id", "size": "group_size"})
    # rows that were repeated, however often, are made again some at a time
    some = F.lit(MOST_COPIES)
    return (
        rest.unionByName(met)
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {MOST_COPIES}"))))
        .withColumn("copy", F.explode(F.sequence(F.col("run") * some + 1, F.least(F.col("copies"), (F.col("run") + 1) * some))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id.

    Null ids are smallest, null texts count as empty.  Of rows that repeat id and text the
    one with the least hash of all columns stays.  All columns stay, of whatever name."""
    kept = exact_groups(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text"))
    marked = boxed(docs, id=F.col(id_col), sha=F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    once = marked.join(kept, marked["id"].eqNullSafe(kept["kept_id"]) & (marked["sha"] == kept["kept_text"]), "left_semi")
    if not docs.groupBy(id_col).agg(F.count("*").alias("n_rows")).where("n_rows > 1").isEmpty():  # rows that repeat id and text
        once = once.groupBy("id", "sha").agg(F.min_by("row", row_hash(docs)).alias("row"))
    return once.select("row.*")
