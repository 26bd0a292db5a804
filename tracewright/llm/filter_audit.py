"""How document filters act together: every order of the filters, every step, at once.

Which filters a document fails, and its labels, are a mask of bits.  A mask decides what
happens to the document at each step of each order, so it stands for one wide integer whose
fields hold all these outcomes; the integers of a part's documents are added up, and the
fields of the sum are the counts.  A field has 64 bits, so no count of documents can run
over into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD_BYTES = 8
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in (*OUTCOMES, "shapley"))


@dataclass(frozen=True)
class Audit:
    """Orders of some filters, and the integer of each mask.

    Bit i of a mask is set where filter i fails the document; two bits more say whether it
    is good and whether it is toxic."""

    letters: str

    @property
    def orders(self) -> list[tuple[int, ...]]:
        return list(permutations(range(len(self.letters))))

    @property
    def n_fields(self) -> int:
        return len(self.orders) * len(self.letters) * len(OUTCOMES)

    def outcomes(self, mask: int) -> np.ndarray:
        """0 or 1 for each order, step and outcome."""
        n = len(self.letters)
        fails, good, toxic = mask & ((1 << n) - 1), mask >> n & 1, mask >> (n + 1) & 1
        out = np.zeros((len(self.orders), n, len(OUTCOMES)), np.uint64)
        for o, order in enumerate(self.orders):
            gone = False
            for step, i in enumerate(order):
                fail = bool(fails >> i & 1)
                first = fail and not gone
                out[o, step] = (not (gone or fail), first, fail and gone, fails == 1 << i, first and good, first and toxic)
                gone = gone or fail
        return out

    def integer(self, mask: int) -> int:
        return int.from_bytes(self.outcomes(mask).astype("<u8").tobytes(), "little")

    def unpacked(self, total: int) -> np.ndarray:
        """Counts by order, step and outcome."""
        flat = np.frombuffer(total.to_bytes(self.n_fields * FIELD_BYTES, "little"), "<u8")
        return flat.reshape(len(self.orders), len(self.letters), len(OUTCOMES))

    def rows(self, part: str, total: int) -> pa.RecordBatch:
        """Every order and step of a part; shapley is the filter's removals over all orders."""
        counts = self.unpacked(total).astype(np.int64)
        orders, removed = np.array(self.orders), counts[:, :, OUTCOMES.index("removed")]
        shapley = np.array([removed[orders == i].sum() for i in range(len(self.letters))])
        n = orders.size
        names = np.repeat(["".join(self.letters[i] for i in order) for order in self.orders], len(self.letters))
        steps = np.tile(np.arange(1, len(self.letters) + 1, dtype=np.int32), len(self.orders))
        columns = [pa.array([part] * n), pa.array(names), pa.array(steps), *(pa.array(counts[:, :, k].ravel()) for k in range(len(OUTCOMES))), pa.array(shapley[orders.ravel()])]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUTCOMES, "shapley"])


@lru_cache(maxsize=512)
def _integer(audit: Audit, mask: int) -> int:
    return audit.integer(mask)


def audit_masks(masks: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` and counts from ``masks(part, mask, n)``: n documents each.

    Each task adds up the integers of its rows by part and passes on one for each part it
    met; these meet by part and are added one after the other, so that a task holds one
    sum.  What is shuffled is a wide integer for each task and part."""
    audit = Audit(letters)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            packed = [x.to_bytes(audit.n_fields * FIELD_BYTES, "little") for x in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(packed, pa.binary())], names=["part", "total"])

        for batch in batches:
            met = pa.table(batch).group_by(["part", "mask"]).aggregate([("n", "sum")]).to_pydict()
            for part, mask, n in zip(met["part"], met["mask"], met["n_sum"], strict=True):
                sums[part] = sums.get(part, 0) + n * _integer(audit, mask)
                if len(sums) >= 1024:  # more parts than are held at a time
                    yield out()
                    sums = {}
        if sums:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = total = None
        for batch in batches:
            for name, packed in zip(batch.column("part"), batch.column("total"), strict=True):
                name, value = name.as_py(), int.from_bytes(packed.as_py(), "little")
                if total is not None and name != part:
                    yield audit.rows(part, total)
                    total = None
                part, total = name, value + (total or 0)
        if total is not None:
            yield audit.rows(part, total)

    sums = masks.select("part", "mask", "n").mapInArrow(partial, "part string, total binary")
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(added, AUDIT)


def text_filters(text: Column) -> Mapping[str, Column]:
    """Whether a text fails: A, under 200 words; B, less than half its words distinct; C, over
    three in a hundred characters A to Z; D, one of ``#$%&*|`` in it."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n``: documents by language, failed filters (A to E) and labels.

    E fails a document whose text a document with a smaller id has.  Texts are told apart
    by their SHA-256 and length, and never shuffled; copies are counted before they meet,
    by language and labels, with the least id and how many rows have it, so a group of any
    size is a few rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    fails = text_filters(F.col("text"))
    bits = lambda columns: sum((c.cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
    seen = named.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("name"), F.octet_length("text").alias("size"), bits(fails.values()).alias("fails"))
    # rows without an id meet no label, and are spread by their text
    key = F.coalesce(F.col("doc_id"), F.xxhash64("name"))
    one = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = seen.withColumn("key", key).join(one, (F.col("key") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    marked = marked.withColumn("marks", F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0)))
    same = ["name", "size", "fails", "part", "marks"]
    rows = marked.groupBy("key", "doc_id", *same).agg(F.count("*").alias("n"))
    some = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min(some).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"))
    first = F.min("least.doc_id").over(Window.partitionBy("name", "size"))
    firsts = F.col("without") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = groups.withColumn("first", first).withColumn("firsts", firsts)
    mask = F.col("fails") + F.col("marks") * 32
    either = F.explode(F.array(F.struct(mask.alias("mask"), F.col("firsts").alias("n")), F.struct((mask + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    return groups.select("part", either.alias("x")).select("part", "x.mask", "x.n").where("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for all orders of the five filters, by language.

    A null text counts as empty, a null language as the empty string.  Rows without an id
    are no copies of others, nor others of them, and have no labels; of rows with one id
    and one text none comes before the other.  A label counts if any row of the document's
    id has it.  Other columns make no difference; an empty table has no parts."""
    return audit_masks(filter_masks(docs, labels), "ABCDE")
