"""Near-duplicate join on word n-grams with adaptive multi-match prefixes.

Every document is the set of its shingles in one global order, rare ones first.
Two sets of similarity t share at least l shingles within prefixes that are l-1
longer than the shortest that must share one.  Each document chooses its own l by
the estimated cost of its candidates: longer prefixes mean longer postings, but a
candidate must then share l of them before it is verified.  A pair is held to the
smaller l of the two.

Only components are asked for, so verification is spared where it can't change
them.  Equal sets are one class from the start.  Each class is compared with the most
central class that shares half of its least hashes; those of which half is alike
become a group around that centre, and are held from then on as what they differ by
from it.  Differences decide every pair of a group exactly: sets x and y that differ
from the centre by p and q tokens, c of them in common, differ by p + q - 2c.  Those
that link with the centre are one component; the others are joined with the rest of
the group by the same adaptive prefixes, taken over the differences, in which what
all copies share doesn't occur.  Pairs of different groups meet by the prefixes of
their whole sets and are verified one by one.

For the order, half of all shingles (by a bit of their hash) are counted in every
document, and those found twice are marked in a filter of bounded size.  A counted
shingle without a mark is in no other document; such shingles come first, and need
no posting.  Then come the others, by an estimate of how many documents hold them.
Over very many shingles the filter marks too many, which means more postings and
the same links.

Shingles and classes are named by 64 bits of hash (classes are told apart by 128
bits and their size), and sets are compared by 40 bits of their shingles; that is
the only approximation.  The frequency estimate only shapes the order and l; any
estimate gives the same links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, WordHashes, as_bytes, bloom, bloom_has, boxed, cut, list_column, long_array, mix64, row_hash, slot_of, staged
from .components import connected_components

SKETCH_SLOTS = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 29
MOST_MATCHES = 4
VERIFY_COST = 8.0
LEAST, SHARED_LEAST = 8, 4
CHUNK_WORDS = 1 << 16
MOST_PAIRS = 1 << 10  # of a class in one place
SALTS = 16


class Shingler:
    """Sorted distinct shingle hashes of texts, made for many texts at a time."""

    def __init__(self, width: int):
        self.width, self.table = width, WordHashes()

    def _hashes(self, h: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = mix64(total * np.uint64(3) + h[i : len(h) - n + 1 + i])
        return total

    def sets(self, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        """One array per text, in order; a text of fewer words is one shingle."""
        words: list[bytes] = []
        counts: list[int] = []
        for text in texts:
            found = text.translate(LOWER_TABLE).split()
            counts.append(len(found))
            words += found
            if len(words) >= CHUNK_WORDS:
                yield from self._sets(words, counts)
                words, counts = [], []
        yield from self._sets(words, counts)

    def _sets(self, words: list[bytes], counts: list[int]) -> Iterator[np.ndarray]:
        h = self.table.array(words)
        every = self._hashes(h, self.width) if len(h) >= self.width else h[:0]
        at = 0
        for n in counts:
            if n >= self.width:
                s = np.sort(every[at : at + n - self.width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield self._hashes(h[at : at + n], n) if n else h[:0]
            at += n


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set of that similarity."""
    return -(-percent * n // 100)


def chosen_length(others: np.ndarray, shortest: int, most: int) -> tuple[int, int]:
    """How long a prefix to take, and how many matches to ask for: 1 in the shortest, one
    more for each token more.  ``others`` counts the other holders of each token in order."""
    cost = np.cumsum(others[: shortest + most - 1], dtype=np.float64)[shortest - 1 :]
    matches = np.arange(1, len(cost) + 1)
    best = int(np.argmin(shortest + matches + cost + VERIFY_COST * cost / matches))
    return shortest + best, best + 1


def prefix(found: np.ndarray, marks: np.ndarray, heavy: np.ndarray, percent: int) -> tuple[int, np.ndarray, float]:
    """The chosen prefix, rarest first: how many shingles that no other document holds,
    and the other ones.  Then how widely the document's shingles are held, on average:
    of edited copies of one text, most widely those of the text itself."""
    n = len(found)
    if not n:
        return 0, found, 0.0
    alone = (found & np.uint64(1) == 0) & ~bloom_has(marks, _marked_slot(found, marks))
    others = heavy[(found >> np.uint64(44)).view(np.int64)] + 1
    others[alone] = 0
    spread = float(others.sum(dtype=np.float64)) / n
    order = np.argsort(others, kind="stable")
    shortest, most = n - _needed(n, percent) + 1, min(MOST_MATCHES, _needed(n, percent))
    chosen = order[: chosen_length(others[order[: shortest + most - 1]], shortest, most)[0]]
    skipped = min(int(alone.sum()), len(chosen))
    return skipped, found[chosen[skipped:]], spread


def _marked_slot(found: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(65 - (len(marks) * 8).bit_length())).view(np.int64)


def frequencies(docs: DataFrame, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter over counted shingles that are in several documents; and for each of
    a fixed number of hash slots, roughly how many shingles beyond the usual it holds.

    Counted shingles are dealt by their leading bits, in packed runs of 32 further
    bits.  For the slots every task counts all shingles of its documents and reports
    those that stand out from its own mean.  Documents with equal sets count once in
    a task."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n_docs * 256).bit_length()))
    lead = max(4, min(28, (n_docs // 4000).bit_length()))
    down, keep = np.uint64(64 - lead), np.uint64(32 - lead)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen, held, size = Shingler(width), np.zeros(SKETCH_SLOTS, np.int64), set(), [], 0

        def rows(buckets, parts, slots, n):
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(parts, pa.binary()), pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["bucket", "part", "slot", "n"])

        def packed():
            if not size:  # no document has a counted shingle
                return rows([], [], [], [])
            every, n = np.unique(np.concatenate(held), return_counts=True)
            every = np.sort(np.concatenate([every, every[n > 1]]))
            bucket = (every >> down).astype(np.int32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [x.tobytes() for x in np.split((every >> keep).astype(np.uint32), starts[1:])]
            return rows(bucket[starts], parts, [None] * len(parts), [None] * len(parts))

        for batch in batches:
            for found in shingler.sets(as_bytes(batch.column("text"))):
                name = _class_of(found)[0]
                if not len(found) or name in seen:
                    continue
                seen.add(name)
                np.add.at(counts, (found >> np.uint64(44)).view(np.int64), 1)
                held.append(found[found & np.uint64(1) == 0])
                size += len(held[-1])
                if size >= 1 << 20:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()
        mean = counts.mean()
        high = np.flatnonzero(counts > mean + 4 * mean**0.5 + 4)
        yield rows([-1] * len(high), [None] * len(high), high, counts[high] - int(mean))

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # of one bucket; they come in order

        def found(bucket: int) -> pa.RecordBatch:
            every = np.sort(np.frombuffer(b"".join(held), np.uint32))
            again = np.unique(every[1:][every[1:] == every[:-1]]).astype(np.uint64)
            slots = np.unique((np.uint64(bucket) << down | again << keep) >> np.uint64(65 - bits.bit_length()))
            return pa.RecordBatch.from_arrays([pa.array(long_array(slots))], names=["slot"])

        last = None
        for batch in batches:
            for bucket, part in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if bucket != last:
                    if held:
                        yield found(last)
                    held, last = [], bucket
                held.append(part)
        if held:
            yield found(last)

    out = staged(docs.select("text").mapInArrow(scan, "bucket int, part binary, slot long, n long"))
    dealt = out.where("bucket >= 0").select("bucket", "part").repartition("bucket").sortWithinPartitions("bucket")
    marks = bloom(dealt.mapInArrow(twice, "slot long"), "slot", bits)
    sums = out.where("bucket < 0").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    heavy = np.zeros(SKETCH_SLOTS, np.float32)
    heavy[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return marks, heavy


def _class_of(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def _prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, key, cls, cls2, n, least, spread, skipped, tokens`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, width, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (marks, heavy) = Shingler(width), shared.value
        for batch in batches:
            names, sizes, least, spread, skipped, tokens = [], [], [], [], [], []
            for s in shingler.sets(as_bytes(batch.column("text"))):
                names.append(_class_of(s))
                sizes.append(len(s))
                least.append(long_array(s[:LEAST]))
                chosen = prefix(s, marks, heavy, percent)
                skipped.append(chosen[0])
                spread.append(chosen[2])
                tokens.append(long_array(chosen[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()),
                    pa.array(sizes, pa.int64()), list_column(least, pa.int64()),
                    pa.array(spread, pa.float64()), pa.array(skipped, pa.int64()), list_column(tokens, pa.int64()),
                ],
                names=["doc_id", "key", "cls", "cls2", "n", "least", "spread", "skipped", "tokens"],
            )

    out = staged(docs.mapInArrow(run, "doc_id long, key long, cls long, cls2 long, n long, least array<long>, spread double, skipped long, tokens array<long>"))
    shared.destroy()
    return out


def _packed(found: np.ndarray) -> bytes:
    """The 40 low bits of each hash: all low words, then all high bytes."""
    return found.astype(np.uint32).tobytes() + (found >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _with_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` makes of the packed sets of the two classes of ``pairs(a, b)``.

    Sets are made again from the text of one document of a class; a filter of fixed
    size over those documents keeps most others from being split into words.  Rows that
    repeat it, and others of its class that pass, are one set before they meet a pair.  A
    class of very many pairs has its set in several places, among which they are dealt."""
    spark = docs.sparkSession
    pairs, used = cut(pairs), []
    documents = classes.select(F.col("cls").alias("of"), slot_of(F.xxhash64("first.doc_id", "first.key")).alias("slot"))

    def scan(bits) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(width)
            for batch in batches:
                batch = batch.filter(pa.array(bloom_has(bits.value, batch.column("slot").to_numpy())))
                found = {_class_of(s)[0]: _packed(s) for s in shingler.sets(as_bytes(batch.column("text")))}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["cls", "found"])

        return run

    met = pairs.select("a", "b")
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        ends = pairs.select(F.col(end).alias("of")).distinct().join(documents, "of")
        used.append(spark.sparkContext.broadcast(bloom(ends.select("slot").distinct(), "slot")))
        sets = docs.select("text", slot_of(F.xxhash64("doc_id", "key")).alias("slot")).mapInArrow(scan(used[-1]), "cls long, found binary")
        sets = sets.groupBy(F.col("cls").alias(end)).agg(F.any_value("found").alias(name))
        places = cut(pairs.groupBy(F.col(end).alias("of")).agg(F.ceil(F.count("*") / MOST_PAIRS).alias("places")).where("places > 1"))
        if not places.isEmpty():
            met = met.join(places, met[end] == places["of"], "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1)))).drop("of", "places")
            sets = sets.join(places, sets[end] == places["of"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("places", F.lit(1)) - 1))).drop("of", "places")
            met = met.join(sets, [end, "salt"]).drop("salt")
        else:
            met = met.join(sets, end)
    out = staged(met.select("a", "b", "x", "y").mapInArrow(judge, schema))
    for bits in used:
        bits.destroy()
    return out


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough, by their intersection."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.sort(np.concatenate([_unpacked(x), _unpacked(y)]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, docs, classes, width, similar, "a long, b long")


def _members(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``cls, n, center, nc, diff, s, sc`` of the classes that belong to a centre.

    ``diff`` holds the tokens that one of the two has and the other hasn't, at most a
    third of both.  With s = (100 + percent) * |diff| - (100 - percent) * n, two members
    x and y link exactly if 2 * (100 + percent) times the tokens that their differences
    share are at least s(x) + s(y); a centre's own s is ``sc``."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], ([], [], [])
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.sort(np.concatenate([_unpacked(x), _unpacked(y)]))
                same = np.flatnonzero(both[1:] == both[:-1])
                alone = np.delete(both, np.concatenate((same, same + 1)))
                keep.append(3 * len(alone) <= len(both))
                if keep[-1]:
                    for part, value in zip(rows, (len(x) // 5, len(y) // 5, long_array(alone)), strict=True):
                        part.append(value)
            ends = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            columns = [*ends.columns, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), list_column(rows[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "center", "n", "nc", "diff"])

    # every centre is more central than its members, so following them ends
    found = _with_sets(pairs, docs, classes, width, differ, "cls long, center long, n long, nc long, diff array<long>")
    while not found.join(found.select(F.col("cls").alias("center")), "center", "left_semi").isEmpty():
        up = found.select(F.col("cls").alias("center"), F.col("center").alias("next"), F.col("nc").alias("next_n"), F.col("diff").alias("more"))
        both = F.concat(F.array_except("diff", "more"), F.array_except("more", "diff"))
        found = staged(
            found.join(up, "center", "left").select(
                "cls", F.coalesce("next", "center").alias("center"), "n", F.coalesce("next_n", "nc").alias("nc"), F.when(F.col("next").isNull(), F.col("diff")).otherwise(both).alias("diff")
            )
        )
    s = (100 + percent) * F.size("diff") - (100 - percent) * F.col("n")
    return found.where("3 * size(diff) <= n + nc").withColumns({"s": s.cast("long"), "sc": -(100 - percent) * F.col("nc")})


def _within(members: DataFrame, percent: int) -> DataFrame:
    """The links ``a, b`` of the groups that make their components: those with the centre,
    and all of members that don't link with it."""
    star = members.where("s + sc <= 0").select(F.col("cls").alias("a"), F.col("center").alias("b"))
    unit, far = 2 * (100 + percent), F.col("s") + F.col("sc") > 0
    ends = cut(members.groupBy("center").agg(F.min("s").alias("low"), F.min(F.when(far, F.col("s"))).alias("far_low")).where("far_low is not null"))
    least = F.ceil((F.col("s") + F.when(far, F.col("low")).otherwise(F.col("far_low"))) / F.lit(unit)).cast("int")
    open_ = staged(members.join(ends, "center").select("cls", "center", "s", far.alias("far"), least.alias("needed"), "diff").where("needed <= size(diff)"))
    held = open_.select("cls", "center", F.explode("diff").alias("token"))
    counts = held.groupBy("center", "token").agg(F.count("*").alias("k"))
    ranked = held.join(counts, ["center", "token"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("ranked"))
    ranked = open_.drop("diff").join(ranked, "cls").select("cls", "center", "s", "far", "needed", F.col("ranked.k").alias("k"), F.col("ranked.token").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sizes, rows = [], ([], [], [], [])
            for k, tokens, needed in zip(batch.column("k").to_pylist(), batch.column("tokens").to_pylist(), batch.column("needed").to_pylist(), strict=True):
                others = np.array(k, np.float64) - 1
                taken, matches = chosen_length(others, len(others) - needed + 1, min(MOST_MATCHES, needed))
                at = np.flatnonzero(others[:taken])
                sizes.append(len(at))
                for part, value in zip(rows, (np.array(tokens, np.int64)[at], at, np.full(len(at), matches), np.full(len(at), len(others))), strict=True):
                    part.append(value.astype(np.int64))
            row = pa.array(np.repeat(np.arange(len(batch)), sizes))
            flat = [pa.array(np.concatenate(part) if part else np.zeros(0, np.int64)) for part in rows]
            columns = [*(batch.column(c).take(row) for c in ("cls", "center", "s", "far")), *flat]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "center", "s", "far", "token", "pos", "matches", "d"])

    held = staged(ranked.mapInArrow(run, "cls long, center long, s long, far boolean, token long, pos long, matches long, d long"))
    few = held.where("far").select("center", "token", *[F.col(c).alias(f"{c}_a") for c in ("cls", "s", "pos", "matches", "d")])
    meets = few.join(held, ["center", "token"]).where("cls_a <> cls and (not far or cls_a < cls)")
    overlap = F.expr(f"((s + s_a + {unit - 1}) div {unit})")
    asked = F.least("matches_a", "matches")
    meets = meets.where((F.col("pos") < F.col("d") - overlap + asked) & (F.col("pos_a") < F.col("d_a") - overlap + asked))
    pairs = meets.groupBy(F.col("cls_a").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("n"), F.max(asked).alias("asked")).where("n >= asked").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(open_.select(F.col("cls").alias(end), F.col("s").alias(f"s_{end}"), F.col("diff").alias(f"diff_{end}")), end)
    linked = pairs.where(unit * F.size(F.array_intersect("diff_a", "diff_b")) >= F.col("s_a") + F.col("s_b"))
    return star.unionByName(staged(linked.select("a", "b")))


def _likely(classes: DataFrame) -> DataFrame:
    """For each class one more central class that shares half of its least hashes.

    The head of a hash is, of the classes that hold it, the one whose shingles are most
    widely held."""
    held = classes.select("cls", "spread", F.explode("least").alias("token"))
    heads = held.groupBy("token").agg(F.max_by("cls", F.struct("spread", "cls")).alias("head"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    heads = cut(heads.where("low <> high").select("token", "head"))
    # a hash that very many hold: its head stands in several places
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = held.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    shared = held.join(heads, ["token", "salt"]).where("head <> cls").groupBy("cls", "head").agg(F.count("*").alias("k")).where(f"k >= {SHARED_LEAST}")
    return shared.groupBy("cls").agg(F.max_by("head", F.struct("k", "head")).alias("b")).select(F.col("cls").alias("a"), "b")


def _across(classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in different groups that meet the prefix condition.

    Of each shingle's holders, those outside its largest group meet all others;
    holders within one group never meet."""
    placed = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = staged(placed.where("size(tokens) > 0").select("cls", "n", "root", "skipped", "tokens"))
    held = placed.select("root", F.explode("tokens").alias("token"))
    split = cut(held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token"))
    bits = classes.sparkSession.sparkContext.broadcast(
        bloom(split.select(F.shiftrightunsigned("token", 38).alias("slot")).distinct(), "slot", 1 << 26)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().to_numpy().view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(bloom_has(bits.value, (flat >> np.uint64(38)).view(np.int64)))
            row = row[keep]
            n = batch.column("n").to_numpy()
            beyond = n - (percent * n + 99) // 100
            skipped = batch.column("skipped").to_numpy()
            pos += np.repeat(skipped, sizes)
            taken = [batch.column(c).take(pa.array(row)) for c in ("cls", "n", "root")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat[keep].view(np.int64)), *taken, pa.array(pos[keep]), pa.array((skipped + sizes - beyond)[row])
                ],
                names=["token", "cls", "n", "root", "pos", "matches"],
            )

    columns = "token long, cls long, n long, root long, pos long, matches long"
    held = placed.mapInArrow(run, columns).distinct()
    held = staged(held.join(split, "token", "left_semi"))
    bits.destroy()
    largest = held.groupBy("token", "root").agg(F.count("*").alias("k"))
    largest = cut(largest.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main")))
    marked = staged(held.join(largest, "token"))
    few = marked.where("root <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "pos", "matches", "root")])
    meets = few.join(marked, "token").where("root_a <> root and (root = main or root_a < root)")
    meets = meets.where(F.expr(f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)"))
    # the sizes of a pair tell the overlap it needs, and so how much of each prefix counts
    overlap = F.expr(f"(({percent} * (n + n_a) + {99 + percent}) div {100 + percent})")
    asked = F.least("matches_a", "matches")
    meets = meets.where((F.col("pos") < F.col("n") - overlap + asked) & (F.col("pos_a") < F.col("n_a") - overlap + asked))
    meets = meets.select(F.least("cls_a", "cls").alias("a"), F.greatest("cls_a", "cls").alias("b"), asked.alias("asked"))
    counts = meets.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("asked").alias("asked"))
    return cut(counts.where("n >= asked").select("a", "b"))


def _placed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, n, component_id, first`` for every row: a hash of its text, and
    the id and key of the component's first row by both, null ids last."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = _prefixes(docs, width, percent)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    # all rows of a class have the same set, and so the same prefix
    classes = staged(
        rows.where("n > 0").groupBy("cls", "cls2", "n").agg(
            F.min(place).alias("first"), F.min("least").alias("least"), F.max("spread").alias("spread"), F.min("skipped").alias("skipped"), F.min("tokens").alias("tokens")
        )
    )
    members = staged(_members(_likely(classes), docs, classes, width, percent))
    groups = members.select(F.col("cls").alias("node"), F.col("center").alias("root"))
    groups = groups.union(groups.select("root", "root").distinct())
    rest = _across(classes, groups, percent)
    roots = connected_components(_within(members, percent).union(_verified(rest, docs, classes, width, percent)))
    named = classes.select("cls", "cls2", "n", F.col("first").alias("lowest")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    lows = named.groupBy("root").agg(F.min("lowest").alias("first"))
    named = cut(named.join(lows, "root").select("cls", "cls2", "n", "first"))
    return rows.select("doc_id", "key", "cls", "cls2", "n").join(named, ["cls", "cls2", "n"], "left").select(
        "doc_id", "key", "n", F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "first"
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Documents link when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable.  Null and empty texts have no
    shingles and are their own component.  Rows with equal sets, repeated rows
    among them, are linked.  Null ids count as larger than all others."""
    return _placed(docs, width, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id.

    Rows are told apart by id and text, so null and repeated ids cost no other row.  Of
    rows of one id, or without any, the one with the least hash of the text stays; of
    those equal in both, the one with the least hash of all columns.  Null and empty
    texts all stay.  All columns stay, of whatever name."""
    placed = _placed(docs, width, percent, id_col, text_col).where("n > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    pairs = placed.groupBy("doc_id", "key").agg(F.max(stays).alias("stays"), F.count("*").alias("k"))
    pairs = cut(pairs.where("not stays or k > 1"))
    rows = boxed(docs, id=F.col(id_col).cast("long"), of=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("key"))
    kept = rows.join(pairs, same, "left_anti").select("row")
    again = pairs.where("stays")
    if not again.isEmpty():
        one = rows.join(again, same).groupBy("id", "of").agg(F.min_by("row", row_hash(docs)).alias("row"))
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")
