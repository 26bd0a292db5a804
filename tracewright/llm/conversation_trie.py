"""The prefix trie of conversations that start with turns of others.

A sequence of turns has a fingerprint, a polynomial over the digests of its turns modulo a
prime of 127 bits.  Fingerprints form a monoid with the length: that of a joined sequence
comes from those of its halves, and that of a tail from those of the whole and of what is
cut off.  So the fingerprint of every prefix of a rebuilt conversation is worked out from
the base's head and the conversation's own prefixes, and no rebuilt text is ever put
together; a row keeps the place of its last turn and the turn's SHA-256.

Prefixes with one fingerprint are one node.  They are verified: all last turns under a
fingerprint must have one digest, and all prefixes without it one fingerprint, so by
induction the sequences are equal.  If one isn't, all is done again with another base of
the polynomial.

Orders within a conversation or a node are scans over ranges of rows: each partition is
folded by itself, the folds of partitions (one small row for each) are combined, and each
partition starts from what those before it come to.  A conversation or a node with very
many rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, staged

PRIME = (1 << 127) - 1
EMPTY = bytes(16)
HEAD_TURNS = 3  # a head has the base's first 0 to 3 turns


# --- scans over ranges


@dataclass(frozen=True)
class Scan:
    """A fold over the rows of a key: ``step`` adds a row's values to a state, ``combine`` joins
    the states of two runs of rows; ``shown`` are the columns made from a state."""

    zero: tuple
    step: Callable[[tuple, tuple], tuple]
    combine: Callable[[tuple, tuple], tuple]
    shown: Callable[[tuple], tuple]


def prefix_scan(rows: DataFrame, key: list[str], order: list[Column], values: list[str], scan: Scan, made: str) -> DataFrame:
    """``rows`` with the columns ``made`` from the fold of a key's rows up to and including each.

    Keys must not be null.  Rows are sorted in ranges of key and order; the driver gets one
    row for each partition, its last key's fold, and never more."""
    ordered = [F.col(k) for k in key] + order
    held = cut(rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered))
    names = rows.columns

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = [batch.column(c).to_pylist() for c in (*key, *values)]
        for row in zip(*columns, strict=True):
            yield row[: len(key)], row[len(key) :]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        state = scan.zero
        for batch in batches:
            for k, value in keyed(batch):
                if k != last:
                    first, last, state = first or k, k, scan.zero
                state = scan.step(state, value)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "state": pickle.dumps((first, last, state))}], pa.schema([("part", pa.int32()), ("state", pa.binary())]))

    carries, at, state = {}, None, scan.zero
    for row in sorted(held.mapInArrow(fold, "part int, state binary").collect(), key=lambda r: r.part):
        first, last, own = pickle.loads(row.state)
        if at == first:
            carries[row.part] = (first, state)
            own = scan.combine(state, own) if first == last else own
        at, state = last, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = carries.get(TaskContext.get().partitionId(), (None, scan.zero))
        for batch in batches:
            found = []
            for k, value in keyed(batch):
                if k != last:
                    last, state = k, scan.zero
                state = scan.step(state, value)
                found.append(scan.shown(state))
            new = [pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)] if found else [pa.array([], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *(f.name for f in fields)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(made)
    fields = list(to_arrow_schema(more))
    return held.mapInArrow(run, StructType([*rows.schema.fields, *more.fields]))


# --- fingerprints


@lru_cache(maxsize=16)
def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()) % (PRIME - 2) + 2


@lru_cache(maxsize=1 << 16)
def _power(base: int, n: int) -> int:
    return pow(base, n, PRIME)


def value_of(digest: bytes) -> int:
    return int.from_bytes(digest) % PRIME


def packed(value: int) -> bytes:
    return value.to_bytes(16)


def _own_prefixes(base: int) -> Scan:
    """Number of turns and fingerprint of a conversation's own prefixes."""
    return Scan(
        (0, 0),
        lambda state, value: (state[0] + 1, (state[1] * base + value_of(value[0])) % PRIME),
        lambda a, b: (a[0] + b[0], (a[1] * _power(base, b[0]) + b[1]) % PRIME),
        lambda state: (state[0], packed(state[1])),
    )


def _rebuilt(base: int):
    """Fingerprints of rebuilt prefixes that end in an own turn, and of those without it."""
    inverse = pow(base, -1, PRIME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [batch.column(c).to_pylist() for c in ("own_fp", "digest", "head_fp", "skipped_fp", "beyond")]
            fps, parents = [], []
            for own, digest, head, skipped, beyond in zip(*of, strict=True):
                own, head, skipped = (int.from_bytes(x) for x in (own, head, skipped))
                fp = (own + (head - skipped) * _power(base, beyond)) % PRIME
                fps.append(packed(fp))
                parents.append(packed((fp - value_of(digest)) * inverse % PRIME))
            kept = [batch.column(c) for c in ("conv_id", "depth", "length", "digest", "words", "turn_conv", "turn_pos")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.binary()), pa.array(parents, pa.binary())], names=ROW_NAMES)

    return run


ROWS = "conv_id long, depth long, length long, digest binary, words long, turn_conv long, turn_pos long, fp binary, parent_fp binary"
ROW_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words``: role and text as one SHA-256, each with its length before it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), ""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256))
    return conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), words.cast("long").alias("words"))


def rebuilt_prefixes(turns: DataFrame, seed: int = 0) -> DataFrame:
    """One row per prefix of each rebuilt conversation, the empty one among them.

    ``conv_id, depth, length`` (of the rebuilt conversation), ``digest, words, turn_conv,
    turn_pos`` (of the last turn), ``fp, parent_fp``."""
    base = base_of(seed)
    own = prefix_scan(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], ["digest"], _own_prefixes(base), "pos long, own_fp binary")
    head = F.when(F.col("pos") <= HEAD_TURNS, F.struct("pos", "own_fp", "digest", "words"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("firsts"))
    convs = staged(convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")))
    base_id = F.col("conv_id") - F.col("conv_id") % 20
    bases = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base_id"), F.col("firsts").alias("base_firsts"))
    joined = convs.withColumn("of_base", base_id).join(bases, F.col("of_base") == F.col("base_id"), "left")
    joined = joined.withColumn("head", F.slice(F.coalesce("base_firsts", F.array().cast(convs.schema["firsts"].dataType)), F.lit(1), F.col("h")))
    at = lambda items, i: F.coalesce(F.get(items, i - 1)["own_fp"], F.lit(EMPTY))
    size = F.size("head")
    joined = joined.select(
        "conv_id", "of_base", "h", "head", size.alias("j"), at(F.col("head"), size).alias("head_fp"), at(F.col("firsts"), F.col("h")).alias("skipped_fp"),
        (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
    )
    none = F.lit(None)
    roots = joined.select("conv_id", F.lit(0).cast("long"), "length", none.cast("binary"), F.lit(0).cast("long"), none.cast("long"), none.cast("long"), F.lit(EMPTY), none.cast("binary")).toDF(*ROW_NAMES)
    turn = F.explode(F.transform("head", lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get("head", i - 1)["own_fp"]).otherwise(F.lit(EMPTY)).alias("before"))))
    heads = joined.select("conv_id", "of_base", "length", turn.alias("t")).select("conv_id", "t.x.pos", "length", "t.x.digest", "t.x.words", "of_base", "t.x.pos", "t.x.own_fp", "t.before").toDF(*ROW_NAMES)
    beyond = F.col("pos") - F.col("h")
    tails = own.join(joined.drop("of_base", "head"), "conv_id").where("pos > h")
    tails = tails.withColumns({"beyond": beyond, "depth": beyond + F.col("j"), "turn_conv": F.col("conv_id"), "turn_pos": F.col("pos")})
    return roots.unionByName(heads).unionByName(tails.mapInArrow(_rebuilt(base), ROWS))


# --- the trie

NODE = ["depth", "fp"]


def verified_nodes(prefixes: DataFrame) -> DataFrame | None:
    """``depth, fp, conv_id`` (smallest member)``, n_convs, n_longer`` (members that go on)``,
    parent_fp``; None where a fingerprint stands for two sequences."""
    nodes = staged(
        prefixes.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("length") > F.col("depth")).cast("long")).alias("n_longer"),
            F.min("parent_fp").alias("parent_fp"), (F.min("parent_fp") != F.max("parent_fp")).alias("unlike"), (F.min("digest") != F.max("digest")).alias("other"),
        )
    )
    return None if not nodes.where("unlike or other").isEmpty() else nodes.drop("unlike", "other")


def _ends(prefixes: DataFrame) -> DataFrame:
    """``depth, fp, ends_sha256``: the hash of the ids that end at a node, in order.

    Ids are joined to texts in ranges of node and id, so those of one node are many tasks'
    work; only the hash itself passes over these texts one after the other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("fp", pa.binary()), ("first_id", pa.int64()), ("ids", pa.string())])
        node, ids, rows = None, [], []

        def flush() -> None:
            if ids:
                rows.append({"depth": node[0], "fp": node[1], "first_id": ids[0], "ids": ",".join(map(str, ids))})

        for batch in batches:
            for depth, fp, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "conv_id")), strict=True):
                if (depth, fp) != node or len(ids) >= 1 << 16:
                    flush()
                    node, ids = (depth, fp), []
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        flush()
        yield pa.RecordBatch.from_pylist(rows, schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("fp", pa.binary()), ("ends_sha256", pa.string())])
        node, digest, rows = None, None, []
        for batch in batches:
            for depth, fp, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
                if (depth, fp) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    rows.append({"depth": node[0], "fp": node[1], "ends_sha256": digest.hexdigest()})
                node, digest = (depth, fp), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        if node:
            yield pa.RecordBatch.from_pylist([{"depth": node[0], "fp": node[1], "ends_sha256": digest.hexdigest()}], schema)

    ends = prefixes.where("length = depth").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    texts = ends.mapInArrow(joined, "depth long, fp binary, first_id long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first_id").mapInArrow(hashed, "depth long, fp binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, and ``turn_conv, turn_pos``: where the node's last turn is stored.

    A node belongs to its smallest member.  Those that belong to one conversation are the
    end of its path, so sums over a subtree are sums over the members of what belongs to
    each of them from there on; no pair of node and ancestor is made.

    Rows without ``conv_id`` belong to no conversation and are left out.  Null roles and
    texts are empty, a null turn comes first, turns of one number are ordered by their
    digest and repeated rows are turns each; other columns make no difference; without
    conversations there is no node."""
    turns = staged(turns_of(conversations))
    while True:
        prefixes = staged(rebuilt_prefixes(turns, seed))
        nodes = verified_nodes(prefixes)
        if nodes is not None:
            break
        seed += 1
    own = nodes.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), "n_convs", (F.col("n_longer") == 0).cast("long").alias("leaf"))
    owned = prefixes.join(own, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("at")), "left")
    owned = owned.select("conv_id", *NODE, F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0)).alias("saved"), (F.col("owner").isNotNull()).alias("owns"), "turn_conv", "turn_pos")
    # from the end of each conversation on: what belongs to it so far
    add = Scan((0, 0), lambda s, v: (s[0] + v[0], s[1] + v[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s)
    summed = prefix_scan(owned, ["conv_id"], [F.col("depth").desc()], ["leaf", "saved"], add, "leaves_after long, saved_after long")
    place = F.max(F.when(F.col("owns"), F.struct("turn_conv", "turn_pos")))
    below = summed.groupBy(*NODE).agg(F.sum("leaves_after").alias("n_leaves"), F.sum("saved_after").alias("saved_tokens"), place.alias("place"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_fp").alias("fp")).agg(F.count("*").alias("n_children"))
    # a node's row before its children's, so that each of them meets its parent, however many they are
    none = F.lit(None).cast("long")
    meet = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"), none.alias("child"), F.lit(None).cast("binary").alias("child_fp"))
    meet = meet.unionByName(nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent_fp").alias("fp"), none.alias("parent_conv_id"), F.col("conv_id").alias("child"), F.col("fp").alias("child_fp")))
    first = Scan((None,), lambda s, v: s if s[0] is not None else v, lambda a, b: a if a[0] is not None else b, lambda s: s)
    parents = prefix_scan(meet, NODE, [F.col("child").asc_nulls_first()], ["parent_conv_id"], first, "parent long").where("child is not null")
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("child_fp").alias("fp"), F.col("parent").alias("parent_conv_id"))
    found = nodes.join(below, NODE).join(children, NODE, "left").join(parents, NODE, "left").join(_ends(prefixes), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "place.turn_conv", "place.turn_pos",
    )
