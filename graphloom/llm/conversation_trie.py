"""Trie of conversations that share their first turns, rolled up by pointer jumping.

A node is a distinct sequence of first turns, keyed by a digest of it. The
digest is a polynomial over the turns' SHA-256 values modulo a prime, so the
digests of two stretches of a conversation give that of both: conversations are
sorted by range, each range is digested on its own, and the driver carries one
value a range over to the next. A conversation of any length needs no task of
its own. A turn's parent is the digest without that turn, which the polynomial
gives too, so each turn is an edge of the trie by itself.

Leaf counts and savings go up in doubling rounds: in round k a node gives what
its subtree holds within ``2**k`` levels to the ancestor ``2**k`` levels up, and
then takes that ancestor's own pointer. A trie of depth d needs log2(d) rounds,
and only nodes deeper than the round's reach take part. Sums are combined before
they are shuffled; pointers of very common ancestors are joined by a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE_BITS, hot_join, stored

#: Prime and base of the digest; a key is 16 bytes. The root's key is 1.
P, BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B
BACK = pow(BASE, -1, P)
ROOT = (1).to_bytes(16, "big")
#: Bytes of joined ids in one row, at which a list of members goes on in another.
PIECE = 1 << 16


def _powers() -> Callable[[int], int]:
    known = [1]

    def power(n: int) -> int:
        if n > 4096:
            return pow(BASE, n, P)
        while len(known) <= n:
            known.append(known[-1] * BASE % P)
        return known[n]

    return power


ROLLED = "conv_id long, n_local long, local binary, digest binary, n_bytes long"


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest the turns of a range, each conversation from its first turn there."""
    conv, n, h = None, 0, 0
    for batch in batches:
        numbers, locals_ = [], []
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != conv:
                conv, n, h = c, 0, 0
            n, h = n + 1, (h * BASE + int.from_bytes(x, "big")) % P
            numbers.append(n)
            locals_.append(h.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(locals_, pa.binary()), batch.column(1), batch.column(2)], ["conv_id", "n_local", "local", "digest", "n_bytes"])


def _carried(over: dict[int, tuple[int, int, int]]) -> Callable:
    """Turns with their place and keys, given each range's unfinished conversation: ``{range: (conv_id, turns, digest)}``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers()
        for batch in batches:
            places, keys, parents = [], [], []
            for part, c, n, local, x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                conv, before, h = over.get(part, (None, 0, 1))
                if conv != c:
                    before, h = 0, 1
                key = (h * power(n) + int.from_bytes(local, "big")) % P
                places.append(before + n)
                keys.append(key.to_bytes(16, "big"))
                parents.append(((key - int.from_bytes(x, "big")) * BACK % P).to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(places, pa.int64()), batch.column(4), batch.column(5), pa.array(keys, pa.binary()), pa.array(parents, pa.binary())], ["conv_id", "place", "digest", "n_bytes", "key", "parent"]
            )

    return run


SEQUENCED = "conv_id long, place long, digest binary, n_bytes long, key binary, parent binary"


def sequenced(turns: DataFrame, *order: str) -> DataFrame:
    """``conv_id, place, digest, n_bytes, key, parent`` of turns in order, written once.

    ``turns`` has ``conv_id`` (not null), ``digest`` and ``n_bytes``; ``order`` names
    the columns that order a conversation's turns, null first. ``place`` counts from
    1. Rows that are equal in all of these may change places, which changes nothing.
    """
    keys = ["conv_id", *order, "_tie"]
    ranges = turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = stored(ranges.select("conv_id", "digest", "n_bytes").mapInArrow(_rolled, ROLLED).withColumn("_at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("_at", PLACE_BITS).alias("part")
    ends = local.groupBy(part).agg(F.min_by("conv_id", "_at").alias("first"), F.max_by(F.struct("conv_id", "n_local", "local"), "_at").alias("last"))
    over, conv, n, h = {}, None, 0, 1
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a range
        over[r["part"]] = (conv, n, h)
        last = r["last"]
        if not conv == r["first"] == last["conv_id"]:
            n, h = 0, 1
        conv, n, h = last["conv_id"], n + last["n_local"], (h * pow(BASE, last["n_local"], P) + int.from_bytes(last["local"], "big")) % P
    return stored(local.select(part, "conv_id", "n_local", "local", "digest", "n_bytes").mapInArrow(_carried(over), SEQUENCED), "places")


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """As ``sequenced``, from conversations: ordered by turn number (null first), equal numbers by role and text.

    Null roles and texts become empty. Rows without a conversation are left out.
    Repeated rows are turns of their own. Other columns are not read.
    """
    own = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv_id is not null")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return sequenced(own.withColumns({"digest": F.unhex(F.substring(said, 1, 32)), "n_bytes": F.octet_length("text").cast("long")}), "turn", "role", "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, a row for each key and ``PIECE`` bytes."""
    key, first, ids, size = None, None, [], 0
    rows: list[tuple] = []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or size >= PIECE:
                if ids:
                    rows.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "ids"), r, strict=True)) for r in rows], PIECES)
            rows = []
    if ids:
        yield pa.RecordBatch.from_pylist([{"key": key, "first": first, "ids": ",".join(ids)}], PIECES)


PIECES = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each key's pieces, which stream by in order."""
    key, made = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                made.update(b"," + ids.encode())
                continue
            if made:
                keys.append(key)
                out.append(made.hexdigest())
            key, made = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([made.hexdigest()])], ["key", "ends_sha256"])


def joined_ids(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``key, conv_id``: the SHA-256 of each key's ids in ascending order, joined by commas.

    Ids are sorted by range and joined to pieces there, so a key that holds a
    third of all rows comes to its last task as a few long pieces. That task
    holds one piece and the hash's state.
    """
    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, *sums: str) -> DataFrame:
    """``key`` and ``sums`` added up over each node's subtree, itself included.

    ``nodes`` has ``key`` (unique), ``parent``, ``depth`` (root: 0) and the columns to
    add up; it is read several times. Each round halves what is left: nodes at
    least ``reach`` deep give their sums to the ancestor ``reach`` levels up, and
    those at least twice as deep go on with that ancestor's pointer.
    """
    added = [F.sum(x).alias(x) for x in sums]
    parts = [nodes.select("key", *sums)]
    live, reach = nodes.where("depth > 0").select("key", "depth", F.col("parent").alias("jump"), *sums), 1
    while True:
        given = stored(live.groupBy("jump").agg(*added, F.count("*").alias("n")), "given")
        parts.append(given.select(F.col("jump").alias("key"), *sums))
        reach *= 2
        deeper = live.where(F.col("depth") >= reach)
        if deeper.isEmpty():
            break
        targets = live.select(F.col("key").alias("jump"), F.col("jump").alias("beyond")).join(given.select("jump", "n"), "jump")
        moved = hot_join(deeper, stored(targets, "targets"), ["jump"], "n").select("key", "depth", F.col("beyond").alias("jump"), *sums)
        taken = given.select(F.col("jump").alias("key"), *[F.col(x).alias(f"_{x}") for x in sums])
        live = stored(moved.join(taken, "key", "left").select("key", "depth", "jump", *[(F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in sums]), "live")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("key").agg(*added)


def trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The trie's nodes, from ``sequenced`` turns: one row for each distinct sequence of first turns.

    ``conv_id`` is the smallest member, and with ``depth`` tells nodes apart;
    ``parent_conv_id`` is the parent's (root: null); ``n_convs`` counts members,
    ``n_children`` children, ``n_leaves`` childless nodes of the subtree;
    ``saved_bytes`` is, over the subtree, the last text's bytes once for each member
    but one; ``ends_sha256`` is of the ids of members that end there. ``members``
    (``conv_id``, unique) adds conversations without turns, which end in the root.
    Without conversations there is no node.
    """
    convs = turns.select("conv_id").where("place = 1")
    if members is not None:
        convs = convs.unionByName(members.select("conv_id")).distinct()
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    below = turns.groupBy("key", "parent", F.col("place").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    plain = stored(below.unionByName(root), "nodes")
    children = plain.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(
        plain.join(children, "key", "left").select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_bytes")),
        "nodes",
    )
    last = turns.groupBy("conv_id").agg(F.max(F.struct("place", "key"))["key"].alias("key"))
    ends = last if members is None else members.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    with_parent = hot_join(nodes.drop("n_leaves", "saved_bytes"), parents, ["parent"], "n", "left")
    return (
        with_parent.join(rolled_up(nodes, "n_leaves", "saved_bytes"), "key")
        .join(joined_ids(ends.select("key", "conv_id")), "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    )


def shared_start(turns: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are taken from another one: ``sequenced`` turns, and all their ids.

    ``source`` has ``conv_id`` (unique), ``start`` (the other conversation) and ``h``:
    the first ``h`` turns of ``start`` (all if fewer, none if it isn't there), then
    the conversation's own turns after its first ``h``. ``h`` is small.
    """
    sizes = stored(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "sizes")
    known = source.join(sizes, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    other = sizes.select(F.col("conv_id").alias("start"), F.col("n").alias("n_start"))
    plan = stored(known.join(other, "start", "left").select("conv_id", "start", "h", "n", F.least("h", F.coalesce("n_start", F.lit(0))).alias("taken")), "plan")
    most = plan.agg(F.max("h")).first()[0] or 0
    first = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "start").join(plan.select("conv_id", "start", "h"), "start").where("place <= h")
    rest = hot_join(turns, plan.select("conv_id", "h", "taken", "n"), ["conv_id"], "n").where("place > h").withColumn("place", F.col("taken") + F.col("place") - F.col("h"))
    both = first.select("conv_id", "place", "digest", "n_bytes").unionByName(rest.select("conv_id", "place", "digest", "n_bytes"))
    return sequenced(both, "place"), plan.select("conv_id")
