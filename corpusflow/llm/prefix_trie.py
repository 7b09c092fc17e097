"""The trie of conversations by common first turns.

A node is a distinct sequence of first turns; its members are the conversations that
start with it. Training each node once instead of once per member saves the words of its last turn
for every member but one.

A prefix is named by a 128-bit digest that adds up: the exclusive or of hashes of (depth, role,
text), so the digest of a prefix and that of its parent differ by one turn's hash, and digests run
along a conversation in blocks that different tasks compute. A count-min sketch counts all prefixes. Counts in
it are never too small, so an estimate of one proves that one conversation alone holds a prefix: such a node and
all it needs are emitted where its row is, without a shuffle. Only prefixes that may
be shared are shuffled and grouped exactly. The sketch has ``SKETCH_WIDTH`` cells of one byte in
each of four rows at most; where there are more prefixes, more of them are grouped exactly, with the same result.

Sums over subtrees need no walk down the trie. A node belongs to its smallest member, so the nodes of one
conversation are a chain that ends where the conversation ends. The sum over a subtree is what all members' whole
chains sum up to, less the part of the own chain above the node.

No key is a single task's: conversations and chains are cut into blocks of ``BLOCK`` turns, digests that the sketch
says many rows share are salted, groups are combined before they are shuffled, and the ids that end at
one node are joined range by range before they are hashed.

Defined results: turns that tie are ordered by SHA-256 of role and text; null role or text is
empty; rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their
own; an empty table has no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import n_words, partitions
from corpusflow.llm.hot import join_counted
from corpusflow.operators.ordered import position_in_group
from corpusflow.session import settled

BLOCK = 1 << 16
HEADS = 3
SKETCH_ROWS = 4
SKETCH_WIDTH = 1 << 22
FULL = 255
#: Cells of the sketch that travel together.
PART = 1 << 16
SALTS = 32
PIECE = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, a, b (a digest of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)

    def number(first: int) -> Column:
        return F.conv(F.substring(said, first, 15), 16, 10).cast("bigint")

    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        number(1).alias("a"), number(16).alias("b"), n_words(F.col("text")).alias("words"),
    )


def _lanes(depth: Column, a: Column, b: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, a, b) for seed in (1, 2)]


def running(rows: DataFrame, key: str, at: str, values: list[str], total, block: int) -> DataFrame:
    """``rows`` with running totals of ``values`` along ``at`` for each key, a block at a time. ``rows`` is stored.

    Inside a block by a window; totals of earlier blocks, one row per block, are added only for keys that have several.
    """
    part = F.floor(F.col(at) / block)
    cut = rows.withColumn("__block", part)
    local = W.partitionBy(key, "__block").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({v: total(v).over(local) for v in values})
    if rows.filter(F.col(at) >= block).isEmpty():
        return out.drop("__block")
    earlier = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(key, "__block").agg(*[total(v).alias(v) for v in values])
        .select(key, "__block", *[total(v).over(earlier).alias(f"__{v}") for v in values])
        .filter(F.col("__block") > 0)
    )
    both = {v: F.col(v).bitwiseXOR(F.coalesce(f"__{v}", F.lit(0))) if total is F.bit_xor else F.col(v) + F.coalesce(f"__{v}", F.lit(0)) for v in values}
    return out.join(carried, [key, "__block"], "left").withColumns(both).drop("__block", *[f"__{v}" for v in values])


def prefixes(conversations: DataFrame, every: int, block: int = BLOCK) -> DataFrame:
    """conv, depth, size, words, p1, p2, q1, q2: all prefixes of the rebuilt conversations with the digests of
    themselves and of their parents; depth 0 is the root.

    Conversation c starts with the first crc32(c) % (HEADS + 1) turns of c - c % every instead of its own.
    """
    placed = settled(position_in_group(turns(conversations), ["conv"], ["turn", "a", "b"]).drop("turn"))
    heads = (
        placed.filter((F.col("conv") % every == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("heads"))
    )
    conv, h = F.col("conv"), F.crc32(F.col("conv").cast("string")) % (HEADS + 1)
    none = F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>")
    each = (
        placed.filter("pos = 0").select("conv", "n", h.alias("h"), (conv - conv % every).alias("base"))
        .join(heads, "base", "left")
        .withColumn("heads", F.slice(F.coalesce("heads", none), F.lit(1), F.col("h").cast("int")))
        .withColumn("k", F.size("heads").cast("bigint"))
        .withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    for lane in (0, 1):
        for depth in range(1, HEADS + 1):
            turn = F.get("heads", F.lit(depth - 1))
            mine = F.coalesce(F.when(F.col("k") >= depth, _lanes(F.lit(depth).cast("bigint"), turn["a"], turn["b"])[lane]), F.lit(0))
            before = F.col(f"h{lane}_{depth - 1}") if depth > 1 else F.lit(0)
            each = each.withColumn(f"h{lane}_{depth}", before.bitwiseXOR(mine))
    each = settled(each)

    def digest(lane: int, depth: int) -> Column:
        return F.col(f"h{lane}_{depth}") if depth else F.lit(0).cast("bigint")

    steps = [
        F.struct(
            F.lit(d).cast("bigint").alias("depth"), (F.get("heads", F.lit(d - 1))["words"] if d else F.lit(0).cast("bigint")).alias("words"),
            digest(0, d).alias("p1"), digest(1, d).alias("p2"), digest(0, max(d - 1, 0)).alias("q1"), digest(1, max(d - 1, 0)).alias("q2"),
        )
        for d in range(HEADS + 1)
    ]
    led = each.select("conv", "size", F.explode(F.slice(F.array(*steps), F.lit(1), F.col("k").cast("int") + 1)).alias("x")).select("conv", "size", "x.*")
    # One row per block of a conversation, so no conversation is one task's.
    blocks = each.filter("n > h").select(
        "conv", "h", "k", "size", F.col(f"h0_{HEADS}").alias("h1"), F.col(f"h1_{HEADS}").alias("h2"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("part"),
    )
    own = placed.withColumn("part", F.floor(F.col("pos") / block)).join(blocks, ["conv", "part"]).filter("pos >= h")
    depth = F.col("k") + F.col("pos") - F.col("h") + 1
    l1, l2 = _lanes(F.col("depth"), F.col("a"), F.col("b"))
    own = settled(
        own.withColumn("depth", depth).select("conv", "size", "depth", "words", "h1", "h2", l1.alias("l1"), l2.alias("l2"))
    )
    own = running(own.withColumns({"p1": F.col("l1"), "p2": F.col("l2")}), "conv", "depth", ["p1", "p2"], F.bit_xor, block)
    p1, p2 = F.col("p1").bitwiseXOR(F.col("h1")), F.col("p2").bitwiseXOR(F.col("h2"))
    tail = own.select(
        "conv", "size", "depth", "words", p1.alias("p1"), p2.alias("p2"),
        p1.bitwiseXOR(F.col("l1")).alias("q1"), p2.bitwiseXOR(F.col("l2")).alias("q2"),
    )
    return led.unionByName(tail)


class Sketch:
    """Count-min over pairs of 64-bit digests; counts stop at ``FULL``."""

    def __init__(self, width: int, cells: np.ndarray | None = None) -> None:
        self.bits = width.bit_length() - 1
        self.cells = np.zeros((SKETCH_ROWS, width), np.uint8) if cells is None else cells.reshape(SKETCH_ROWS, width)

    def places(self, first: pa.Array, second: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        a, b = (v.to_numpy(zero_copy_only=False).astype(np.uint64) for v in (first, second))
        for row in range(SKETCH_ROWS):
            # Rows take different mixes of the two halves; the upper bits of a product are well spread.
            mixed = (a + b * np.uint64(2 * row + 1)) * np.uint64(0x9E3779B97F4A7C15)
            yield row, (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, first: pa.Array, second: pa.Array) -> None:
        for row, at in self.places(first, second):
            cell, times = np.unique(at, return_counts=True)
            self.cells[row, cell] = np.minimum(self.cells[row, cell] + times, FULL)

    def estimate(self, first: pa.Array, second: pa.Array) -> np.ndarray:
        found = None
        for row, at in self.places(first, second):
            held = self.cells[row, at]
            found = held if found is None else np.minimum(found, held)
        return found


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Cells of the sketch of all prefixes: one per task, merged part by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or Sketch(width)
            held.add(batch.column("p1"), batch.column("p2"))
        if held is not None:
            yield from parts(dict(enumerate(held.cells.reshape(-1, PART))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part"), batch.column("cells"), strict=True):
                more = np.frombuffer(zlib.decompress(cells.as_py()), np.uint8)
                now = held.get(part.as_py())
                held[part.as_py()] = more if now is None else np.minimum(now.astype(np.uint16) + more, FULL).astype(np.uint8)
        yield from parts(held)

    def parts(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, cells in held.items():
            if cells.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())})

    schema = "part int, cells binary"
    merged = rows.select("p1", "p2").mapInArrow(count, schema).repartition(partitions(rows.sparkSession), "part").mapInArrow(merge, schema)
    out = np.zeros((SKETCH_ROWS * width // PART, PART), np.uint8)
    # At most SKETCH_ROWS * SKETCH_WIDTH bytes, whatever the size of the table.
    for part, cells in merged.toLocalIterator():
        out[part] = np.frombuffer(zlib.decompress(cells), np.uint8)
    return out


def screened(rows: DataFrame, widest: int = SKETCH_WIDTH) -> DataFrame:
    """``rows`` with alone (proven), parent_alone (proven), hot and parent_hot (may be held by many)."""
    wanted = 1 << max(2 * rows.count(), PART).bit_length()
    width = min(wanted, max(widest, PART))
    cells = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sketch(width, cells.value)
        for batch in batches:
            own = known.estimate(batch.column("p1"), batch.column("p2"))
            parent = known.estimate(batch.column("q1"), batch.column("q2"))
            flags = [pa.array(f) for f in (own == 1, parent == 1, own >= FULL, parent >= FULL)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "alone", "parent_alone", "hot", "parent_hot"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(judge, f"{schema}, alone boolean, parent_alone boolean, hot boolean, parent_hot boolean")


def joined_ids(ends: DataFrame) -> DataFrame:
    """p1, p2, said: SHA-256 of the ids of each digest in ascending order, comma-joined."""

    def join_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"p1": [key[0]], "p2": [key[1]], "first": [first], "ids": [",".join(ids)]})

        for batch in batches:
            for a, b, conv in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "conv")], strict=True):
                if ids and (key != (a, b) or size >= PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    key, first = (a, b), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_pydict({"p1": pa.array(columns[0], pa.int64()), "p2": pa.array(columns[1], pa.int64()), "said": columns[2]})

        for batch in batches:
            for a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "ids")], strict=True):
                if key == (a, b):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            if len(out) >= 1_000:
                yield rows()
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
        if out:
            yield rows()

    order = ["p1", "p2", "conv"]
    pieces = (
        ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(join_range, "p1 long, p2 long, first long, ids string")
    )
    return (
        pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
        .mapInArrow(hash_pieces, "p1 long, p2 long, said string")
    )


def trie(conversations: DataFrame, every: int = 20, block: int = BLOCK, widest: int = SKETCH_WIDTH, limit: int = 500_000) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = settled(prefixes(conversations, every, block))
    rows = settled(screened(rows, widest))
    p, zero = ["p1", "p2"], F.lit(0).cast("bigint")
    ends = F.col("size") == F.col("depth")
    tails, shared = rows.filter("alone"), rows.filter("NOT alone")

    nodes = (
        shared.groupBy(*p).agg(
            F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("words").alias("words"),
            F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.first("hot").alias("hot"), F.first("parent_hot").alias("parent_hot"),
            F.count(F.lit(1)).alias("n_convs"), F.count_if(ends).alias("n_ends"),
        )
    )
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = settled(nodes.withColumn("saved", saved))

    # What each conversation's own chain holds: its leaf, and the words its nodes save.
    credit = (
        tails.filter(ends).select("conv", F.lit(1).cast("bigint").alias("leaf"), zero.alias("saved"))
        .unionByName(nodes.select("conv", (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaf"), "saved"))
        .unionByName(shared.select("conv", zero.alias("leaf"), zero.alias("saved")).withColumn("times", F.lit(1)), allowMissingColumns=True)
        .groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("chain"), F.count("times").alias("times"))
        .filter("times > 0")
    )
    credit = settled(credit)
    members = join_counted(shared.select("conv", "depth", *p), credit, "conv", "times", spread=F.struct("depth"), limit=limit)
    sums = members.groupBy(*p).agg(F.sum("leaf").alias("n_leaves"), F.sum("chain").alias("below"))
    above = running(nodes.select(*p, "conv", "depth", "saved", F.col("saved").alias("run")), "conv", "depth", ["run"], F.sum, block)
    above = above.select(*p, (F.col("run") - F.col("saved")).alias("above"))

    # Nodes that have to ask for their parent: all that may be shared, and the first of each tail.
    asking = nodes.select(*p, "conv", "q1", "q2", "parent_hot", F.lit(True).alias("grouped"), "depth", F.col("n_ends").alias("size")).unionByName(
        tails.filter("NOT parent_alone").select(*p, "conv", "q1", "q2", "parent_hot", F.lit(False).alias("grouped"), "depth", "size")
    )
    under = F.col("depth") > 0
    children = asking.filter(under).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    salt = F.when(F.col("parent_hot"), F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answers = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.explode(salts).alias("salt"), F.col("conv").alias("parent"))
    # A parent that is not among the grouped ones is proven to be held by the same conversation alone.
    asked = asking.withColumn("salt", salt).join(answers, ["q1", "q2", "salt"], "left")
    parent = F.when(under, F.coalesce("parent", "conv")).alias("parent_conv_id")

    nothing = F.sha2(F.lit(""), 256)
    lone = F.when(ends, F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")
    one, goes_on = F.lit(1).cast("bigint"), (F.col("size") > F.col("depth")).cast("bigint").alias("n_children")

    def tail(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(
            F.col("conv").alias("conv_id"), "depth", parent, one.alias("n_convs"), goes_on, one.alias("n_leaves"),
            zero.alias("saved_tokens"), lone,
        )

    asked = settled(asked)
    grouped = (
        nodes.join(sums, p).join(above.withColumnRenamed("above", "__above"), p)
        .join(children, p, "left").join(joined_ids(shared.filter(ends)), p, "left")
        .join(asked.filter("grouped").select(*p, parent), p)
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves", (F.col("below") - F.col("__above")).alias("saved_tokens"), F.coalesce("said", nothing).alias("ends_sha256"),
        )
    )
    inner = tail(tails.filter("parent_alone"), F.when(under, F.col("conv")).alias("parent_conv_id"))
    return grouped.unionByName(inner).unionByName(tail(asked.filter("NOT grouped"), parent))
