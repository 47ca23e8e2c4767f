"""The trie of conversations' prefixes.

Turns are dealt by ranges of conversation and place, and a numpy scan over each range adds
up a polynomial of their hashes; what a conversation had in earlier ranges is added
from the totals of ranges, so no conversation has to fit a task. Turns of equal depth and
prefix fingerprint are candidates for one node. Each group is checked turn by turn: all its
members must have the turn of its representative (the smallest conversation) and come from
one group of the depth before, which by induction makes their prefixes equal; equal turns are
combined before the shuffle. Members that differ are split off, with all their deeper turns,
and what was split is checked again until no group is mixed.

A node is named by its smallest conversation and its depth, so the nodes of one name are a
path of the trie. Sums over subtrees are added up over paths by pointer doubling (rounds
grow with the logarithm of the nesting) and then along each path by running sums over ranges.

Defined cases: null roles and texts are empty, null turns come first, rows of one turn are
ordered by role and text, and equal rows are turns of their own. Rows without an id belong
to no conversation. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import small_batches
from conefix.operators.scans import running
from conefix.session import Scratch

#: The point at which the polynomials are taken, an odd number modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Bits of a fingerprint.
BITS = 64
#: Characters of the ids that one row carries on their way to a hash.
PIECE = 1 << 15

_ALL = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(min(n, 1), dtype=np.uint64), np.full(max(n - 1, 0), BASE, dtype=np.uint64)]), dtype=np.uint64)


def turn_hashes(roles: list[bytes], texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d:%b%b" % (len(r), r, t)) for r, t in zip(roles, texts, strict=True)], dtype=np.uint64)


def scan(c: np.ndarray, t: np.ndarray, state: tuple[int | None, int, int]) -> tuple[np.ndarray, np.ndarray, tuple[int | None, int, int]]:
    """Places and prefix polynomials of consecutive turns of sorted conversations; ``state`` is conversation, turns and sum so far."""
    n = len(c)
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    k = np.arange(n, dtype=np.int64) - first[own]
    goes_on = int(c[0]) == state[0]
    powers = _powers(n)[k]
    if goes_on:
        powers = np.where(own == 0, powers * np.uint64(pow(BASE, state[1], 1 << 64)), powers)
        k = np.where(own == 0, k + state[1], k)
    terms = t * powers
    sums = np.cumsum(terms, dtype=np.uint64)
    sums -= (sums[first] - terms[first])[own]
    if goes_on:
        sums = np.where(own == 0, sums + np.uint64(state[2]), sums)
    return k, sums, (int(c[-1]), int(k[-1]) + 1, int(sums[-1]))


def _scanned(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """``rows(c, ..., role, text)`` dealt by c and order, with ``pid, k, s`` within their range, and what to add: range -> conversation, turns and sum before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = (None, 0, 0), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                t = turn_hashes(batch.column("role").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
                k, s, state = scan(batch.column("c").to_numpy(), t, state)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), pid, dtype=np.int64)), pa.array(k), pa.array(s.view(np.int64))], [*batch.schema.names, "pid", "k", "s"])

    small_batches(rows.sparkSession)
    keys = ["c", *order, "\0tag"]
    dealt = rows.withColumn("\0tag", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("\0tag")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    held = scratch.save(dealt.mapInArrow(run, f"{fields}, pid long, k long, s long"), name)
    ends = held.groupBy("pid").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    parts = held.groupBy("pid", "c").agg(F.max(F.struct("k", "s")).alias("end")).join(F.broadcast(ends), "pid").where("c = first OR c = last")
    add, state = {}, (None, 0, 0)
    for row in parts.orderBy("pid", "c").collect():  # two rows for each range at most
        n, s = row["end"]["k"] + 1, row["end"]["s"] & _ALL
        if row["c"] == state[0]:
            add[row["pid"]] = state
            state = (state[0], state[1] + n, state[2] + pow(BASE, state[1], 1 << 64) * s & _ALL)
        else:
            state = (row["c"], n, s)
    return held, add


def _placed(rows: DataFrame, add: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Rows of ``_scanned`` with ``k`` and ``s`` in their whole conversation."""
    if not add:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, c = batch.column("pid").to_numpy(), batch.column("c").to_numpy()
            k, s = batch.column("k").to_numpy().copy(), batch.column("s").to_numpy().copy().view(np.uint64)
            for p in np.unique(pid).tolist():
                if p in add:
                    conv, n, total = add[p]
                    at = (pid == p) & (c == conv)
                    k[at] += n
                    s[at] = s[at] * np.uint64(pow(BASE, n, 1 << 64)) + np.uint64(total)
            columns = {name: column for name, column in zip(batch.schema.names, batch.columns, strict=True)} | {"k": pa.array(k), "s": pa.array(s.view(np.int64))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, rows.schema)


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(c, d, role, text)``, turns from depth 1, and ``(c, length)`` of all conversations.

    A conversation begins with the first h turns of the one whose id is its own rounded down to
    twenties, and goes on with its own behind its first h; h is the CRC-32 of its decimal id, modulo 4.
    """
    long = F.col("conv_id").cast("long")
    turns = conversations.where(long.isNotNull()).select(long.alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held, add = _scanned(turns, ["turn", "role", "text"], scratch, "turns")
    sizes = scratch.save(_placed(held.select("c", "pid", "k", "s"), add).groupBy("c").agg((F.max("k") + 1).alias("n")), "sizes")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    convs = sizes.withColumns({"h": h, "b": F.col("c") - F.col("c") % 20})
    based = convs.join(sizes.select(F.col("c").alias("b"), F.col("n").alias("n_b")), "b", "left").withColumn("m", F.least("h", F.coalesce("n_b", F.lit(0))))
    based = scratch.save(based.select("c", "b", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    placed = _placed(held.select("c", "pid", "k", "s", "role", "text"), add).select("c", "k", "role", "text")
    heads = placed.where("k < 3 AND c % 20 = 0").withColumnRenamed("c", "b").join(based.where("m > 0"), "b").where("k < m").select("c", (F.col("k") + 1).alias("d"), "role", "text")
    own = placed.join(based, "c").where("k >= h").select("c", (F.col("k") - F.col("h") + F.col("m") + 1).alias("d"), "role", "text")
    return heads.unionByName(own), based.select("c", "length")


def _verified(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns(c, d, f, p, role, text, ...)`` with ``cls, pcls``: equal (d, f, cls) are equal prefixes; ``pcls`` is the class of the turn before."""
    current = turns.withColumns({"cls": F.lit(""), "pcls": F.lit("")})
    for turn in itertools.count():
        group = ["d", "f", "cls"]
        variants = current.groupBy(*group, "p", "pcls", "role", "text").agg(F.min("c").alias("first"))
        mixed = scratch.save(variants.groupBy(*group).agg(F.min("first").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), f"mixed-{turn}")
        if mixed.isEmpty():
            return current
        rep = current.join(mixed, group).where("c = rep").select(*group, F.struct("p", "pcls", "role", "text").alias("wanted"))
        wrong = current.join(rep, group).where(F.struct("p", "pcls", "role", "text") != F.col("wanted")).groupBy("c").agg(F.min("d").alias("at"))
        at = F.coalesce("at", F.lit(1 << 62))
        split = lambda name, d: F.concat(name, F.when(d >= at, "1").otherwise("0"))
        current = scratch.save(current.join(wrong, "c", "left").withColumns({"cls": split("cls", F.col("d")), "pcls": split("pcls", F.col("d") - 1)}).drop("at"), f"split-{turn}")


def _ends(members: DataFrame) -> DataFrame:
    """``members(conv_id, depth, c)`` -> the hash of each node's ids in order: sorted by ranges into pieces, and those hashed one after the other."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pid, n = ["conv_id", "depth", "pid", "n", "ids"], TaskContext.get().partitionId(), 0
        node, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, pid, n, ",".join(held))], names)

        for batch in batches:
            for conv, depth, c in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "c")), strict=True):
                if held and ((conv, depth) != node or size > PIECE):
                    yield row()
                    held, size, n = [], 0, n + 1
                node = (conv, depth)
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["conv_id", "depth", "ends_sha256"])
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["conv_id", "depth", "ends_sha256"])

    keys = ["conv_id", "depth", "c"]
    cut = members.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "conv_id long, depth long, pid long, n long, ids string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "pid", "n").mapInArrow(hashes, "conv_id long, depth long, ends_sha256 string")


def _path_totals(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """``paths(conv_id, parent, saved, leaves)`` -> the sums over each path and all below it, by pointer doubling."""
    current = scratch.save(paths.select("conv_id", F.col("parent").alias("jump"), "saved", "leaves"), "paths-0")
    for turn in itertools.count(1):
        moving = current.where("jump IS NOT NULL")
        if moving.isEmpty():
            return current.select("conv_id", "saved", "leaves")
        below = moving.groupBy(F.col("jump").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        further = current.select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        step = current.join(below, "conv_id", "left").join(further, "jump", "left")
        current = scratch.save(step.select("conv_id", F.col("next").alias("jump"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), f"paths-{turn}")


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch | None = None, bits: int = BITS) -> DataFrame:
    """``turns(c, d, role, text)``, d from 1 without gaps, and ``lengths(c, length)`` -> a row for each node.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``;
    ``bits`` of the fingerprints are used (fewer make more collisions, never other results).
    """
    scratch, mask = scratch or Scratch(turns.sparkSession, "trie"), (1 << bits) - 1
    held, add = _scanned(turns.select("c", "d", "role", "text"), ["d"], scratch, "scanned")

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fingerprint up to a turn and that before it, and the words of its text."""
        for batch in batches:
            roles, texts = (batch.column(x).cast(pa.binary()).to_pylist() for x in ("role", "text"))
            k, s = batch.column("k").to_numpy(), batch.column("s").to_numpy().view(np.uint64)
            powers = np.array([pow(BASE, i, 1 << 64) for i in k.tolist()], dtype=np.uint64)
            p = s - turn_hashes(roles, texts) * powers
            f, p = (x & np.uint64(mask) for x in (s, p))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("c", "d", "role", "text")), pa.array(f.view(np.int64)), pa.array(p.view(np.int64)), pa.array([len(t.split()) for t in texts], pa.int64())], ["c", "d", "role", "text", "f", "p", "words"])

    marked = _placed(held, add).select("c", "d", "role", "text", "k", "s").mapInArrow(before, "c long, d long, role string, text string, f long, p long, words long")
    zero, none = F.lit(0).cast("long"), F.lit("")
    roots = lengths.select("c", zero.alias("d"), none.alias("role"), none.alias("text"), zero.alias("f"), zero.alias("p"), zero.alias("words"))
    rows = _verified(scratch.save(marked.unionByName(roots), "marked"), scratch)

    group = ["d", "f", "cls"]
    found = rows.groupBy(*group).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p").alias("p"), F.min("pcls").alias("pcls"), F.max("words").alias("words"))
    named = scratch.save(found, "named")
    above = named.select((F.col("d") + 1).alias("d"), F.col("f").alias("p"), F.col("cls").alias("pcls"), F.col("conv_id").alias("parent_conv_id"))
    linked = scratch.save(named.join(above, ["d", "p", "pcls"], "left").select(*group, "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own")), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    zeros = lambda c: F.coalesce(c, zero)
    nodes = scratch.save(linked.join(children, ["conv_id", "depth"], "left").withColumns({"n_children": zeros("n_children"), "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")}), "nodes")

    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("parent"), F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    paths = scratch.save(paths, "paths")
    totals = _path_totals(paths, scratch).join(paths.select("conv_id", "top", "parent"), "conv_id").where("parent IS NOT NULL")
    hanging = totals.groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    weighed = nodes.join(hanging, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("own") + zeros("s")).alias("saved"), (F.col("leaf") + zeros("l")).alias("leaves"))
    summed = running(weighed, ["conv_id"], ["depth"], {"deeper_saved": F.col("saved"), "deeper_leaves": F.col("leaves")}, descending=True)

    last = rows.select("c", *group).join(lengths.select("c", F.col("length").alias("d")), ["c", "d"])
    ends = _ends(last.join(named.select(*group, "conv_id"), group).select("conv_id", F.col("d").alias("depth"), "c"))
    out = summed.join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("deeper_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("deeper_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``(conv_id, turn, role, text)``."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, lengths = rebuilt(conversations, scratch)
    return prefix_trie(turns, lengths, scratch, bits)
