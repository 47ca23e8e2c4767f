"""SimHash near-duplicates with bit-sliced comparison.

A document becomes a sketch of 64 or more bits, the majority vote of its
shingles' hashes. Distinct sketches are dealt into buckets that any two close
sketches share, and each bucket is compared with its bit planes stored
vertically: one machine word holds the same bit of 64 sketches, the distances
of all lanes are counted by carry-save adders, and rows are abandoned as soon as
every lane has gone beyond the radius.

Nothing here is quadratic in a group of equal documents (they share one sketch)
and no pair list leaves a bucket: it emits a spanning forest of its links.
Buckets above ``BUCKET_ROWS`` are dealt as pairs of chunks over several tasks,
so all of their links are still found.

Nulls and texts without words have the zero sketch and are alike. Rows with a
null doc_id get a sketch and the component of that sketch. Ids keep their type.

``keep_first`` deletes by the exact Jaccard similarity of shingle sets. Two sets of at
least that similarity share one of their first shingles in any common order (prefix
filter), so buckets of such shingles lose no pair. The order puts shingles last whose
place in a table of counts over all documents is full, so that common passages make no
buckets. Within a bucket the bit-sliced comparison puts sketches aside that are six
standard deviations beyond the bound; sets too small for a sketch are compared
themselves. What is left forms clusters, and within a cluster every link is confirmed
on the sets before it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values
from conefix.llm.components import components
from conefix.session import Scratch

#: Rows of one bucket that one task compares; larger buckets are cut into chunks.
BUCKET_ROWS = 4096
#: Small buckets are compared together in blocks of about this many rows.
BLOCK_ROWS = 256
#: Query rows that are compared with all lanes of a block at a time.
TILE_ROWS = 512
#: Rows up to which the table of oversized buckets may be broadcast.
BROADCAST_ROWS = 100_000
#: Bits of a shingle's hash that are its place in the table of counts; the table's size is fixed by it.
COUNT_BITS = 18
#: Sets below this many shingles are compared themselves, as a sketch of few votes says little.
SMALL_SET = 64
#: Rows and shingles of a cluster that one task confirms against one another; larger clusters are cut into chunks.
CLUSTER_ROWS = 2048
CLUSTER_SHINGLES = 2_000_000
#: Similarities are compared with this slack, for fractions that have no exact float.
SLACK = 1e-9
SEED = 42

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Byte b -> a word whose eight bytes are the bits of b, so that sums of up to 255 words count bits bytewise.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None] * np.array([1, 0, 0, 0, 0, 0, 0, 0], dtype=np.uint8), axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


@dataclass(frozen=True)
class Scheme:
    """What is hashed and what counts as close.

    words: words of a shingle. lanes: 64-bit words of a sketch. radius: largest
    number of differing bits. distinct: whether a repeated shingle votes once.
    similarity: the Jaccard similarity of shingle sets that ``keep_first`` confirms.
    width: bits of a probe key where the radius is too large for an exact choice of
    runs; wider keys make smaller buckets and find fewer pairs.
    """

    words: int = 3
    lanes: int = 1
    radius: int = 3
    distinct: bool = False
    similarity: float = 0.8
    width: int = 16

    def masks(self) -> list[list[tuple[int, int]]]:
        """Per probe table, the (first bit, bits) runs that two close sketches may share.

        With radius r, the bits are cut into r + 2 runs: of these at least two
        are untouched, so each pair of runs is a table and no close pair is
        lost. Above radius 8 the tables are runs of ``width`` bits; then a pair is found
        with the probability given in ``recall``.
        """
        bits = 64 * self.lanes
        if self.radius <= 8:
            cuts = [bits * i // (self.radius + 2) for i in range(self.radius + 3)]
            runs = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            return [list(x) for x in combinations(runs, 2)]
        return [[(i, self.width)] for i in range(0, bits - self.width + 1, self.width)]

    def recall(self, similarity: float) -> float:
        """Probability that ``near_duplicates`` links a pair of this Jaccard similarity: within the radius, and with a probe table in common."""
        p, bits = turn_of(similarity), 64 * self.lanes
        within = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(self.radius + 1))
        return within if self.radius <= 8 else within * (1 - (1 - (1 - p) ** self.width) ** len(self.masks()))


def turn_of(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of shingle sets."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def scheme_for(similarity: float, words: int = 5, lanes: int = 12) -> Scheme:
    """A wide sketch whose radius takes pairs of ``similarity`` with six standard deviations to spare."""
    bits, p = 64 * lanes, turn_of(similarity)
    return Scheme(words=words, lanes=lanes, radius=int(bits * p + 6 * math.sqrt(bits * p * (1 - p))), distinct=True, similarity=similarity)


def shingles(text: bytes, k: int) -> Iterable[bytes]:
    """Space-joined k-word shingles of a UTF-8 text with A-Z lower-cased; fewer words: all of them."""
    words = text.lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of a further lane, from those of the first."""
    if not lane:
        return h
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hashes(texts: list[bytes], scheme: Scheme) -> list[np.ndarray]:
    """The hashes of each text's shingles."""
    digest, parts = xxhash.xxh64_intdigest, []
    for text in texts:
        grams = shingles(text, scheme.words)
        if scheme.distinct:
            grams = set(grams)
        parts.append(np.fromiter((digest(s, SEED) for s in grams), dtype=np.uint64))
    return parts


def sketches(texts: list[bytes], scheme: Scheme) -> np.ndarray:
    """(documents, 8 * lanes) bytes, the most significant first: a bit is set in over half the hashes."""
    return votes_of(hashes(texts, scheme), scheme)


def votes_of(parts: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """The sketches of documents given as hashes of shingles."""
    sizes = [len(part) for part in parts]
    out = np.zeros((len(parts), scheme.lanes), dtype=">u8")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.uint8).reshape(len(parts), -1)
    h, n = np.concatenate(parts), np.array(sizes)[full]
    ends = np.cumsum(n)
    chunks = -(-n // 255)
    first = np.cumsum(chunks) - chunks
    at = np.repeat(ends - n, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    for lane in range(scheme.lanes):
        spread = _SPREAD[_mixed(h, lane).view(np.uint8)].reshape(-1, 8)
        counts = np.add.reduceat(spread, at, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
        votes = np.add.reduceat(counts, first, axis=0)
        out[full, lane] = np.packbits(votes * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.uint8).reshape(len(parts), -1)


def _planes(bits: np.ndarray) -> np.ndarray:
    """(bits, words): plane b holds bit b of 64 sketches in each word."""
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = -(-packed.shape[1] // 8)
    out = np.zeros((packed.shape[0], words * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: three words of equal weight into a sum and a carry."""
    u = a ^ b
    carry = a & b
    carry |= u & c
    u ^= c
    return u, carry


def survivors(sketch: np.ndarray, radius: int, tile: int = TILE_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows within ``radius`` differing bits, from (rows, bytes) uint8."""
    m = len(sketch)
    bits = np.unpackbits(sketch, axis=1)
    planes, total = _planes(bits), bits.shape[1]
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius
    for a in range(0, m, tile):
        rows = np.arange(a, min(a + tile, m))
        word = a // 64
        lanes = planes[:, word:]
        query = np.where(bits[rows].T, _ALL, np.uint64(0))
        dead = np.packbits(np.arange(64 * word, 64 * planes.shape[1])[None, :] <= rows[:, None], axis=1, bitorder="little").view(np.uint64)
        if m % 64:
            dead[:, -1] |= _ALL << np.uint64(m % 64)
        # Counters start at the spare, so that the carry out of the last one means "beyond the radius".
        counts = [np.full(dead.shape, _ALL if spare >> i & 1 else 0, dtype=np.uint64) for i in range(width)]
        waiting: list[np.ndarray | None] = [None] * width
        for b in range(total):
            x = lanes[b][None, :] ^ query[b][:, None]
            for i in range(width):
                if waiting[i] is None:
                    waiting[i] = x
                    break
                counts[i], x = _csa(counts[i], waiting[i], x)
                waiting[i] = None
            else:
                dead |= x
                keep = np.flatnonzero((dead != _ALL).any(axis=1))
                if len(keep) < len(rows):
                    rows, dead, query = rows[keep], dead[keep], query[:, keep]
                    counts = [c[keep] for c in counts]
                if not len(rows):
                    break
        else:
            for i in range(width):
                x = waiting[i]
                for j in range(i, width):
                    if x is None:
                        break
                    counts[j], x = counts[j] ^ x, counts[j] & x
                if x is not None:
                    dead |= x
        for row, lane in zip(rows, ~dead, strict=True):
            found = np.flatnonzero(np.unpackbits(lane.view(np.uint8), bitorder="little"))
            if len(found):
                yield int(row), found + 64 * word


def forest(ids: np.ndarray, sketch: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it within this block), for nodes that have one."""
    order = np.argsort(ids, kind="stable")
    label = np.arange(len(ids))
    for row, near in survivors(sketch[order], radius):
        held = np.unique(np.append(label[near], label[row]))
        if len(held) > 1:
            label[np.isin(label, held)] = held[0]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order][moved], ids[order][label[moved]]


def sketch_documents(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, sketch binary)``, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out = sketches(values(batch, "text"), scheme)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "sketch"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sketch binary")


def _probe(scheme: Scheme, with_sketch: bool):
    masks = scheme.masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                raw, n = batch.column("sketch").to_pylist(), batch.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(n, -1), axis=1)
                keys = []
                for runs in masks:
                    part = np.concatenate([bits[:, a : a + k] for a, k in runs], axis=1).astype(np.int64)
                    keys.append(part @ (1 << np.arange(part.shape[1], dtype=np.int64)))
                cols = [pa.array(np.repeat(np.arange(len(masks), dtype=np.int32), n)), pa.array(np.concatenate(keys))]
                names = ["tab", "key"]
                if with_sketch:
                    take = pa.array(np.tile(np.arange(n), len(masks)))
                    cols += [batch.column("node").take(take), batch.column("sketch").take(take)]
                    names += ["node", "sketch"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[np.ndarray] = []
        held_sk: list[np.ndarray] = []
        held_key: list[np.ndarray] = []

        def compare(ids: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
            u, v = forest(ids, sk, radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Compare whole buckets; what may go on in the next batch stays."""
            if not held_ids:
                return
            ids, sk, key = np.concatenate(held_ids), np.concatenate(held_sk), np.concatenate(held_key)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(ids))
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            many = ends - starts > 1
            rows = np.repeat(many, ends - starts)
            size, at = (ends - starts)[many], 0
            ids_in, sk_in = ids[:done][rows], sk[:done][rows]
            cut = 0
            for n in size:
                if at + n - cut > BLOCK_ROWS and at > cut:
                    yield compare(ids_in[cut:at], sk_in[cut:at])
                    cut = at
                at += int(n)
            if at > cut:
                yield compare(ids_in[cut:at], sk_in[cut:at])
            held_ids[:], held_sk[:], held_key[:] = [ids[done:]], [sk[done:]], [key[done:]]

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("sketch").to_pylist()
            held_sk.append(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1))
            held_ids.append(batch.column("node").to_numpy())
            held_key.append(np.stack([batch.column(c).to_numpy() for c in ("tab", "key", "lo", "hi")], axis=1))
            yield from ready(False)
        yield from ready(True)

    return run


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``nodes(node long, sketch binary)`` of distinct sketches -> spanning links ``(u, v)``."""
    probes = nodes.mapInArrow(_probe(scheme, True), "tab int, key long, node long, sketch binary")
    sizes = nodes.mapInArrow(_probe(scheme, False), "tab int, key long").groupBy("tab", "key").count()
    wide = sizes.where(F.col("count") > BUCKET_ROWS).select("tab", "key", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts"))
    if wide.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wide = F.broadcast(wide)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (
        probes.join(wide, ["tab", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("tab", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "sketch")
    )
    spread = dealt.repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi")
    return spread.mapInArrow(_linker(scheme.radius), "u long, v long")


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes(node, doc_id)`` and ``roots(node, root)`` -> ``(node, component_id)``: the least doc_id of each node's component."""
    named = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.select("node", "root").join(first, "root").select("node", "component_id")


def near_duplicates(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, sketch, component_id)``: the smallest doc_id that links reach, itself included."""
    scratch = Scratch(docs.sparkSession, "simhash")
    held = scratch.save(sketch_documents(docs, scheme, key, text), "sketches")
    # A sketch of one word is its own number; wider ones are numbered by a hash.
    number = F.conv(F.hex("sketch"), 16, -10).cast("long") if scheme.lanes == 1 else F.xxhash64("sketch")
    nodes = scratch.save(held.groupBy("sketch").agg(F.min("doc_id").alias("doc_id")).withColumn("node", number), "nodes")
    roots = components(links(nodes.select("node", "sketch"), scheme), scratch)
    named = nodes.select("node", "sketch").join(_named(nodes, roots), "node").select("sketch", "component_id")
    return held.join(named, "sketch").select("doc_id", "sketch", "component_id")


def prefix_size(n: int, similarity: float) -> int:
    """How many first shingles of n, in an order that all sets share, meet those of any set of this similarity."""
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def _tree(n: int, near) -> tuple[list[int], list[int]]:
    """A spanning forest: ``near(row, others)`` says which of the others a row is linked to; linked rows are not compared again."""
    tails, heads, rest = [], [], np.arange(n)
    while len(rest) > 1:
        waiting, rest = [int(rest[0])], rest[1:]
        while waiting and len(rest):
            row = waiting.pop()
            hit = near(row, rest)
            if hit.any():
                found = rest[hit].tolist()
                heads += found
                tails += [row] * len(found)
                waiting += found
                rest = rest[~hit]
    return tails, heads


def near_sets(payload: list[bytes], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the sets of at least this Jaccard similarity."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in payload]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner, mark = np.repeat(np.arange(len(sets)), sizes), np.zeros(len(known), dtype=bool)
    held = {"n": len(sets), "flat": flat, "owner": owner}

    def near(row: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) * 2 < held["n"]:  # leave out the rows that are linked by now
            kept = np.isin(held["owner"], rest)
            held.update(n=len(rest), flat=held["flat"][kept], owner=held["owner"][kept])
        own = flat[ends[row] - sizes[row] : ends[row]]
        mark[own] = True
        common = np.bincount(held["owner"][mark[held["flat"]]], minlength=len(sets))[rest]
        mark[own] = False
        return common >= similarity * (sizes[row] + sizes[rest] - common) - SLACK

    return _tree(len(sets), near)


def shingle_weights(rows: DataFrame, scheme: Scheme) -> np.ndarray:
    """How full each place of the table of counts is: 0 below twice the mean, then one more with each doubling. Counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = hashes(values(batch, "text"), scheme)
                if found:
                    total += np.bincount((np.concatenate(found) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        full = np.flatnonzero(total)
        for a in range(0, len(full), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(full[a : a + 100_000]), pa.array(total[full[a : a + 100_000]])], ["place", "n"])

    counts = rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    n[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    mean = max(float(n.mean()), 1.0)
    return np.floor(np.log2(np.maximum(n / mean, 1.0))).astype(np.uint8)


def _set_rows(scheme: Scheme, weights: np.ndarray):
    """doc_id, node (a digest of the set), n, the first shingles, a sketch (larger sets) or the set (smaller ones)."""

    def first(x: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, weights[(x >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
        return x[order[: prefix_size(len(x), scheme.similarity)]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [np.sort(x) for x in hashes(values(batch, "text"), scheme)]
                prints = votes_of(sets, scheme)
                cols = [
                    batch.column("doc_id"),
                    pa.array([_node(x) for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([first(x) for x in sets], pa.list_(pa.int64())),
                    pa.array([p.tobytes() if len(x) >= SMALL_SET else None for x, p in zip(sets, prints, strict=True)], pa.binary()),
                    pa.array([x.tobytes() if len(x) * scheme.similarity < SMALL_SET + 1 else None for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "first", "sketch", "members"])

    return run


def _node(ordered: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(ordered.tobytes(), SEED)).astype(np.int64))


def _buckets(nodes: DataFrame) -> DataFrame:
    """``nodes(node, first)`` -> ``(bucket, node)``: the nodes that share a token, buckets of equal members once.

    Tokens are counted, and their members digested, before the shuffle, so a token of very many
    nodes is a row of each task; its nodes are then joined in parts, as adaptive execution splits them.
    """
    shared = nodes.select("node", F.explode("first").alias("token"))
    members = shared.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    named = members.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    return shared.join(named, "token").select(F.col("token").alias("bucket"), "node")


def _compared(compare):
    """Sorted (key, lo, hi, node, sketch) -> links within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out_u, out_v = None, {}, [], []

        def close() -> None:
            if len(held) > 1:
                ids = list(held)
                tails, heads = compare(list(held.values()))
                out_u.extend(ids[i] for i in tails)
                out_v.extend(ids[i] for i in heads)
            held.clear()

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)
            for own, node, payload in zip(keys, batch.column("node").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                if own != key:
                    close()
                    key = own
                held[node] = payload
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])
            out_u, out_v = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return run


def _linked(groups: DataFrame, payloads: DataFrame, run, parts) -> DataFrame:
    """``groups(bucket, node, n)`` and ``payloads(node, sketch)`` -> links by the Arrow function ``run``; groups of several ``parts`` are dealt as pairs of chunks."""
    wide = groups.groupBy("bucket").agg(F.ceil(parts).cast("int").alias("parts")).where("parts > 1")
    if wide.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wide = F.broadcast(wide)
    dealt = (
        groups.join(wide, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node")
    )
    ready = dealt.join(payloads, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return ready.select(F.lit(0).alias("tab"), F.col("bucket").alias("key"), "lo", "hi", "node", "sketch").mapInArrow(run, "u long, v long")


def _set_of(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [np.sort(x) for x in hashes(values(batch, "text"), scheme)]
                same = pa.array([_node(x) == node for x, node in zip(sets, batch.column("node").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "sketch"]).filter(same)

    return run


def similar(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: the smallest doc_id that links of at least ``scheme.similarity`` reach, for rows with a doc_id."""
    scratch, least = Scratch(docs.sparkSession, "similar"), scheme.similarity
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = scratch.save(rows.mapInArrow(_set_rows(scheme, shingle_weights(rows, scheme)), f"doc_id {kind}, node long, n long, first array<bigint>, sketch binary, members binary"), "held")
    nodes = scratch.save(held.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "first", "sketch", "members"))), "nodes")
    groups = scratch.save(_buckets(nodes), "buckets")
    by_sketch = _linked(groups, nodes.where("sketch IS NOT NULL").select("node", "sketch"), _linker(scheme.radius), F.count("*") / BUCKET_ROWS)
    by_set = _linked(groups, nodes.where("members IS NOT NULL").select("node", F.col("members").alias("sketch")), _compared(lambda x: near_sets(x, least)), F.count("*") / BUCKET_ROWS)
    reached = scratch.save(components(by_sketch.unionByName(by_set), scratch, "candidates"), "clusters")
    member = reached.select("node", F.col("root").alias("bucket")).unionByName(reached.select(F.col("root").alias("node"), F.col("root").alias("bucket")).distinct())
    member = scratch.save(member.join(nodes.select("node", "n", "doc_id"), "node"), "members")
    sets = rows.join(member.select("doc_id", "node"), "doc_id").select("node", "text").mapInArrow(_set_of(scheme), "node long, sketch binary")
    parts = F.greatest(F.count("*") / CLUSTER_ROWS, F.sum("n") / CLUSTER_SHINGLES)
    confirmed = _linked(member.select("bucket", "node", "n"), sets, _compared(lambda x: near_sets(x, least)), parts)
    named = _named(nodes, components(confirmed, scratch, "confirmed"))
    return held.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but the smallest doc_id of each group of similar shingle sets; columns as they are.

    Rows without a doc_id stay. Repeated rows of a kept doc_id all stay.
    """
    found = similar(docs, scheme, key, text)
    drop = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__simhash_drop")).distinct()
    return docs.join(drop, F.col(key) == F.col("__simhash_drop"), "left_anti")
