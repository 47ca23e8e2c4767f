"""Centroids, chunk recipes and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from conefix.llm import centroids, chunk_dedup, conversation_trie
from conefix.session import Scratch

# --- centroids ---------------------------------------------------------------


def lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    at = [list(q) for _, q in seeds]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds if at else 0):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(at)):
            members = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if members:
                at[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [(i, *near(q)) for i, q in kept] if at else []
    sums = {j: sum(d for _, d, o in last if o == j) for j in range(len(at))}
    top = (1 << 63) - 1
    return sorted(((i, j, min(d, top), min(sums[j], top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def clustered(spark, rows, kind="float", dims=4, **options):
    frame = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, q string, weight int").repartition(3)
    return sorted(map(tuple, centroids.cluster(frame, dims=dims, **options).collect()), key=str)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.4, 4).astype(np.float32)]) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(60)]  # hot vectors


def test_centroids_equal_brute_force(spark):
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (3, [9.0, 9.0, 9.0, 9.0]), (905, [-1.0, -0.0005, 0.0, -7.25])]
    rows = vectors(150, 1) + odd
    assert clustered(spark, rows, k=8, rounds=6) == lloyd(rows, 8, 6, 4)


def test_centroids_with_ties_few_rows_and_none(spark):
    tie = [(i, v) for i, v in enumerate([[0.0] * 4, [2.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0] * 4, [2.0, 0.0, 0.0, 0.0]])]
    for k in (1, 2, 8):
        assert clustered(spark, tie, k=k, rounds=3) == lloyd(tie, k, 3, 4)
    assert clustered(spark, [], k=8) == [] and clustered(spark, [(1, None), (2, [1.0])], k=8) == [] and clustered(spark, [(None, [1.0] * 4)], k=8) == []


def test_centroids_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * s for _ in range(4)]) for i, s in enumerate([1.0, 5e3, 1e6, 1e9, 3e11] * 8)]
    assert clustered(spark, rows, "double", k=4, rounds=4) == lloyd(rows, 4, 4, 4)


# --- chunk recipes -----------------------------------------------------------


def documents(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij éß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", " ", "", "a", "A", "a ", long, long + "x", "x" + long, long[:-1], long, "é" * 9000, "é" * 9000, "é" * 9001, "z" * 200_000, "z" * 200_000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    texts += [rng.choice(texts) for _ in range(60)] + [texts[8]] * 40
    return [(i, t) for i, t in enumerate(texts)]


def deduplicated(spark, rows, width=16):
    frame = spark.createDataFrame([(i, t, "x", b"x", 1) for i, t in rows], "doc_id long, text string, sha string, recipe binary, n int").repartition(4)
    return chunk_dedup.deduplicate(frame, width=width)


def by_text(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("width", [16, 1])
def test_chunk_dedup_equals_grouping_by_text(spark, width):
    """A fingerprint of one byte makes most recipes collide; results stay the same."""
    rows = documents()
    got = deduplicated(spark, rows, width).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == by_text(rows)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({r["keep_id"] for r in got})


def test_chunk_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, "same"), (None, "alone"), (None, "alone"), (None, None)]
    got = deduplicated(spark, rows).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == by_text(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == 4
    assert deduplicated(spark, []).collect() == []


def test_cuts_depend_on_content_alone():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    whole = chunk_dedup.chunks_of([data])[0]
    assert b"".join(whole) == data and all(len(c) <= chunk_dedup.MOST for c in whole) and all(len(c) >= chunk_dedup.LEAST for c in whole[:-1])
    assert chunk_dedup.chunks_of([b"before", data, b"", data])[1::2] == [whole, whole]
    moved = chunk_dedup.chunks_of([rng.integers(0, 256, 777, dtype=np.uint8).tobytes() + data])[0]
    assert len(set(whole) & set(moved)) > 0.9 * len(whole)
    old = chunk_dedup.BLOCK
    try:
        chunk_dedup.BLOCK = 4096
        assert chunk_dedup.chunks_of([data])[0] == whole
    finally:
        chunk_dedup.BLOCK = old


@pytest.mark.parametrize("width", [16, 1])
def test_chunk_store_round_trip(spark, width):
    rows = documents(8)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids, chunks = chunk_dedup.chunk_store(frame, width=width)
    assert sorted((r["doc_id"], r["text"]) for r in chunk_dedup.restored(ids, chunks).collect()) == sorted((i, t) for i, t in rows if t)
    assert chunks.count() == len({c for _, t in rows for c in chunk_dedup.chunks_of([(t or "").encode()])[0]})


# --- trie --------------------------------------------------------------------


def brute_trie(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(r)] for c, r in own.items()}
    full = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members: dict[tuple, list] = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = {k for k in below if len(k) == len(key) + 1}
        leaves = sum(not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode().split()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(key))))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-45, 130)
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi there", "one two  three", "é x y"])))
    return rows + rows[:5] + [(None, 1, "user", "nobody's")]


def trie(spark, rows, bits=64, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, depth int").repartition(parts)
    return sorted(map(tuple, conversation_trie.conversation_trie(frame, bits).collect()), key=str)


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 64), (3, 1), (4, 0)])
def test_trie_equals_brute_force(spark, seed, bits):
    """With one bit or none nearly all prefixes collide and are split again."""
    rows = conversations(seed, 60 if bits > 1 else 14)
    assert trie(spark, rows, bits) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, [], parts=1) == [] and trie(spark, [(None, 0, "user", "x")], parts=1) == []
    rows = [(c, 0, "user", "hello you") for c in range(100, 120)]
    turnless = [c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4 > 0]
    rows = [r for r in rows if r[0] != 100]
    assert trie(spark, rows) == brute_trie(rows) and len(turnless) > 3


def test_trie_of_a_conversation_over_many_ranges(spark):
    """One conversation of 900 turns, its copies, and chains that branch off one another."""
    turns = [(t, "user", f"turn {t} of a long talk") for t in range(900)]
    rows = [(40, *t) for t in turns] + [(41, *t) for t in turns[:500]] + [(c, t, "user", f"{min(t, c)} x" if t < c % 60 else f"own {c}") for c in range(200, 230) for t in range(c % 60 + 1)]
    rows += [(c, t, "user", "all the same here") for c in range(1000, 1090) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pointer_doubling_of_a_deep_chain(spark):
    frame = spark.createDataFrame([(i, i - 1 if i else None, i, 1) for i in range(100)], "conv_id long, parent long, saved long, leaves long")
    got = {r["conv_id"]: (r["saved"], r["leaves"]) for r in conversation_trie._path_totals(frame, Scratch(spark, "test")).collect()}
    assert got == {i: (sum(range(i, 100)), 100 - i) for i in range(100)}
