"""SimHash, packing, token counts and decontamination against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from conefix.llm import decontaminate, packing, simhash, tokens
from conefix.llm.components import components
from conefix.llm.queries import tokenizer_path
from conefix.session import Scratch

WORDS = "the of and ring threndwh der über élan ñandú ing stone river KEY Lamp x9 42 don't".split()


def texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", "  ", "one", "one two", "ONE two"]
    while len(out) < n:
        if len(out) > 12 and rng.random() < 0.4:
            words = (rng.choice(out[6:]) or "x").split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 20, 200]))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(prints: dict[int, int], radius: int) -> dict[int, int]:
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_matches_brute_force(spark):
    rows = list(enumerate(texts(300)))
    got = {r["doc_id"]: (r["sketch"].hex(), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows), simhash.Scheme()).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    want = closure(prints, 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 9]))) for i in range(150)}
    prints = {i: p for i, p in {p: (i, p) for i, p in prints.items()}.values()}
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in prints.items()], "node long, sketch binary")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, simhash.Scheme()), Scratch(spark, "t")).collect()}
    assert {i: roots.get(i, i) for i in prints} == closure(prints, 3)


@pytest.mark.parametrize("radius", [1, 3, 6, 12])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 256, (1, 16), dtype=np.uint8)
    flips = rng.random((150, 128)) < rng.choice([0.0, 0.02, 0.05, 0.5], (150, 1))
    sketch = np.packbits(np.unpackbits(base, axis=1) ^ flips, axis=1)
    got = {(i, int(j)) for i, near in simhash.survivors(sketch, radius, tile=40) for j in near}
    bits = np.unpackbits(sketch, axis=1).astype(int)
    far = (bits[:, None] != bits[None]).sum(2)
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if far[i, j] <= radius}


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals[:20]):
        near = list(w)
        near[rng.randrange(200)] = "changed"
        rows.append((100 + i, " ".join(near)))
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, rows), simhash.scheme_for(0.8)).collect()}
    assert kept == set(range(40))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_near_duplicate_stage_follows_exact_similarity(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CLUSTER_ROWS", chunk)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 2 * chunk)
    rng, rows = random.Random(6), []
    for group in range(60):
        base = [f"w{group}x{i}" for i in range(rng.choice([7, 12, 24, 29, 60, 70, 84, 150, 270, 700]))]
        rows.append(base)
        for _ in range(4):
            near = list(base)
            cut = max(1, int(len(near) * rng.choice([0.04, 0.1, 0.11, 0.12, 0.13, 0.2])))
            rows.append(near[cut:] if rng.random() < 0.5 else [f"n{rng.random()}"] * cut + near[cut:])
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900 + i, f"{line} " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(12)]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, rows), simhash.scheme_for(0.8)).collect()}
    assert kept == set(root.values()) and 0 < len(rows) - len(kept) < 240


def test_near_copies_at_the_bound_are_found(spark):
    """Pairs at 0.80 to 0.83 of whole sets, against all pairs: at least nine of ten, here all, as every link is exact."""
    rng, rows = random.Random(15), []
    for group in range(40):
        base = [f"b{group}x{i}" for i in range(rng.choice([80, 160, 300]))]
        rows.append(" ".join(base))
        n = len(base) - 4
        tail = int(n * rng.uniform(0.17, 0.2))
        rows.append(" ".join(base[:-tail]))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in rows]
    near = [i for i in range(0, 80, 2) if 10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1])]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, list(enumerate(rows))), simhash.scheme_for(0.8)).collect()}
    assert len(near) > 20 and [i for i in near if found[i + 1] != i] == [] and all(found[i + 1] == i + 1 for i in range(0, 80, 2) if i not in near)


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four five six", 1), ("a", "one two three four five six", 2), (None, "one two three four five six", 3), ("c", "other words stand here for once", 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, sketch int")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, simhash.Scheme()).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c")}
    assert {r["doc_id"] for r in simhash.keep_first(docs, simhash.scheme_for(0.8)).collect()} == {"a", None, "c"}
    path = tokenizer_path("byte_bpe_50k.json")
    assert sorted(str(r["doc_id"]) for r in packing.pack(docs, path).collect()) == ["None", "a", "b", "c"]
    assert sorted(str(r["doc_id"]) for r in tokens.token_counts(docs, tokenizer_path("word_bpe_49k.json")).collect()) == ["None", "a", "b", "c"]
    bench = spark.createDataFrame([("q", "one two three"), (None, "other words")], "item_id string, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {"b": (3, 1), "a": (3, 1), None: (3, 1), "c": (2, 0)}


def test_scheme_recall_counts_radius_and_tables():
    scheme = simhash.Scheme(words=5, lanes=12, radius=126, distinct=True)
    assert 0.75 < scheme.recall(0.8) < 0.9 < simhash.scheme_for(0.8).recall(0.8) and simhash.Scheme(radius=200, lanes=12, width=24).recall(0.8) < simhash.Scheme(radius=200, lanes=12).recall(0.8)


def test_components_with_a_hub(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randrange(60, 90), rng.randrange(60, 90)) for _ in range(20)] + [(200, 201)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {i: roots.get(i, i) for i in root} == root


def test_simhash_of_an_empty_table(spark):
    assert simhash.keep_first(frame(spark, [(1, "a")]).limit(0), simhash.scheme_for(0.8)).count() == 0
    assert simhash.near_duplicates(frame(spark, [(1, "a")]).limit(0), simhash.Scheme()).count() == 0


def test_packing_round_trip(spark):
    rows = [*enumerate(texts(60)), (70, "long words " * 3000), (71, "a<|endoftext|>b"), (72, "Ωμέγα 漢字 é")]
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = [r.asDict() for r in packing.pack(frame(spark, rows), path, with_ids=True).collect()]
    slow = Tokenizer.from_file(path)
    for doc, text in rows:
        want = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == want.tobytes()
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert all(p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in own)
    windows: dict[int, list] = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    filled = []
    for _, parts in sorted(windows.items()):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        filled.append(at)
    assert set(filled[:-1]) <= {2048} and filled[-1] <= 2048 and sorted(windows) == list(range(len(windows)))
    whole = packing.sequences(packing.pack(frame(spark, rows), path, with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_packing_of_very_long_runs(spark):
    rows = [(1, " " * 1_200_000), (2, "\n" * 1_200_000), (3, "x" * 200_000), (4, "a b"), (4, "a b")]
    path = tokenizer_path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(frame(spark, rows), path).collect()}
    assert got == {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0


def test_fast_encoder_equals_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), tokens.byte_encoder(path)
    for text in ["", " ", "\n\n a  b\t", "It's I'LL we've 12345 ...!!", "naïve  Ñandú—x", "a b c", "<|endoftext|><|endoftext|> x", "\x00\x1f x\x85y", "αβγ ½ ²", "e" * 5000]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text


def test_token_counts_of_long_and_odd_texts(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    odd = ["a<|startoftext|>b <|endoftext|>", "it's 12 IT'S", "é ́x  y", "x" * 300, "a\x0bb\x1cc\x85d\xa0e\u2028f \u0301g h\u0301 \u03a3\u03a3 \u03a3", " ".join(["Straße don't 99%"] * 400), None, ""]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 3)
    for _ in range(2):
        assert tokens.counts([(t or "").encode() for t in odd], path) == [len(slow.encode(t or "", add_special_tokens=False).ids) for t in odd]
    got = {r["doc_id"]: r for r in tokens.token_counts(frame(spark, list(enumerate(odd))), path, limit=100).collect()}
    for i, t in enumerate(odd):
        n = len(slow.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)


def hit_words(text: str | None, items: list[tuple[int, str | None]]) -> tuple[list[bool], set[int]]:
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, found = cut(text), set()
    hit = [False] * len(words)
    for item, body in items:
        own = cut(body)
        n = min(13, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                found.add(item)
                hit[i : i + n] = [True] * n
    return hit, found


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination_matches_brute_force(spark, monkeypatch, bound):
    """By the broadcast set, and by the join beyond its bound, with hot windows and copies joined in place."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 14)
    monkeypatch.setattr("conefix.llm.skew.HOT_ROWS", 2)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([30, 13, 14, 5, 2, 40, 13])] + [(50, None), (51, "..."), (3, "again the same id")]
    rows = list(enumerate(texts(60, 2)))
    rows += [(200 + i, rows[6][1]) for i in range(5)] + [(300, None), (301, "")]
    rows += [(100 + i, "intro! " + (t or "").upper() + " … and more " * (20 * i)) for i, (_, t) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, rows), bench).collect()}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_documents(frame(spark, rows), bench).collect()}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, rows), bench).collect()}
    for doc, text in rows:
        hit, found = hit_words(text, items)
        bad = any(hit) and 20 * sum(hit) >= len(hit)
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(hit), sum(hit), len(found), bad)
        assert (doc in clean) == (not bad)
        assert len(decontaminate.words((cut[doc] or "").encode())) <= len(hit) - sum(hit)


def test_decontamination_with_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_words long, marks string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, none).collect() == docs.collect()
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
