"""Benchmark decontamination: a hash set of normalised test n-grams.

Words are maximal runs of ASCII letters and digits and of all non-ASCII
characters, with A-Z lower-cased. The windows of the benchmark are 13 consecutive
words, or a whole shorter item. Every hit is verified word by word.

Up to ``BROADCAST_BYTES`` of benchmark text the windows are numbered and hashed once on
the driver, broadcast, and looked up block by block. A larger benchmark stays a table.
Of it only a bit filter of fixed size is broadcast: documents send the few windows that
pass it to a shuffled join with that table on the words themselves. Texts are never
shuffled, equal texts meet the table once, and windows that very many documents share are
joined in place, so neither driver nor workers hold more as the benchmark grows.

Null texts have no words. Items without words have no windows, repeated items
count once by item_id, and items with a null id mark words but are not listed. Ids keep
their type. A window's items are a list, as is what the result tells of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from conefix.llm.arrow import slices, small_batches, values
from conefix.llm.skew import join_split
from conefix.session import Scratch

WINDOW = 13
#: Bytes of benchmark text up to which its windows are broadcast.
BROADCAST_BYTES = 2 << 20
#: Bits of the filter that is broadcast beyond, whatever the size of the benchmark.
FILTER_BITS = 26
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 500_000
#: A document is contaminated if hit words are at least one in this many.
SHARE = 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_TABLE).split()


def _mixed(rows: np.ndarray, factors: np.ndarray) -> np.ndarray:
    z = (rows.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    return z ^ (z >> np.uint64(29))


class Grams:
    """The windows of some benchmark items, by length, as sorted hashes with exact words behind them."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, seed: int = 7):
        self.ids: dict[bytes, int] = {}
        sets: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            n = min(window, len(row))
            for i in range(len(row) - n + 1 if n else 0):
                sets.setdefault(n, {}).setdefault(tuple(row[i : i + n]), set()).add(item)
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[list]]] = []
        for n, grams in sorted(sets.items()):
            rows, found = np.array(list(grams), dtype=np.int64), [[i for i in s if i is not None] for s in grams.values()]
            while True:
                factors = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
                hashes = _mixed(rows, factors)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.tables.append((n, factors, hashes[order], rows[order], [found[i] for i in order]))

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Words of each text; a flag for each word of all texts (with one blank after each text); items by text."""
        split = [words(t) for t in texts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        total = int(sizes.sum()) + len(split)
        flow = chain.from_iterable(chain(s, (b"",)) for s in split)
        ids = np.fromiter(map(self.ids.get, flow, repeat(0)), dtype=np.int64, count=total)
        at = np.arange(total)
        run = at - np.maximum.accumulate(np.where(ids == 0, at, -1))
        change = np.zeros(total + 1, dtype=np.int64)
        items: dict[int, set] = {}
        ends = np.cumsum(sizes + 1)
        for n, factors, hashes, rows, found in self.tables:
            for low in range(0, total, 1 << 20):
                start = low + np.flatnonzero(run[low : low + (1 << 20)] >= n) - n + 1
                if not len(start):
                    continue
                grams = ids[start[:, None] + np.arange(n)]
                h = _mixed(grams, factors)
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[place] == h)
                hit = hit[(rows[place[hit]] == grams[hit]).all(axis=1)]
                np.add.at(change, start[hit], 1)
                np.add.at(change, start[hit] + n, -1)
                pairs = np.unique(np.stack([np.searchsorted(ends, start[hit], side="right"), place[hit]], axis=1), axis=0)
                for doc, gram in pairs.tolist():
                    items.setdefault(doc, set()).update(found[gram])
        return sizes, np.cumsum(change[:-1]) > 0, items


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of runs of hit words, and the words behind them."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return turns[::2], turns[1::2]


def _marks_in_place(rows: DataFrame, grams: Grams, kind: str, item_kind) -> DataFrame:
    item_type, ints = to_arrow_type(item_kind), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, flags, items = grams.scan(values(batch, "text"))
                cuts = np.cumsum(sizes + 1) - sizes - 1
                found = [_spans(flags[a : a + n]) for a, n in zip(cuts, sizes, strict=True)]
                columns = [pa.array(sizes), pa.array([s for s, _ in found], ints), pa.array([e for _, e in found], ints), pa.array([sorted(items.get(i, ())) for i in range(len(sizes))], pa.list_(item_type))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "n_words", "starts", "ends", "items"])

    return rows.mapInArrow(run, f"doc_id {kind}, text binary, n_words long, starts array<bigint>, ends array<bigint>, items array<{item_kind.simpleString()}>")


# --- beyond the broadcast ------------------------------------------------------

_KNOWN: dict[bytes, int] = {}


def _word_hashes(split: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > KNOWN_WORDS:
        _KNOWN.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(split).difference(_KNOWN):
        _KNOWN[w] = digest(w)
    return np.fromiter(map(_KNOWN.__getitem__, split), dtype=np.uint64, count=len(split))


def window_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words, from the words' hashes; the same everywhere."""
    factors = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(max(len(hashed) - n + 1, 0), dtype=np.uint64)
    for i, factor in enumerate(factors):
        out += hashed[i : i + len(out)] * factor
    return out ^ (out >> np.uint64(29))


def _filter_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``items(item, text binary)`` -> ``(gram, n, item, a, b)``: the words of each window, joined by blanks, and its two places in the filter."""
    kind, bits = items.schema["item"].dataType.simpleString(), FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, sizes, owner, places = [], [], [], []
                for i, text in enumerate(values(batch, "text")):
                    split = words(text)
                    n = min(window, len(split))
                    if n:
                        own = [b" ".join(split[k : k + n]) for k in range(len(split) - n + 1)]
                        grams += own
                        sizes += [n] * len(own)
                        owner += [i] * len(own)
                        places.append(np.stack(_filter_places(window_hashes(_word_hashes(split), n), bits)))
                ab = np.concatenate(places, axis=1).astype(np.int64) if places else np.zeros((2, 0), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(sizes, pa.int32()), batch.column("item").take(pa.array(owner, pa.int64())), pa.array(ab[0]), pa.array(ab[1])], ["gram", "n", "item", "a", "b"])

    return items.mapInArrow(run, f"gram binary, n int, item {kind}, a long, b long")


def _filter_of(windows: DataFrame) -> np.ndarray:
    """The bits of all windows, as bytes; its size is that of ``FILTER_BITS``."""
    places = windows.select(F.explode(F.array("a", "b")).alias("p"))
    held = places.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("mask"))
    table = held.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy().astype(np.uint32)
    return out


def _candidates(rows: DataFrame, bits: np.ndarray, lengths: list[int], kind: str) -> DataFrame:
    """``rows(doc_id, digest, text)`` -> the number of words, and the windows that pass the filter: first word and words."""
    size = FILTER_BITS

    def passes(p: np.ndarray) -> np.ndarray:
        return (bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, starts, grams = [], [], []
                for text in values(batch, "text"):
                    split = words(text)
                    hashed, own_s, own_g = _word_hashes(split), [], []
                    for n in lengths:
                        a, b = _filter_places(window_hashes(hashed, n), size)
                        for i in np.flatnonzero(passes(a) & passes(b)).tolist():
                            own_s.append(i)
                            own_g.append(b" ".join(split[i : i + n]))
                    sizes.append(len(split))
                    starts.append(own_s)
                    grams.append(own_g)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.binary()))], ["doc_id", "digest", "n_words", "start", "gram"])

    return rows.mapInArrow(run, f"doc_id {kind}, digest string, n_words long, start array<bigint>, gram array<binary>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hit words from the windows of a text."""
    for batch in batches:
        starts, ends = [], []
        for s, e in zip(batch.column("s").to_pylist(), batch.column("e").to_pylist(), strict=True):
            order = np.argsort(s, kind="stable")
            s, e = np.array(s)[order], np.maximum.accumulate(np.array(e)[order])
            fresh = s[1:] > e[:-1]
            starts.append(s[np.append(True, fresh)])
            ends.append(e[np.append(fresh, True)])
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(starts, ints), pa.array(ends, ints)], ["digest", "n", "starts", "ends"])


def _marks_by_join(rows: DataFrame, items: DataFrame, kind: str, carry: bool) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "decontaminate")
    windows = scratch.save(benchmark_windows(items), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 13 at most
    known = scratch.save(windows.groupBy("gram", "n").agg(F.collect_set("item").alias("items")).withColumnRenamed("n", "size"), "known")
    named = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    scanned = scratch.save(_candidates(named.select("doc_id", "digest", "text"), _filter_of(windows), lengths, kind), "scanned")
    texts = scanned.where(F.size("gram") > 0).groupBy("digest").agg(F.count("*").alias("n"), F.first(F.struct("start", "gram")).alias("w"))
    single = scratch.save(texts.select("digest", "n", F.inline(F.arrays_zip("w.start", "w.gram"))), "passing")
    uses = single.groupBy("gram").agg(F.count("*").alias("n"))
    hits = scratch.save(join_split(single.select("digest", "start", "gram", F.col("n").alias("copies")), known.join(uses, "gram"), "gram", single.count()), "hits")
    spans = hits.groupBy("digest").agg(F.first("copies").alias("n"), F.collect_list("start").alias("s"), F.collect_list(F.col("start") + F.col("size")).alias("e"))
    # A text's own windows bound the lists.
    merged = spans.mapInArrow(_merge, "digest string, n long, starts array<bigint>, ends array<bigint>")
    listed = hits.select("digest", F.explode("items").alias("item")).distinct().groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    item_kind = items.schema["item"].dataType.simpleString()
    found = scratch.save(merged.join(listed, "digest", "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{item_kind}>"))), "found")
    base = named.select("doc_id", "text", "digest") if carry else scanned.select("doc_id", "digest", "n_words")
    out = join_split(base, found, "digest", scanned.count(), "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return out.select(*(c for c in base.columns if c != "digest"), none("starts", "bigint"), none("ends", "bigint"), none("items", item_kind))


# --- results -------------------------------------------------------------------


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", carry: bool = False) -> DataFrame:
    """``(doc_id, n_words or text, starts, ends, items)``: the runs of hit words, by word numbers, and the ids of items with occurring windows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _marks_by_join(rows, items, kind, carry)
    grams = Grams([(r["item"], bytes(r["text"])) for r in items.toLocalIterator()])
    return _marks_in_place(rows, grams, kind, items.schema["item"].dataType).drop("n_words" if carry else "text")


def _hit() -> F.Column:
    return F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row for each document."""
    marked = mark(docs, benchmark, key, text, item)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = marked.select("doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that are not contaminated, unchanged, in all their columns. Equal texts have the same fate."""
    small_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        named = docs.withColumn("\0digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        found = contamination(named, benchmark, "\0digest", text, item)
        gone = found.where("contaminated").groupBy(F.col("doc_id").alias("\0digest")).agg(F.count("*").alias("n"))
        gone = Scratch(docs.sparkSession, "decontaminate").save(gone, "gone")
        return join_split(named, gone, "\0digest", gone.agg(F.sum("n")).first()[0] or 0, "left_anti").select(docs.columns)
    items = benchmark.select(F.col(item).alias("item"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    grams, names = Grams([(r["item"], bytes(r["text"])) for r in items.toLocalIterator()]), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(pa.RecordBatch.from_arrays([*whole.columns, whole.column(text).cast(pa.binary())], [*names, "\0text"]), "\0text"):
                sizes, flags, _ = grams.scan(values(batch, "\0text"))
                hit = np.add.reduceat(flags, np.cumsum(sizes + 1) - sizes - 1, dtype=np.int64)
                yield batch.select(names).filter(pa.array(~((hit > 0) & (hit * SHARE >= sizes))))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the hit words cut out, each run of them with its inner separators."""
    marked = mark(docs, benchmark, key, text, carry=True)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def cut(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
        if not starts:
            return raw
        folded, places, at = raw.translate(_TABLE), [], 0
        for word in folded.split():
            at = folded.index(word, at)
            places.append(at)
            at += len(word)
        places.append(len(raw))
        out, done = [], 0
        for a, b in zip(starts, ends, strict=True):
            out.append(raw[done : places[a]])
            done = places[b]
        return b"".join([*out, raw[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True)
            out = [None if t is None else cut(t, s, e).decode() for t, s, e in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return marked.select("doc_id", "text", "starts", "ends").mapInArrow(run, f"doc_id {kind}, text string")
