"""Tokenizers in Arrow functions: token counts, and ids for packing.

Tokenizer files are named by a path parameter and loaded once in each Python
worker. Encoding runs on one thread, as Spark already fills the cores.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values

#: UTF-8 bytes of text in one call of the library.
BATCH_BYTES = 1 << 20
#: Pieces whose counts a worker remembers, and the longest of them in bytes.
KNOWN_PIECES = 400_000
KNOWN_BYTES = 64

#: What the fast encoder is used for; other texts go to the library that owns the file, whose tables of letters are its own.
_PLAIN = re.compile(r"[^\x00-ɏ‐-‧€]")
#: Characters of one run, of white space or of anything else, from which the fast encoder is not used either:
#: its pattern recurses over white space, and merging one long piece is slow. Both libraries give the same ids.
LONG_RUN = 1000
_BLANKS = re.compile(r"\s{64,}")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces_of(text: bytes) -> list[bytes]:
    """A text cut at ASCII white space, the boundaries that no token of the word tokenizer reaches over.

    It drops white space, and neither its normal forms, case rules and word
    patterns nor its special strings join what white space separates, so the counts
    of the pieces add up to that of the text, however long it is.
    """
    return text.split()


@lru_cache(maxsize=2)
def _known(path: str) -> dict[bytes, int]:
    return {}


def _encode(pieces: list[bytes], path: str) -> list[int]:
    """Token counts of pieces, in calls of about BATCH_BYTES each."""
    out, start, held = [], 0, 0
    for i, piece in enumerate(pieces):
        if held > BATCH_BYTES:
            out += [len(e) for e in load(path).encode_batch_fast([p.decode() for p in pieces[start:i]], add_special_tokens=False)]
            start, held = i, 0
        held += len(piece) + 16
    return out + [len(e) for e in load(path).encode_batch_fast([p.decode() for p in pieces[start:]], add_special_tokens=False)]


def counts(texts: list[bytes], path: str) -> list[int]:
    """Token counts of UTF-8 texts. Each distinct piece of a batch is encoded once, and short ones are remembered."""
    known = _known(path)
    if len(known) > KNOWN_PIECES:
        known.clear()
    split = [pieces_of(t) for t in texts]
    new = list({p for pieces in split for p in pieces}.difference(known))
    found = dict(zip(new, _encode(new, path), strict=True))
    known.update(found)
    out = [sum(map(known.__getitem__, pieces)) for pieces in split]
    for piece in new:
        if len(piece) > KNOWN_BYTES:
            del known[piece]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``; null texts are empty, without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                raw = values(batch, "text")
                found = counts(raw, path)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def has_long_run(text: str) -> bool:
    """Whether white space, or anything else, runs on for ``LONG_RUN`` characters."""
    return any(len(w) >= LONG_RUN for w in text.split()) or any(m.end() - m.start() >= LONG_RUN for m in _BLANKS.finditer(text))


def special_ids(path: str) -> dict[str, int] | None:
    """The added strings of a tokenizer file and their ids; None where the file is not plain byte-level BPE, as the fast encoder takes it to be."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    before, model, added = data.get("pre_tokenizer") or {}, data["model"], data.get("added_tokens") or []
    plain = data.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    bare = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return {t["content"]: t["id"] for t in added} if plain and bare else None


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """A function from a text to the ids (a list) that the byte-level tokenizer file at ``path`` gives.

    The library that owns the file is exact but slow. Where the rank file of the
    same vocabulary lies beside it, ordinary Latin texts go through the faster
    library; the special strings inside a text take their own ids in both. Texts with
    other letters or with very long runs go to the owner.
    """
    slow = load(path)
    ranks, special = path.removesuffix(".json") + ".tiktoken", special_ids(path)
    if not os.path.exists(ranks) or special is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(text: str) -> list[int]:
        if _PLAIN.search(text) or has_long_run(text):
            return slow.encode(text, add_special_tokens=False).ids
        if cut is None:
            return fast(text)
        first, *rest = cut.split(text)
        ids = fast(first)
        for mark, part in zip(rest[::2], rest[1::2], strict=True):
            ids.append(special[mark])
            ids.extend(fast(part))
        return ids

    return encode
