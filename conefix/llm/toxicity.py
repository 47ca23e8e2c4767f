"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms and case, letters of other scripts
that look Latin, and digits or signs that stand for a letter inside a word. I, l
and 1 become one letter, in the lexicon as well. Terms match from the start of a
word, so that inflected forms count; a term inside an exception phrase does not.

The lexicon is learned from labelled rows: word beginnings that are far more
frequent in toxic texts than in others, with the log of that ratio as weight. A few
plain insults are known from the start, so that an unlabelled corpus has a
lexicon too. A text's score is a logistic function of its weight of matches,
its weight per hundred words and its greatest weight, fitted on the same rows.

Null texts are empty, and an empty text has the score that no match gives. Rows
without a label, or with a null doc_id, are not learned from but are scored.
Without labelled rows of both kinds the prior model scores.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values

#: Labelled rows of each label that the fit reads at most (those with the least hash of their doc_id).
FIT_ROWS = 8_000
#: Least share of the toxic rows that have a term. The rows read bound the terms: of beginnings that long, not more
#: than 1 / COMMON times as many as a row has on average.
COMMON = 0.01
#: Characters of a word beginning.
LENGTHS = range(4, 11)
#: How much more frequent in toxic rows a term has to be.
RATIO = 20.0
#: Least log-likelihood ratio of a term, so that words that few texts hold by chance are not learned.
EVIDENCE = 20.0
#: Share of its texts that a longer beginning must keep to stand for a shorter one.
SHARED = 0.9

#: Insults known without labels, and phrases in which they are harmless.
SEEDS = ("idiot", "moron", "loser", "scum", "stupid", "worthless", "pathetic", "disgusting", "trash", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "class clown", "circus clown", "idiot proof", "loser bracket", "stupidly simple", "pond scum", "soap scum")

#: Letters of other scripts that look like Latin ones, after case folding (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ν": "v", "α": "a", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "ι": "i", "κ": "k", "χ": "x", "ε": "e", "η": "n", "ω": "w", "ԝ": "w", "ӏ": "l", "ı": "i", "ɑ": "a", "օ": "o",
}
#: Digits and signs that stand for letters inside a word (fixed values).
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "l", "|": "l"}

_SCRIPTS = str.maketrans(HOMOGLYPHS)
_FAR = re.compile(r"[^\x00-İĲ-ɐ‐-‧]|[ı​-‏­]")
_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_STANDS = re.compile(r"[0134578@$!|](?=[0134578@$!|]*[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The words of a text in folded form, a blank before and after each."""
    if _FAR.search(text):
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(_SCRIPTS)
    else:
        text = text.lower()
    text = _STANDS.sub(lambda m: DIGITS[m[0]], text).replace("i", "l")
    return f" {' '.join(_WORDS.findall(text))} "


def _merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """First and last places of ranges, those that overlap as one, in order."""
    begins, ends = [], []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


@dataclass
class Model:
    """Weights by folded term, folded exception phrases, and the logistic coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-4.0, 0.6, 0.4, 0.8)
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(f" {term}", (weight, len(term) + 1))
            for phrase in self.exceptions:
                found.add_word(fold(phrase).rstrip(), (None, len(fold(phrase).rstrip())))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def matches(self, text: str) -> tuple[np.ndarray, int]:
        """The weight of each word that a term matches, and the number of words."""
        folded = fold(text)
        terms: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (weight, size) in self.automaton().iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                terms[start] = max(terms.get(start, 0.0), weight)
        begins, ends = _merged(spared)
        kept = [w for s, w in terms.items() if not ((i := bisect_right(begins, s)) and s <= ends[i - 1])]
        return np.array(kept), folded.count(" ") - 1

    def features(self, text: str) -> list[float]:
        weights, n = self.matches(text)
        total = float(weights.sum())
        return [1.0, math.log1p(total), math.log1p(100 * total / max(n, 1)), float(weights.max(initial=0.0))]

    def score(self, text: str) -> float:
        z = float(np.dot(self.features(text), self.coefficients))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def prior() -> Model:
    return Model({fold(w).strip(): 3.0 for w in SEEDS})


def held_out(key: str = "doc_id") -> F.Column:
    """Rows that no fit may read: the CRC-32 of the id's text is a multiple of 5. A null id is none of them, as no label can name it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """At most FIT_ROWS rows of each label, one of each beginning of five words so that groups of copies count once."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    # The least hashes are found by a threshold first, so that no task ranks all rows.
    chosen = None
    for value in (0, 1):
        some = rows.where(F.col("label") == value).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(order, "doc_id").limit(FIT_ROWS)
        chosen = some if chosen is None else chosen.unionByName(some)
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = body.join(F.broadcast(chosen), "doc_id")
    start = F.xxhash64(F.lower(F.regexp_extract("text", r"^(\s*\S+){1,5}", 0)))
    first = Window.partitionBy("label", "start").orderBy("doc_id", "text")
    return joined.withColumn("start", start).withColumn("rank", F.row_number().over(first)).where("rank = 1").select("label", "text")


def _begins(text: str) -> set[str]:
    words = set(fold(text).split())
    return {w[:n] for w in words for n in LENGTHS if len(w) >= n} | {w for w in words if 3 < len(w) < 12}


def _counter(keep: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(_begins(text) if keep is None else _begins(text) & keep)
            if len(total) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of these labels; its size and what the driver gathers have the bounds above."""
    from conefix.session import Scratch

    sample = Scratch(docs.sparkSession, "toxicity").save(_sample(docs, labels, key, text, label), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return prior()

    def counted(value: int, keep: set[str] | None) -> DataFrame:
        return sample.where(F.col("label") == value).select("text").mapInArrow(_counter(keep), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    least = max(3, math.ceil(COMMON * toxic))
    common = {r["term"]: r["n"] for r in counted(1, None).where(F.col("n") >= least).collect()}
    other = {r["term"]: r["n"] for r in counted(0, set(common)).collect()}
    ratio = {t: (n + 0.5) / (toxic + 1) / ((other.get(t, 0) + 0.5) / (clean + 1)) for t, n in common.items()}
    weights = {fold(w).strip(): 3.0 for w in SEEDS}
    following: dict[str, str] = {}
    for term in common:
        held = following.get(term[:-1])
        if held is None or (common[term], held) > (common[held], term):
            following[term[:-1]] = term

    def evidence(term: str) -> float:
        a, b = common[term], other.get(term, 0)
        rate = (a + b) / (toxic + clean)
        cells = ((a, toxic * rate), (b, clean * rate), (toxic - a, toxic * (1 - rate)), (clean - b, clean * (1 - rate)))
        return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)

    for term in sorted((t for t in ratio if ratio[t] >= RATIO and evidence(t) >= EVIDENCE), key=lambda t: (len(t), -ratio[t], t)):
        if not any(term[:n] in weights and term != term[:n] for n in range(3, len(term))):
            # The longest beginning that nearly all of its texts share, so that other words are not taken in.
            while (longer := following.get(term)) and common[longer] >= SHARED * common[term]:
                term = longer
            weights[term] = min(8.0, math.log(ratio[term]))
    model = Model(weights)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    rows = sample.select("label", "text").mapInArrow(features, "label int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.coefficients = tuple(float(v) for v in w)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [model.score(t.decode()) for t in values(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, in all their columns."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sized = pa.RecordBatch.from_arrays([whole.column(at).cast(pa.binary())], ["text"])
            start = 0
            for part in slices(sized, "text"):
                batch = whole.slice(start, part.num_rows)
                start += part.num_rows
                keep = [model.score(t.decode()) < 0.5 for t in values(part, "text")]
                yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
