"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text: good, low or nothing. How often each
is right is not known; expectation-maximisation over the counts of vote patterns (at
most 3 ** number of labellers, whatever the corpus) estimates it, together with the
share of good texts. The posterior of its votes is a text's weak label. A linear
scorer over hashed features (word shapes, pairs of shapes, repetition) is trained on
the posteriors of a bounded sample, chosen by hash, and scores every whole text. Human
labels are not used. Repetition is measured over the whole text, whatever its length
(:func:`repetition`).

Defined results: a null text counts as empty; a text without a word has score 0 and is
not kept; null and repeated ids stay rows of their own; an empty table gives an empty
result; other columns are ignored (:func:`keep_good` passes them on).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that the scorer is trained on, on average; the choice is by hash.
TRAIN_DOCS = 12_000
BITS = 14
REMEMBERED = 200_000
#: Words of a stretch in which distinct words are counted, and of a passage that counts as met again.
STRETCH, PASSAGE = 500, 5

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")
_LOUD = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_STOP = re.compile(r"[.!?]+(?=\s|$)")


def _range_vote(x: float, good: float, low: float) -> int:
    """Good up to one bound, low from the other on."""
    return 1 if x <= good else -1 if x >= low else 0


_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repetition(words: list[str]) -> float:
    """Share of words met before in their stretch of ``STRETCH`` words, or of passages met before anywhere, whichever is more.

    Unlike the share of distinct words of a whole text, neither rises with the length of
    ordinary text. A passage met again starts with a word met again, so within one
    stretch the first share is never the lesser one.
    """
    n = len(words)
    if n <= STRETCH:
        return 1 - len(set(words)) / n if n else 0.0
    again = n - sum(len(set(words[i:i + STRETCH])) for i in range(0, n, STRETCH))
    first: dict[str, int] = {}
    at = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n).astype(np.uint64)
    m = n - PASSAGE + 1
    passage = np.zeros(m, np.uint64)
    for i in range(PASSAGE):
        x = (passage ^ at[i:i + m]) * _FACTORS[i]
        passage = x ^ (x >> np.uint64(29))
    return max(again, m - len(np.unique(passage))) / n


def votes(text: str) -> tuple[int, ...]:
    """One vote per labeller: 1 good, -1 low, 0 none."""
    words = text.split()
    n = len(words)
    if n < 5:
        return (0,) * LABELLERS
    letters = sum(map(str.isalpha, text))
    capital = sum(map(str.isupper, text))
    enough = n >= 30
    top = Counter(words).most_common(1)[0][1] / n
    return (
        _range_vote(sum(map(eq, words, words[1:])) / n, 0.06, 0.25) if n >= 12 else 0,
        _range_vote(capital / letters, 0.12, 0.5) if letters >= 80 else 0,
        _range_vote(len(_SYMBOL.findall(text)) / len(text), 0.01, 0.06),
        _range_vote(text.count("!") / n, 0.1, 0.6),
        _range_vote(len(_LOUD.findall(text)) / n, 0.05, 0.4),
        _range_vote(len(_BARE.findall(text)) / n, 0.03, 0.2),
        _range_vote(repetition(words), 0.45, 0.75) if enough else 0,
        _range_vote(top, 0.12, 0.3) if enough else 0,
        _range_vote(abs(len(_STOP.findall(text)) / n - 0.15), 0.13, 0.5) if enough else 0,
    )


LABELLERS = 9
_POWERS = 3 ** np.arange(LABELLERS)


def _pattern(text: str) -> int:
    return int(((np.asarray(votes(text)) + 1) * _POWERS).sum())


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // _POWERS % 3 - 1


class LabelModel:
    """Share of good texts and, per labeller, the chance of a good vote given that it votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        v, n = _unpack(patterns), counts.astype(float)
        up, voted = (v > 0).astype(float), (v != 0).astype(float)
        # Start: a text with any low vote is likely low.
        q = np.where((v < 0).any(axis=1), 0.1, np.where(voted.any(axis=1), 0.95, 0.5))
        for _ in range(rounds):
            w1, w0 = n * q, n * (1 - q)
            self.good = (w1.sum() + 1) / (n.sum() + 2)
            self.right = ((w1 @ up) + 0.95 * 4) / ((w1 @ voted) + 4)
            self.wrong = ((w0 @ up) + 0.5 * 4) / ((w0 @ voted) + 4)
            self.right, self.wrong = (np.clip(x, 1e-4, 1 - 1e-4) for x in (self.right, self.wrong))
            q = self._posterior(v)

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        up, down = v > 0, v < 0
        ratio = np.log(self.good / (1 - self.good)) + up @ np.log(self.right / self.wrong) + down @ np.log((1 - self.right) / (1 - self.wrong))
        return 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(_unpack(np.asarray(patterns, np.int64)))


# --- features -----------------------------------------------------------------------



def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each; at most two equal signs of another kind in a row."""
    out = []
    for c in word:
        s = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not (out and out[-1] == s and (s in "Xx9" or out[-2:] == [s, s])):
            out.append(s)
    return "".join(out[:12])


class Features:
    """Hashed features of a text as rates per word: shapes, pairs of shapes, two measures of repetition."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.known: dict[str, int] = {}
        self.same, self.seen, self.bias = (zlib.crc32(x) & self.mask for x in (b"same", b"seen", b"bias"))

    def _shapes(self, words: list[str]) -> np.ndarray:
        try:
            at = list(map(self.known.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(words)
            self.known.update((w, zlib.crc32(shape(w).encode())) for w in new)
            at = list(map(self.known.__getitem__, words))
        return np.asarray(at, np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values), both empty for a text without words; buckets may repeat."""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        s = self._shapes(words)
        pair = (s[:-1] * np.uint64(0x9E3779B1) + s[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        hashed = (np.concatenate([s, pair]) & np.uint64(self.mask)).astype(np.int64)
        where = np.concatenate([hashed, [self.same, self.seen, self.bias]])
        value = np.full(len(where), 1.0 / n)
        value[-3:] = 4 * sum(map(eq, words, words[1:])) / n, repetition(words), 1
        return where, value


def train(rows: list[tuple[list[int], list[float], float]], bits: int = BITS, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic scorer on soft labels; full passes with Adagrad steps."""
    weights = np.zeros(1 << bits)
    if not rows:
        return weights
    where = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.asarray([r[2] for r in rows])
    # Both classes weigh the same, however rare low texts are.
    share = min(max(target.mean(), 1e-3), 1 - 1e-3)
    weigh = target * (0.5 / share) + (1 - target) * (0.5 / (1 - share))
    seen = np.full(len(weights), 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, weights[where] * value, len(rows))
        error = (1 / (1 + np.exp(-score)) - target) * weigh
        slope = np.bincount(where, error[row] * value, len(weights)) / len(rows) + 1e-6 * weights
        seen += slope * slope
        weights -= 0.5 * slope / np.sqrt(seen)
    return weights


# --- the operator -------------------------------------------------------------------

class Model:
    def __init__(self, labels: LabelModel, weights: np.ndarray, threshold: float = 0.5):
        self.labels, self.weights, self.threshold = labels, weights, threshold


def _text(docs: DataFrame, text_col: str):
    return docs.select(F.coalesce(text_col, F.lit("")).alias("text"))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(_pattern(t.as_py()) for t in batch["text"])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        pattern, buckets, values = [], [], []
        for t in batch["text"]:
            text = t.as_py()
            where, value = features.of(text)
            distinct, at = np.unique(where, return_inverse=True)
            pattern.append(_pattern(text))
            buckets.append(distinct.astype(np.int32))
            values.append(np.bincount(at, value, len(distinct)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pattern, pa.int64()), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["pattern", "buckets", "values"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Vote patterns of all texts give the label model; a sample of about ``train_docs`` texts trains the scorer. Runs jobs."""
    counted = _text(docs, text_col).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns, counts = (np.asarray([r[c] for r in counted], np.int64) for c in ("pattern", "n"))
    labels = LabelModel(patterns, counts)
    total = int(counts.sum())
    share = min(1.0, train_docs / max(1, total))
    # By id and text, so that rows without an id are not drawn all or none; equal rows are one.
    chosen = docs.select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("quality")).alias("draw"), F.col(text_col).alias("text"))
    chosen = chosen.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["draw"])
    sample = _text(chosen, "text").mapInArrow(_sampled, "pattern long, buckets array<int>, values array<float>").toArrow()
    weak = labels.posterior(sample["pattern"].to_numpy())
    rows = [(b.values.to_numpy(), v.values.to_numpy(), w) for b, v, w in zip(sample["buckets"], sample["values"], weak) if len(b)]
    return Model(labels, train(rows))


def _score(features: Features, weights: np.ndarray, text: str | None) -> float:
    where, value = features.of(text or "")
    if not len(where):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip((weights[where] * value).sum(), -50, 50))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, kept) of every row."""
    weights, threshold = model.weights, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            s = np.asarray([_score(features, weights, t.as_py()) for t in batch["text"]], float)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(s), pa.array(s >= threshold)], names=["doc_id", "score", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the scorer keeps, with all their columns."""
    weights, threshold, at = model.weights, model.threshold, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield batch.filter(pa.array([_score(features, weights, t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the documents and score them all."""
    return score(docs, fit(docs, **columns), **columns)
