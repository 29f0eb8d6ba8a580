"""How document filters interact: what each removes, in every order they may be applied in.

Filters are columns that say whether a row fails. Rows are counted by (part, mask of
failed filters), which is combined before its shuffle and leaves at most ``2 ** filters``
rows per part, whatever the table. Per part, the mask matrix M (0 where the
mask fails a filter, beyond the last step elsewhere) meets the matrix P of inverse
permutations (the step at which an order applies a filter) in a min-plus product: the
least ``M[mask, filter] + P[order, filter]`` is the step at which the order removes the mask. Counts
are scattered to (order, step) with the masks' weights.

Defined results: a null failure column means the row does not fail; rows with a null
part count under the empty string; repeated rows count each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle

#: More filters than this would give more than 5,040 orders.
MOST_FILTERS = 7
SCHEMA = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


# --- the audit ----------------------------------------------------------------------

def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Min-plus product: step (1 to filters) at which each order removes each mask; more than filters: never.

    ``masks`` are the bits of failed filters, ``places[order, filter]`` is the step of a filter in an order.
    """
    filters = places.shape[1]
    fails = (masks[:, None] >> np.arange(filters)) & 1
    penalty = np.where(fails == 1, 0, filters + 1)
    return (penalty[:, None, :] + places[None, :, :]).min(axis=2)


def audit_masks(masks: np.ndarray, weights: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of shape (orders, filters), by step. ``weights`` has a row for documents, good and toxic ones."""
    orders, filters = places.shape
    step = removal_steps(masks, places)
    at = np.arange(orders)[None, :]
    gone = np.zeros((3, orders, filters + 2), np.int64)
    for w, table in zip(weights, gone):
        np.add.at(table, (np.broadcast_to(at, step.shape), np.minimum(step, filters + 1)), w[:, None])
    removed, good, toxic = gone[:, :, 1:filters + 1]
    redundant, alone = np.zeros((2, orders, filters), np.int64)
    for f in range(filters):
        late = ((masks >> f) & 1 == 1)[:, None] & (step < places[None, :, f])
        np.add.at(redundant, (np.arange(orders), places[:, f] - 1), (late * weights[0][:, None]).sum(axis=0))
        alone[np.arange(orders), places[:, f] - 1] = weights[0][masks == 1 << f].sum()
    # A filter's removals over all orders.
    shares = np.asarray([removed[np.arange(orders), places[:, f] - 1].sum() for f in range(filters)])
    by_step = np.argsort(places, axis=1)
    return {
        "kept": weights[0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": redundant, "unique_fails": alone,
        "good_lost": good, "toxic_lost": toxic, "shapley": shares[by_step],
    }


def audit(rows: DataFrame, filters: dict[str, str], part: str, good: str, toxic: str) -> DataFrame:
    """One row (see ``SCHEMA``) per part, order and step.

    ``filters`` maps a one-letter name to the boolean column that says a row fails it; ``good`` and ``toxic`` are boolean columns.
    """
    if not 0 < len(filters) <= MOST_FILTERS or any(len(k) != 1 for k in filters):
        raise ValueError(f"one to {MOST_FILTERS} filters with names of one letter")
    names = list(filters)
    mask = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    one = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    classes = rows.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), one(good).alias("good"), one(toxic).alias("toxic"),
    ).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    orders = list(permutations(range(len(names))))
    places = np.argsort(np.asarray(orders), axis=1) + 1
    labels = ["".join(names[i] for i in o) for o in orders]

    def run(key, group):
        weights = np.stack([group[c].to_numpy() for c in ("n", "good", "toxic")])
        found = audit_masks(group["mask"].to_numpy().astype(np.int64), weights, places)
        n = len(names)
        out = {
            "part": pa.array([key[0].as_py()] * (len(orders) * n)), "filter_order": pa.array([x for x in labels for _ in range(n)]),
            "step": pa.array(list(range(1, n + 1)) * len(orders), pa.int32()), "filter": pa.array([c for x in labels for c in x]),
        }
        return pa.table(out | {c: pa.array(v.reshape(-1), pa.int64()) for c, v in found.items()})

    return classes.groupBy("part").applyInArrow(run, SCHEMA)


# --- the five filters of documents ---------------------------------------------------

_UPPER, _MARKS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Under 200 words; under half of them distinct; over 3 % of ``[A-Z]``; any mark. Words are split at ASCII white space."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUATION))
    return n < 200, 100 * len(set(words)) < 50 * n, 100 * upper > 3 * points, len(text.translate(None, _MARKS)) < len(text)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch["text"]]
        judged = list(zip(*(failures(t) for t in texts))) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["part"], *[pa.array(c, pa.bool_()) for c in judged],
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=["doc_id", "part", *"ABCD", "digest"])


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic) of every row of ``docs``; booleans.

    E is true for a row whose text (by SHA-256) some smaller ``doc_id`` of the whole table has; null ids neither fail it nor
    make others fail. An id with several labels is good or toxic if any of them says so.
    Texts are read once and not shuffled; what travels is about 60 bytes a row. Runs jobs.
    """
    rows = settle(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(_facts, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"))
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = settle(copied.filter("first < last").select("digest", "first"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = settle(said.filter("doc_id IS NOT NULL"))
    return rows.join(copied, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).select(
        "doc_id", "part", *"ABCDE").join(said, "doc_id", "left").select(
        "doc_id", "part", *"ABCDE", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the five filters over ``docs``, by language. Runs jobs."""
    return audit(document_failures(docs, labels), {c: c for c in "ABCDE"}, "part", "good", "toxic")
