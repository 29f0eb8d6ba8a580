"""Packing documents into windows of ids, in order, by dynamic programming.

The documents' ids stand in a row in ``doc_id`` order. A window is a stretch of at
most ``WINDOW`` ids between two cuts; cuts may be at document ends, at sentence ends
(ids that end in ``. ! ?``) and, at a higher penalty, every ``1 / HARD_STEPS`` of a window inside longer sentences.
Chosen are the cuts with the least sum of padding and penalties. The cost of a window
is linear in its start, so the best start of each cut is the least value in a sliding
range, which a monotone queue gives in constant time.

Rows are range-partitioned by id and streamed; cuts are chosen within blocks of about
``BLOCK`` ids (a block ends with a document), so memory is bounded by a block or one
document, and a block costs half a window of padding at most on average.

Defined results: a null text counts as empty (its only id is the end id); null ids
come first; rows that repeat an id stay separate documents, in the order of their
texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder, encoder, public_path

WINDOW = 4096
BLOCK = 1 << 20
#: Penalties in ids of padding: a document cut at a sentence end, and inside a sentence.
SENTENCE_CUT, HARD_CUT = 8, 64
#: Places for hard cuts in a window's length of text without a sentence end; a window then misses less than one step.
HARD_STEPS = 64
#: Characters of text for one partition, about, and the most partitions.
PARTITION_CHARS, MOST_PARTITIONS = 16_000_000, 10_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) range-partitioned and sorted by id; ids that repeat are spread by their text."""
    size = docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-size // PARTITION_CHARS), max(MOST_PARTITIONS, parallel)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut is allowed, ascending from 0, and their penalties."""
    ends = np.flatnonzero(sentence_end[ids]) + 1
    at = np.union1d(np.union1d(ends, doc_ends), [0])
    step = max(1, window // HARD_STEPS)
    gaps = np.flatnonzero(np.diff(at) > step)
    if len(gaps):
        extra = [np.arange(at[g] + step, at[g + 1], step) for g in gaps]
        hard = np.concatenate(extra)
        at = np.union1d(at, hard)
        penalty = np.where(np.isin(at, hard), HARD_CUT, SENTENCE_CUT)
    else:
        penalty = np.full(len(at), SENTENCE_CUT)
    penalty[np.searchsorted(at, doc_ends)] = 0
    penalty[0] = 0
    return at, penalty


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The cheapest cuts, both ends included."""
    n = len(at)
    where, extra = at.tolist(), penalty.tolist()
    before = [0] * n
    # Queue of (cost up to the cut + its position, index): rising from left to right.
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, n):
        p = where[j]
        low = p - window
        while where[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        before[j] = i
        value = best + window + extra[j]  # cost of this cut + its position
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return at[np.asarray(cuts[::-1])]


def pack_block(doc_ids: list, blobs: list[bytes], sentence_end: np.ndarray, first_sequence: int, window: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of one block; sequences are numbered from ``first_sequence``."""
    raw = b"".join(blobs)
    ids = np.frombuffer(raw, "<u4")
    lengths = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
    doc_ends = np.cumsum(lengths)
    doc_starts = doc_ends - lengths
    cuts = choose_cuts(*candidates(ids, doc_ends, sentence_end, window), window)
    edges = np.union1d(cuts, np.concatenate([[0], doc_ends]))
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_starts, start, "right") - 1
    sequence = np.searchsorted(cuts, start, "right") - 1
    view = memoryview(raw)
    crc = [zlib.crc32(view[a * 4:b * 4]) for a, b in zip(start.tolist(), end.tolist())]
    owner = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    columns = [owner, start - doc_starts[doc], end - start, crc, lengths[doc], first_sequence + sequence, start - cuts[sequence]]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), len(cuts) - 1


def _packer(path: str, end_id: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(WordEncoder, path)
        vocabulary = words.library.get_vocab()
        sentence_end = np.zeros(max(max(vocabulary.values()), end_id) + 1, bool)
        sentence_end[[i for t, i in vocabulary.items() if t.removesuffix("</w>")[-1:] in {".", "!", "?"}]] = True
        end = np.asarray([end_id], "<u4").tobytes()
        # Numbers of a partition's sequences start after those of all partitions before it.
        sequence = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        blobs: list[bytes] = []
        size = 0
        for batch in batches:
            owners = batch["id"].to_pylist()
            texts = batch["text"]
            for i in range(0, len(owners), 64):
                for k, ids in enumerate(words.encode_all(texts[i:i + 64].to_pylist()), i):
                    doc_ids.append(owners[k])
                    blobs.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= block:
                        out, n = pack_block(doc_ids, blobs, sentence_end, sequence, window)
                        yield out
                        sequence += n
                        doc_ids, blobs, size = [], [], 0
        if blobs:
            yield pack_block(doc_ids, blobs, sentence_end, sequence, window)[0]

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = WINDOW, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece (see ``SCHEMA``); sequence ids rise with ``doc_id``. Runs a job that adds up text lengths."""
    path = vocabulary or public_path("word_bpe_49k.json")
    return in_order(docs, id_col, text_col).mapInArrow(_packer(path, end_id, window, block), SCHEMA)
