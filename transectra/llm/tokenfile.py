"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with two Parquet tables. ``code`` has the code length of every
id that occurs (the canonical code follows from the lengths). ``blocks`` has one row
per block of about ``BLOCK`` ids: the documents it holds, the position of its first id
among all ids, the bit stream, and a checkpoint (bit offset) before every
``STRIDE``-th id. A block needs nothing but the code to be decoded, and any checkpoint
is a place to start: that is how decoding is vectorised, one lane per checkpoint, a
table look-up per step.

Writing takes two passes over ids that are stored once, beside their counts by block:
the sum of these gives the code, then every block is coded by itself. Rows are range-partitioned by ``doc_id``; only
one count per id, one total per partition and the code pass through the driver, all
bounded by the vocabulary or the number of partitions.

Defined results: a null text counts as empty (only the end id); null ids come first;
rows that repeat an id stay separate documents; an empty table writes no blocks and
reads back empty; other columns are ignored. A document never spans blocks, so memory
is bounded by a block or the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import scratch, settle
from .packing import in_order
from .tokens import CUT_TOGETHER, ByteLevelEncoder, encoder, public_path

BLOCK = 1 << 20
STRIDE = 1024
#: Most texts encoded in one call; ``CUT_TOGETHER`` bounds their bytes.
TOGETHER = 512
#: Longest code in bits; 2**MAX_LENGTH entries make the decoding table.
MAX_LENGTH = 18

RAW = "part int, number int, local_start long, doc_ids array<long>, lengths array<long>, n_tokens long, ids binary, counts binary"
BLOCKS = ("first_token long, doc_ids array<long>, lengths array<long>, n_tokens long, n_bits long, "
          "checkpoints binary, payload binary")


# --- the code -----------------------------------------------------------------------

def code_lengths(counts: np.ndarray, longest: int = MAX_LENGTH) -> np.ndarray:
    """Lengths (0 for ids that do not occur) of the best prefix code with lengths up to ``longest``: package-merge."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes longer than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    level, kinds = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        even = len(level) // 2 * 2
        packages = level[0:even:2] + level[1:even:2]
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    need = 2 * n - 2
    for symbol in reversed(kinds):
        symbols = int(symbol[:need].sum())
        out[order[:symbols]] += 1
        need = 2 * (need - symbols)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    lengths = np.asarray(lengths, np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, codes: np.ndarray, longest: int = MAX_LENGTH) -> np.ndarray:
    """Entry for every ``longest`` next bits: id, and length in the top byte."""
    table = np.zeros(1 << longest, np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (np.uint64(longest) - lengths[used].astype(np.uint64)))]
    entry = used.astype(np.uint32) | (lengths[used].astype(np.uint32) << np.uint32(24))
    filled = np.repeat(entry, 1 << (longest - lengths[used]))
    table[:len(filled)] = filled
    return table


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, int, bytes]:
    """(bit stream, number of bits, checkpoints as 64-bit offsets)."""
    words = np.zeros(len(ids) * int(lengths.max(initial=0)) // 32 + 3, np.uint64)
    n_bits, marks = 0, []
    # In parts whose arrays stay in the processor's cache.
    for a in range(0, len(ids), 32 * stride):
        part = ids[a:a + 32 * stride]
        size = lengths[part]
        ends = n_bits + np.cumsum(size)
        at = ends - size
        word, shift = at >> 5, at & 31
        value = codes[part] << (64 - size - shift).astype(np.uint64)
        # No code is longer than a word, so every word has a code that starts in it; bits never overlap, so sums are ors.
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        marks.append(at[::stride].astype("<u8").tobytes())
        n_bits = int(ends[-1])
    stream = words[:n_bits // 32 + 1].astype(">u4").tobytes()[: -(-n_bits // 8)]
    return stream, n_bits, b"".join(marks)


def decode_block(stream: bytes, checkpoints: bytes, n_tokens: int, table: np.ndarray, stride: int = STRIDE, longest: int = MAX_LENGTH) -> np.ndarray:
    """Ids of a block; all lanes take one step at a time."""
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    b = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    out = np.zeros((stride, len(at)), np.uint32)
    drop = np.uint32(32 - longest)
    last = len(at) - 1
    for step in range(min(stride, n_tokens)):
        if last >= 0 and step == n_tokens - last * stride:
            at = at[:last]  # the last lane may be shorter
        entry = table[(ahead[at >> 3] << (at & 7).astype(np.uint32)) >> drop]
        out[step, :len(at)] = entry & np.uint32(0xFFFFFF)
        at = at + (entry >> np.uint32(24))
    return out.T.reshape(-1)[:n_tokens]


# --- writing ------------------------------------------------------------------------

def _raw_blocks(path: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(ByteLevelEncoder, path)
        end = np.asarray([end_id], "<u4").tobytes()
        # Two bytes an id where the vocabulary allows it.
        stored = "<u2" if max(end_id, tokens.library.get_vocab_size() - 1) < 1 << 16 else "<u4"
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        owners: list = []
        blobs: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), "<u4")
            n = np.bincount(ids)
            used = np.flatnonzero(n)
            values = [part, number, start, owners, [len(x) // 4 for x in blobs], size, ids.astype(stored).tobytes(),
                      np.stack([used, n[used]]).astype("<u4").tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in RAW.split(", ")])

        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"]
            ends, stop = np.cumsum(pc.binary_length(texts).to_numpy()), 0
            while stop < len(ids):
                # Few long texts or many short ones.
                i, before = stop, ends[stop - 1] if stop else 0
                stop = max(i + 1, min(i + TOGETHER, int(np.searchsorted(ends, before + CUT_TOGETHER, "right"))))
                for k, blob in enumerate(tokens.encode_all(texts[i:stop].to_pylist()), i):
                    owners.append(ids[k])
                    blobs.append(blob + end)
                    size += len(blob) // 4 + 1
                    if size >= block:
                        yield close()
                        start, number, size, owners, blobs = start + size, number + 1, 0, [], []
        if blobs:
            yield close()

    return run


def _ids(row: pa.Scalar, n: int) -> np.ndarray:
    data = row.as_buffer()
    return np.frombuffer(data, f"<u{data.size // n}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for counts in batch["counts"]:
            ids, n = np.frombuffer(counts.as_buffer(), "<u4").reshape(2, -1)
            if ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
            total[ids] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text and write the file set below ``path`` (a folder that executors share). Runs jobs."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_path("byte_bpe_50k.json")
    raw = settle(in_order(docs, id_col, text_col).mapInArrow(_raw_blocks(vocabulary, end_id, block), RAW))
    counted = raw.select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    before, offsets = 0, {}
    for r in raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        offsets[r["part"]] = before
        before += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stream, bits, marks = encode_block(_ids(batch["ids"][i], batch["n_tokens"][i].as_py()), lengths, codes)
                first = offsets[batch["part"][i].as_py()] + batch["local_start"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first], pa.int64()), batch["doc_ids"].slice(i, 1), batch["lengths"].slice(i, 1),
                     batch["n_tokens"].slice(i, 1), pa.array([bits], pa.int64()), pa.array([marks], pa.binary()),
                     pa.array([stream], pa.binary())],
                    names=[x.split()[0] for x in BLOCKS.split(", ")])

    used = [(i, int(n)) for i, n in enumerate(lengths.tolist()) if n]
    spark.createDataFrame(used, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    # Coded ids do not shrink further.
    raw.drop("counts").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


# --- reading ------------------------------------------------------------------------

def _load_code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def _read(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    lengths = _load_code(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, canonical(lengths))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                ids = decode_block(row["payload"].as_py(), row["checkpoints"].as_py(), row["n_tokens"].as_py(), table)
                size = row["lengths"].values.to_numpy()
                ends = np.cumsum(size)
                yield each(row["first_token"].as_py(), row["doc_ids"].values, size, ends - size, ids.astype("<u4"))

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files."""

    def each(first, owners, size, starts, ids):
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([owners, pa.array(starts + first, pa.int64()), lists], names=["doc_id", "start", "ids"])

    return _read(spark, path, each, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def each(first, owners, size, starts, ids):
        view = memoryview(ids.tobytes())
        crc = [zlib.crc32(view[a * 4:(a + n) * 4]) for a, n in zip(starts.tolist(), size.tolist())]
        return pa.RecordBatch.from_arrays(
            [owners, pa.array(starts + first, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the documents to a new folder of the shared place and give the digests read back from it."""
    path = scratch(docs.sparkSession)
    write_tokens(docs, path, **options)
    return read_digests(docs.sparkSession, path)
