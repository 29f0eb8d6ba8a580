"""SentencePiece encoding that keeps, for every piece, its bytes in the original text.

Normalisation goes from left to right: at each place the longest source string in the
model's compiled character map (a double-array trie) is replaced by its target, else
one character is copied; spaces become the space mark and a dummy one is put in front,
as the model's settings say. Every normalised byte remembers where its source begins,
so the end of a piece in normalised bytes is an end in the original bytes.

The ids are the library's (see :class:`.tokens.PieceEncoder`); the spans are projected
from the pieces' lengths. Defined results: a null text counts as empty (only the end
id, no spans); null and repeated ids stay rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PieceEncoder, encoder, public_path

SPACE = "▁".encode()


# --- the model's normaliser ---------------------------------------------------------

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, value)."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[i:i + size]
            i += size
        yield tag >> 3, value


class CharacterMap:
    """Compiled character map: size of the trie, the trie's units, then targets that end in a zero byte."""

    def __init__(self, blob: bytes):
        self.units, self.targets = [], b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.targets = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest source string at this place, its target)."""
        if not self.units:
            return None
        found, units = None, self.units

        def step(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, target = found
        return length, self.targets[target:self.targets.index(b"\0", target)]


class Normaliser:
    """Settings of a model's normaliser, and the walk with alignment."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for f, v in _fields(model) if f == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and for the end) the original byte offset."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        mark = SPACE if self.escape else b" "
        if not self.map.units and not self.trim:
            raw = np.frombuffer(source, np.uint8)
            width = np.where(raw == 0x20, len(mark), 1)
            starts = np.repeat(np.arange(len(raw)), width)
            body, prefix = source.replace(b" ", mark), mark if self.dummy_prefix else b""
            return prefix + body, np.concatenate([np.zeros(len(prefix), np.int64), starts, [len(raw)]])
        return self._walk(source, mark)

    def _walk(self, source: bytes, mark: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, i = bytearray(), [], 0
        steps = []
        while i < len(source):
            hit = self.map.longest(source, i)
            if hit is None:
                lead = source[i]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, source[i:i + size]
            steps.append((i, hit[1]))
            i += hit[0]
        end = len(source)
        if self.trim:
            while steps and not steps[0][1].strip(b" "):
                steps.pop(0)
            while steps and not steps[-1][1].strip(b" "):
                end = steps.pop()[0]
        if not steps:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += mark
            origin += [steps[0][0]] * len(mark)
        was_space = self.trim
        for at, target in steps:
            if self.trim and was_space:
                target = target.lstrip(b" ")
            for b in target:
                piece = mark if b == 0x20 else bytes([b])
                out += piece
                origin += [at] * len(piece)
            if target:
                was_space = target.endswith(b" ")
        if self.trim:
            while out.endswith(mark) and len(out) > len(mark):
                end = origin[len(out) - len(mark)]
                del out[-len(mark):]
        return bytes(out), np.asarray(origin[:len(out)] + [end], np.int64)


@lru_cache(maxsize=4)
def _normaliser(path: str) -> Normaliser:
    with open(path, "rb") as f:
        return Normaliser(f.read())


@lru_cache(maxsize=4)
def _widths(path: str) -> np.ndarray:
    """Bytes of every piece in normalised text; a byte piece stands for one, the unknown piece for none known."""
    library = encoder(PieceEncoder, path).library
    n = library.get_piece_size()
    return np.asarray([
        0 if library.is_control(i) else -1 if library.is_unknown(i) else 1 if library.is_byte(i)
        else len(library.id_to_piece(i).encode()) for i in range(n)
    ], np.int64)


def spans(text: str, ids: np.ndarray, path: str) -> np.ndarray:
    """(begin, end) in original bytes of each piece that stands for text."""
    _, origin = _normaliser(path).align(text)
    width = _widths(path)[ids]
    if (width < 0).any():
        # Unknown pieces have the length of what they replace: ask for the surfaces.
        surfaces = encoder(PieceEncoder, path).library.encode(text, return_type="proto").pieces
        width = np.asarray([len(p.piece.encode()) for p in surfaces], np.int64)
    ends = np.cumsum(width[width > 0])
    starts = ends - width[width > 0]
    return np.stack([origin[starts], origin[ends]], axis=1) if len(ends) else np.zeros((0, 2), np.int64)


# --- the operator -------------------------------------------------------------------

def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4")


def encode_pieces(docs: DataFrame, model: str | None = None, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): ids with the end id, byte spans of the pieces before it, decoded text."""
    path = model or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(PieceEncoder, path)
        eos = np.asarray([pieces.library.eos_id()] if end else [], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = part["text"].to_pylist()
                blobs = pieces.encode_all(texts)
                where = [spans(t, _ids(b), path) for t, b in zip(texts, blobs)]
                full = [_ids(b + eos).tolist() for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(full, pa.list_(pa.int32())), pa.array([w[:, 0] for w in where], pa.list_(pa.int64())),
                     pa.array([w[:, 1] for w in where], pa.list_(pa.int64())), pa.array([pieces.library.decode(x) for x in full])],
                    names=["doc_id", "ids", "begins", "ends", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what :func:`encode_pieces` gives, made where it is computed: no id list leaves the task.

    ``spans_crc32`` is over the spans as little-endian 64-bit (begin, end) pairs.
    """
    path = model or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(PieceEncoder, path)
        eos = np.asarray([pieces.library.eos_id()], "<u4").tobytes()
        decimal = [str(i) for i in range(pieces.library.get_piece_size())].__getitem__
        for batch in batches:
            n, sha, back, crc = [], [], [], []
            for i in range(0, batch.num_rows, 64):
                texts = batch["text"][i:i + 64].to_pylist()
                for text, blob in zip(texts, pieces.encode_all(texts)):
                    ids = _ids(blob + eos).tolist()
                    n.append(len(ids))
                    sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest())
                    crc.append(zlib.crc32(spans(text, _ids(blob), path).astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(crc, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
