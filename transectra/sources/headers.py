"""Image tags by ranged reads: a few KB per file, whatever its size.

Files come from a listing that Spark makes without reading any content. Each task
opens its files at random access, reads the header, the directories and the values of
wanted tags, in 32-bit and in 64-bit files, and hands the directory entries on; they become
typed fields by the same column expressions as entries found in whole contents. The
content of a file is read, in blocks, only if its hash is wanted.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .tiff import ENTRIES, GPS_TAGS, TAGS, TYPE_SIZES

#: Bytes of the first read; small headers need no other.
FIRST = 1024
#: Bytes of one block while hashing.
BLOCK = 1 << 20
#: Names of the same store for Spark and for Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
# Bytes of the field types that 64-bit files add, and types whose value is one unsigned number.
_MORE_SIZES = {13: 4, 16: 8, 17: 8, 18: 8}
_NUMBERS = {3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}


class Ranged:
    """Reads byte ranges of a file and counts what it reads."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.count = read_at, size, 0
        self.first = self._fetch(0, min(FIRST, size))

    def _fetch(self, offset: int, n: int) -> bytes:
        data = bytes(self.read_at(n, offset)) if n > 0 else b""
        self.count += len(data)
        return data

    def __call__(self, offset: int, n: int) -> bytes | None:
        """``n`` bytes, or None if the file does not have them all."""
        if offset < 0 or offset + n > self.size:
            return None
        return self.first[offset:offset + n] if offset + n <= len(self.first) else self._fetch(offset, n)


def _directory(read: Ranged, order: str, large: bool, offset: int | None, wanted: set[int]) -> list[dict] | None:
    count_size, entry_size, inline, code = (8, 20, 8, "Q") if large else (2, 12, 4, "I")
    head = read(offset, count_size) if offset is not None and offset >= 8 else None
    if head is None:
        return None
    count = struct.unpack(order + ("Q" if large else "H"), head)[0]
    block = read(offset + count_size, count * entry_size)
    if count < 1 or block is None:
        return None
    out = []
    for at in range(0, len(block), entry_size):
        tag, kind = struct.unpack_from(order + "HH", block, at)
        if tag not in wanted:
            continue
        n = struct.unpack_from(order + code, block, at + 4)[0]
        raw = block[at + entry_size - inline:at + entry_size]
        each = TYPE_SIZES[kind] if kind < len(TYPE_SIZES) else None
        each = each or (_MORE_SIZES.get(kind) if large else None)
        data, number = None, None
        if each is not None:
            data = raw[:each * n] if each * n <= inline else read(struct.unpack(order + code, raw)[0], each * n)
        if kind in _NUMBERS and (large or kind < len(TYPE_SIZES)):
            number = struct.unpack_from(order + _NUMBERS[kind], raw)[0]
        out.append({"tag": tag, "kind": kind, "n": n, "number": number, "hex": None if data is None else data.hex().upper()})
    return out


def walk(read: Ranged) -> tuple[bool | None, list | None, list | None, list | None]:
    """(little-endian, root, Exif and GPS entries) of a file; None for what is not there."""
    order = {b"II": "<", b"MM": ">"}.get(read.first[:2])
    kind = struct.unpack_from(order + "H", read.first, 2)[0] if order and len(read.first) >= 4 else None
    if kind not in (42, 43):
        return None, None, None, None
    large = kind == 43
    if not large and len(read.first) < 8:
        return order == "<", None, None, None
    if large and (len(read.first) < 16 or struct.unpack_from(order + "HH", read.first, 4) != (8, 0)):
        return None, None, None, None
    offset = struct.unpack_from(order + ("Q" if large else "I"), read.first, 8 if large else 4)[0]
    root = _directory(read, order, large, offset, set(TAGS.values()))
    below = lambda tag: next((e["number"] for e in root or () if e["tag"] == TAGS[tag]), None)
    exif = _directory(read, order, large, below("exif_ifd"), set(TAGS.values()))
    return order == "<", root, exif, _directory(read, order, large, below("gps_ifd"), set(GPS_TAGS.values()))


def reachable(path: str) -> bool:
    """Whether Arrow opens files of this store by itself: local or mounted folders. Other stores are opened if asked for."""
    return urlparse(path).scheme in ("", "file")


def _open(path: str) -> pa.NativeFile:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(url.path))
    store, inside = fs.FileSystem.from_uri(path.replace(url.scheme, _SCHEMES.get(url.scheme, url.scheme), 1))
    return store.open_input_file(inside)


def _hash(file: pa.NativeFile, read: Ranged) -> str:
    digest = hashlib.sha256()
    file.seek(0)
    while block := file.read(BLOCK):
        digest.update(block)
        read.count += len(block)
    return digest.hexdigest()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), 256):
            part = batch.slice(at, 256)
            rows = []
            for path, known in zip(part["path"].to_pylist(), part["sha256"].to_pylist()):
                try:
                    with _open(path) as file:
                        read = Ranged(file.read_at, file.size())
                        found = walk(read)
                        rows.append((*found, known or _hash(file, read), read.count, None))
                except (OSError, ValueError) as problem:
                    rows.append((None, None, None, None, known or None, 0, f"not_a_valid_image: {type(problem).__name__}"))
            columns = list(zip(*rows)) or [()] * 7
            given = {c: part[c] for c in part.schema.names if c != "sha256"}
            entries = pa.list_(pa.struct([("tag", pa.int64()), ("kind", pa.int64()), ("n", pa.int64()), ("number", pa.int64()), ("hex", pa.string())]))
            types = (pa.bool_(), entries, entries, entries, pa.string(), pa.int64(), pa.string())
            names = ("_little", "_root", "_exif", "_gps", "sha256", "bytes_read", "_failed")
            made = {n: pa.array(c, t) for n, c, t in zip(names, columns, types)}
            yield pa.RecordBatch.from_arrays([*given.values(), *made.values()], names=[*given, *made])


def with_entries(files: DataFrame) -> DataFrame:
    """Files (path, sha256, ...) with their directory entries and ``bytes_read``; a null or empty ``sha256`` is computed from the content.

    A file that cannot be opened gets an error text in ``_failed``, never a failed task.
    """
    rest = [f for f in files.schema.fields if f.name != "sha256"]
    made = f"_little boolean, _root {ENTRIES}, _exif {ENTRIES}, _gps {ENTRIES}, sha256 string, bytes_read long, _failed string"
    schema = StructType([*rest, *StructType.fromDDL(made).fields])
    return files.mapInArrow(_reader, schema)
