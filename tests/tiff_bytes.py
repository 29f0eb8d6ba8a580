"""Hand-built TIFF files."""

from __future__ import annotations

import struct

ASCII, SHORT, LONG, RATIONAL = 2, 3, 4, 5


def _value(order, kind, value):
    if kind == ASCII:
        data = value.encode("latin-1") + b"\x00"
        return len(data), data
    if kind == RATIONAL:
        return len(value), b"".join(struct.pack(order + "II", n, d) for n, d in value)
    return 1, struct.pack(order + ("H" if kind == SHORT else "I"), value)


def _directory(order, entries, start, big=False):
    """Bytes of a directory at ``start``, its long values right behind it."""
    body, extra = b"", b""
    count_code, entry_size, inline, code = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    heap = start + struct.calcsize(count_code) + entry_size * len(entries) + inline
    for tag, kind, value in entries:
        count, data = _value(order, kind, value)
        if len(data) <= inline:
            field = data.ljust(inline, b"\x00")
        else:
            field = struct.pack(order + code, heap + len(extra))
            extra += data + b"\x00" * (len(data) % 2)
        body += struct.pack(order + "HH" + code, tag, kind, count) + field
    return struct.pack(order + count_code, len(entries)) + body + struct.pack(order + code, 0) + extra


def tiff(entries=(), exif=None, gps=None, order="<", width=4000, height=3000, big=False, pixels=b"\xff"):
    """A file with the image size, the given root entries and optional sub-directories; ``big`` has 64-bit offsets.

    ``pixels`` stand between the header and the directories.
    """
    root = sorted([(256, SHORT, width), (257, SHORT, height), *entries])
    parts, pointers = [], [(0x8769, exif), (0x8825, gps)]
    n_sub = sum(d is not None for _, d in pointers)
    start = (16 if big else 8) + len(pixels)
    probe = _directory(order, sorted(root + [(t, LONG, 0) for t, d in pointers if d is not None]), start, big)
    at = start + len(probe)
    for tag, sub in pointers:
        if sub is not None:
            data = _directory(order, sorted(sub), at, big)
            root.append((tag, LONG, at))
            parts.append(data)
            at += len(data)
    assert len(parts) == n_sub
    head = b"II" if order == "<" else b"MM"
    head += struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start)
    return head + pixels + _directory(order, sorted(root), start, big) + b"".join(parts)
