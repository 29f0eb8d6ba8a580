"""Jaccard self-join of word n-gram sets that skips by what is known of related sets.

Two sets with a Jaccard similarity of at least t share a shingle among the first
``n - ceil(t n) + 1`` of each, in any fixed order of all shingles. The order used is by
rough document frequency, rare first, from a count sketch over all documents, so a
passage that very many documents share is not used to look for partners. The prefixes
make an inverted index. Within a list

* entries are sorted by set size and looked at block by block; a block whose sizes and
  positions cannot reach the threshold is skipped whole, before single entries are;
* signatures of hashed bits bound what two sets can share;
* the least entry leads: it is compared with all others, and answers of entries
  similar to it follow from its own. Jaccard distance is a metric, so an entry at
  distance d1 of the leader and one at distance d2 are at least d2 - d1 apart; pairs
  that this rules out, and pairs already in one component, are never compared. The
  leaders of a set's lists take turns: the least one first, and then only those that
  are not yet in the set's component.

All remaining pairs are compared, in exact arithmetic over the whole texts. Nothing is
capped: the result has every link's effect on the components.

Texts with the same shingle set are one node. Copies inside a task are combined before
the index is shuffled, so a group of copies gives each list at most one entry per task.

Defined results: without words (null, empty or white space) a document has no shingle
and is its own component; fewer words than ``WORDS`` make one shingle. A null
``doc_id`` takes part and gets the component's least id, null if it has none. Rows
that repeat an id count as one document: the components of their texts join. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import settle
from .merging import merge, pieces_of

WORDS = 5
#: Similarity threshold in hundredths.
LEAST = 75
#: Counters of the frequency sketch, and bits of the filter of nodes that have candidates.
SKETCH_BITS, FILTER_BITS = 22, 25
#: Index entries of one bucket, about: 12 MB.
ENTRIES_PER_BUCKET = 500_000
#: Rounds of leaders: each set's least one, the least of those left, ..., in the last round all of them.
TURNS = 3
#: Bits of a set's signature.
SIGNATURE_BITS = 2048
#: Entries of a list that are judged together before they are judged singly.
BLOCK = 256
REMEMBERED = 200_000


# --- shingles -----------------------------------------------------------------------

_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; word hashes are remembered."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.factors = np.resize(_FACTORS, words) ^ np.arange(words, dtype=np.uint64) // np.uint64(5)
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        try:
            out = list(map(self.known.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(words)
            self.known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
            out = list(map(self.known.__getitem__, words))
        return np.asarray(out, np.uint64)

    def of(self, text: str) -> np.ndarray:
        # Bytes: lower() and split() then know ASCII letters and ASCII white space only.
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self._hashes(words)
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            x = (out ^ h[i:i + n]) * self.factors[i]
            out = x ^ (x >> np.uint64(29))
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return np.unique(out ^ (out >> np.uint64(32)))


def prefix_length(n: np.ndarray | int, least: int = LEAST):
    return n - (least * n + 99) // 100 + 1


# --- what all tasks add up -----------------------------------------------------------

_SEEN = "doc_id long, n long, set_key binary, sid long, block int, data binary"


def _sets_and_counts(words: int):
    """Rows of two kinds: one per document, and a task's sketch of shingle counts in compressed pieces."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(words), np.zeros(size, np.int64)
        waiting, n = [], 0

        def add() -> None:
            at = (np.concatenate(waiting) & np.uint64(size - 1)).astype(np.int64)
            np.add(table, np.bincount(at, minlength=size), out=table)

        for batch in batches:
            sizes, keys = [], []
            for text in batch["text"]:
                s = shingler.of(text.as_py())
                sizes.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                waiting.append(s)
                n += len(s)
                if n > 1 << 20:
                    add()
                    waiting, n = [], 0
            k = len(sizes)
            yield _batch(_SEEN, [batch["id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                 pa.array([None if x is None else _sid(x) for x in keys], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())])
        if waiting:
            add()
        piece = pieces_of(table)
        k, data = piece.num_rows, [zlib.compress(x.as_py(), 1) for x in piece["data"]]
        yield _batch(_SEEN, [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())] + [piece["block"], pa.array(data, pa.binary())])

    return run


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def frequency_classes(seen: DataFrame) -> tuple[np.ndarray, int]:
    """(binary logarithm of each counter of the sketch over all texts, number of shingles)."""
    # Pieces travel compressed: dealt by block first, unpacked where they are added up. One byte of each counter reaches the driver.
    packed = seen.filter("block IS NOT NULL").select("block", "data")
    classes = merge(packed, 1 << SKETCH_BITS, "<i8", np.add, unpack=zlib.decompress, finish=_logarithms, finished="u1")
    return classes, seen.agg(F.sum("n")).first()[0] or 0


def _logarithms(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.uint8)


def _node_filter(nodes: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of long values, of fixed size; full, it lets all through, which costs time only."""
    size = 1 << FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _filter_places(batch["node"].to_numpy()):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pieces_of(bits)

    return merge(nodes.select("node").mapInArrow(run, "block int, data binary"), size // 8, "u1", np.bitwise_or)


def _filter_places(nodes: np.ndarray) -> list[np.ndarray]:
    h = nodes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [((h >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for s in (39, 20, 5)]


def _set_key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _node(doc_id: int | None, key: bytes) -> int:
    """A set's node: the id of a document that has it; a row without one gets a number apart from ids."""
    return doc_id if doc_id is not None else -(int.from_bytes(key[8:15], "big") + 2)


def _sid(key: bytes) -> int:
    """64 bits of a set's key, as a number in the index."""
    return int.from_bytes(key[:8], "little", signed=True)


# --- the index ----------------------------------------------------------------------

_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _index(classes: np.ndarray, buckets: int, words: int, least: int):
    """Index entries of the sets of a task, one row per batch and bucket; a set met again adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(words), set()
        mask = np.uint64(len(classes) - 1)
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                entries = []
                for text in batch["text"].slice(first, 2048):
                    s = shingler.of(text.as_py())
                    if not len(s):
                        continue
                    key = _set_key(s)
                    if key in met:
                        continue
                    met.add(key)
                    order = np.argsort(classes[(s & mask).astype(np.int64)], kind="stable")[:prefix_length(len(s), least)]
                    e = np.empty(len(order), _ENTRY)
                    e["token"], e["node"], e["n"], e["at"] = s[order], _sid(key), len(s), np.arange(len(order))
                    entries.append(e)
                if not entries:
                    continue
                e = np.concatenate(entries)
                bucket = ((e["token"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                used, start = np.unique(bucket[order], return_index=True)
                cut = np.append(start, len(e))
                data = [e[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield _batch("bucket int, data binary", [pa.array(used, pa.int32()), pa.array(data, pa.binary())])

    return run


def _enough(nx, ny, least: int):
    """Least overlap of sets of these sizes that makes a link: the smallest o with 100 o >= least (nx + ny - o)."""
    return -(-least * (nx + ny) // (100 + least))


_LED = "lead long, node long, token long, n int, at int"


def _led_lists(least: int):
    """Rows of two kinds from the lists of a bucket.

    Without a token: a distinct pair of a list's leader and an entry, as far as sizes and
    positions let it be a link. With a token: the entries of lists of three and more,
    the leader (the least node) included, for what the leader's answers leave open.
    """

    def run(key, table):
        e = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in table["data"]])
        e = e[np.lexsort((e["node"], e["token"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (e["node"][1:] != e["node"][:-1])
        e = e[fresh]
        start = np.flatnonzero(np.append(True, e["token"][1:] != e["token"][:-1]))
        size = np.diff(np.append(start, len(e)))
        y = e[np.repeat(size >= 2, size)]
        x = e[np.repeat(start, size)[np.repeat(size >= 2, size)]]
        nx, ny, ax, ay = (v.astype(np.int64) for v in (x["n"], y["n"], x["at"], y["at"]))
        rest = np.minimum(nx - ax, ny - ay)
        compare = (100 * np.minimum(nx, ny) >= least * np.maximum(nx, ny)) & (rest >= _enough(nx, ny, least)) & (x["node"] != y["node"])
        pairs = np.unique(np.stack([x["node"][compare], y["node"][compare]], axis=1), axis=0)
        long = e[np.repeat(size >= 3, size)]
        k, m = len(pairs), len(long)
        return pa.table([
            pa.chunked_array([pa.array(pairs[:, 0].copy(), pa.int64()), pa.nulls(m, pa.int64())]),
            pa.chunked_array([pa.array(pairs[:, 1].copy(), pa.int64()), pa.array(long["node"].copy(), pa.int64())]),
            pa.chunked_array([pa.nulls(k, pa.int64()), pa.array(long["token"].copy().view(np.int64), pa.int64())]),
            pa.chunked_array([pa.nulls(k, pa.int32()), pa.array(long["n"].astype(np.int32), pa.int32())]),
            pa.chunked_array([pa.nulls(k, pa.int32()), pa.array(long["at"].astype(np.int32), pa.int32())]),
        ], names=["lead", "node", "token", "n", "at"])

    return run


# --- comparing ----------------------------------------------------------------------

def _compare(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        known, first = None, None
        for batch in batches:
            shared, nx, ny = [], [], []
            for text_x, text_y in zip(batch["text_x"], batch["text_y"]):
                text_x = text_x.as_py()
                if text_x != known:  # by text: one node may have several
                    known, first = text_x, shingler.of(zlib.decompress(text_x).decode())
                other = shingler.of(zlib.decompress(text_y.as_py()).decode())
                shared.append(len(np.intersect1d(first, other, assume_unique=True)))
                nx.append(len(first))
                ny.append(len(other))
            yield pa.RecordBatch.from_arrays(
                [batch["x"], batch["y"], *[pa.array(v, pa.int64()) for v in (shared, nx, ny)]], names=["x", "y", "shared", "nx", "ny"])

    return run


class _Texts:
    """Whole texts of the nodes of a pair table, fetched once; these pairs, all or some, are then compared."""

    def __init__(self, rows: DataFrame, words: int, pairs: DataFrame):
        self.rows, self.words = rows, words
        wanted = settle(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct())
        # Both sides of a pair read this; written once, so that the documents are read once.
        self.texts = settle(self._of(wanted))

    def _of(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of all wanted nodes and a few others, compressed; rows repeated in a task are one."""
        bits, words = _node_filter(wanted), self.words

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, seen = Shingler(words), set()
            for batch in batches:
                nodes = batch["id"].to_pylist()
                for i in np.flatnonzero(batch["id"].is_null()).tolist():
                    s = shingler.of(batch["text"][i].as_py())
                    nodes[i] = _node(None, _set_key(s)) if len(s) else 0
                ids = np.asarray(nodes, np.int64)
                ok = np.ones(len(ids), bool)
                for at in _filter_places(ids):
                    ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                at, texts = [], []
                for i in np.flatnonzero(ok).tolist():
                    text = batch["text"][i].as_py()
                    mark = nodes[i], xxhash.xxh64_intdigest(text)
                    if mark not in seen:
                        seen.add(mark)
                        at.append(i)
                        texts.append(zlib.compress(text.encode(), 1))
                yield _batch("node long, text binary", [pa.array(ids[at], pa.int64()), pa.array(texts, pa.binary())])

        return self.rows.mapInArrow(pick, "node long, text binary")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(x, y, shared, nx, ny) of distinct (x, y): sizes and overlap of the two sets."""
        both = (
            pairs.join(self.texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y")
            .join(self.texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
        )
        return settle(both.select("x", "y", "text_x", "text_y").mapInArrow(
            _compare(self.words), "x long, y long, shared long, nx long, ny long"))


def _signatures(words: int):
    """(node, bits): a bit for each shingle of a node's text, by hash. A bit that only one of two sets has is a shingle they do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            out = []
            for text in batch["text"]:
                bits = np.zeros(SIGNATURE_BITS, np.uint8)
                bits[(shingler.of(zlib.decompress(text.as_py()).decode()) >> np.uint64(40) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = 1
                out.append(np.packbits(bits).tobytes())
            yield _batch("node long, bits binary", [batch["node"], pa.array(out, pa.binary())])

    return run


# --- what the leader's answers leave open -------------------------------------------

def _each_list(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Lists, one at a time, of rows sorted by token."""
    waiting: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        out = {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}
        waiting.clear()
        return out

    for batch in batches:
        rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
        token = rows["token"]
        cut = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)] if len(token) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if waiting and waiting[-1]["token"][0] != token[a]:
                yield whole()
            waiting.append({c: v[a:b] for c, v in rows.items()})
    if waiting:
        yield whole()


_OPEN = "token long, node long, part long, n int, at int, lead long, most int, sure boolean"


def _lists_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists whose entries are of several components, each entry beside its leader.

    ``most``: the most shingles the two can share, whatever stands before in their prefixes.
    ``sure`` is false where two sets have one number, so that the leader is not known, and
    where the entry's node or the leader's has several sets (one id, different texts), as
    answers are of nodes.
    """
    waiting, rows = [], 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate([w[i] for w in waiting]) for i in range(8)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        return _batch(_OPEN, [pa.array(c, t) for c, t in zip(columns, types)])

    for e in _each_list(batches):
        part = e["part"]
        if (part == part[0]).all():
            continue
        n, at = e["n"].astype(np.int64), e["at"].astype(np.int64)
        x = int(e["sid"].argmin())
        most = np.minimum(np.minimum(at, at[x]) + np.minimum(n - at, n[x] - at[x]), np.minimum(n, n[x]))
        several = e["several"].astype(bool)
        sure = ~(several | several[x]) & (len(np.unique(e["sid"])) == len(n))
        waiting.append((e["token"], e["node"], part, n, at, np.full(len(n), e["node"][x]), most, sure))
        rows += len(n)
        if rows > 1 << 16:
            yield flush()
            waiting, rows = [], 0
    if waiting:
        yield flush()


def _open_blocks(e: dict[str, np.ndarray], least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first of one block, first of another, which pairs are open) of a list in the order of its sizes.

    Open: settled by neither a component, nor sizes and positions, nor the leader's answers.
    """
    reach = 1 - least / 100
    n, at, part, far, near = (e[c] for c in ("n", "at", "part", "far", "near"))
    rest = n - at
    first = np.arange(0, len(n), BLOCK)
    most = np.maximum.reduceat(rest, first)
    for i, a in enumerate(first.tolist()):
        x = slice(a, a + BLOCK)
        for j in range(i, len(first)):
            b = int(first[j])
            if 100 * n[x][-1] < least * n[b]:
                break  # sizes only grow from here on
            if min(most[i], most[j]) < _enough(n[a], n[b], least):
                continue  # positions too late for any pair of these blocks
            y = slice(b, b + BLOCK)
            nx, ny = n[x][:, None], n[y][None, :]
            ok = (100 * nx >= least * ny) & (np.minimum(rest[x][:, None], rest[y][None, :]) >= _enough(nx, ny, least))
            ok &= part[x][:, None] != part[y][None, :]
            ok &= (far[y][None, :] - near[x][:, None] <= reach + 1e-9) & (far[x][:, None] - near[y][None, :] <= reach + 1e-9)
            if i == j:
                ok &= np.tri(len(n[x]), len(n[y]), -1, bool).T
            yield a, b, ok


def _by_size(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.argsort(e["n"], kind="stable")
    return {c: v[order].astype(np.int64) if c in ("n", "at") else v[order] for c, v in e.items()}


_BOUNDED = "token long, node long, n int, at int, part long, far double, near double, sure boolean"


def _open_entries(least: int):
    """The rows, sorted by token, that have an open pair in their list; in most lists none has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in _BOUNDED.split(", ")]
        waiting, rows = [], 0

        def flush() -> pa.RecordBatch:
            return _batch(_BOUNDED, [pa.array(np.concatenate([w[c] for w in waiting]), t) for c, t in zip(names, types)])

        for e in map(_by_size, _each_list(batches)):
            open_ = np.zeros(len(e["n"]), bool)
            for a, b, ok in _open_blocks(e, least):
                open_[a:a + BLOCK] |= ok.any(axis=1)
                open_[b:b + BLOCK] |= ok.any(axis=0)
            if open_.any():
                waiting.append({c: e[c][open_] for c in names})
                rows += int(open_.sum())
                if rows > 1 << 16:
                    yield flush()
                    waiting, rows = [], 0
        if waiting:
            yield flush()

    return run


def _open_pairs(least: int, one_each: bool = False):
    """Open pairs of entries of one list that their signatures do not settle either.

    ``far`` is a lower bound of an entry's distance to its leader, ``near`` an upper one;
    ``bits`` is null, or not there, where no signature can be relied on. With
    ``one_each``, only the first such pair of every entry with one before it.
    """

    def of_list(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        e = _by_size(e)
        node, n = e["node"], e["n"]
        bits = e.get("bits", np.full(len(n), None))
        signed = np.asarray([b is not None for b in bits])
        bits = np.frombuffer(b"".join(b or bytes(SIGNATURE_BITS // 8) for b in bits), np.uint64).reshape(len(n), -1)
        spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        done = np.zeros(len(n), bool)
        for a, b, ok in _open_blocks(e, least):
            p, q = np.nonzero(ok & ~done[b:b + BLOCK])
            p, q = p + a, q + b
            shared = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64) + np.minimum(spare[p], spare[q])
            keep = (shared >= _enough(n[p], n[q], least)) | ~(signed[p] & signed[q])
            p, q = p[keep], q[keep]
            if one_each:
                q, at_first = np.unique(q, return_index=True)
                p = p[at_first]
                done[q] = True
            if len(p):
                yield node[p], node[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by token; pairs of a few lists are made distinct together."""
        xs, ys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], axis=1), axis=0)
            return _batch("x long, y long", [pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64())])

        for e in _each_list(batches):
            for x, y in of_list(e):
                xs.append(np.minimum(x, y))
                ys.append(np.maximum(x, y))
                held += len(x)
                if held > 1 << 18:
                    yield flush()
                    xs, ys, held = [], [], 0
        if xs:
            yield flush()

    return run


# --- components, round by round -----------------------------------------------------

def _ends(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` with the components of their ends, ``px`` and ``py``; a node without one is its own."""
    for c in ("x", "y"):
        of = parts.select(F.col("node").alias(c), F.col("component").alias(f"_p{c}"))
        pairs = pairs.join(of, c, "left").withColumn(f"p{c}", F.coalesce(f"_p{c}", c)).drop(f"_p{c}")
    return pairs


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    return _ends(pairs, parts).filter("px <> py").select(pairs.columns)


def _grown(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) with more links (x, y): only whole components are joined anew. Runs jobs."""
    if parts is None:
        return connected_components(links)
    joined = settle(connected_components(_ends(links, parts).select("px", "py")))
    moved = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    return moved.select("node", F.coalesce("_to", "component").alias("component")).unionByName(
        joined.join(parts.select("node"), "node", "left_anti"))


# --- the operator -------------------------------------------------------------------

def similarity_components(
    docs: DataFrame, words: int = WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Runs jobs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = settle(rows.mapInArrow(_sets_and_counts(words), _SEEN))
    classes, total = frequency_classes(seen)
    buckets = max(parallel, -(-(total * (100 - least) // 100) // ENTRIES_PER_BUCKET))
    members = seen.filter("block IS NULL").select("doc_id", "n", "set_key", "sid")

    # One node per set: its least id. In the index a set is 64 bits of its key; should two sets share
    # them, both nodes are looked up, so nothing is lost.
    sets = members.filter("set_key IS NOT NULL").groupBy("set_key", "sid").agg(F.min("doc_id").alias("least_id"))
    synthetic = -2 - F.conv(F.hex(F.substring("set_key", 9, 7)), 16, 10).cast("long")
    sets = settle(sets.withColumn("node", F.coalesce("least_id", synthetic)))
    number = sets.select("sid", "node")

    def nodes_of(df: DataFrame, column: str) -> DataFrame:
        return df.join(number.select(F.col("sid").alias(column), F.col("node").alias(f"_{column}")), column).drop(column)

    entries = rows.select("text").mapInArrow(_index(classes, buckets, words, least), "bucket int, data binary")
    led = settle(entries.groupBy("bucket").applyInArrow(_led_lists(least), _LED))
    pairs = led.filter("token IS NULL").select("lead", "node").distinct().withColumn("rank", F.col("lead"))
    pairs = nodes_of(nodes_of(pairs, "lead"), "node").filter("_lead <> _node")
    pairs = settle(
        pairs.groupBy(F.least("_lead", "_node").alias("x"), F.greatest("_lead", "_node").alias("y"))
        .agg(F.min(F.struct("rank", "_node")).alias("_first")).select("x", "y", "_first.rank", F.col("_first._node").alias("led")))
    texts = _Texts(rows, words, pairs)

    def linked(found: DataFrame) -> DataFrame:
        return found.filter(f"100 * shared >= {least} * (nx + ny - shared)").select("x", "y")

    # Round by round, so that a group of near copies has about one link per set, whatever its number of lists:
    # pairs that the links found so far have put in one component are not compared.
    answers, parts, rest = None, None, pairs
    for turn in range(TURNS):
        chosen = rest
        if turn < TURNS - 1:
            chosen = settle(rest.groupBy("led").agg(F.min(F.struct("rank", "x", "y")).alias("_first")).select("_first.x", "_first.y").distinct())
        found = texts.compared(chosen)
        answers = found if answers is None else answers.unionByName(found)
        parts = settle(_grown(parts, linked(found)))
        if turn < TURNS - 1:
            rest = settle(_across(rest.join(chosen, ["x", "y"], "left_anti"), parts))
            if rest.isEmpty():
                break
    # Nodes of ids that come with different texts; none if ids are unique.
    several = settle(sets.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("_several")))
    placed = settle(sets.join(parts, "node", "left").join(several, "node", "left").select(
        "set_key", "sid", "node", "least_id", F.coalesce("component", "node").alias("part"),
        F.coalesce("_several", F.lit(False)).alias("several")))

    # Lists that are in one component already have nothing open.
    lists = led.filter("token IS NOT NULL").select("token", F.col("node").alias("sid"), "n", "at")
    lists = lists.join(placed.select("sid", "node", "part", "several"), "sid").repartition("token").sortWithinPartitions("token")
    across = settle(lists.mapInArrow(_lists_across, _OPEN))
    # The bounds need the leader's answers in these lists, those inside a component too.
    asked = across.filter("lead <> node").select(F.least("lead", "node").alias("x"), F.greatest("lead", "node").alias("y")).distinct()
    asked = settle(asked.join(pairs.select("x", "y"), ["x", "y"], "left_semi").join(answers.select("x", "y"), ["x", "y"], "left_anti"))
    if not asked.isEmpty():
        answers = answers.unionByName(texts.compared(asked))
    known = answers.select("x", "y", "shared", (F.col("nx") + F.col("ny")).alias("both")).dropDuplicates(["x", "y"])
    near_lead = F.when(F.col("lead") == F.col("node"), 0.0).otherwise(1 - F.col("shared") / (F.col("both") - F.col("shared")))
    leads = across.filter("lead = node").select("token", F.col("n").alias("n_lead")).distinct()
    most = F.col("most")
    bounded = (
        across.withColumns({"x": F.least("lead", "node"), "y": F.greatest("lead", "node")}).join(known, ["x", "y"], "left")
        .join(leads, "token").withColumn("near_lead", near_lead)
        .select(
            "token", "node", "n", "at", "part",
            F.when(~F.col("sure"), 0.0).otherwise(F.coalesce("near_lead", 1 - most / (F.col("n_lead") + F.col("n") - most))).cast("double").alias("far"),
            F.when(~F.col("sure"), 1.0).otherwise(F.coalesce("near_lead", F.lit(1.0))).cast("double").alias("near"), "sure")
    )
    # Signatures and texts go only to what this leaves.
    bounded = settle(bounded.repartition("token").sortWithinPartitions("token").mapInArrow(_open_entries(least), _BOUNDED))
    listed = _Texts(rows, words, bounded.select(F.col("node").alias("x"), F.col("node").alias("y")))
    bits = listed.texts.mapInArrow(_signatures(words), "node long, bits binary").groupBy("node").agg(F.min("bits").alias("bits"))
    signed = settle(
        bounded.drop("part").join(bits, "node", "left").withColumn("bits", F.when(F.col("sure"), F.col("bits"))).drop("sure"))
    # First one open pair of every entry, as its answer may settle the others; then all that are still open.
    for one_each in (True, False):
        of = parts.select("node", F.col("component").alias("_part"))
        lists = signed.join(of, "node", "left").withColumn("part", F.coalesce("_part", "node")).drop("_part")
        more = settle(
            lists.repartition("token").sortWithinPartitions("token").mapInArrow(_open_pairs(least, one_each), "x long, y long").distinct()
            .join(answers.select("x", "y"), ["x", "y"], "left_anti"))
        if not more.isEmpty():
            found = listed.compared(more)
            answers = answers.unionByName(found)
            parts = settle(_grown(parts, linked(found)))

    placed = settle(sets.join(parts, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("part")))
    least_id = settle(placed.groupBy("part").agg(F.min("least_id").alias("component_id")))
    found = settle(placed.join(least_id, "part").select("set_key", "component_id"))
    return members.select("doc_id", "n", "set_key").join(found, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
