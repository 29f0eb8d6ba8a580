"""Exact duplicates: static filters of immutable snapshots screen what comes in.

A snapshot is the list of distinct normalised texts seen so far, by SHA-256, cut into
buckets by digest prefix. It never changes, so each bucket gets a static binary-fuse
filter: three probes, about nine bits a key, no false negatives. A batch is first
grouped by digest, which settles duplicates inside it whatever their number. Its distinct digests are
screened by the filters; negatives are new, positives meet the snapshot's exact bucket
in a join. Rows of a group are then compared byte for byte with the group's first
text; if a digest ever stood for two texts, its rows are grouped by text instead.

Defined results: a null text counts as empty; rows with a null ``doc_id`` take part,
and a group keeps a null id only if it has no other; an empty table gives an empty
result; columns other than the two named ones are ignored. Rows that repeat both
``doc_id`` and text are all marked kept; :func:`drop_copies` leaves one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle

#: Distinct digests in one bucket, about; a bucket's filter then has some 300 KB.
KEYS_PER_BUCKET = 250_000
_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


# --- binary-fuse filter -------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (multiply and shift), vectorised."""
    x = keys ^ np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _probes(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments of a filter; the segment comes from the high bits."""
    first = (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64) * segment
    mask = np.uint64(segment - 1)
    a = first + (h & mask).astype(np.int64)
    b = first + segment + ((h >> np.uint64(11)) & mask).astype(np.int64)
    c = first + 2 * segment + ((h >> np.uint64(21)) & mask).astype(np.int64)
    return a, b, c


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, one byte per slot) of distinct 64-bit keys.

    Peels in rounds: slots that only one unplaced key touches place that key. A seed
    with which peeling gets stuck is given up for the next.
    """
    n = len(keys)
    segment = 1 << max(2, min(10, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    slots = int(np.ceil(max(n, 1) * (1.13 + 0.4 / np.log10(max(n, 10)))))
    segments = max(1, -(-slots // segment))
    size = (segments + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = np.stack(_probes(h, segment, segments))
        touching = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        order, left = [], n
        while left:
            single = np.flatnonzero(touching == 1)
            if not len(single):
                break
            found, first = np.unique(who[single], return_index=True)
            order.append((found, single[first]))
            left -= len(found)
            for row in at[:, found]:
                np.subtract.at(touching, row, 1)
                np.bitwise_xor.at(who, row, found)
        if left:
            continue
        value, table = _print(h), np.zeros(size, np.uint8)
        # Last placed first: a key's own slot is touched by no key placed after it in this direction.
        for found, slot in reversed(order):
            p = at[:, found]
            others = table[p[0]] ^ table[p[1]] ^ table[p[2]] ^ table[slot]
            table[slot] = value[found] ^ others
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter; are the keys distinct?")


def maybe_in(keys: np.ndarray, built: tuple[int, int, int, bytes]) -> np.ndarray:
    seed, segment, segments, slots = built
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    table = np.frombuffer(slots, np.uint8)
    a, b, c = _probes(h, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _print(h)


# --- snapshots ----------------------------------------------------------------------

_FACTS = "digest string, first_id long, n long"


def _with_bucket(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumns({
        "bucket": F.pmod(F.hash("digest"), F.lit(buckets)).cast("int"), "key": F.xxhash64("digest"),
    })


def _keys(group) -> np.ndarray:
    return group["key"].to_numpy().astype(np.int64).view(np.uint64)


def _build(key, group):
    seed, segment, segments, slots = build_filter(np.unique(_keys(group)))
    return pa.table({
        "bucket": pa.array([key[0].as_py()], pa.int32()), "seed": pa.array([seed], pa.int64()),
        "segment": pa.array([segment], pa.int64()), "segments": pa.array([segments], pa.int64()),
        "slots": pa.array([slots], pa.binary()),
    })


def _screen(key, incoming, built):
    keys = _keys(incoming)
    if built.num_rows and len(keys):
        hit = maybe_in(keys, tuple(built[c][0].as_py() for c in ("seed", "segment", "segments", "slots")))
    else:
        hit = np.zeros(len(keys), bool)
    return incoming.select(["digest", "first_id", "n"]).append_column("maybe", pa.array(hit, pa.bool_()))


class Snapshot:
    """Distinct digests (digest, first_id, n) and one filter per bucket; never changed once made."""

    def __init__(self, facts: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET):
        self.facts = settle(facts)
        parallel = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(parallel, -(-self.facts.count() // keys_per_bucket))
        self.filters = settle(
            _with_bucket(self.facts.select("digest"), self.buckets).select("bucket", "key").groupBy("bucket")
            .applyInArrow(_build, "bucket int, seed long, segment long, segments long, slots binary")
        )

    def screen(self, incoming: DataFrame) -> DataFrame:
        """Facts of incoming distinct digests with ``maybe``: false only if the snapshot lacks the digest."""
        return (
            _with_bucket(incoming, self.buckets).groupBy("bucket").cogroup(self.filters.groupBy("bucket"))
            .applyInArrow(_screen, _FACTS + ", maybe boolean")
        )


def admit(snapshots: list[Snapshot], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, new) of a batch of (id, digest) rows: facts of digests that a snapshot has, and of the others."""
    # Copies inside the batch are one row from here on, combined before the shuffle.
    left = settle(rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    hits = left.limit(0)
    for s in snapshots:
        screened = settle(s.screen(left))
        maybe = screened.filter("maybe").drop("maybe")
        hits = hits.unionByName(maybe.join(s.facts.select("digest"), "digest", "left_semi"))
        left = screened.filter("not maybe").drop("maybe").unionByName(
            maybe.join(s.facts.select("digest"), "digest", "left_anti"))
    return hits, left


def exact_duplicates(
    docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", hashed=digest,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    The rows come in ``batches`` parts (by hashed id), each screened against the
    snapshots that the parts before it left. Runs jobs. ``hashed`` is the digest; a
    weak one only costs time.
    """
    rows = settle(docs.select(
        F.col(id_col).cast("long").alias("id"), hashed(F.col(text_col)).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches)).alias("batch"),
    ))
    snapshots: list[Snapshot] = []
    parts = []
    for b in range(batches):
        hits, new = admit(snapshots, rows.filter(F.col("batch") == b))
        snapshots.append(Snapshot(new))
        parts += [hits, snapshots[-1].facts]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    facts = settle(total.groupBy("digest").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")))

    # Bytes: only texts that have a copy travel; the side with one text per group is streamed against.
    copied = facts.filter("group_size > 1")
    texts = settle(
        docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"))
        .withColumn("digest", hashed(F.col("body")))
        .join(copied, "digest").select("id", "body", "digest", "keep_id")
    )
    firsts = texts.filter("id <=> keep_id").groupBy("digest").agg(F.first("body").alias("first_body"))
    other = texts.join(firsts, "digest").filter("body <> first_body").select("digest").distinct()
    other = settle(other)
    found = rows.select("id", "digest").join(facts, "digest")
    if not other.isEmpty():
        # Digests that stand for several texts: group their rows by text.
        split = texts.join(other, "digest")
        by_text = split.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = split.select("id", "digest", "body").join(by_text, ["digest", "body"])
        found = found.join(other, "digest", "left_anti").unionByName(again.select(found.columns))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay by :func:`exact_duplicates`; of rows equal in id and text, one. Columns may have any names."""
    kept = settle(
        found.filter("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = F.col("id").cast("long").eqNullSafe(F.col("kept_id")) & (digest(F.col("text")) == F.col("kept_digest"))
    once, often = kept.filter("rows = 1"), kept.filter("rows > 1")
    out = rows.join(once, same, "left_semi").select("row.*")
    if not often.isEmpty():
        repeated = rows.join(often, same, "left_semi")
        first = repeated.groupBy("id", normalised(F.col("text")).alias("body")).agg(F.first("row").alias("row"))
        out = out.unionByName(first.select("row.*"))
    return out
