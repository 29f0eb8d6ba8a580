"""Spelling variants: words one edit apart, and each word's commoner form.

Asymmetric chunks: of two words one edit apart, the longer (or either, if equally
long) is cut into two disjoint chunks; the edit leaves one of them as it is. The other
word gives its positional grams of the chunks' widths. A chunk can only stand where it
stood or, behind the place of a deletion, one to the left, so grams further off are not made.
Chunk and gram meet in an equi-join on (length, place, gram); a bounded edit distance
verifies.

A chunk that very many words share would compare them all with each other. Such keys
are split instead: the chunk that holds the edit is cut in two again and the preserved
half is added to the key, until keys are small or the edit is pinned to one character,
where a key holds no more words than there are letters. No pair is lost and no key is skipped.

Defined results: a null or empty text has no words; a null id stands in the hash as
an empty string; rows that repeat an id and a text count each; very long texts and runs are taken whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle

#: One run in so many of a document's distinct runs loses a letter (the noise to be found).
NOISE = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Comparisons that a key may cause before it is split.
PAIRS_A_KEY = 4096
#: Distinct words that a task holds before it hands on its counts.
HELD = 400_000

#: Runs in a text whose A to Z are lower case already.
_RUN = re.compile("[a-zÀ-ÿ]+")


# --- words --------------------------------------------------------------------------

def _counter(least_length: int, held: int):
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Lower-casing bytes changes A to Z only.
                for run, n in Counter(_RUN.findall(text.lower().decode())).items():
                    if len(run) >= least_length:
                        h = zlib.crc32(run.encode(), prefix)
                        if not h % NOISE:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < least_length:
                                continue
                        counts[run] += n
                if len(counts) > held:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words long and frequent enough. Counts are combined in each task before the shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counter(least_length, HELD), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- pairs --------------------------------------------------------------------------

def _place(step: Column, size: Column, level: int) -> Column:
    """Where the part numbered ``step`` of ``2 ** level`` begins in a word of ``size`` characters."""
    return F.floor(step * size / (1 << level)).cast("int")


def _entries(words: DataFrame, parts: Column, level: int) -> DataFrame:
    """Chunks (``role`` 0) and grams (1) of words of (word, n, role, size): what is left of and right of the edited part.

    ``size`` is the length of the chunked word; a gram's own word is as long or one shorter.
    """
    cut = words.withColumn("part", F.explode(parts))
    size, short = F.col("size"), F.col("size") - F.char_length("word")
    cut = cut.withColumns({"low": _place(F.col("part"), size, level), "high": _place(F.col("part") + 1, size, level)}).filter("low < high")
    left = F.col("word").substr(F.lit(1), F.col("low"))
    right = F.col("word").substr(F.col("high") - short + 1, size)
    # Lengths and places are in the key, so only like-placed grams meet; one deletion moves the right one by a place.
    key = F.xxhash64("size", "low", "high", left, right)
    return cut.select("word", "n", "role", "size", "part", (F.col("high") - F.col("low") == 1).alias("pinned"), key.alias("key"))


def near_pairs(words: DataFrame, pairs_a_key: int = PAIRS_A_KEY) -> DataFrame:
    """(a, a_n, b, b_n): pairs of the distinct words of (word, n) that are one edit apart, once each. Runs jobs."""
    size = F.char_length("word")
    kinds = F.array(
        F.struct(F.lit(0).alias("role"), size.alias("size")), F.struct(F.lit(1).alias("role"), size.alias("size")),
        F.struct(F.lit(1).alias("role"), (size + 1).alias("size")))
    todo = words.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.role", "k.size")
    level, parts = 1, F.sequence(F.lit(0), F.lit(1))
    found = []
    while True:
        entries = settle(_entries(todo, parts, level))
        chunks, grams = F.sum(1 - F.col("role")), F.sum("role")
        hot = settle(entries.filter("not pinned").groupBy("key").agg((chunks * grams).alias("pairs")).filter(F.col("pairs") > pairs_a_key).select("key"))
        some = not hot.isEmpty()
        cold = entries.join(hot, "key", "left_anti") if some else entries
        a = cold.filter("role = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = cold.filter("role = 1").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        longer = F.char_length("a") > F.char_length("b")
        met = a.join(b, "key").filter((longer | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(met.drop("key"))
        if not some:
            break
        todo = settle(entries.join(hot, "key", "left_semi").select("word", "n", "role", "size", "part"))
        level, parts = level + 1, F.array(F.col("part") * 2, F.col("part") * 2 + 1)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


# --- forms --------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of each chain. Chains are halved in every round; they must not run in circles. Runs jobs."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of (word, n).

    A form is ``times`` commoner than its word, so chains rise and end. Runs jobs.
    """
    words = settle(words)
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("other")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("other")).alias("near")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    common = -F.col("best.n") >= F.col("n") * times
    judged = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")))
    last = roots(judged.filter("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """:func:`spelling_variants` of the words of all documents. Runs jobs."""
    return spelling_variants(vocabulary(docs))
