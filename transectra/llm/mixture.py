"""Mixing sources to target weights, by words, exact to the word.

Every document gets a hash-random key. Documents are range-sorted by (source, key),
sizes are summed up in that order in two levels, and each source is cut at its budget:
whole passes over the source first, then the documents before the cut once more; the
document on the cut gives its first words only. A source may span any number of
partitions.

Targets: the sources share ``share`` times all words by weight, none gets more than
``most`` times its own words, and what is over goes to the others by weight. That is
a common level of words per unit of weight; a source is full if filling all sources up to its own
limit takes no more than there is to share. Sources are sorted by that limit and
summed up the same way, so their number does not matter either.

Defined results: a null text has size 0; a null source is a source of its own, after
the others; rows that repeat id and text are rows of their own (their order among
themselves is open, which changes nothing in the result's rows); an empty table gives an empty
result; a null or repeated id is allowed; other columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from .frames import settle

_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def by_turns(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, weight): weights dealt in turn to sources in code-point order, null last."""
    placed = running_sums(sources, [], [F.col("source").isNull(), "source"], {"at": F.lit(1)})
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("at_before") % len(weights) + 1).cast("int"))
    return placed.select("source", "source_size", turn.alias("weight"))


def targets(weighed: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size, weight); weights are whole and above 0.

    ``share`` is a fraction, at most ``most``. One row of totals reaches the driver. Runs jobs.
    """
    up, down = share
    limit = F.col("source_size") * most
    order = [limit / F.col("weight"), F.col("source").isNull(), "source"]
    filled = running_sums(weighed, [], order, {"cap": limit, "w": "weight", "s": "source_size"})
    wide = lambda c: c.cast("decimal(19,0)")
    # Words that fill all sources up to this one's limit, times weight: below come the full ones, the others get the same level.
    spent = wide(F.col("cap_before") + limit) * wide(F.col("weight")) + wide(limit) * wide(F.col("w_all") - F.col("w_before") - F.col("weight"))
    there = wide(F.col("s_all") * up) * wide(F.col("weight"))
    judged = settle(filled.select(
        "source", "source_size", "weight", limit.alias("limit"), F.col("s_all").alias("total"), F.col("w_all").alias("weights"),
        (spent * down <= there).alias("full")))
    sums = judged.agg(
        F.max("total").alias("total"), F.max("weights").alias("weights"),
        F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).alias("taken"), F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).alias("used"),
    ).first()
    if sums["total"] is None:
        return judged.select("source", "source_size", "weight", F.col("limit").cast("double").alias("target"))
    left, weight = sums["total"] * up - down * sums["taken"], down * (sums["weights"] - sums["used"])
    level = (wide(F.col("weight")) * F.lit(left).cast("decimal(19,0)")).cast("double") / F.lit(float(max(weight, 1)))
    return judged.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level).alias("target"))


def mix(
    docs: DataFrame, weigh=by_turns, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry_text: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; with ``carry_text`` the text too.

    ``taken`` counts repeats; a source's add up to its target, rounded down. ``weigh`` gives (source, source_size, weight) of (source,
    source_size). Runs jobs. Without the text, some 60 bytes a row travel.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("key"),
        *[F.col(text_col).alias("text")] * carry_text,
    ))
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = targets(weigh(sources), share, most)
    goals = goals.select("source", "source_size", "target", F.floor("target").alias("budget"))
    placed = running_sums(rows, ["source"], ["key", "doc_id"], {"s": "size"}, goals)
    size, budget, whole = F.col("size"), F.col("budget"), F.col("source_size")
    passes = F.when(whole > 0, F.expr("budget div source_size")).otherwise(0)
    rest = budget - passes * whole
    taken = passes * size + F.greatest(F.lit(0), F.least(size, rest - F.col("s_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *["text"] * carry_text)


def mixed_texts(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, pass, text): each document as often as the mix takes it; of a cut one the first words, joined by one space."""
    size, taken = F.col("size"), F.col("taken")
    each = mixed.filter("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    left = taken - (F.col("pass") - 1) * size
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return each.select("doc_id", "source", "pass", F.when(left >= size, F.col("text")).otherwise(first).alias("text"))
