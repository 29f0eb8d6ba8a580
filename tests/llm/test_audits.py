"""Filter interactions, mixing and spelling variants against brute force, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from transectra.llm import interactions, mixture, variants
from transectra.llm.queries import QUERIES

from .conftest import SCHEMA, plain, prose

LABELS = "doc_id bigint, quality int, toxic int"


# --- interactions -------------------------------------------------------------------

def fails_of(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, lang, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((i, lang or "", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]))
    return out


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    judged, out = fails_of(rows), []
    for part in {p for _, p, _ in judged}:
        here = [(i, f) for i, p, f in judged if p == part]
        removed_by, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                removed_by[name] += len(gone)
                lines.append([part, "".join(order), step, name, len(left), len(gone), sum(f[k] for _, f in here) - len(gone),
                              sum(f[k] and sum(f) == 1 for _, f in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [tuple([*x, removed_by[x[3]]]) for x in lines]
    return sorted(out, key=repr)


def test_audit_equals_filtering_in_every_order(spark, awkward):
    rng = random.Random(4)
    rows = [tuple(r) for r in awkward.collect()]
    for i in range(100, 160):
        t = " ".join(rng.choice(["one", "Two", "THREE", "four#", "five", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([3, 150, 260])))
        rows.append((i, t if i % 3 else prose(i % 7, 230), rng.choice(["en", "de", None, ""]), "s", 1))
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), *[(i, i % 2, int(i % 5 == 0)) for i in range(100, 150)]]
    got = interactions.document_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert plain(got) == brute_audit(rows, labels)


def test_removal_step_is_the_first_failing_filter_of_the_order():
    orders = list(permutations(range(4)))
    places = np.argsort(np.asarray(orders), axis=1) + 1
    got = interactions.removal_steps(np.arange(16), places)
    for m in range(16):
        for k, o in enumerate(orders):
            assert got[m, k] == next((s for s, f in enumerate(o, 1) if m >> f & 1), 5) or (m == 0 and got[m, k] > 4)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None, True, False), ("p", True, True, False, True), ("p", None, None, None, None)],
                                 "k string, x boolean, y boolean, g boolean, t boolean")
    got = {(r.filter_order, r.step): r for r in interactions.audit(rows, {"x": "x", "y": "y"}, "k", "g", "t").collect()}
    assert (got["xy", 1].removed, got["xy", 1].kept, got["xy", 2].redundant, got["yx", 2].removed) == (2, 1, 1, 1)
    assert (got["xy", 1].good_lost, got["xy", 1].toxic_lost, got["xy", 1].shapley, got["xy", 2].shapley) == (1, 1, 3, 1)
    assert got["xy", 1].unique_fails == 1 and got["xy", 2].unique_fails == 0
    with pytest.raises(ValueError):
        interactions.audit(rows, {}, "k", "g", "t")


# --- mixing -------------------------------------------------------------------------

def brute_targets(sizes, weights, share, most):
    """Share out by weight, cap, share the excess out again, until nobody is above the cap."""
    left, full = share * sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in full}
        level = left / sum(free.values()) if free else 0
        over = [s for s in free if weights[s] * level > most * sizes[s]]
        if not over:
            return {s: Fraction(full[s] if s in full else weights[s] * level) for s in sizes}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check_mix(rows, got, share=Fraction(3, 2), most=2):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, share, most)
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= most * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s])
        # All but one document are taken a whole number of times.
        assert sum(r.taken % r.size > 0 for r in got if r.source == s and r.size) <= 1
    return taken


def documents(n, sources):
    rng = random.Random(9)
    return [(i, " ".join(["w"] * rng.randrange(40)) + f" d{i}", "en", rng.choice(sources), 1) for i in range(n)]


def test_mix_meets_every_budget_to_the_word(spark, awkward):
    big = documents(400, ["b"] * 6 + ["a", "é", "\U0001F389", "￮", None])
    for rows in (big, big + [tuple(r) for r in awkward.collect()], documents(30, ["x"]), [(1, None, "en", None, 0), (2, "", "en", "s", 0)]):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = mixture.mix(df).collect()
        check_mix(rows, got)
        assert sorted(got, key=repr) == sorted(mixture.mix(df.repartition(2)).collect(), key=repr)


def test_mix_of_equal_rows_cuts_between_them(spark):
    rows = [(7, "a b c", "en", "s", 5)] * 500 + [(8, "a " * 300, "en", "t", 5)]
    got = mixture.mix(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    check_mix(rows, got)


def test_mixed_texts_have_the_words_taken(spark):
    rows = documents(60, ["a", "b", "c"])
    mixed = mixture.mix(spark.createDataFrame(rows, SCHEMA), carry_text=True)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in mixture.mixed_texts(mixed).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text == texts[r.doc_id] or r.text.split() == texts[r.doc_id].split()[:len(r.text.split())]
    assert dict(words) == {i: n for i, n in taken.items() if n}


def test_targets_with_given_weights(spark):
    sizes, weights = {"a": 10, "b": 1000, "c": 90, None: 5}, {"a": 100, "b": 1, "c": 7, None: 1}
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight long")
    want = brute_targets(sizes, weights, Fraction(4, 5), 3)
    assert {r.source: r.target for r in mixture.targets(df, (4, 5), 3).collect()} == pytest.approx({s: float(v) for s, v in want.items()})


# --- spelling variants ---------------------------------------------------------------

def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_words(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_of_documents(spark, awkward):
    rng = random.Random(2)
    base = ["straße" + "nbahn", "während", "running", "banana" * 3, "ÀÁÂÃÄÅ", "prefixes", "x" * 300, "tropical"]
    def slip(w):
        i, c = rng.randrange(len(w)), rng.choice("abé÷×ÿ")
        return rng.choice([w, w, w, w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w.upper()])
    rows = [(i, " ".join(slip(rng.choice(base)) for _ in range(300)) + "œ’ ok", "en", "s", 1) for i in range(60)] + [tuple(r) for r in awkward.collect()] * 5
    got = variants.document_variants(spark.createDataFrame(rows, SCHEMA).repartition(6))
    want = brute_words(rows)
    assert len(want) > 300
    assert plain(got) == brute_variants(want)


def test_query_on_the_given_documents(spark, given):
    words = brute_words([(r.doc_id, r.text) for r in given("documents").collect()])
    got = QUERIES["op13_variants"](spark, "/root/testdata/sf0.001")
    assert plain(got) == brute_variants(words)


@pytest.mark.parametrize("limit", [1, 9, 4096])
def test_hot_chunks_are_split_without_losing_pairs(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(300)}
    words |= {"gemein" + "".join(rng.choice("xyz") for _ in range(6)) for _ in range(150)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in variants.near_pairs(df, limit).collect()]
    assert len(got) == len(set(got))
    ordered = sorted(words)
    want = {frozenset((a, b)) for k, a in enumerate(ordered) for b in ordered[k + 1:] if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert {frozenset(p) for p in got} == want


def test_chains_of_forms(spark):
    words = [("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abckhg", 625), ("ablkhg", 3125), ("amlkhg", 15625), ("nothing", 9)]
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdef"].root == "amlkhg" and got["abcdef"].form == "abcdeg" and got["amlkhg"].form is None
    assert (got["nothing"].root, got["nothing"].n_near, got["nothing"].form_n) == ("nothing", 0, None)


# --- all three -------------------------------------------------------------------------

def test_empty_tables_clashes_and_nulls(spark, awkward, clashing, no_documents):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    odd = lambda df: df.withColumns({c: F.lit("other") for c in ("part", "A", "mask", "size", "s_before", "_part", "_tie", "_v_s", "word")})
    for run in (lambda d: interactions.document_audit(d, labels), mixture.mix, variants.document_variants):
        assert run(no_documents).collect() == []
        assert plain(run(odd(clashing(awkward)))) == plain(run(awkward))
    assert interactions.document_audit(nulls, labels.limit(0)).filter("part = '' AND step = 1 AND filter = 'A' AND removed = 3").count() == 24
    assert [(r.size, r.taken, r.target) for r in mixture.mix(nulls).collect()] == [(0, 0, 0.0)] * 3
    assert variants.document_variants(nulls).collect() == []
