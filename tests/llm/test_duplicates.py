"""Exact and near copies, components and vectors against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transectra.llm import exact, jaccard, vectors
from transectra.llm.components import connected_components

from .conftest import SCHEMA, edited, plain, prose


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "cliques"])
def test_connected_components(spark, kind):
    rng = random.Random(3)
    links = {
        "path": [(i, i + 1) for i in rng.sample(range(40), 40)], "star": [(7, i) for i in range(60)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "cliques": [(a * 10 + i, a * 10 + j) for a in range(5) for i in range(6) for j in range(i)],
    }[kind]
    got = dict(connected_components(spark.createDataFrame(links, "x long, y long")).collect())
    nodes = {n for p in links if p[0] != p[1] for n in p}
    assert got == components(nodes, links)


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100, 5000, 60000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        built = exact.build_filter(keys)
        assert exact.maybe_in(keys, built).all()
        others = rng.integers(0, 1 << 63, 20000, dtype=np.int64).view(np.uint64) | np.uint64(1 << 63)
        assert exact.maybe_in(others, built).mean() < 0.02
        if n >= 50000:
            assert len(built[3]) < 1.3 * n


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g if i is not None)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_exact_duplicates(awkward, batches):
    found = exact.exact_duplicates(awkward, batches=batches).collect()
    want = brute_exact([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_a_digest_of_several_texts_is_told_apart_by_bytes(awkward):
    weak = exact.exact_duplicates(awkward, hashed=lambda t: (F.length(exact.normalised(t)) % 3).cast("string"))
    want = brute_exact([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in weak.collect() if r.doc_id is not None) == want


def test_one_row_of_each_text_stays(awkward, clashing):
    docs = clashing(awkward)
    left = exact.drop_copies(docs, exact.exact_duplicates(docs))
    assert left.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()})


# --- n-gram sets --------------------------------------------------------------------

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    part = components(ids, links)
    return sorted((i, len(sets[i]), part[i]) for i in ids)


def test_similar_documents_of_the_given_table(given):
    docs = given("documents")
    assert sorted(tuple(r) for r in jaccard.similarity_components(docs).collect()) == brute_similar([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_passages_and_thresholds(spark):
    """Drifting versions, a passage that all share, pairs just at and just below the threshold."""
    passage = prose(99, 60)
    texts = []
    for k in range(12):
        version = prose(k, 150).split(" ")
        for step in range(8):  # each version is near the one before only
            version = version[:step * 12] + [f"new{k}x{step}y{j}" for j in range(4)] + version[step * 12 + 4:]
            texts.append(" ".join(version))
    texts += [passage + " " + prose(200 + k, 30 + k) for k in range(25)]
    texts += [passage] * 3 + [passage.upper()]
    base = [f"b{i}" for i in range(204)]  # 200 shingles
    texts += [" ".join(base), " ".join(base[:154]), " ".join(base[:153])]  # 150 / 200 and 149 / 200
    texts += ["a b c", "A b  c", "a b c d", "", "  "]
    rng = random.Random(4)
    texts += [edited(prose(500 + rng.randrange(6), 90), rng.choice([20, 30, 45, 90])) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in jaccard.similarity_components(docs).collect()) == brute_similar(rows)


def test_what_leaders_leave_open_is_compared(spark):
    """Members of one list that are like each other but not like its leader."""
    shared = [f"rare{i}" for i in range(5)]
    rows = [(0, " ".join(shared + prose(1, 40).split(" ")))]
    for g in range(4):
        body = prose(50 + g, 120).split(" ")
        for v in range(5):
            rows.append((1 + 5 * g + v, " ".join(shared + body[:100] + [f"tail{g}{v}{j}" for j in range(8)])))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in jaccard.similarity_components(docs).collect()) == brute_similar(rows)


def test_an_id_with_different_texts_hides_no_link(spark):
    """Lists of a leader, two texts of one id, near to it and far from it, and a document like the far one only."""
    shingler, rows = jaccard.Shingler(), []

    def sid(text):
        return jaccard._sid(jaccard._set_key(shingler.of(text)))

    for k in range(10):
        rare, near, far = (" ".join(f"{kind}{k}x{i}" for i in range(n)) for kind, n in (("rare", 40), ("near", 116), ("far", 116)))
        for salt in range(1000):
            lead, first, second, other = (f"{rare} {x}{k}s{salt} {body}" for x, body in (("a", near), ("b", near), ("c", far), ("d", far)))
            if sid(lead) < min(map(sid, (first, second, other))):
                break
        base = 100 * k
        rows += [(base + 1, lead), *[(base + 2, t) for t in ((first, second) if k % 2 else (second, first))], (base + 3, other)]
        # These make all but the rare shingles frequent, and are like nothing else.
        rows += [(base + 10 + j, f"{near} {' '.join(f'own{k}x{j}y{i}' for i in range(400))} {far}") for j in range(8)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    found = {(r.doc_id, r.component_id) for r in jaccard.similarity_components(docs).collect()}
    assert found == {(i, i if i % 100 >= 10 else i // 100 * 100 + 1) for i, _ in rows}


def test_open_pairs_skip_nothing_that_can_link():
    """The block walk against all pairs, with bounds that rule nothing out but size, place and component."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n = 1500
    size = np.sort(rng.integers(20, 400, n))
    at = rng.integers(0, size // 4 + 1)
    part = rng.integers(0, 5, n)
    token = np.repeat([3, 9], [900, 600])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(v) for v in (token, np.arange(n), part, size, at, np.zeros(n), np.ones(n))], names=["token", "node", "part", "n", "at", "far", "near"])
    got = set()
    for out in jaccard._open_pairs(75)(iter([batch.slice(0, 700), batch.slice(700, 150), batch.slice(850)])):
        got |= set(zip(out["x"].to_pylist(), out["y"].to_pylist()))
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            low, high = min(size[a], size[b]), max(size[a], size[b])
            rest = min(size[a] - at[a], size[b] - at[b])
            if token[a] == token[b] and part[a] != part[b] and 100 * low >= 75 * high and 175 * rest >= 75 * (low + high):
                want.add((a, b))
    assert got == want


def test_the_driver_gets_one_byte_of_each_counter(awkward, monkeypatch):
    """The classes are those of the counts; the tables of counts stay with the tasks."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 18)
    seen = jaccard.settle(awkward.selectExpr("doc_id AS id", "coalesce(text, '') AS text").mapInArrow(jaccard._sets_and_counts(5), jaccard._SEEN))
    sets = [jaccard.Shingler().of(r.text or "") for r in awkward.collect()]
    counts = np.bincount((np.concatenate(sets) & np.uint64((1 << 18) - 1)).astype(np.int64), minlength=1 << 18)
    sizes, real = [], type(seen).collect
    monkeypatch.setattr(type(seen), "collect", lambda df: [sizes.append(len(r["data"])) or r if "data" in r else r for r in real(df)])
    classes, total = jaccard.frequency_classes(seen)
    assert classes.dtype == np.uint8 and classes.tolist() == np.frexp(counts.astype(float))[1].tolist()
    assert total == sum(map(len, sets))
    assert 0 < sum(sizes) <= 1 << 18


def test_signatures_and_turns_keep_a_large_group_linear(spark, monkeypatch):
    """Copies of one absent template, mostly a little too far from each other: whole texts of few pairs are compared, links as by brute force."""
    rng = random.Random(5)
    base = prose(77, 200).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(4, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    asked = []
    real = jaccard._Texts.compared

    def compared(self, pairs):
        asked.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(jaccard._Texts, "compared", compared)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in jaccard.similarity_components(docs).collect()) == brute_similar([r[:2] for r in rows])
    assert sum(asked) < 10 * len(rows)


def test_a_signature_never_rules_out_a_link():
    import pyarrow as pa
    import zlib

    rng = random.Random(9)
    base = prose(5, 600).split(" ")
    texts = [" ".join("new" + str(rng.random()) if rng.random() < share else w for w in base) for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(6)]
    sets = [set(map(int, jaccard.Shingler().of(t))) for t in texts]
    packed = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([zlib.compress(t.encode()) for t in texts])], names=["node", "text"])
    bits = next(jaccard._signatures(5)(iter([packed])))["bits"]
    n = len(texts)
    one = pa.RecordBatch.from_arrays(
        [pa.array(v) for v in (np.full(n, 3), np.arange(n), np.arange(n), [len(s) for s in sets], np.zeros(n, int), np.zeros(n), np.ones(n))] + [bits],
        names=["token", "node", "part", "n", "at", "far", "near", "bits"])
    got = {(x, y) for out in jaccard._open_pairs(75)(iter([one])) for x, y in zip(out["x"].to_pylist(), out["y"].to_pylist())}
    links = {(a, b) for a in range(n) for b in range(a + 1, n) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links and links <= got and len(got) < n * (n - 1) / 2
    first = {(x, y) for out in jaccard._open_pairs(75, True)(iter([one])) for x, y in zip(out["x"].to_pylist(), out["y"].to_pylist())}
    assert first <= got and len(first) < n


# --- vectors ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, least=0.98):
    ok = {}
    for i, e, label in rows:
        if label is not None and e is not None and len(e) and None not in e and np.isfinite(e).all() and any(e):
            ok[i] = (np.asarray(e, np.float32).astype(float), label)
    ids = sorted(ok)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            (x, p), (y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links.append((a, b))
    part = components([r[0] for r in rows], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((i, count[i], part[i], part[i] == i) for i, *_ in rows)


def vector_rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(400):
        x = centres[i % 6] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2, 0.6])
        rows.append((i, [float(np.float32(v)) for v in x], i % 3))
    rows += [(400 + i, rows[0][1], 0) for i in range(40)] + [(440 + i, [2 * v for v in rows[1][1]], 1) for i in range(3)]
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [None] * 24, 1), (503, [float("nan")] * 24, 1), (504, rows[0][1], None), (505, [], 1),
             (506, [1.0, 0.0], 1), (507, [1.0, 0.1], 1), (508, [float("inf")] + [0.0] * 23, 1), (509, [-0.0] + rows[0][1][1:], 0), (510, [1e30] * 24, 2)]
    return rows


@pytest.mark.parametrize("slice_rows", [8192, 30])
def test_vectors(spark, slice_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"node": F.lit(1), "key": F.lit("k"), "cell": F.lit(0)})
    assert sorted(tuple(r) for r in vectors.near_duplicates(df, slice_rows=slice_rows).collect()) == brute_vectors(rows)


def test_vectors_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], VECTORS)
    assert plain(vectors.near_duplicates(df)) == sorted([(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 0, None, True)], key=repr)
    assert vectors.near_duplicates(df.limit(0)).collect() == []
