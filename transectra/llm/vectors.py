"""Embedding near-duplicates: PCA-ordered tiles with suffix-norm bounds.

Unit vectors are rotated to the principal axes of all vectors, so that the first few
coordinates carry most of a product. Two vectors with cosine >= t are at most
``sqrt(2 - 2 t)`` apart in every coordinate, so only neighbouring cells of the first
coordinate can hold partners. A cell of one label is dealt into slices of about
``SLICE`` vectors, and each tile compares two slices, in order of the first
coordinate, block by block: products of the leading dimensions first; the rest of a
product is at most the product of the suffix norms, and a pair is dropped as soon as
that cannot lift it to the threshold. What remains is decided in double precision on
the vectors as given.

Equal vectors of a label are one class before any comparison. A tile gives sums and one
edge per linked class (its own spanning forest), never pairs; every slice meets every
slice in reach, so the work on one label grows with its square divided by what the
bounds save.

Defined results: vectors link only if labels are equal and not null and lengths are
equal. Null vectors, zero vectors and those with null or non-finite components link
with nothing. A null ``vec_id`` takes part and gets the component's least id. Rows that
repeat an id count as one vector for components, each for the number of links. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import settle
from .merging import merge, pieces_of

LEAST = 0.98
SLICE = 8192
BLOCK = 512
#: Leading dimensions looked at in each step.
STEPS = (8, 16, 32)
_SLACK = 1e-9

_READ = "vec_id long, label string, dim int, key binary, vector binary"


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in double precision: present, finite throughout, not zero."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
            if not (np.isfinite(x).all() and x.any()):
                x = None
        out.append(x)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs = [x if ok else None for x, ok in zip(_vectors(batch["vector"]), batch["label"].is_valid().to_pylist())]
        raw = [None if x is None else x.tobytes() for x in xs]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array([None if x is None else len(x) for x in xs], pa.int32()),
             pa.array([None if r is None else blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
            names=[x.split()[0] for x in _READ.split(", ")])


def _stacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values would overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes as columns, by falling share of the squared lengths of all unit vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_stacked(batch["vector"], dim))
                total += u.T @ u
        flat = np.zeros(_padded(dim))
        flat[:dim * dim] = total.ravel()
        yield pieces_of(flat)

    parts = vectors.filter(F.col("dim") == dim).select("vector").mapInArrow(run, "block int, data binary")
    square = merge(parts, _padded(dim), "<f8", np.add)[:dim * dim].reshape(dim, dim)
    return np.linalg.eigh(square)[1][:, ::-1]


def _padded(dim: int) -> int:
    """A size that cuts into whole pieces."""
    return 1 << int(np.ceil(np.log2(dim * dim)))


def _first_coordinate(axes: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cell = np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                first = _unit(_stacked(batch["vector"].take(pa.array(at)), d)) @ axes[d][:, 0]
                cell[at] = np.floor(first / width)
            yield batch.append_column("cell", pa.array(cell))

    return run


# --- a tile -------------------------------------------------------------------------

class _Forest:
    """Components of the rows of a tile."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        differ = x != y
        if not differ.any():
            return
        for p, q in np.unique(np.stack([x[differ], y[differ]], axis=1), axis=0).tolist():
            while self.root[p] != p:
                p = self.root[p]
            while self.root[q] != q:
                q = self.root[q]
            self.root[max(p, q)] = min(p, q)
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]


def linked_in_block(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two rotated blocks that may reach ``least``; ``sx[:, k]`` is the norm from STEPS[k] on."""
    dim = x.shape[1]
    k = min(STEPS[0], dim)
    part = x[:, :k] @ y[:, :k].T
    p, q = np.nonzero(part + sx[:, :1] * sy[:, 0] >= least)
    product = part[p, q]
    for i, k in enumerate(STEPS):
        if not len(p) or k >= dim:
            break
        end = STEPS[i + 1] if i + 1 < len(STEPS) else dim
        end = min(end, dim)
        product = product + np.einsum("ij,ij->i", x[p, k:end], y[q, k:end])
        rest = sx[p, i + 1] * sy[q, i + 1] if i + 1 < len(STEPS) and end < dim else 0.0
        ok = product + rest >= least
        p, q, product = p[ok], q[ok], product[ok]
    return p, q


def _compare_tile(axes: dict[int, np.ndarray], least: float):
    width = np.sqrt(2 - 2 * least)

    def run(key, table):
        dim = key[1].as_py()
        node, weight = table["node"].to_numpy(), table["n"].to_numpy()
        left = table["left"].to_numpy()
        right = table["right"].to_numpy()
        given = _unit(_stacked(table["vector"], dim))
        turned = given @ axes[dim]
        order = np.argsort(turned[:, 0], kind="stable")
        node, weight, left, right, given, turned = (v[order] for v in (node, weight, left, right, given, turned))
        suffix = np.stack([np.linalg.norm(turned[:, min(k, dim):], axis=1) for k in STEPS], axis=1)
        links, forest = np.zeros(len(node), np.int64), _Forest(len(node))
        starts = range(0, len(node), BLOCK)
        for a in starts:
            x = slice(a, a + BLOCK)
            for b in range(a, len(node), BLOCK):
                y = slice(b, b + BLOCK)
                if turned[b, 0] - turned[x][-1, 0] > width + _SLACK:
                    break
                p, q = linked_in_block(turned[x], turned[y], suffix[x], suffix[y], least - _SLACK)
                p, q = p + a, q + b
                # One slice against another: only pairs across; a slice by itself: every pair once.
                ok = ((left[p] & right[q]) | (right[p] & left[q])) & (p < q)
                p, q = p[ok], q[ok]
                ok = np.einsum("ij,ij->i", given[p], given[q]) >= least
                p, q = p[ok], q[ok]
                if len(p):
                    links += np.bincount(p, weight[q], len(node)).astype(np.int64) + np.bincount(q, weight[p], len(node)).astype(np.int64)
                    forest.join(p, q)
        used = np.flatnonzero(links)
        # The edge goes to the least node of the tree, whichever row is its root here.
        best = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(best, forest.root, node)
        return pa.table([pa.array(node[used]), pa.array(links[used]), pa.array(best[forest.root[used]])], names=["node", "links", "root"])

    return run


# --- the operator -------------------------------------------------------------------

def near_duplicates(
    vectors: DataFrame, least: float = LEAST, slice_rows: int = SLICE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Runs jobs."""
    rows = settle(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).mapInArrow(_read, _READ))
    group = ["label", "dim", "key"]
    usable = rows.filter("key IS NOT NULL")
    # Equal vectors are combined before the shuffle, however many there are.
    classes = settle(
        usable.groupBy(*group).agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
        .withColumn("node", F.coalesce("least_id", -2 - F.pmod(F.xxhash64("label", "key"), F.lit(1 << 60))))
    )
    # One row per vector length.
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]
    axes = {d: principal_axes(classes, d) for d in dims}
    width = float(np.sqrt(2 - 2 * least)) + 1e-6
    schema = "node long, n long, label string, dim int, vector binary, cell long"
    placed = settle(classes.select("node", "n", "label", "dim", "vector").mapInArrow(_first_coordinate(axes, width), schema))
    slices = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"))
    slices = settle(slices)
    # A row's own slice, and every slice of its own and the next cell that it meets.
    own = placed.join(slices, ["label", "dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    inside = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(
        "label", "dim", "cell", F.col("cell").alias("cell2"), F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"),
        "node", "n", "vector", (F.col("slice") <= F.col("other")).alias("left"), (F.col("slice") >= F.col("other")).alias("right"))
    after = slices.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("slices").alias("there"))
    before = slices.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("slices").alias("there"))

    def across(neighbour: DataFrame, first: bool) -> DataFrame:
        met = own.join(neighbour, ["label", "dim", "cell"]).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("there") - 1)))
        cell = F.col("cell") if first else F.col("cell") - 1
        i, j = ("slice", "other") if first else ("other", "slice")
        return met.select("label", "dim", cell.alias("cell"), (cell + 1).alias("cell2"), F.col(i).alias("i"), F.col(j).alias("j"),
                          "node", "n", "vector", F.lit(first).alias("left"), F.lit(not first).alias("right"))

    tiles = inside.unionByName(across(after, True)).unionByName(across(before, False))
    found = settle(tiles.groupBy("label", "dim", "cell", "cell2", "i", "j").applyInArrow(
        _compare_tile(axes, least), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "root"))
    facts = (
        classes.select(*group, "node", "least_id", "n").join(links, "node", "left").join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    facts = settle(facts)
    # Classes without any id have numbers below zero: the component's least real id counts.
    least_id = facts.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = settle(facts.join(settle(least_id), "component").select(*group, "n", "links", "component_id"))
    return rows.select("vec_id", *group).join(facts, group, "left").select(
        "vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.expr("vec_id <=> component_id"))
