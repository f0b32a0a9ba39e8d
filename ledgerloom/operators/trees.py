"""Growth of a random forest's trees, each within one task, on values coded as bins of one byte.

Three jobs make a forest, whatever its trees and depth: all rows are summed up to find the bins, the rows are coded, and the
trees are grown from the codes, which are broadcast behind a count.  Trees are grown level by level: one histogram of (node,
tried feature, bin, class) a level gives the best cuts and the class weights of the children.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import slots

#: Bins of a feature, a power of 2; a code is the bin, and so many more for class 1, within a byte.
BINS = 32
#: Points a feature's values are summed up to in a partition where they are more; ranks are then off by one in so many at most.
POINTS = 512
#: Values (rows x features) that are broadcast as codes, a byte each.
MOST = 128 << 20
#: Rows whose keys are made at a time.
CHUNK = 8192

NODE = np.dtype([("feature", "i4"), ("bin", "i4"), ("left", "i4"), ("right", "i4"), ("weight", "f8", 2)])


@dataclass
class Forest:
    """The nodes of all trees in arrays; a leaf has feature -1, ``roots`` has the place of each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The mean probability of class 1 over the trees, for rows x features."""
        leaf = self.feature < 0
        here = np.arange(len(leaf))
        feature, cut = np.where(leaf, 0, self.feature), np.where(leaf, np.inf, self.cut)
        child = np.stack([np.where(leaf, here, self.left), np.where(leaf, here, self.right)], 1).ravel()
        value = share(self.weight)
        out = np.zeros(len(x))
        for i in range(0, len(x), 256):
            part = np.ascontiguousarray(x[i : i + 256])
            flat, row = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                # not (<=), so that a NaN goes right as it does among the codes
                at = child.take(2 * at + ~(flat.take(row + feature.take(at)) <= cut.take(at)))
            out[i : i + 256] = value.take(at).mean(1)
        return out


    def importances(self, width: int) -> np.ndarray:
        """Of each feature, how much its cuts lessen the impurity: shares of a tree's, the mean over the trees, summing up to 1."""
        inner = np.flatnonzero(self.feature >= 0)
        held = impurity(*self.weight.T)
        less = held[inner] - held[self.left[inner]] - held[self.right[inner]]
        tree = np.searchsorted(self.roots, inner, "right") - 1
        each = np.bincount(tree * width + self.feature[inner], less, len(self.roots) * width).reshape(-1, width)
        whole = each.sum(1, keepdims=True)
        mean = np.divide(each, whole, out=np.zeros(each.shape), where=whole > 0).mean(0)
        return mean / (mean.sum() or 1.0)

    def as_rows(self) -> list[dict[int, dict]]:
        """The nodes of each tree by their place in it, with the names that Spark ML writes them under."""
        out = []
        for root, end in zip(self.roots, [*self.roots[1:], len(self.feature)]):
            row = lambda i: {"leftChild": int(self.left[i] - root) if self.feature[i] >= 0 else -1, "rightChild": int(self.right[i] - root) if self.feature[i] >= 0 else -1, "impurityStats": self.weight[i].tolist(), "split": {"featureIndex": int(self.feature[i]), "leftCategoriesOrThreshold": [float(self.cut[i])]}}  # noqa: E731, B023
            out.append({i - root: row(i) for i in range(root, end)})
        return out


def share(weight: np.ndarray) -> np.ndarray:
    """Class 1's part of the class weights of nodes, 0 where there are none."""
    total = weight.sum(1)
    return np.divide(weight[:, 1], total, out=np.zeros(len(total)), where=total > 0)


def values(names: list[str]) -> Column:
    """The features as an array of doubles; nulls count as 0."""
    return F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("x")


def matrix(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy().reshape(b.num_rows, -1)


# bins


def summed(value: np.ndarray, count: np.ndarray, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; of more than ``points``, those in the middle of equal parts."""
    value, at = np.unique(value, return_inverse=True)
    count = np.bincount(at, count, len(value))
    if points and len(value) > points:
        upto = np.cumsum(count)
        part = np.minimum(((upto - count / 2) * (points / upto[-1])).astype(int), points - 1)
        ends = np.flatnonzero(np.diff(part, append=points))
        begins = np.concatenate([[0], ends[:-1] + 1])
        value, count = value[(begins + ends) // 2], np.add.reduceat(count, begins)
    return value, count


def edges(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where ``BINS`` bins of about equal counts meet, between two values; a value more frequent than that fills one bin."""
    at = np.arange(len(value) - 1)
    if len(value) > BINS:
        part = count.astype(float)
        for _ in range(BINS):
            part = np.minimum(part, part.sum() / BINS)
        upto = np.cumsum(part)
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS))
        at = at[at < len(value) - 1]
    return value[at] / 2 + value[at + 1] / 2


def survey(table: DataFrame, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of rows of each class, and the edges of each feature's bins from all rows of (x, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.zeros(2, np.int64)
        held = [(np.zeros(0), np.zeros(0))] * width
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                classes += np.bincount(b["label"].to_numpy(), minlength=2)
                for j, (v, c) in enumerate(held):
                    v, c = summed(np.concatenate([v, x[:, j]]), np.concatenate([c, np.ones(len(x))]))
                    held[j] = (v, c) if len(v) <= 16 * POINTS else summed(v, c, POINTS)
        held = [summed(v, c, POINTS) for v, c in held]
        if classes.sum():
            yield pa.RecordBatch.from_pydict({"classes": [classes.tobytes()], "sizes": [np.array([len(v) for v, _ in held]).tobytes()], "v": [np.concatenate([v for v, _ in held]).tobytes()], "c": [np.concatenate([c for _, c in held]).tobytes()]}, pa.schema([(n, pa.binary()) for n in ("classes", "sizes", "v", "c")]))

    classes, parts = np.zeros(2, np.int64), [[] for _ in range(width)]
    for r in table.mapInArrow(run, "classes binary, sizes binary, v binary, c binary").collect():
        classes += np.frombuffer(r["classes"], np.int64)
        cuts = np.cumsum(np.frombuffer(r["sizes"], np.int64))[:-1]
        for p, v, c in zip(parts, np.split(np.frombuffer(r["v"]), cuts), np.split(np.frombuffer(r["c"]), cuts)):
            p.append((v, c))
    return classes, [edges(*summed(*map(np.concatenate, zip(*p)))) if p else np.zeros(0) for p in parts]


def codes(table: DataFrame, bounds: list[np.ndarray]) -> np.ndarray:
    """Rows x features of codes, the bin and ``BINS`` more where the label is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, out = matrix(b), np.empty((b.num_rows, len(bounds)), np.uint8)
                for j, e in enumerate(bounds):
                    out[:, j] = np.searchsorted(e, x[:, j])
                yield pa.RecordBatch.from_arrays([pa.array([(out + BINS * b["label"].to_numpy().astype(np.uint8)[:, None]).tobytes()], pa.binary())], names=["codes"])

    found = table.mapInArrow(run, "codes binary").toArrow()["codes"]
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(c.as_buffer(), np.uint8) for c in found)]).reshape(-1, len(bounds))


# trees


def impurity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the Gini impurity of nodes by their class weights, times their sum."""
    return a * b / np.maximum(a + b, 1e-300)


def grow(codes: np.ndarray, weights: np.ndarray, rng: np.random.Generator, depth: int, leaf: int, tried: int) -> np.ndarray:
    """A tree on rows drawn with replacement, as an array of ``NODE``.

    Each node tries ``tried`` features; a cut leaves ``leaf`` rows at least on either side and lessens the Gini impurity of the
    classes weighted by ``weights``.
    """
    n, width = codes.shape
    flat = codes.ravel()
    drawn = rng.poisson(1.0, n)
    base = np.flatnonzero(drawn)
    count = drawn[base].astype(float)
    base = base * width
    at = np.zeros(len(base), np.int64)
    whole = np.bincount(flat[base] // BINS, count, 2)[None]
    nodes = np.zeros(1, NODE)
    nodes["feature"], nodes["weight"] = -1, whole * weights
    places = np.zeros(1, np.int64)  # of the nodes that may be cut, which ``at`` numbers
    cells = tried * 2 * BINS
    for level in range(depth):
        if level == 0 and (whole.min() == 0 or whole.sum() < 2 * leaf):
            break
        a = len(places)
        tries = np.argsort(rng.random((a, width)), 1)[:, :tried]
        first_cell = (np.arange(a * tried) * 2 * BINS).reshape(a, tried)
        hist = np.zeros(a * cells)
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            place = tries.take(part, 0)
            place += base[i : i + CHUNK, None]
            key = first_cell.take(part, 0)
            key += flat.take(place)
            hist += np.bincount(key.ravel(), np.repeat(count[i : i + CHUNK], tried), a * cells)
        upto = hist.reshape(a, tried, 2, BINS).cumsum(3)
        whole = upto[:, 0, :, -1]
        below, above = upto[..., :-1], whole[:, None, :, None] - upto[..., :-1]
        rows = below[:, :, 0] + below[:, :, 1]
        after = impurity(below[:, :, 0] * weights[0], below[:, :, 1] * weights[1]) + impurity(above[:, :, 0] * weights[0], above[:, :, 1] * weights[1])
        after[(rows < leaf) | (rows > whole.sum(1)[:, None, None] - leaf)] = np.inf
        after = after.reshape(a, -1)
        best = after.argmin(1)
        cut = np.flatnonzero(after[np.arange(a), best] < impurity(*(whole * weights).T) * (1 - 1e-9))
        if not len(cut):
            break
        t, b = np.divmod(best[cut], BINS - 1)
        lower = upto[cut, t, :, b]
        children = np.stack([lower, whole[cut] - lower], 1).reshape(-1, 2)
        first = len(nodes)
        added = np.zeros(2 * len(cut), NODE)
        added["feature"], added["weight"] = -1, children * weights
        nodes = np.concatenate([nodes, added])
        p = places[cut]
        nodes["feature"][p], nodes["bin"][p] = tries[cut, t], b
        nodes["left"][p] = first + 2 * np.arange(len(cut))
        nodes["right"][p] = nodes["left"][p] + 1
        if level == depth - 1:
            break
        # rows go to the children that may be cut again; the others' rows are done
        live = (children.min(1) > 0) & (children.sum(1) >= 2 * leaf)
        number = np.where(live, np.cumsum(live) - 1, -1)
        child, feature, bound = np.full(2 * a, -1), np.zeros(a, np.int64), np.zeros(a, np.int64)
        child[2 * cut], child[2 * cut + 1] = number[0::2], number[1::2]
        feature[cut], bound[cut] = tries[cut, t], b
        at = child.take(2 * at + (flat.take(base + feature.take(at)) % BINS > bound.take(at)))
        keep = np.flatnonzero(at >= 0)
        at, base, count = at[keep], base[keep], count[keep]
        places = first + np.flatnonzero(live)
        if not len(places):
            break
    return nodes


def forest(table: DataFrame, width: int, classes: np.ndarray, bounds: list[np.ndarray], trees: int, depth: int, leaf: int, seed: int) -> Forest:
    """The forest of (x, label) with both classes counting the same, grown from codes in as many tasks as there are slots."""
    spark = table.sparkSession
    weights = np.divide(classes.sum() / 2, classes, out=np.zeros(2), where=classes > 0)
    tried = math.ceil(math.sqrt(width))
    sent = spark.sparkContext.broadcast(codes(table, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([grow(sent.value, weights, np.random.default_rng([seed % 2**32, i]), depth, leaf, tried).tobytes()], pa.binary())], names=["tree", "nodes"])

    grown = spark.range(0, trees, 1, min(trees, slots(spark))).mapInArrow(run, "tree long, nodes binary").collect()
    sent.destroy()
    each = [np.frombuffer(r["nodes"], NODE) for r in sorted(grown, key=lambda r: r["tree"])]
    roots = np.cumsum([0, *(len(t) for t in each[:-1])])
    nodes, shift = np.concatenate(each), np.repeat(roots, [len(t) for t in each])
    table_of = np.full((width, BINS), np.inf)
    for j, e in enumerate(bounds):
        table_of[j, : len(e)] = e
    inner = nodes["feature"] >= 0
    cut = np.where(inner, table_of[nodes["feature"], nodes["bin"]], np.inf)
    return Forest(nodes["feature"], cut, np.where(inner, nodes["left"] + shift, -1), np.where(inner, nodes["right"] + shift, -1), nodes["weight"], roots, depth)
