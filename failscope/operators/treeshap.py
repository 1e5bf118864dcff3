"""Exact Shapley values of trees from their leaves, polynomial in the number of features.

With one background row a leaf counts for a coalition if the row's own features satisfy its path where the coalition has them
and the background's where it has not. So a leaf's path splits features into those only the row satisfies (p of them), those
only the background does (q), and the rest; the weight of either kind is a ratio of factorials of p and q, whatever M is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import r6, valid

#: Rows whose values are computed at once, and most cells of a tree whose values are kept ready.
AT_ONCE, CELLS = 4096, 1 << 12


def leaves(model) -> list:
    """For each tree of a fitted Spark tree, forest or boosted regression (box, value) of every leaf: a box maps a feature to the
    interval (low, high] of its path; values are class 1's share, or the prediction times the tree's weight."""
    trees = getattr(model, "trees", None)
    if trees is None:
        trees, weights = [model], [1.0]
    else:
        weights = list(model.treeWeights)
        if hasattr(model, "numClasses"):
            if type(model).__name__.startswith("GBT"):
                raise ValueError("boosted classes have a link over their trees; explain a forest, a tree or a boosted regression")
            weights = [1.0 / len(trees)] * len(trees)
        elif type(model).__name__.startswith("RandomForest"):
            weights = [1.0 / len(trees)] * len(trees)
    out: list = []

    def walk(node, box, weight, classes, out) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats()) if classes else None
            out.append((box, weight * (stats[1] / sum(stats) if stats else node.prediction())))
            return
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only numeric splits are explained")
        f, at = split.featureIndex(), split.threshold()
        low, high = box.get(f, (-math.inf, math.inf))
        walk(node.leftChild(), box | {f: (low, min(high, at))}, weight, classes, out)
        walk(node.rightChild(), box | {f: (max(low, at), high)}, weight, classes, out)

    for tree, weight in zip(trees, weights):
        walk(tree._java_obj.rootNode(), {}, weight, hasattr(tree, "numClasses"), own := [])
        out.append(own)
    return out


def values(x: np.ndarray, background: np.ndarray, boxes: list[tuple[dict[int, tuple[float, float]], float]]) -> np.ndarray:
    """(rows, features) Shapley values of the sum of leaf boxes against the background row."""
    out = np.zeros(x.shape)
    most = 2 + max((len(b) for b, _ in boxes), default=0)
    factor = np.array([math.factorial(k) for k in range(2 * most)], float)
    for box, value in boxes:
        f = np.array(sorted(box), int)
        if not len(f):
            continue
        low, high = np.array([box[i] for i in f]).T
        own, base = (x[:, f] > low) & (x[:, f] <= high), (background[f] > low) & (background[f] <= high)
        plus, minus = own & ~base, ~own & base
        p, q = plus.sum(axis=1), minus.sum(axis=1)
        open_ = (own | base).all(axis=1) & (p + q > 0)
        up = np.where(p > 0, factor[np.maximum(p - 1, 0)] * factor[q] / factor[p + q], 0.0)
        down = np.where(q > 0, factor[p] * factor[np.maximum(q - 1, 0)] / factor[p + q], 0.0)
        out[:, f] += np.where(open_[:, None], value * (plus * up[:, None] - minus * down[:, None]), 0.0)
    return out


class Cells(NamedTuple):
    """A tree's values by cell: the features it cuts, where, and those features' values in each cell between
    cuts."""

    features: list[int]
    cuts: list[np.ndarray]
    table: np.ndarray


def cells(boxes: list, background: np.ndarray) -> Cells | None:
    """The cells of a tree, as rows between the same cuts have the same values; None where they are more than CELLS."""
    used = sorted({f for box, _ in boxes for f in box})
    cuts = [np.array(sorted({v for box, _ in boxes for v in box.get(f, ()) if math.isfinite(v)})) for f in used]
    if math.prod(len(c) + 1 for c in cuts) > CELLS:
        return None
    # a row of each cell: at its upper cut (a cell holds it), or over the last one
    ends = [np.append(c, np.inf) for c in cuts]
    x = np.zeros((math.prod(map(len, ends)), len(background)))
    for f, v in zip(used, np.meshgrid(*ends, indexing="ij")):
        x[:, f] = v.ravel()
    return Cells(used, cuts, values(x, background, boxes)[:, used])


def tabled(x: np.ndarray, background: np.ndarray, trees: list) -> np.ndarray:
    """(rows, features) Shapley values of the sum of trees, each its cells or, without, its leaf boxes."""
    out = np.zeros(x.shape)
    for tree in trees:
        if isinstance(tree, list):
            out += values(x, background, tree)
            continue
        at = np.zeros(len(x), np.int64)
        used, cuts, table = tree
        for f, cut in zip(used, cuts):
            at = at * (len(cut) + 1) + np.searchsorted(cut, x[:, f], side="left")
        out[:, used] += table[at]
    return out


def tree_shap(model, df: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """XP5 for trees: (key, feature, value), exact against the mean row, for any number of features. One pass; what tasks hold
    is the values of each tree's cells between its cuts, or its leaves where cells are many. Rows with a null or NaN feature are left out; equal rows have equal values."""
    rows = valid(df, *features).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    mean = rows.agg(*[F.avg(f) for f in features]).first()
    background = np.array([np.nan if v is None else v for v in mean], float)
    shared = rows.sparkSession.sparkContext.broadcast((background, [cells(t, background) or t for t in leaves(model)]))
    names = [f"v{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x = np.stack([part[f].to_numpy(zero_copy_only=False) for f in features], axis=1)
                yield pa.RecordBatch.from_arrays([part[key], *map(pa.array, tabled(x, background, trees).T.copy())], ["k", *names])

    out = rows.mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, {', '.join(f'{n} double' for n in names)}")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), r6(n).alias("value")) for f, n in zip(features, names)]))
    return out.select(F.col("k").alias(key), each.alias("e")).select(key, "e.feature", "e.value")
