"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TILE_ROWS, components, cut, in_tiles, sorted_groups, union_labels, width

#: Number of lattices, neighbouring cells probed in each, and lattice units for a vector of length one.
TABLES, PROBES, SCALE = 8, 4, 2.0
#: Vectors multiplied with the rest of their tile at once.
ROWS = 256
SEED = 2024


def projections(dim: int, tables: int = TABLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(tables, dim, 8) random orthogonal projections that keep lengths on average, and (tables, 8) random shifts."""
    rng = np.random.default_rng([seed, dim])
    out = np.stack([np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] for _ in range(tables)])
    return out * np.sqrt(max(dim, 8) / 8), rng.random((tables, 8))


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and where the sum is odd re-round the coordinate
    that rounding moved most."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    off = y[odd] - r[odd]
    at = np.abs(off).argmax(axis=1)
    r[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points, in half units (so whole numbers): the better of the even integers and of those plus a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, in half units."""
    whole = [v for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((2, -2), repeat=2)
             for v in [[s if k == i else t if k == j else 0 for k in range(8)]]]
    half = [v for v in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, dtype=np.int64)


ROOTS = _roots()
_MIX = np.random.default_rng(5).integers(1 << 62, size=9, dtype=np.int64) | 1


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(n, tables, 1 + probes) cell keys of unit vectors: the home cell, then the nearest neighbouring cells."""
    p, shift = projections(x.shape[1], tables)
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            y = scale * (x @ p[t]) + shift[t]
            home = decode(y)
            key = lambda c, t=t: c @ _MIX[:8] + t * _MIX[8] + len(p[t]) * 7919
            out[:, t, 0] = key(home)
            if probes:
                near = np.argpartition(-((y - home / 2) @ (ROOTS.T / 2)), probes - 1, axis=1)[:, :probes]
                for k in range(probes):
                    out[:, t, 1 + k] = key(home + ROOTS[near[:, k]])
    return out


def _first(ci: np.ndarray, cj: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether (table, cell) is the first place where rows with cell keys ci and cj meet; a place is where both have a
    key and at least one of them is at home."""
    first = np.ones(len(ci), bool)
    for t in range(table):
        hi, hj = ci[:, t, :1], cj[:, t, :1]
        first &= ~((ci[:, t] == hj).any(axis=1) | (cj[:, t] == hi).any(axis=1))
    hi, hj = ci[:, table, 0], cj[:, table, 0]
    least = np.where((cj[:, table] == hi[:, None]).any(axis=1), hi, np.iinfo(np.int64).max)
    least = np.minimum(least, np.where((ci[:, table] == hj[:, None]).any(axis=1), hj, np.iinfo(np.int64).max))
    return first & (least == cell)


def compare(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """In one pair of tiles of one cell: new links of each row (by count of copies) and pairs that join all linked rows."""
    n = len(rows)
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    home, tile, mult = rows["home"].to_numpy(bool), rows["tile"].to_numpy(), rows["mult"].to_numpy()
    table, cell = int(rows["t"].iloc[0]), int(rows["cell"].iloc[0])
    one = rows["tile_a"].iloc[0] == rows["tile_b"].iloc[0]
    left = np.arange(n) if one else np.flatnonzero(tile == rows["tile_a"].iloc[0])
    right = np.arange(n) if one else np.flatnonzero(tile == rows["tile_b"].iloc[0])
    links, root, pairs, keys = np.zeros(n, np.int64), np.arange(n), [], None
    for s in range(0, len(left), ROWS):
        a = left[s : s + ROWS]
        hit = (x[a] @ x[right].T) / (norm[a][:, None] * norm[right][None, :]) >= threshold
        hit &= home[a][:, None] | home[right][None, :]
        i, j = np.nonzero(hit)
        i, j = a[i], right[j]
        if one:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        if keys is None:
            keys = cells(x / norm[:, None])
        new = _first(keys[i], keys[j], table, cell)
        np.add.at(links, i[new], mult[j[new]])
        np.add.at(links, j[new], mult[i[new]])
        ri, rj = root[i], root[j]
        if (ri != rj).any():
            got = np.unique(np.stack([ri[ri != rj], rj[ri != rj]], axis=1), axis=0)
            root = union_labels(n, got)[root]
    member = np.flatnonzero(root != np.arange(n))
    return links, np.stack([member, root[member]], axis=1)


def usable(v: Column | str) -> Column:
    """A vector that can link: not null or zero, no null or non-finite component."""
    v = F.col(v) if isinstance(v, str) else v
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(emb: DataFrame, threshold: float = 0.93, tile: int = TILE_ROWS) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept) of every row.

    Rows of equal label link where their cosine (double precision) is at least threshold. Each vector of length one is
    projected TABLES times to eight dimensions and decoded to the nearest E8 point; it is filed in that cell and probes
    the nearest neighbouring cells. Rows meet in a cell if one of them is at home there; those that meet are verified. A
    pair found in several cells counts in the first of them only, so n_links is exact over what was found. Groups that
    are too large for a task are dealt into pairs of tiles. Inside a tile pair only a spanning set of links is emitted,
    and counts a row, so copies are never expanded. Equal vectors of a label are one class with a multiplicity.

    Null labels and unusable vectors link with nothing and keep their row (n_links 0, own component). Vectors of other
    lengths do not link. Repeated rows count as copies. A null vec_id counts as a vector but names no component. Empty
    input: no rows.
    """
    spark = emb.sparkSession
    rows = emb.select("vec_id", "label", "embedding")
    key = [F.xxhash64("embedding").alias("h1"), F.hash("embedding", F.lit(3)).alias("h2")]
    fine = F.col("label").isNotNull() & usable("embedding")
    classes = rows.where(fine).select("*", *key).groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding"))
    node = F.coalesce("least", -1 - F.shiftrightunsigned("h1", 1))
    classes = cut(classes.select("label", "h1", "h2", "least", node.alias("node"), "mult", "embedding"), "vectors")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["embedding"].map(len).to_numpy()
            for d in np.unique(dims):
                part = b[dims == d]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                got = cells(x / np.sqrt((x * x).sum(axis=1))[:, None])
                n, tables, each = got.shape
                yield pd.DataFrame({
                    "label": np.repeat(part["label"].to_numpy(), tables * each), "node": np.repeat(part["node"].to_numpy(), tables * each),
                    "dim": int(d), "t": np.tile(np.repeat(np.arange(tables), each), n), "cell": got.ravel(),
                    "home": np.tile(np.arange(each) == 0, n * tables)})

    kind = classes.schema["label"].dataType.simpleString()
    signed = classes.select("label", "node", "embedding").mapInPandas(sign, f"label {kind}, node bigint, dim int, t int, cell bigint, home boolean")
    group = ["label", "dim", "t", "cell"]
    signed = cut(signed, "cells")
    dealt = in_tiles(signed, group, F.xxhash64("node"), tile, having=F.max("home"))
    dealt = dealt.join(classes.select("label", "node", "mult", "embedding"), ["label", "node"])
    by = [*group, "tile_a", "tile_b"]
    dealt = dealt.repartition(2 * width(spark), *by).sortWithinPartitions(*by)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(batches, by):
            for _, g in part.groupby(by, sort=False):
                if len(g) < 2:
                    continue
                links, pairs = compare(g.reset_index(drop=True), threshold)
                ids, some = g["node"].to_numpy(), np.flatnonzero(links)
                if len(some):
                    yield pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "n": links[some]})
                if len(pairs):
                    yield pd.DataFrame({"a": ids[pairs[:, 0]], "b": pd.array(ids[pairs[:, 1]], "Int64"), "n": np.int64(0)})

    found = cut(dealt.mapInPandas(verify, "a bigint, b bigint, n bigint"), "links")
    comp = components(found.where("b is not null").select("a", "b"))
    count = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    least = classes.select("node", "least").join(comp, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = comp.join(least, "root").select("node", "component_id").join(count, "node", "full")
    info = classes.drop("embedding").join(named, "node", "left").select(
        "label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.withColumn("_fine", fine).select("vec_id", "label", F.when(F.col("_fine"), key[0]).alias("h1"), F.when(F.col("_fine"), key[1]).alias("h2"))
    out = out.join(info, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.cast("bigint").alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
