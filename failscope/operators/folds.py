"""Cross-validation and out-of-fold scores from sufficient statistics by fold.

One aggregate gives the count, means and sums of products of every fold. The statistics of any other set of folds are their
sum, so every model that leaves one fold out, every nested fold and every penalty of a grid is solved from that one pass, and
the squared error on a fold too. What meets the driver is a small matrix a fold (and class), whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import r6, valid
from .prep import draw_of


class Moments(NamedTuple):
    """Rows, means, and sums of products of what is left of the means."""

    n: float
    mean: np.ndarray
    products: np.ndarray


def fold_of(key: str, k: int, salt: str = "v") -> Column:
    return F.floor(draw_of(key, salt) * k).cast("int")


def moments(df: DataFrame, by: list[str], columns: list[str]) -> dict[tuple, Moments]:
    """Moments of each group of whole numbers or null, in one pass: every task sums its rows batch by batch, and what tasks
    found is put together by group. Groups must be few, and values not null."""
    width, none = len(columns), -(1 << 62)
    x = df.select(*[F.coalesce(F.col(b).cast("bigint"), F.lit(none)).alias(f"g{i}") for i, b in enumerate(by)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def joined(a, b):  # (n, means, products) of both; plain tuples, so workers need no package
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def rows(found: dict) -> pd.DataFrame:
        keys = list(found)
        own = {f"g{i}": np.array([k[i] for k in keys], np.int64) for i in range(len(by))}
        return pd.DataFrame(own | {"n": np.array([found[k][0] for k in keys], float), "m": [found[k][1].tolist() for k in keys], "p": [found[k][2].ravel().tolist() for k in keys]})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for b in batches:
            v = b.to_numpy(np.float64) if width else np.zeros((len(b), len(by)))
            v = v[:, len(by) :]
            keys, at = np.unique(b[[f"g{i}" for i in range(len(by))]].to_numpy(np.int64), axis=0, return_inverse=True)
            for j, k in enumerate(map(tuple, keys)):
                part = v[at.ravel() == j]
                mean = part.mean(axis=0)
                part = part - mean
                found[k] = joined(found.get(k), (float(len(part)), mean, part.T @ part))
        if found:
            yield rows(found)

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        got = None
        for n, m, p in zip(part["n"], part["m"], part["p"]):
            got = joined(got, (n, np.array(m, float), np.array(p, float).reshape(width, width)))
        return rows({tuple(part[f"g{i}"].iloc[0] for i in range(len(by))): got})

    schema = ", ".join([*(f"g{i} bigint" for i in range(len(by))), "n double, m array<double>, p array<double>"])
    tasks = x.mapInPandas(own, schema)  # a row a task and group
    got = tasks.groupBy(*[f"g{i}" for i in range(len(by))]).applyInPandas(whole, schema).collect()
    name = lambda v: None if v == none else v
    return {tuple(name(r[f"g{i}"]) for i in range(len(by))): Moments(r["n"], np.array(r["m"], float), np.array(r["p"], float).reshape(width, width)) for r in got}


def together(parts: list[Moments]) -> Moments | None:
    """Moments of all rows of the parts."""
    n = sum(p.n for p in parts)
    if not n:
        return None
    mean = sum(p.n * p.mean for p in parts) / n
    return Moments(n, mean, sum(p.products + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts))


def ridge(m: Moments, reg: float = 0.0) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the last column on the others, with a penalty ``reg`` on the squared weights of scaled columns
    against the mean squared error. A constant column has weight 0; of linearly dependent ones the least weights are taken."""
    sd = np.sqrt(np.diag(m.products)[:-1] / m.n)
    scale = np.where(sd > 0, sd, 1)
    r = m.products[:-1, :-1] / m.n / np.outer(scale, scale)
    beta = np.linalg.lstsq(r + reg * np.eye(len(r)), m.products[:-1, -1] / m.n / scale, rcond=1e-12)[0]
    w = np.where(sd > 0, beta / scale, 0.0)
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def squared_error(m: Moments, w: np.ndarray, b: float) -> float:
    """Sum of squared errors of a linear model over the rows behind the moments."""
    s, off = m.products, m.mean[-1] - b - w @ m.mean[:-1]
    return float(max(0.0, s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w) + m.n * off * off)


def _scores(train: Moments | None, test: Moments | None, reg: float) -> tuple[float | None, float | None]:
    """(rmse, r2) on the test rows; null where either side is empty, r2 also where the test rows are constant."""
    if train is None or test is None:
        return None, None
    e, spread = squared_error(test, *ridge(train, reg)), test.products[-1, -1]
    return float(np.sqrt(e / test.n)), float(1 - e / spread) if spread > 0 else None


def ridge_folds(df: DataFrame, features: list[str], y: str, key: str = "row_id", k: int = 5, reg: float = 0.0) -> DataFrame:
    """VS6 for linear models: (fold, n, rmse, r2) of each fold under a model of the others, with the mean, sample deviation
    and 1.96 interval of rmse. One scan. Rows with a null or NaN take no part; folds are by hash of the key."""
    parts = {f: m for (f,), m in moments(valid(df, y, *features).withColumn("_f", fold_of(key, k)), ["_f"], [*features, y]).items()}
    rows = []
    for f in range(k):
        rmse, r2 = _scores(together([m for g, m in parts.items() if g != f]), parts.get(f), reg)
        rows.append((f, int(parts[f].n) if f in parts else 0, rmse, r2))
    out = df.sparkSession.createDataFrame(rows, "fold int, n bigint, rmse double, r2 double")
    s = out.agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"))
    half = 1.96 * F.col("std") / float(k) ** 0.5
    return out.crossJoin(F.broadcast(s)).select("fold", "n", r6("rmse").alias("rmse"), r6("r2").alias("r2"), r6("mean").alias("mean"), r6("std").alias("std"), r6(F.col("mean") - half).alias("low"), r6(F.col("mean") + half).alias("high"))


def ridge_nested(df: DataFrame, features: list[str], y: str, grid: list[float], key: str = "row_id", outer: int = 5, inner: int = 3) -> DataFrame:
    """VS7 for linear models: (fold, reg, rmse, r2): for each outer fold the penalty of the grid whose inner folds have the
    least mean rmse (ties: the first), and the outer fold's scores under a model of the other folds with it. One scan: inner
    folds are of all rows, so a training set is the cells (outer, inner) that leave both out."""
    cells = moments(valid(df, y, *features).withColumn("_o", fold_of(key, outer, "outer")).withColumn("_i", fold_of(key, inner, "inner")), ["_o", "_i"], [*features, y])
    pick = lambda keep: together([m for at, m in cells.items() if keep(*at)])
    rows = []
    for o in range(outer):
        tried = []
        for reg in grid:
            got = [_scores(pick(lambda a, b: a != o and b != i), pick(lambda a, b: a != o and b == i), reg)[0] for i in range(inner)]  # noqa: B023
            got = [s for s in got if s is not None]
            tried.append(float(np.mean(got)) if got else np.inf)
        best = grid[int(np.argmin(tried))]
        rows.append((o, float(best), *_scores(pick(lambda a, b: a != o), pick(lambda a, b: a == o), best)))  # noqa: B023
    out = df.sparkSession.createDataFrame(rows, "fold int, reg double, rmse double, r2 double")
    return out.select("fold", "reg", r6("rmse").alias("rmse"), r6("r2").alias("r2"))


def discriminant(parts: dict[int, Moments], shrink: float = 1e-6) -> dict[int, tuple[np.ndarray, float]]:
    """(weights, intercept) of each class's log probability up to a common term: normal classes with one covariance."""
    n = sum(p.n for p in parts.values())
    cov = sum(p.products for p in parts.values()) / n
    cov = cov + shrink * (np.trace(cov) / len(cov) + 1e-12) * np.eye(len(cov))
    out = {}
    for c, p in parts.items():
        w = np.linalg.solve(cov, p.mean)
        out[c] = w, float(np.log(p.n / n) - w @ p.mean / 2)
    return out


def linear(weights: Column, features: list[str]) -> Column:
    """Inner product of an array column with feature columns."""
    return sum((weights[i] * F.col(f).cast("double") for i, f in enumerate(features)), F.lit(0.0))


def out_of_fold(df: DataFrame, features: list[str], y: str, key: str = "row_id", k: int = 5, reg: float = 0.0) -> DataFrame:
    """(key, y, yhat): each row's prediction by a linear model of the other folds. Rows with a null or NaN are left out."""
    d = valid(df, y, *features).withColumn("_f", fold_of(key, k))
    parts, rows = {f: m for (f,), m in moments(d, ["_f"], [*features, y]).items()}, []
    for f in parts:
        rest = together([m for g, m in parts.items() if g != f])
        w, b = ridge(rest, reg) if rest is not None else (np.zeros(len(features)), float(parts[f].mean[-1]))
        rows.append((f, w.tolist(), b))
    models = df.sparkSession.createDataFrame(rows, "_f int, _w array<double>, _b double")
    return d.join(F.broadcast(models), "_f").select(key, F.col(y).cast("double").alias("y"), (linear(F.col("_w"), features) + F.col("_b")).alias("yhat"))  # a row a fold


def out_of_fold_classes(df: DataFrame, features: list[str], label: str, classes: int, key: str = "row_id", k: int = 5) -> DataFrame:
    """(key, label, p0, p1, ...): each row's class probabilities by a linear discriminant of the other folds; a class that
    those do not hold has 0. Two passes over the rows: one for the statistics of all folds and classes, one for the scores."""
    d = valid(df, label, *features).where(F.col(label).between(0, classes - 1)).withColumn("_f", fold_of(key, k)).withColumn("_c", F.col(label).cast("int"))
    cells, rows = moments(d, ["_f", "_c"], features), []
    for f in sorted({f for f, _ in cells}):
        rest = {c: together([m for (g, h), m in cells.items() if g != f and h == c]) for c in range(classes)}
        rest = {c: m for c, m in rest.items() if m is not None}
        model = discriminant(rest) if rest else {}
        rows.append((f, [model[c][0].tolist() if c in model else None for c in range(classes)], [model[c][1] if c in model else None for c in range(classes)]))
    models = df.sparkSession.createDataFrame(rows, "_f int, _w array<array<double>>, _b array<double>")
    d = d.join(F.broadcast(models), "_f")  # a row a fold
    return d.select(key, F.col(label).alias("label"), *[p.alias(f"p{c}") for c, p in enumerate(probabilities(F.col("_w"), F.col("_b"), features, classes))])


def probabilities(weights: Column, intercepts: Column, features: list[str], classes: int) -> list[Column]:
    """Class probabilities of linear log scores; 0 where a class has none, all 0 where no class has."""
    scores = [linear(weights[c], features) + intercepts[c] for c in range(classes)]
    top = F.greatest(*scores) if classes > 1 else scores[0]
    parts = [F.coalesce(F.exp(s - top), F.lit(0.0)) for s in scores]
    return [F.coalesce(F.try_divide(p, sum(parts[1:], parts[0])), F.lit(0.0)) for p in parts]
