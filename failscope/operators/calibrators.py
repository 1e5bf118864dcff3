"""Calibrators: maps from scores to probabilities, fitted by Spark and applied as expressions."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import r6, valid, written
from .calibration import errors, reliability


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def counted(df: DataFrame, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """(y, x, n): rows by label and score, written once for all passes of a fit; fits take
    it as ``counts`` where it is there already."""
    d = valid(df, y_true, y_prob).groupBy(F.col(y_true).cast("double").alias("y"), F.col(y_prob).cast("double").alias("x"))
    return written(d.agg(F.count(F.lit(1)).cast("double").alias("n")))


def platt(df: DataFrame, y_true="y_true", y_prob="y_prob", counts: DataFrame | None = None) -> tuple[float, float]:
    """CA6: (a, b) of the sigmoid 1 / (1 + exp(-(a score + b))) of the highest likelihood. One class only: no slope, and the
    smoothed logit of the share."""
    h = counted(df, y_true, y_prob) if counts is None else counts
    n, pos = h.agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).first()
    if not n or pos in (0, n):
        share = ((pos or 0) + 1) / ((n or 0) + 2)
        return 0.0, math.log(share / (1 - share))
    m = LogisticRegression(featuresCol="v", labelCol="y", weightCol="n", regParam=0.0, maxIter=100, tol=1e-9).fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(h))
    return float(m.coefficients[0]), float(m.intercept)


def platt_apply(score: Column, fitted: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(fitted[0] * score + fitted[1])))


def temperature(df: DataFrame, y_true="y_true", y_prob="y_prob", rounds: int = 4, grid: int = 24, counts: DataFrame | None = None) -> float:
    """CA7: the temperature (at least 0.01) by which logits are divided for the least log loss: the losses of a grid of
    temperatures in one aggregate over counted scores, then a finer grid around the best, ``rounds`` times."""
    d = (counted(df, y_true, y_prob) if counts is None else counts).select("y", "n", logit(F.col("x")).alias("z"))
    lo, hi, best = math.log(0.01), math.log(100.0), 1.0
    for _ in range(rounds):
        ts = [math.exp(lo + (hi - lo) * i / (grid - 1)) for i in range(grid)]
        # log(1 + exp(-s)) without overflow, s the signed logit
        loss = lambda t: F.sum(F.col("n") * (F.log1p(F.exp(-F.abs(F.col("z") / t))) + F.greatest(-F.when(F.col("y") == 1, F.col("z")).otherwise(-F.col("z")) / t, F.lit(0.0))))
        row = d.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(ts)]).first()
        if row["t0"] is None:
            return 1.0
        at = min(range(grid), key=lambda i: row[f"t{i}"])
        best, step = ts[at], (hi - lo) / (grid - 1)
        lo, hi = max(math.log(0.01), math.log(best) - step), math.log(best) + step
    return best


def temperature_apply(score: Column, t: float) -> Column:
    return 1 / (1 + F.exp(-logit(score) / t))


def isotonic(df: DataFrame, y_true="y_true", y_prob="y_prob", counts: DataFrame | None = None) -> list[tuple[float, float]]:
    """CA8: breakpoints (score, probability) of the nondecreasing fit of least squares. Scores are counted first, so the fit
    sees one weighted row a distinct score."""
    h = (counted(df, y_true, y_prob) if counts is None else counts).groupBy("x").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("w"))
    if h.isEmpty():
        return []
    m = IsotonicRegression(featuresCol="v", labelCol="y", weightCol="w").fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(h))
    return list(zip(map(float, m.boundaries), map(float, m.predictions)))


def isotonic_apply(score: Column, fitted: list[tuple[float, float]]) -> Column:
    """Linear between breakpoints, constant beyond them; the score itself where nothing was fitted."""
    if not fitted:
        return score
    xs, ys = F.array(*[F.lit(x) for x, _ in fitted]), F.array(*[F.lit(y) for _, y in fitted])
    i = F.size(F.filter(xs, lambda x: x <= score))
    lo, hi, a, b = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return F.when(i == 0, ys[0]).when(i == len(fitted), ys[len(fitted) - 1]).otherwise(a + (b - a) * (score - lo) / (hi - lo))


def auto_calibrate(fit: DataFrame, test: DataFrame, y_true="y_true", y_prob="y_prob", bins: int = 10) -> DataFrame:
    """CA12: (method, ece, chosen, improvement): raw, platt, temperature and isotonic, fitted on one part and compared by ECE
    on another in one unpivoted pass; raw is chosen where none is better. improvement is in % of the raw ECE."""
    s, n = F.col(y_prob).cast("double"), counted(fit, y_true, y_prob)
    made = {"raw": s, "platt": platt_apply(s, platt(fit, y_true, y_prob, n)), "temperature": temperature_apply(s, temperature(fit, y_true, y_prob, counts=n)), "isotonic": isotonic_apply(s, isotonic(fit, y_true, y_prob, n))}
    long = valid(test, y_true, y_prob).select(y_true, *[c.alias(n) for n, c in made.items()]).unpivot([y_true], list(made), "method", "p")
    e = errors(reliability(long, y_true, "p", bins, by=["method"]), ["method"]).select("method", "ece")
    best = e.agg(F.min_by("method", F.struct(F.round("ece", 12), (F.col("method") != "raw").cast("int"), "method")).alias("_b"), F.max(F.when(F.col("method") == "raw", F.col("ece"))).alias("_r"))
    gain = F.try_divide((F.col("_r") - F.col("ece")) * 100, F.col("_r"))
    return e.crossJoin(F.broadcast(best)).select("method", r6("ece").alias("ece"), (F.col("method") == F.col("_b")).alias("chosen"), F.round(gain, 4).alias("improvement"))
