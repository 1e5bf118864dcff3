"""Causal estimates by regression and matching; event studies. Regressions are sums of products in one aggregate and a
solve of as many equations as there are terms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.core import corr, r6, valid, written
from .causal import effects, simpson
from .prep import draw_of


def ols(df: DataFrame, terms: dict[str, Column], y: str) -> DataFrame:
    """(term, estimate, se, t, df, low, high) of y on the terms and an intercept, over rows where all are there.

    The products of centred terms are summed in one aggregate; only that table of (terms + 1)² numbers meets the driver.
    """
    names = list(terms)
    d = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())], F.col(y).cast("double").alias("y"))
    d = valid(d, *d.columns)
    cols = d.columns
    m = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]).first()
    n, k = m["n"], len(names) + 1
    mean = np.array([m[c] if m[c] is not None else 0.0 for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    s = d.agg(*[F.sum((F.col(cols[i]) - float(mean[i])) * (F.col(cols[j]) - float(mean[j]))).alias(f"s{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        g[i, j] = g[j, i] = s[f"s{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(g[:-1, :-1])
    beta = inverse @ g[:-1, -1]
    rest = max(0.0, g[-1, -1] - beta @ g[:-1, -1])
    sigma2 = rest / (n - k) if n > k else float("nan")
    se = np.sqrt(np.maximum(0, np.diag(inverse)) * sigma2)
    zero = mean[-1] - beta @ mean[:-1]
    se0 = np.sqrt(sigma2 * (1 / max(n, 1) + mean[:-1] @ inverse @ mean[:-1]))
    num = lambda v: None if v != v else float(v)
    rows = [(name, num(b), num(e), int(n - k)) for name, b, e in zip(["intercept", *names], [zero, *beta], [se0, *se])]
    out = df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, df bigint")
    out = out.withColumn("t", F.try_divide(F.col("estimate"), F.col("se"))).withColumn("p", dist.t_p(F.col("t"), F.col("df").cast("double")))
    half = dist.t_critical(F.greatest(F.col("df"), F.lit(1)).cast("double")) * F.col("se")
    out = out.withColumn("_h", half)
    return out.select("term", r6("estimate").alias("estimate"), r6("se").alias("se"), F.round("t", 4).alias("t"), "df", r6(F.col("estimate") - F.col("_h")).alias("low"), r6(F.col("estimate") + F.col("_h")).alias("high"), "p")


def adjusted_effect(df: DataFrame, t: str, y: str, covariates: list[str]) -> DataFrame:
    """CS5: the coefficient of a treatment (of any number of values) beside covariates."""
    return ols(df, {t: F.col(t), **{c: F.col(c) for c in covariates}}, y).where(F.col("term") == t)


def did_regression(df: DataFrame, t: str, y: str, post: Column, covariates: list[str] = ()) -> DataFrame:
    """CS11: the coefficient of treated x post beside both and covariates."""
    d = df.withColumn("_post", post.cast("double"))
    terms = {"treated": F.col(t), "post": F.col("_post"), "treated_post": F.col(t) * F.col("_post"), **{c: F.col(c) for c in covariates}}
    return ols(d, terms, y).where("term = 'treated_post'")


def parallel_trends(df: DataFrame, t: str, y: str, period: str, before: Column) -> DataFrame:
    """CS12: slopes of the period means of both groups before the change, and their difference."""
    m = df.where(before).groupBy(F.col(t).alias("t"), F.col(period).cast("double").alias("p")).agg(F.avg(y).alias("m"))
    slope = lambda k: F.regr_slope(F.when(F.col("t") == k, F.col("m")), F.when(F.col("t") == k, F.col("p")))
    return m.agg(slope(1).alias("treated"), slope(0).alias("control")).select(r6("treated").alias("treated_slope"), r6("control").alias("control_slope"), r6(F.col("treated") - F.col("control")).alias("difference"))


def event_study(df: DataFrame, t: str, y: str, relative: str) -> DataFrame:
    """CS13: treated less control mean in each period relative to the change, less that of period -1."""
    of = lambda k: F.avg(F.when(F.col(t) == k, F.col(y)))
    g = df.groupBy(F.col(relative).alias("period")).agg((of(1) - of(0)).alias("gap"), F.count(F.lit(1)).alias("n"))
    base = g.agg(F.max(F.when(F.col("period") == -1, F.col("gap"))).alias("_b"))
    return g.crossJoin(F.broadcast(base)).select("period", "n", r6(F.col("gap") - F.col("_b")).alias("effect"))


def propensity(df: DataFrame, t: str, covariates: list[str]) -> DataFrame:
    """CS2: df plus ``ps``, the probability of treatment by a logistic regression on scaled covariates (rows with a null one
    have none)."""
    x = VectorAssembler(inputCols=covariates, outputCol="_x", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(x).transform(x)
    model = LogisticRegression(featuresCol="_z", labelCol=t, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r").fit(x)
    return model.transform(x).withColumn("ps", vector_to_array("_p")[1]).drop("_x", "_z", "_p", "_y", "_r")


def nearest_scores(a: DataFrame, b: DataFrame, score: str, y: str, key: str) -> DataFrame:
    """(key, y, match) for each row of a: the outcome of the row of b whose score is nearest (ties: the smaller score, then
    the smaller key).

    Both sides are put in order of score once: a row's neighbours are the last and the next row of b, found by running
    last/first values inside ranges of scores, with the edges of ranges (one row each) carried over.
    """
    both = a.select(F.col(score).alias("s"), F.col(key).alias("k"), F.col(y).cast("double").alias("y"), F.lit(0).alias("b"))
    both = both.unionByName(b.groupBy(F.col(score).alias("s")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(y).cast("double").alias("y"))).alias("f")).select("s", "f.k", "f.y", F.lit(1).alias("b")))
    d = both.repartitionByRange("s").withColumn("_p", F.spark_partition_id())
    d = written(d)
    own = F.when(F.col("b") == 1, F.struct("s", "y"))
    edges = d.groupBy("_p").agg(F.max(own).alias("hi"), F.min(own).alias("lo"))
    w = Window.orderBy("_p")  # a row a partition
    edges = edges.select("_p", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
    up = Window.partitionBy("_p").orderBy("s", F.desc("b"))
    down = Window.partitionBy("_p").orderBy(F.desc("s"), F.desc("b"))
    last = F.last(own, True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    following = F.last(own, True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_l", last).withColumn("_r", following).where("b = 0").join(F.broadcast(edges), "_p")
    left, right = F.coalesce("_l", "_left"), F.coalesce("_r", "_right")
    match = F.when(right.isNull() | (F.abs(F.col("s") - left["s"]) <= F.abs(right["s"] - F.col("s"))), left["y"]).otherwise(right["y"])
    return d.select(F.col("k").alias(key), "y", match.alias("match"))


def matching(df: DataFrame, t: str, y: str, score: str, key: str = "row_id") -> DataFrame:
    """CS7, CS8: ATE by matching every row, ATT by matching treated rows, to the nearest propensity of the other group, with
    replacement."""
    rows = valid(df, t, y, score)
    treated, control = rows.where(F.col(t) == 1), rows.where(F.col(t) == 0)
    one = nearest_scores(treated, control, score, y, key).select((F.col("y") - F.col("match")).alias("d"), F.lit(1).alias("t"))
    two = nearest_scores(control, treated, score, y, key).select((F.col("match") - F.col("y")).alias("d"), F.lit(0).alias("t"))
    return one.unionByName(two).agg(r6(F.avg("d")).alias("ate"), r6(F.avg(F.when(F.col("t") == 1, F.col("d")))).alias("att"), F.count("d").alias("n"))


def refuted(df: DataFrame, t: str, y: str, covariates: list[str], key: str = "row_id") -> DataFrame:
    """CS17: the adjusted effect, and that of a placebo: the treatment dealt anew by a hash draw of the key at its mean."""
    own = adjusted_effect(df, t, y, covariates).select(F.col("estimate").alias("effect"), "se")
    share = df.agg(F.avg(F.col(t).cast("double")).alias("_share"))
    placebo = df.crossJoin(F.broadcast(share)).withColumn("_placebo", (draw_of(key, "placebo") < F.col("_share")).cast("double"))
    fake = adjusted_effect(placebo, "_placebo", y, covariates).select(F.col("estimate").alias("placebo"), F.col("se").alias("placebo_se"))
    return own.crossJoin(F.broadcast(fake)).withColumn("passes", (F.abs("placebo") < 0.1 * F.abs("effect")) | (F.abs("placebo") < 2 * F.col("placebo_se")))


def audit(df: DataFrame, t: str = "t", y: str = "y", ps: str = "ps", stratum: str = "stratum") -> DataFrame:
    """CS18: findings: a Simpson's paradox is HIGH, bad overlap MEDIUM; no row where all is well."""
    paradox = simpson(df, t, y, stratum).where("whole").select(F.lit("simpson").alias("finding"), F.lit("HIGH").alias("severity"), (F.col("paradox_by_correlation") | F.col("paradox_by_effect")).alias("_on"))
    overlap = effects(df, t, y, ps).select(F.lit("overlap").alias("finding"), F.lit("MEDIUM").alias("severity"), (~F.col("valid_overlap")).alias("_on"))
    return paradox.unionByName(overlap).where("_on").drop("_on")


def balance(df: DataFrame, t: str, covariates: list[str]) -> DataFrame:
    """Standardised mean difference and correlation with treatment of each covariate."""
    g = lambda f, k, c: f(F.when(F.col(t) == k, F.col(c).cast("double")))
    parts = [F.struct(F.lit(c).alias("covariate"), F.try_divide(g(F.avg, 1, c) - g(F.avg, 0, c), F.sqrt((g(F.var_samp, 1, c) + g(F.var_samp, 0, c)) / 2)).alias("d"), corr(t, c).alias("r")).alias(f"_{i}") for i, c in enumerate(covariates)]
    return df.agg(*parts).select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(covariates))])).alias("x")).select("x.covariate", r6("x.d").alias("smd"), r6("x.r").alias("r"))
