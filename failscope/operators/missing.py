"""Missing data: rates, patterns, mechanisms, imputation and pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.core import corr, r6, written
from .prep import draw_of


def _gone(c: str):
    return F.col(c).isNull()


def _each(df: DataFrame, parts: list) -> DataFrame:
    """A row for each aggregated struct of parts, from one aggregate."""
    g = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)])
    return g.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(parts))])).alias("x")).select("x.*")


def missing_profile(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """MD1, MD5, MD7, MD9: missing rate, correlation of the indicator with the target, target gap, mechanism by gap, and
    whether the indicator is worth keeping (|r| of 0.1) or is a signal by itself (over 0.2)."""
    y, parts = F.col(target).cast("double"), []
    for c in cols:
        gap = F.abs(F.avg(F.when(_gone(c), y)) - F.avg(F.when(~_gone(c), y)))
        parts.append(F.struct(F.lit(c).alias("feature"), F.avg(_gone(c).cast("double")).alias("rate"), corr(_gone(c).cast("double"), target).alias("r"), gap.alias("gap")))
    mech = F.when(F.col("rate") == 0, "NONE").when(F.col("gap") > 0.10, "MNAR").when(F.col("gap") > 0.05, "MAR").otherwise("MCAR")
    return _each(df, parts).select("feature", r6("rate").alias("missing_rate"), r6("r").alias("target_corr"), r6("gap").alias("target_gap"), mech.alias("mechanism"),
                                   (F.abs("r") >= 0.1).alias("keep_indicator"), (F.abs("r") > 0.2).alias("signal"), (F.col("rate") > 0.3).alias("high_missing"))


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """MD2: rows of each pattern of missing columns."""
    return df.groupBy(F.concat(*[F.when(_gone(c), "1").otherwise("0") for c in cols]).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def little_test(df: DataFrame, cols: list[str]) -> DataFrame:
    """MD3: Little's test: d² of the pattern means against the whole's, weighted by the inverse of the pairwise-complete
    covariance of the columns that a pattern has; df is their number less that of all columns. Means and covariances are one
    aggregate, patterns another (at most 2^columns rows); only the small solve for a pattern is Python."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    whole = d.agg(F.array(*[F.avg(c) for c in cols]).alias("mu"), F.array(*[F.coalesce(F.covar_samp(cols[i], cols[j]), F.lit(0.0)) for i, j in pairs]).alias("cov"))
    pattern = F.concat(*[F.when(_gone(c), "1").otherwise("0") for c in cols])
    means = d.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"))
    k = len(cols)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.itertuples():
            at = [i for i, p in enumerate(r.pattern) if p == "0"]
            if at:
                sigma = np.zeros((k, k))
                for (i, j), v in zip(pairs, r.cov):
                    sigma[i, j] = sigma[j, i] = v
                diff = np.array([r.means[i] - r.mu[i] for i in at])
                out.append((float(r.n * diff @ np.linalg.pinv(sigma[np.ix_(at, at)]) @ diff), len(at)))
        return pd.DataFrame(out, columns=["d2", "seen"])

    each = means.crossJoin(F.broadcast(whole)).groupBy("pattern").applyInPandas(solve, "d2 double, seen int")
    t = each.agg(F.coalesce(F.sum("d2"), F.lit(0.0)).alias("d2"), F.greatest(F.coalesce(F.sum("seen"), F.lit(0)) - k, F.lit(0)).alias("df"))
    t = t.withColumn("p", dist.chi2_p(F.col("d2"), F.col("df").cast("double")))
    return t.select(F.round("d2", 4).alias("d2"), "df", "p", (F.col("p") > 0.05).alias("mcar"))


def association(df: DataFrame, cols: list[str]) -> DataFrame:
    """MD4: for each incomplete column the other column whose mean-filled values correlate most with its indicator."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(means)).select(*cols, *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(f"_f_{c}") for c in cols])
    parts = [F.struct(F.lit(c).alias("feature"), F.lit(o).alias("other"), F.abs(corr(_gone(c).cast("double"), f"_f_{o}")).alias("r")) for c in cols for o in cols if o != c]
    t = _each(d, parts).where("r is not null")
    return t.groupBy("feature").agg(F.max_by("other", F.struct(F.round("r", 9), "other")).alias("other"), r6(F.max("r")).alias("r"))


def mechanism(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """MD6: NONE without missing values; MCAR where Little's test passes; MNAR where the indicator's correlation with the
    target is over 0.3; MAR where that with another column is over 0.2; else MNAR (Suspected)."""
    p = missing_profile(df, cols, target).select("feature", "missing_rate", F.abs("target_corr").alias("y"))
    t = p.join(association(df, cols).select("feature", F.col("r").alias("x")), "feature", "left").crossJoin(F.broadcast(little_test(df, cols).select("mcar")))
    kind = F.when(F.col("missing_rate") == 0, "NONE").when(F.col("mcar"), "MCAR").when(F.col("y") > 0.3, "MNAR").when(F.col("x") > 0.2, "MAR").otherwise("MNAR (Suspected)")
    return t.select("feature", "missing_rate", r6("y").alias("target_corr"), "x", kind.alias("mechanism"))


def association_tests(df: DataFrame, cols: list[str], others: list[str], alpha: float = 0.05) -> DataFrame:
    """MD8: for each incomplete column and up to five others a test of the indicator against the other: chi-square of its
    classes for a text, Welch's t for a number; MAR where any p is under alpha, else MCAR."""
    kinds, out = dict(df.dtypes), None
    for c in cols:
        for o in [x for x in others if x != c][:5]:
            if kinds[o] == "string":
                k = df.where(F.col(o).isNotNull()).groupBy(F.col(o).alias("v")).agg(F.count_if(_gone(c)).alias("a"), F.count_if(~_gone(c)).alias("b"))
                t = k.crossJoin(F.broadcast(k.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))))
                e = lambda x: (F.col("a") + F.col("b")) * F.col(x) / (F.col("ta") + F.col("tb"))
                x = F.sum(F.try_divide((F.col("a") - e("ta")) * (F.col("a") - e("ta")), e("ta")) + F.try_divide((F.col("b") - e("tb")) * (F.col("b") - e("tb")), e("tb")))
                r = t.agg(x.alias("s"), (F.count(F.lit(1)) - 1).cast("double").alias("d"))
                r = r.withColumn("p", dist.chi2_p(F.col("s"), F.col("d"))).withColumn("test", F.lit("chi2"))
            else:
                g = lambda f, on: f(F.when(on, F.col(o).cast("double")))  # noqa: B023, E731
                m = df.agg(*[g(f, on).alias(f"{n}{s}") for s, on in (("a", _gone(c)), ("b", ~_gone(c))) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
                wa, wb = F.try_divide(F.col("va"), F.col("na")), F.try_divide(F.col("vb"), F.col("nb"))
                r = m.select(F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(wa + wb)).alias("s"), F.try_divide((wa + wb) * (wa + wb), F.try_divide(wa * wa, F.col("na") - 1) + F.try_divide(wb * wb, F.col("nb") - 1)).alias("d"))
                r = r.withColumn("p", dist.t_p(F.col("s"), F.col("d"))).withColumn("test", F.lit("t"))
            r = r.select(F.lit(c).alias("feature"), F.lit(o).alias("other"), "test", r6("s").alias("statistic"), F.round("d", 4).alias("df"), "p")
            out = r if out is None else out.unionByName(r)
    own = F.max((F.col("p") < alpha).cast("int")).over(Window.partitionBy("feature"))
    return out.withColumn("mechanism", F.when(own == 1, "MAR").otherwise("MCAR"))


def pattern_clusters(df: DataFrame, cols: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """MD11: k-means over the indicators, by pattern with its number of rows as weight."""
    from pyspark.ml.clustering import KMeans

    p = missing_patterns(df, cols)
    p = p.select("*", *[F.substring("pattern", i + 1, 1).cast("double").alias(f"_i{i}") for i in range(len(cols))]).withColumn("_w", F.col("n").cast("double"))
    x = VectorAssembler(inputCols=[f"_i{i}" for i in range(len(cols))], outputCol="_x").transform(p)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", weightCol="_w").fit(x)
    return model.transform(x).select("pattern", "n", "cluster")


def pool(estimates: DataFrame, estimate: str = "estimate", variance: str = "variance") -> DataFrame:
    """MD14: Rubin's rules over a row an imputation: mean, within and between variance and the total."""
    g = estimates.agg(F.count(F.lit(1)).alias("m"), F.avg(estimate).alias("q"), F.avg(variance).alias("w"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("b"))
    return g.select("m", r6("q").alias("estimate"), r6("w").alias("within"), r6("b").alias("between"), r6(F.col("w") + (1 + 1 / F.col("m")) * F.col("b")).alias("total"))


def audit(profile: DataFrame) -> DataFrame:
    """MD15: largest and mean missing rate of a profile, severity by the largest (over 0.05 MEDIUM, over 0.20 HIGH; HIGH for
    any MNAR) and by the mean of all cells (over 0.1 MEDIUM, over 0.3 HIGH)."""
    g = profile.agg(F.max("missing_rate").alias("max_rate"), F.avg("missing_rate").alias("cell_rate"), F.count_if(F.col("mechanism").startswith("MNAR")).alias("mnar"))
    level = F.when((F.col("max_rate") > 0.20) | (F.col("mnar") > 0), "HIGH").when(F.col("max_rate") > 0.05, "MEDIUM").otherwise("LOW")
    cells = F.when(F.col("cell_rate") > 0.3, "HIGH").when(F.col("cell_rate") > 0.1, "MEDIUM").otherwise("LOW")
    return g.select(r6("max_rate").alias("max_rate"), r6("cell_rate").alias("cell_rate"), "mnar", level.alias("severity"), cells.alias("cell_severity"))
