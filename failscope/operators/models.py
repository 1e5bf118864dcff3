"""Baseline models as Spark ML jobs over tables, with their results as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import r6, valid, written
from .evaluation import regression
from .prep import draw_of


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df written in even parts, two a core, so that the passes of a fit keep all cores busy, however few files or row groups
    the rows come from; dealt by the columns ``by``, in turn where there are none."""
    return written(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *by))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """df with a vector of the features; rows in which one is null or NaN are left out."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(valid(df, *features))


def simple_linear(df: DataFrame, x: str, y: str) -> DataFrame:
    """BM1 for one feature: slope, intercept and r2, in one aggregate."""
    return valid(df, x, y).agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


def linear(df: DataFrame, features: list[str], y: str, alpha: float = 0.0, lasso: bool = False):
    """BM1, BM2: least squares, ridge (RSS + alpha w²) or lasso (RSS / 2 + alpha |w|); the intercept is free."""
    d = assemble(df, features)
    n = max(1, d.count())
    return LinearRegression(labelCol=y, regParam=alpha / n, elasticNetParam=1.0 if lasso else 0.0, standardization=False).fit(d)


def coefficients(spark, model, features: list[str]) -> DataFrame:
    """Terms of a linear model."""
    rows = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients))]
    return spark.createDataFrame(rows, "term string, estimate double")


def scored(model, df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Errors of a regression model's predictions."""
    return regression(model.transform(assemble(df, features)), y, "prediction", features=len(features))


def logistic(df: DataFrame, features: list[str], y: str, c: float | None = None, classes: int = 2):
    """BM3: logistic regression, with an L2 penalty 1 / (c n) where c is given; softmax for more classes."""
    d = assemble(df, features)
    reg = 0.0 if c is None else 1 / (c * max(1, d.count()))
    return LogisticRegression(labelCol=y, regParam=reg, standardization=False, family="binomial" if classes == 2 else "multinomial").fit(d)


def tree(df: DataFrame, features: list[str], y: str, kind: str = "classifier", depth: int = 5, seed: int = 7, trees: int = 20):
    """BM4, BM5: a decision tree (classifier, regressor), a forest (forest, forest_regressor) or boosted trees (boosted)."""
    make = {"classifier": DecisionTreeClassifier, "regressor": DecisionTreeRegressor, "forest": RandomForestClassifier, "forest_regressor": RandomForestRegressor, "boosted": GBTClassifier}[kind]
    more = {"numTrees": trees} if kind.startswith("forest") else {"maxIter": trees} if kind == "boosted" else {}
    return make(labelCol=y, maxDepth=depth, seed=seed, **more).fit(assemble(df, features))


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 7):
    """BM6: k-means from parallel k-means++ starts."""
    return KMeans(k=k, seed=seed).fit(assemble(df, features))


def elbow(df: DataFrame, features: list[str], ks: list[int], seed: int = 7) -> DataFrame:
    """BM6, BM7: inertia and silhouette (squared Euclidean, linear time) for each number of clusters. Only the features are
    kept for the passes; the view behind them is read once."""
    d, rows = assemble(spread(valid(df, *features).select(*features)), features), []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(d)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(d))) if k > 1 else None))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def pca(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """BM8: (component, explained, loadings, reconstruction_error): share of variance of each component, its loadings and the
    mean squared error of rows rebuilt from all k."""
    d = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(x := assemble(df, features)).transform(x)
    m = PCA(k=k, inputCol="centred", outputCol="scores").fit(d)
    loadings = m.pc.toArray()
    err = reconstruction_error(m, d).agg(F.avg("error")).first()[0]
    rows = [(i + 1, float(m.explainedVariance[i]), [float(v) for v in loadings[:, i]], float(err) if err is not None else None) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, loadings array<double>, reconstruction_error double")


def reconstruction_error(model, centred: DataFrame) -> DataFrame:
    """centred plus ``error``: squared distance of each row to its projection (|x|² less |scores|², since loadings are
    orthonormal)."""
    d = model.transform(centred)
    sq = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
    return d.withColumn("error", F.greatest(sq("centred") - sq("scores"), F.lit(0.0)))


def out_of_fold(df: DataFrame, features: list[str], y: str, key: str = "row_id", classes: int = 2, k: int = 5, seed: int = 7) -> DataFrame:
    """BM9: (key, y, probs or score, prediction) of a forest for each row, fitted on the other folds; missing features are
    mean-filled from the training rows; for regression (classes 0) the score is min-max normalised."""
    d = valid(df, y).withColumn("_fold", F.floor(draw_of(key, "v") * k).cast("int"))
    d = spread(d.select(key, y, *[f for f in features if f not in (key, y)], "_fold"), key)  # read by every fold's passes
    out = None
    for i in range(k):
        train, test = d.where(F.col("_fold") != i), d.where(F.col("_fold") == i)
        means = train.agg(*[F.avg(f).alias(f) for f in features]).first()
        fill = {f: float(means[f]) if means[f] is not None else 0.0 for f in features}
        wide = lambda t, fill=fill: t.select(key, F.col(y).cast("double").alias(y), *[F.coalesce(F.col(f).cast("double"), F.lit(fill[f])).alias(f) for f in features])
        m = tree(wide(train), features, y, "forest" if classes else "forest_regressor", seed=seed)
        p = m.transform(assemble(wide(test), features))
        p = p.select(key, y, vector_to_array("probability").alias("probs"), "prediction") if classes else p.select(key, y, "prediction")
        out = p if out is None else out.unionByName(p)
    if classes:
        return out
    ends = out.agg(F.min("prediction").alias("_lo"), F.max("prediction").alias("_hi"))
    return out.crossJoin(F.broadcast(ends)).select(key, y, ((F.col("prediction") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias("score"), "prediction")


def sensitive_study(df: DataFrame, features: list[str], sensitive: str, y: str, group: str, key: str = "row_id") -> DataFrame:
    """BM10: a logistic model with and without a sensitive feature: accuracy and the gaps between groups of both, on rows
    that were not fitted."""
    from .fairness import gaps, group_rates

    d = written(df.withColumn("_test", draw_of(key, "study") < 0.3))
    out = None
    for name, cols in (("with", [*features, sensitive]), ("without", features)):
        x = assemble(d, cols, "raw")
        x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x.where("not _test")).transform(x)
        p = LogisticRegression(labelCol=y, regParam=0.0).fit(x.where("not _test")).transform(x.where("_test"))
        r = group_rates(p.withColumn("prediction", F.col("prediction").cast("int")), group, y, "prediction")
        one = gaps(r).crossJoin(F.broadcast(r.agg(r6(F.sum(F.col("tp") + F.col("tn")) / F.sum("n")).alias("accuracy")))).select(F.lit(name).alias("model"), "accuracy", "dp_gap", "eo_gap", "di_ratio")
        out = one if out is None else out.unionByName(one)
    return out


def domain_classifier(df: DataFrame, features: list[str], cohort: str = "cohort", key: str = "row_id", k: int = 3, top: int = 5) -> DataFrame:
    """DR7: AUC of a forest, fitted out of fold, that tells cohorts apart (over 0.65 WARNING, over 0.80 CRITICAL), with the
    ``top`` features by importance."""
    from .evaluation import auc

    d = spread(df.select(key, *[f for f in features if f != key], (F.col(cohort) != "reference").cast("int").alias("_y")), key)
    p = out_of_fold(d, features, "_y", key, 2, k).select("_y", F.col("probs")[1].alias("_p"))
    m = tree(d, features, "_y", "forest")
    best = sorted(zip(map(float, m.featureImportances.toArray()), features), key=lambda t: (-t[0], t[1]))[:top]
    a = auc(p.withColumn("_y", F.col("_y").cast("int")), "_y", "_p")
    return a.select("auc", F.when(F.col("auc") > 0.80, "CRITICAL").when(F.col("auc") > 0.65, "WARNING").otherwise("NONE").alias("level"), F.array(*[F.lit(f) for _, f in best]).alias("top_features"))


def pca_drift(df: DataFrame, features: list[str], cohort: str = "cohort", k: int = 5) -> DataFrame:
    """DR8: mean reconstruction error of both cohorts by components of the reference alone, their ratio (over 1.5 WARNING,
    over 2.0 CRITICAL)."""
    x = assemble(df, features)
    ref = x.where(F.col(cohort) == "reference")
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True).fit(ref)
    m = PCA(k=min(k, max(1, len(features) - 1)), inputCol="centred", outputCol="scores").fit(scaler.transform(ref))
    e = reconstruction_error(m, scaler.transform(x)).withColumn("_r", F.col(cohort) == "reference")
    g = e.agg(F.avg(F.when(F.col("_r"), F.col("error"))).alias("a"), F.avg(F.when(~F.col("_r"), F.col("error"))).alias("b"))
    ratio = F.try_divide(F.col("b"), F.col("a"))
    return g.select(r6("a").alias("reference_error"), r6("b").alias("current_error"), r6(ratio).alias("ratio"), F.when(ratio > 2.0, "CRITICAL").when(ratio > 1.5, "WARNING").otherwise("NONE").alias("level"))


def block_mmd(x: np.ndarray, reference: np.ndarray, permutations: int, bandwidth: float, seed: int) -> np.ndarray:
    """Unbiased squared maximum mean discrepancy of a block's rows under an RBF kernel: first by its labels, then by so many
    permutations of them. The kernel matrix is of this block alone; all labellings are products with it."""
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    k = np.exp(-d / (2 * bandwidth * bandwidth))
    np.fill_diagonal(k, 0.0)
    rng = np.random.default_rng(seed)
    labels = np.stack([reference] + [rng.permutation(reference) for _ in range(permutations)], axis=1).astype(float)
    n, m = reference.sum(), (~reference).sum()
    rr = np.einsum("ip,ip->p", labels, k @ labels)
    cc = np.einsum("ip,ip->p", 1 - labels, k @ (1 - labels))
    rc = np.einsum("ip,ip->p", labels, k @ (1 - labels))
    return rr / (n * (n - 1)) + cc / (m * (m - 1)) - 2 * rc / (n * m)


def kernel_drift(df: DataFrame, features: list[str], cohort: str = "cohort", key: str = "row_id", permutations: int = 100, block: int = 512, bandwidth: float = 1.0) -> DataFrame:
    """DR9: squared maximum mean discrepancy between the reference and the other rows under an RBF kernel, the share p of label
    permutations that reach it, drift under 0.05 and a level (CRITICAL under 0.01, WARNING under 0.05).

    Rows are dealt by a hash of the key into blocks of about ``block`` rows, so kernel matrices stay small however many rows
    there are; a block gives its unbiased statistic and those of permutations of its own labels, and both are averaged over
    blocks by their rows. One block is the whole matrix. Features are standardised. Rows with a null or NaN, or of no cohort,
    take no part; a block with fewer than two rows of a side gives nothing, and without any all is null and nothing drifts.
    """
    d = valid(df, cohort, *features).select(F.col(key).alias("k"), (F.col(cohort) == "reference").alias("r"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    d = written(d)
    names = [f"_{i}" for i in range(len(features))]
    at = d.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    blocks = max(1, round(at["n"] / block))
    scaled = [F.lit(0.0) if not at[f"s{c}"] else (F.col(c) - at[f"m{c}"]) / at[f"s{c}"] for c in names]
    d = d.select("k", "r", F.array(*scaled).alias("x"), F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(17)), F.lit(blocks)).alias("b"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", kind="stable")
        r = part["r"].to_numpy(bool)
        if min(r.sum(), (~r).sum()) < 2:
            return pd.DataFrame({"t": pd.Series(dtype="int32"), "v": pd.Series(dtype="float64"), "n": pd.Series(dtype="float64")})
        v = block_mmd(np.stack(part["x"].to_numpy()), r, permutations, bandwidth, int(part["b"].iloc[0]))
        return pd.DataFrame({"t": np.arange(len(v), dtype=np.int32), "v": v, "n": float(len(r))})

    v = d.groupBy("b").applyInPandas(one, "t int, v double, n double").groupBy("t").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    own = v.agg(F.max(F.when(F.col("t") == 0, F.col("v"))).alias("mmd2"))
    p = own.join(F.broadcast(v.where("t > 0")), F.lit(True), "left").groupBy("mmd2").agg(((F.count_if(F.col("v") >= F.col("mmd2")) + 1) / (F.count("v") + 1)).alias("p"))  # a row a permutation
    p = p.withColumn("p", F.when(F.col("mmd2").isNotNull(), F.col("p")))
    level = F.when(F.col("p") < 0.01, "CRITICAL").when(F.col("p") < 0.05, "WARNING").otherwise("NONE")
    return p.select(r6("mmd2").alias("mmd2"), r6("p").alias("p"), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("drift"), level.alias("level"))


def unsupervised_drift(df: DataFrame, features: list[str], cohort: str = "cohort", key: str = "row_id") -> DataFrame:
    """DR10: votes of DR7, DR8 and DR9: two or more CRITICAL, one WARNING, none NONE."""
    a, b, c = domain_classifier(df, features, cohort, key), pca_drift(df, features, cohort), kernel_drift(df, features, cohort, key)
    t = a.select("auc", (F.col("level") != "NONE").cast("int").alias("x")).crossJoin(b.select("ratio", (F.col("level") != "NONE").cast("int").alias("y"))).crossJoin(c.select("mmd2", F.coalesce("drift", F.lit(False)).cast("int").alias("z")))
    votes = F.col("x") + F.col("y") + F.col("z")
    return t.select("auc", "ratio", "mmd2", votes.alias("votes"), F.when(votes >= 2, "CRITICAL").when(votes == 1, "WARNING").otherwise("NONE").alias("level"))
