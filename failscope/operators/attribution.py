"""Attribution: importance by permutation, dropping and impurity, Shapley values, local linear models, agreement."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import corr, r6, valid, written
from .models import assemble


def permutation_importance(model, df: DataFrame, features: list[str], score: Column, key: str = "row_id", repeats: int = 2) -> DataFrame:
    """XP1: mean and deviation over repeats of the drop of a score (a column over the model's output) when one feature's
    values are dealt anew. Values are dealt among rows by rank of a hash within each value of (feature, repeat): the row at
    a place in one hash order gets the value of the row at that place in another."""
    df = written(df)  # read twice for every feature and repeat
    base = model.transform(assemble(df, features)).agg(F.avg(score).alias("_base"))
    rows = df.select(key, *[c for c in df.columns if c != key])
    n = rows.rdd.getNumPartitions()
    out = None
    for f, r in itertools.product(features, range(repeats)):
        place = lambda d, salt: _numbered(d.withColumn("_h", F.xxhash64(F.col(key), F.lit(salt))), ["_h", key], max(1, n))  # noqa: B023, E731
        given = place(rows.select(key, F.col(f).alias("_new")), f"{f}{r}a").select("_at", "_new")
        dealt = place(rows, f"{f}{r}b").join(given, "_at").withColumn(f, F.col("_new")).drop("_at", "_new", "_h")
        one = model.transform(assemble(dealt, features)).agg(F.avg(score).alias("s")).select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), "s")
        out = one if out is None else out.unionByName(one)
    d = out.crossJoin(F.broadcast(base)).withColumn("d", F.col("_base") - F.col("s"))
    return d.groupBy("feature").agg(r6(F.avg("d")).alias("importance"), r6(F.coalesce(F.stddev_samp("d"), F.lit(0.0))).alias("std"))


def _numbered(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df with ``_at``, its place in order, from ranges and row numbers inside them."""
    d = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return d.withColumn("_i", at).join(F.broadcast(sizes), "_p").withColumn("_at", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def drop_importance(df: DataFrame, test: DataFrame, features: list[str], fit, score: Column) -> DataFrame:
    """XP2: drop of the score on test rows when a model is fitted without a feature. ``fit`` takes rows and features. Rows are
    written once for all fits."""
    df, test = written(df), written(test)
    measure = lambda cols: fit(df, cols).transform(assemble(test, cols)).agg(F.avg(score).alias("s"))
    base, out = measure(features).select(F.col("s").alias("_base")), None
    for f in features:
        one = measure([x for x in features if x != f]).select(F.lit(f).alias("feature"), "s")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(base)).select("feature", r6(F.col("_base") - F.col("s")).alias("importance"))


def impurity_importance(spark, model, features: list[str]) -> DataFrame:
    """XP3: the importances of a tree model, ranked."""
    best = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(best)], "feature string, importance double, rank int")


def compare_rankings(tables: dict[str, DataFrame], by: str = "importance", spread: int = 3) -> DataFrame:
    """XP4: ranks of each feature in several tables; a spread of ``spread`` or more is suspicious."""
    out = None
    for name, t in tables.items():
        one = t.select("feature", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by), "feature")).alias("r"), F.lit(name).alias("of"))
        out = one if out is None else out.unionByName(one)
    g = out.groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("of", "r")))).alias("ranks"), (F.max("r") - F.min("r")).alias("spread"))
    return g.select("feature", "ranks", "spread", (F.col("spread") >= spread).alias("suspicious"))


def shapley(model, df: DataFrame, features: list[str], output: Column, key: str = "row_id") -> DataFrame:
    """XP5: (key, feature, value): exact Shapley values of the model's output against the mean row, over all coalitions of at
    most ten features. A row is exploded into its 2^M masked rows; one transform scores them; a feature's value is a
    weighted sum over coalitions."""
    m = len(features)
    if m > 10:
        raise ValueError("exact values are for at most ten features; use kernel_shap")
    mean = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    d = _dealt(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]), key).crossJoin(F.broadcast(mean)).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    on = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    d = d.select(key, "mask", *[F.when(on(i), F.col(f)).otherwise(F.col(f"_m_{f}")).alias(f) for i, f in enumerate(features)])
    s = model.transform(assemble(d, features)).select(key, "mask", output.alias("out"))
    size = F.bit_count("mask")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)) for k in range(m)]), F.when(F.col("with"), size).otherwise(size + 1).cast("int"))
    rows = s.select(key, "mask", "out", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), on(i).alias("with")) for i, f in enumerate(features)])).alias("x")).select(key, "mask", "out", "x.*")
    return rows.groupBy(key, "feature").agg(r6(F.sum(F.when(F.col("with"), weight * F.col("out")).otherwise(-weight * F.col("out")))).alias("value"))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key: the samples that are made of a row stay where its sums are made, so they are not shuffled."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _stacked(arrays: pd.Series, width: int) -> np.ndarray:
    """Array values as the rows of one matrix; a null is NaN."""
    return np.array([np.asarray(a, float) for a in arrays], float).reshape(-1, width)


def _symmetric(arrays: pd.Series, pairs: list[tuple[int, int]], m: int) -> np.ndarray:
    """The symmetric matrices whose upper triangles, in the order of pairs, are the array values."""
    values, out = _stacked(arrays, len(pairs)), np.zeros((len(arrays), m, m))
    for n, (i, j) in enumerate(pairs):
        out[:, i, j] = out[:, j, i] = values[:, n]
    return out


def _solved(rows: DataFrame, key: str, features: list[str], ridge: float) -> DataFrame:
    """(key, feature, value) of a weighted ridge regression for each row from its sums of products; rows: (key, w, z array
    with a leading 1, out). Sums are aggregated map-side; the equations of a batch of rows are solved together in tasks."""
    m = len(features) + 1
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    g = rows.groupBy(key).agg(F.array(*[F.sum(F.col("w") * F.col("z")[i] * F.col("z")[j]) for i, j in pairs]).alias("a"), F.array(*[F.sum(F.col("w") * F.col("z")[i] * F.col("out")) for i in range(m)]).alias("b"))

    def solve(batches):
        for part in batches:
            mat, b = _symmetric(part["a"], pairs, m), _stacked(part["b"], m)
            x = (np.linalg.pinv(mat + ridge * np.diag([0.0, *np.ones(m - 1)])) @ b[:, :, None])[:, 1:, 0]
            yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), m - 1), "feature": features * len(part), "value": x.ravel()})

    return g.mapInPandas(solve, f"{key} {rows.schema[key].dataType.simpleString()}, feature string, value double")


def kernel_shap(model, df: DataFrame, features: list[str], output: Column, key: str = "row_id", samples: int = 64) -> DataFrame:
    """XP6: Shapley values by weighted least squares over coalitions drawn by a hash, with the kernel's weights; the empty and
    the full one are always in, with a large weight."""
    m = len(features)
    mean = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    d = _dealt(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]), key).crossJoin(F.broadcast(mean)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples + 1))))
    mask = F.when(F.col("s") == 0, F.lit(0)).when(F.col("s") == 1, F.lit((1 << m) - 1)).otherwise(F.pmod(F.xxhash64(F.col(key), "s"), F.lit(1 << m)))
    on = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    d = d.withColumn("mask", mask)
    d = d.select(key, "mask", *[F.when(on(i), F.col(f)).otherwise(F.col(f"_m_{f}")).alias(f) for i, f in enumerate(features)])
    kernel = F.array(*[F.lit(1e6 if k in (0, m) else (m - 1) / (math.comb(m, k) * k * (m - k))) for k in range(m + 1)])
    p = model.transform(assemble(d, features)).select(key, kernel[F.bit_count("mask")].alias("w"), F.array(F.lit(1.0), *[on(i).cast("double") for i in range(m)]).alias("z"), output.cast("double").alias("out"))
    return _solved(p, key, features, 0.0).withColumn("value", r6("value"))


def shap_summary(values: DataFrame, rows: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """XP7: by feature the mean absolute attribution, the share of positive ones and the correlation of the feature with its
    attribution, ranked."""
    long = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "x")
    g = values.join(long, [key, "feature"]).groupBy("feature").agg(r6(F.avg(F.abs("value"))).alias("mean_abs"), r6(F.avg((F.col("value") > 0).cast("double"))).alias("positive"), r6(corr("x", "value")).alias("r"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "feature")))


def waterfall(values: DataFrame, base: float, key: str = "row_id") -> DataFrame:
    """XP7: each row's attributions from the largest, with the running total from ``base``."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")
    return values.select(key, F.row_number().over(w).alias("step"), "feature", "value", r6(base + F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("total"))


def lime(model, df: DataFrame, features: list[str], output: Column, key: str = "row_id", samples: int = 50, seed: int = 0, ridge: float = 1e-3) -> DataFrame:
    """XP8: (key, feature, value): a weighted ridge regression of the output on standardised features around each row. Each
    sample moves every feature by a normal deviate (two hash draws) of the column's deviation; weights fall with the
    distance as exp(-d² / (0.75² M))."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    known = valid(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]), *features)
    d = valid(_dealt(known, key).crossJoin(F.broadcast(moments.fillna(0.0))), *[f"_s_{f}" for f in features]).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = lambda f, n: (F.pmod(F.xxhash64(F.col(key), "s", F.lit(f"{f}{n}{seed}")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = {f: F.sqrt(-2 * F.log(u(f, 1))) * F.cos(2 * math.pi * u(f, 2)) for f in features}
    d = d.select(key, *[z[f].alias(f"_z_{f}") for f in features], *[f"_s_{f}" for f in features], *features)
    dist = sum(F.col(f"_z_{f}") * F.col(f"_z_{f}") for f in features)
    d = d.select(key, F.exp(-dist / (0.5625 * len(features))).alias("w"), F.array(F.lit(1.0), *[F.col(f"_z_{f}") for f in features]).alias("z"), array_to_vector(F.array(*[F.col(f) + F.col(f"_z_{f}") * F.col(f"_s_{f}") for f in features])).alias("features"))
    p = model.transform(d).select(key, "w", "z", output.cast("double").alias("out"))
    return _solved(p, key, features, ridge).withColumn("value", r6("value"))


def lime_local(model, df: DataFrame, features: list[str], output: Column, key: str = "row_id", samples: int = 500, k: int = 5, kernel: str = "exponential",
               width: float | None = None, background: int | None = None, seed: int = 0, ridge: float = 0.01) -> DataFrame:
    """XP8 over present and absent features: (key, rank, feature, value, intercept, r2).

    Samples keep 1 to M of a row's features in equal shares from a drawn start, which ones is drawn, and take the others from a
    background row. Rows are dealt by a hash into groups of 1,000 or more (and of twice the samples) and ordered by another; a
    row's samples meet the rows after it in its group, each once, so its background is a random sample of the whole table, and
    every row is in as many as any other. Only where there are no more rows than samples do they meet again. ``background``
    takes one pool for all, so many rows of least hash, where that is wished. Samples that keep all features are the row
    itself: they are scored once, with their number as weight. Samples weigh by nearness on standardised features: exponential
    in the squared distance (width 0.75 sqrt(M)), or in the squared cosine distance (width 0.25). A sparse linear model of
    presence is grown feature by feature, each time by the one that leaves the least weighted error, up to ``k``; r2 is its
    weighted fit. All draws are hashes, so a rerun is equal. Rows with a null or NaN feature are left out.
    """
    m = len(features)
    rows = valid(df, *features).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    scale = rows.agg(F.count(F.lit(1)).alias("_n"), *[g(f).alias(f"_{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_samp))]).first()
    groups = max(1, scale["_n"] // max(1000, 2 * samples))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 16)
    u = lambda n, *of: F.xxhash64(F.col(key), *of, F.lit(seed), F.lit(n))
    dealt = rows.withColumn("_group", F.pmod(u(-1), F.lit(groups))).repartition(parts, "_group")
    held = F.sort_array(F.collect_list(F.struct(u(-2).alias("_h"), key, *features))).alias("_held")
    pool = [F.size("_held").alias("_n"), *[F.col(f"_held.{f}").alias(f"_b_{f}") for f in features]]
    if background is None:
        d = dealt.groupBy("_group").agg(held).select("_group", "_held", *pool).select("*", F.posexplode("_held").alias("_at", "_row"))
        d = d.select("_group", "_at", "_n", F.col(f"_row.{key}").alias(key), *[F.col(f"_row.{f}").alias(f) for f in features], *[f"_b_{f}" for f in features])
    else:
        one = rows.orderBy(u(-2), key).limit(background).agg(held).select(*pool)
        d = dealt.crossJoin(F.broadcast(one)).withColumn("_at", F.pmod(u(-2), F.col("_n")).cast("int"))
    d = d.withColumn("_from", F.pmod(u(-3), F.lit(m)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(-1), F.lit(samples - 1))))
    d = d.withColumn("_on", (F.col("_from") + F.col("s")) % m + 1).where((F.col("s") < 0) | (F.col("_on") < m))
    d = d.withColumn("_whole", F.floor((F.col("_from") + samples) / m))
    d = d.select("_group", key, "s", "_on", "_whole", *features, *[F.get(f"_b_{f}", (F.col("_at") + 1 + F.col("s")) % F.col("_n")).alias(f"_b_{f}") for f in features])
    d = d.withColumns({f"_u_{i}": u(i, "s") for i in range(m)})
    rank = [sum(((F.col(f"_u_{j}") < F.col(f"_u_{i}")).cast("int") for j in range(m) if j != i), F.lit(0)) for i in range(m)]
    whole = F.col("s") < 0
    d = d.withColumns({f"_k_{f}": whole | (rank[i] < F.col("_on")) for i, f in enumerate(features)})
    real = {f: F.when(F.col(f"_k_{f}"), F.col(f)).otherwise(F.col(f"_b_{f}")) for f in features}
    d = d.select("_group", key, whole.alias("_all"), "_whole", *[f"_k_{f}" for f in features], *features, *[real[f].alias(f"_z_{f}") for f in features])
    unit = lambda v, f: (F.col(v) - scale[f"_m_{f}"]) / scale[f"_s_{f}"] if scale[f"_s_{f}"] else F.lit(0.0)
    x, z = [unit(f, f) for f in features], [unit(f"_z_{f}", f) for f in features]
    add = lambda parts: sum(parts[1:], parts[0])
    if kernel == "exponential":
        w = F.exp(-add([(p - q) * (p - q) for p, q in zip(x, z)]) / float(width or 0.75 * math.sqrt(m)) ** 2)
    else:
        cosine = F.coalesce(F.try_divide(add([p * q for p, q in zip(x, z)]), F.sqrt(add([p * p for p in x])) * F.sqrt(add([q * q for q in z]))), F.lit(0.0))
        w = F.exp(-(1 - cosine) * (1 - cosine) / float(width or 0.25) ** 2)
    d = d.select("_group", key, (w * F.when(F.col("_all"), F.col("_whole")).otherwise(1)).alias("w"), *[f"_k_{f}" for f in features], array_to_vector(F.array(*[f"_z_{f}" for f in features])).alias("features"))
    p = model.transform(d).select("_group", key, "w", *[f"_k_{f}" for f in features], output.cast("double").alias("out"))
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    kept = lambda v, *at: F.sum(F.when(functools.reduce(lambda a, b: a & b, [F.col(f"_k_{features[i - 1]}") for i in sorted({*at} - {0})]), v).otherwise(0.0) if any(at) else v)
    g = p.groupBy("_group", key).agg(F.array(*[kept(F.col("w"), i, j) for i, j in pairs]).alias("a"), F.array(*[kept(F.col("w") * F.col("out"), i) for i in range(m + 1)]).alias("b"), F.sum(F.col("w") * F.col("out") * F.col("out")).alias("c"))

    def grow(batches):
        for part in batches:
            n, steps = len(part), min(k, m)
            full, b, c = _symmetric(part["a"], pairs, m + 1), _stacked(part["b"], m + 1), part["c"].to_numpy(float)
            at = np.arange(n)[:, None]
            chosen, beta, error = np.zeros((n, 0), int), b[:, :1] / np.maximum(full[:, :1, 0], 1e-300), np.zeros(n)
            for step in range(steps):
                best, pick, value = np.full(n, np.inf), np.zeros(n, int), np.zeros((n, step + 2))
                for j in range(1, m + 1):
                    own = np.concatenate([np.zeros((n, 1), int), chosen, np.full((n, 1), j)], axis=1)
                    mat, right = full[at[:, :, None], own[:, :, None], own[:, None, :]], b[at, own]
                    x = (np.linalg.pinv(mat + ridge * np.diag([0.0, *np.ones(step + 1)])) @ right[:, :, None])[:, :, 0]
                    left = c - 2 * (x * right).sum(axis=1) + np.einsum("ni,nij,nj->n", x, mat, x)
                    better = ~(chosen == j).any(axis=1) & ((pick == 0) | (np.round(left, 12) < np.round(best, 12)))
                    best[better], pick[better], value[better] = left[better], j, x[better]
                chosen, beta, error = np.concatenate([chosen, pick[:, None]], axis=1), value, best
            spread = c - b[:, 0] * b[:, 0] / np.maximum(full[:, 0, 0], 1e-300)
            fits = spread > 1e-12
            r2 = np.where(fits, 1 - error / np.where(fits, spread, 1.0), 0.0)
            yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), steps), "feature": np.array(features)[chosen.ravel() - 1], "value": beta[:, 1:].ravel(), "intercept": np.repeat(beta[:, 0], steps), "r2": np.repeat(r2, steps)})

    out = g.mapInPandas(grow, f"{key} {rows.schema[key].dataType.simpleString()}, feature string, value double, intercept double, r2 double")
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")
    return out.select(key, F.row_number().over(order).alias("rank"), "feature", r6("value").alias("value"), r6("intercept").alias("intercept"), F.round("r2", 4).alias("r2"))


def lime_stability(model, df: DataFrame, features: list[str], output: Column, key: str = "row_id", seeds: int = 3, samples: int = 50) -> DataFrame:
    """XP9: mean, deviation and coefficient of variation of local attributions over seeds; stable under 0.05."""
    out = None
    for s in range(seeds):
        one = lime(model, df, features, output, key, samples, s)
        out = one if out is None else out.unionByName(one)
    cv = F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value")))
    return out.groupBy(key, "feature").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"), r6(cv).alias("cv"), (F.stddev_samp("value") < 0.05).alias("stable"))


def agreement(a: DataFrame, b: DataFrame, key: str = "row_id", top: int = 3) -> DataFrame:
    """XP10: for each row Spearman's rank agreement of two attributions (by absolute value, ties on their mean rank), how many
    of the ``top`` they share, and a verdict: STRONG (0.75 and two shared), MODERATE (0.5 or one), else WEAK."""
    def ranks(t, name):
        w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")))
        ties = F.count(F.lit(1)).over(Window.partitionBy(key, F.abs("value")))
        first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature"))
        return t.select(key, "feature", (F.rank().over(w) + (ties - 1) / 2).alias(name), (first <= top).alias(f"{name}t"))

    j = ranks(a, "x").join(ranks(b, "y"), [key, "feature"])
    g = j.groupBy(key).agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d"), F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("xt") & F.col("yt")).alias("shared"))
    rho = 1 - F.coalesce(F.try_divide(6 * F.col("d"), F.col("n") * (F.col("n") * F.col("n") - 1)), F.lit(0.0))
    verdict = F.when((rho >= 0.75) & (F.col("shared") >= 2), "STRONG").when((rho >= 0.5) | (F.col("shared") >= 1), "MODERATE").otherwise("WEAK")
    return g.select(key, r6(rho).alias("spearman"), "shared", verdict.alias("verdict"))


def explain(values: DataFrame, key: str = "row_id", top: int = 5) -> DataFrame:
    """XP11: the ``top`` features by mean absolute attribution over all rows, with how often each raises and lowers the
    output and how often it is a row's largest."""
    largest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")) == 1
    g = values.withColumn("_l", largest).groupBy("feature").agg(r6(F.avg(F.abs("value"))).alias("importance"), F.count_if(F.col("value") > 0).alias("raises"), F.count_if(F.col("value") < 0).alias("lowers"), F.count_if("_l").alias("largest"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), "feature"))).where(F.col("rank") <= top)


def ensemble_uncertainty(long: DataFrame, key: str = "row_id", p: str = "p", most: float = 0.1) -> DataFrame:
    """UQ3: from (key, model, p) each row's mean, variance between models (epistemic), mean p (1 - p) (aleatoric) and whether
    the former is over ``most``."""
    g = long.where(F.col(p).isNotNull()).groupBy(key).agg(F.avg(p).alias("m"), F.var_pop(p).alias("e"), F.avg(F.col(p) * (1 - F.col(p))).alias("a"))
    return g.select(key, r6("m").alias("mean"), r6("e").alias("epistemic"), r6("a").alias("aleatoric"), (F.col("e") > most).alias("uncertain"))
