"""Failure slices: losses, effect sizes, a lattice search and error clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.core import r6, valid, written


def losses(df: DataFrame, kind: str, y="y_true", p="y_prob") -> DataFrame:
    """SL1: df plus ``loss``: log loss (probabilities clipped at 1e-15), 0/1 or squared error of each row."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p).cast("double")))
    f = {"log": -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)), "zero_one": (F.col(y) != F.col(p)).cast("double"), "squared": (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))}
    return valid(df, y, p).withColumn("loss", f[kind].cast("double"))


def _totals(df: DataFrame, loss: str) -> DataFrame:
    l = F.col(loss).cast("double")  # noqa: E741
    return df.agg(F.count(l).cast("double").alias("all_n"), F.sum(l).alias("all_s"), F.sum(l * l).alias("all_q"))


def _measured(g: DataFrame, totals: DataFrame, keep: list[str]) -> DataFrame:
    """SL2, SL3 from (n, s, q) of slices and of all rows: means, effect √2 (m - M) / √(v + V) and a one-sided Welch t."""
    g = g.crossJoin(F.broadcast(totals))
    n, rest = F.col("n"), F.col("all_n") - F.col("n")
    m, M = F.col("s") / n, F.try_divide(F.col("all_s") - F.col("s"), rest)
    v, V = F.greatest(F.col("q") / n - m * m, F.lit(0.0)), F.greatest(F.try_divide(F.col("all_q") - F.col("q"), rest) - M * M, F.lit(0.0))
    wa, wb = F.try_divide(v, n - 1), F.try_divide(V, rest - 1)
    t = F.try_divide(m - M, F.sqrt(wa + wb))
    d = F.try_divide((wa + wb) * (wa + wb), F.try_divide(wa * wa, n - 1) + F.try_divide(wb * wb, rest - 1))
    return g.select(*keep, n.cast("bigint").alias("n"), r6(m).alias("mean_loss"), r6(M).alias("rest_loss"), r6(F.try_divide(F.sqrt(F.lit(2.0)) * (m - M), F.sqrt(v + V))).alias("effect"), t.alias("_t"), d.alias("_d"))


def _sums(loss: str) -> list[Column]:
    l = F.col(loss)  # noqa: E741
    return [F.count(l).cast("double").alias("n"), F.sum(l).alias("s"), F.sum(l * l).alias("q")]


def _long(df: DataFrame, features: list[str], loss: str) -> DataFrame:
    return df.select(F.col(loss).cast("double").alias("l"), *[F.col(f).cast("string").alias(f) for f in features])


def slices(df: DataFrame, features: list[str], loss: str, least: int = 20) -> DataFrame:
    """SL2, SL3: all single-feature slices with effect size against the rest and Welch t with its degrees of freedom."""
    g = _long(df, features, loss).unpivot(["l"], features, "feature", "value").groupBy("feature", "value").agg(*_sums("l")).where(F.col("n") >= least)
    out = _measured(g, _totals(df, loss), ["feature", "value"])
    return out.select("feature", "value", "n", "mean_loss", "rest_loss", "effect", r6("_t").alias("t"), F.round("_d", 3).alias("df"))


def suggest(df: DataFrame, features: list[str], loss: str, effect: float = 0.2, top: int = 10, least: int = 20) -> DataFrame:
    """SL7: single-feature slices of at least this effect, the ``top`` largest."""
    s = slices(df, features, loss, least).where(F.col("effect") >= effect)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("effect"), "feature", "value")  # a row a slice
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def problematic(s: DataFrame, effect: float = 0.4, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """SL4: slices of enough rows and effect whose one-sided p (SL3) is under alpha."""
    p = dist.t_p_greater(F.col("t"), F.col("df"))
    return s.withColumn("p", p).where((F.col("n") >= least) & (F.col("effect") >= effect) & (F.col("p") < alpha))


def evaluate(df: DataFrame, where: dict, loss: str) -> DataFrame:
    """SL6: one slice: a value or a list of values for each feature."""
    inside = F.lit(True)
    for f, v in where.items():
        inside = inside & F.coalesce(F.col(f).cast("string").isin([str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])]), F.lit(False))
    g = df.where(inside).select(F.col(loss).cast("double").alias("l")).agg(*_sums("l"))
    return _measured(g, _totals(df, loss), []).select("n", "mean_loss", "rest_loss", "effect", r6("_t").alias("t"), F.round("_d", 3).alias("df"))


def search(df: DataFrame, features: list[str], loss: str, literals: int = 3, effect: float = 0.4, alpha: float = 0.05, least: int = 20, top: int = 10) -> DataFrame:
    """SL5: slices of up to ``literals`` (feature, value) literals that fail: level by level, slices of at least ``least``
    rows; those of enough effect whose one-sided p passes a Bonferroni bound over the level's candidates are found, the
    others are grown by one literal of a later feature. What a found slice contains is not grown, so nothing found is
    subsumed. The ``top`` by effect are returned.

    Each level is one pass: a row is exploded into its literal combinations that extend a surviving parent, and summed
    map-side.
    """
    base = _long(df, features, loss).withColumn("items", F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(i).alias("f"), F.concat(F.lit(f + "="), F.col(f)).alias("x"))) for i, f in enumerate(features)]))).select("l", "items")
    totals, found = _totals(df, loss), None
    rows = base.select("l", "items", F.explode("items").alias("one")).select("l", "items", F.col("one.f").alias("last"), F.array("one.x").alias("slice"))
    for level in range(1, literals + 1):
        g = rows.groupBy("slice", "last").agg(*_sums("l")).where(F.col("n") >= least)
        m = written(_measured(g, totals, ["slice", "last"]))  # each level once
        able = m.where(F.col("effect") >= effect)
        tried = able.agg(F.count(F.lit(1)).alias("_c"))
        p = able.withColumn("p", dist.t_p_greater(F.col("_t"), F.col("_d"))).crossJoin(F.broadcast(tried))
        hit = p.where(F.col("p") * F.col("_c") < alpha).select(F.lit(level).alias("literals"), "slice", "n", "mean_loss", "rest_loss", "effect")
        hit = written(hit)
        found = hit if found is None else found.unionByName(hit)
        if level < literals:
            rest = m.select("slice").join(hit.select("slice"), "slice", "left_anti")
            rows = rows.join(rest, "slice")
            rows = rows.select("l", "items", "slice", F.explode(F.filter("items", lambda i: i["f"] > F.col("last"))).alias("one"))
            rows = rows.select("l", "items", F.col("one.f").alias("last"), F.concat("slice", F.array("one.x")).alias("slice"))
    # a longer slice whose literals hold all of a shorter found one is subsumed
    a, b = found.select(F.col("slice").alias("big")), found.select(F.col("slice").alias("small"))
    inside = a.select("big", F.explode("big").alias("x")).join(b.select("small", F.explode("small").alias("x")), "x").groupBy("big", "small").agg(F.count(F.lit(1)).alias("k"))
    inside = inside.where((F.col("k") == F.size("small")) & (F.size("small") < F.size("big"))).select(F.col("big").alias("slice")).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("effect"), "slice")
    out = found.join(inside, "slice", "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("rank", F.array_join("slice", " & ").alias("slice"), "literals", "n", "mean_loss", "rest_loss", "effect")


def refine(df: DataFrame, where: dict, features: list[str], loss: str, least: int = 20, top: int = 5) -> DataFrame:
    """SL8: the ``top`` slices that add one literal of the first three free features to a base slice, against its rows."""
    inside = F.lit(True)
    for f, v in where.items():
        inside = inside & (F.col(f).cast("string") == str(v))
    return suggest(df.where(inside), [f for f in features if f not in where][:3], loss, float("-inf"), top, least)


def severity(effect: Column) -> Column:
    """SL9's levels of an effect size."""
    return F.when(effect >= 1.3, "CRITICAL").when(effect >= 0.8, "HIGH").when(effect >= 0.5, "MEDIUM").when(effect >= 0.2, "LOW").otherwise("NONE")


def report(df: DataFrame, numbers: list[str], features: list[str], loss: str, bins: int = 4, effect: float = 0.2) -> DataFrame:
    """SL9: numeric features in quantile bins (PR12), then the lattice search over all features, with a severity a slice."""
    from .drift import quantile_bounds

    long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "feature", "value")
    bounds = quantile_bounds(long, bins).groupBy().pivot("feature", numbers).agg(F.first("bounds"))
    d = df.crossJoin(F.broadcast(bounds.select(*[F.col(c).alias(f"_b_{c}") for c in numbers])))
    under = lambda c: F.size(F.filter(f"_b_{c}", lambda b: b <= F.col(c))).cast("string")
    binned = [F.when(F.col(c).isNotNull(), F.concat(F.lit("bin"), under(c))).alias(c) for c in numbers]
    d = d.select(*binned, *features, loss)
    return search(d, [*numbers, *features], loss, literals=2, effect=effect).withColumn("severity", severity(F.col("effect")))


def error_clusters(df: DataFrame, features: list[str], wrong: Column, y: str, p: str, k: int = 3, seed: int = 7) -> DataFrame:
    """SL10: k-means over the wrong rows' scaled features: size, share, centroid and most frequent (label, prediction)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.where(wrong))
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(x).transform(x)
    c = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(x).transform(x)
    mix = c.groupBy("cluster", F.struct(F.col(y).alias("label"), F.col(p).alias("prediction")).alias("mix")).agg(F.count(F.lit(1)).alias("n"))
    top = mix.groupBy("cluster").agg(F.max_by("mix", F.struct("n", "mix")).alias("top"))
    g = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[r6(F.avg(f)) for f in features]).alias("centroid")).join(top, "cluster")
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("cluster", "n", r6(F.col("n") / F.col("_all")).alias("share"), "centroid", "top.label", "top.prediction")


def error_embedding(df: DataFrame, features: list[str], wrong: Column, key: str = "row_id") -> DataFrame:
    """SL11: two principal components of the scaled features of each row, with its error flag."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(x).transform(x)
    x = PCA(k=2, inputCol="_z", outputCol="_p").fit(x).transform(x).withColumn("_a", vector_to_array("_p"))
    return x.select(key, F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"), wrong.alias("wrong"))
