"""Descriptive statistics, tests from sufficient statistics, corrections and effect sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.core import corr, prefix_sums, quantiles, r6, ratio, ratio0, suffix_min, valid, written


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """DS1, DS2, DS6, DS7: moments, quartiles and skewness (third moment over n, sample deviation cubed) by feature."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "v").where("v is not null and not isnan(v)")
    g = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.skewness("v").alias("sk"))
    g = g.join(quantiles(long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), ["feature"], "v", [0.25, 0.5, 0.75]), "feature")
    skew = F.col("sk") * F.pow((F.col("n") - 1) / F.col("n"), F.lit(1.5))
    q = lambda i: F.round(F.col("q")[i], 4)
    return g.select("feature", "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("std"), "lo", q(0).alias("p25"), q(1).alias("median"), q(2).alias("p75"), "hi", F.round(F.col("q")[2] - F.col("q")[0], 4).alias("iqr"), F.round(skew, 4).alias("skewness"))


def modes(df: DataFrame, c: str) -> DataFrame:
    """DS3: all values of maximal count."""
    g = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.max("n").alias("n"))), "n").select("value", "n")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """CH6, DS4, DS8: correlation and sample covariance of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    g = df.agg(*[F.struct(corr(a, b).alias("r"), F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias("c")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}.r").alias("r"), F.col(f"{i}.c").alias("c")) for i, (a, b) in enumerate(pairs)]))
    return g.select(rows.alias("x")).select("x.a", "x.b", r6("x.r").alias("r"), F.round("x.c", 2).alias("cov"))


def impurity(df: DataFrame, label: str, by: str) -> DataFrame:
    """DS9: Gini impurity and entropy (base 2) of the labels of each group."""
    c = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return c.select(by, p.alias("p")).groupBy(by).agg(r6(1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def two_sample(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """HT4, HT13: Welch and pooled t with their degrees of freedom, Cohen's d and its band."""
    g = lambda x: F.when(F.col(group) == x, F.col(value).cast("double"))
    s = df.agg(F.count(g(a)).alias("na"), F.avg(g(a)).alias("ma"), F.var_samp(g(a)).alias("va"), F.count(g(b)).alias("nb"), F.avg(g(b)).alias("mb"), F.var_samp(g(b)).alias("vb"))
    na, nb, va, vb = F.col("na").cast("double"), F.col("nb").cast("double"), F.col("va"), F.col("vb")
    d, wa, wb = F.col("ma") - F.col("mb"), va / na, vb / nb
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    cohen = ratio(d, F.sqrt(pooled))
    return s.select(r6(d).alias("diff"), r6(ratio(d, F.sqrt(wa + wb))).alias("welch_t"), F.round((wa + wb) * (wa + wb) / (wa * wa / (na - 1) + wb * wb / (nb - 1)), 4).alias("welch_df"), r6(ratio(d, F.sqrt(pooled * (1 / na + 1 / nb)))).alias("pooled_t"), (na + nb - 2).cast("bigint").alias("pooled_df"),
                    r6(cohen).alias("cohens_d"), F.when(F.abs(cohen) < 0.2, "negligible").when(F.abs(cohen) < 0.5, "small").when(F.abs(cohen) < 0.8, "medium").otherwise("large").alias("magnitude"))


def with_p(result: DataFrame, kind: str, statistic: str, *df: str) -> DataFrame:
    """result (a row a test) with its p-value: kind is normal, t, chi2 or f."""
    f = {"normal": dist.normal_p, "t": dist.t_p, "chi2": dist.chi2_p, "f": dist.f_p}[kind]
    return result.withColumn("p", f(F.col(statistic), *[F.col(d).cast("double") for d in df]))


def one_sample_z(df: DataFrame, c: str, mu: float, sigma: float, by: str, alternative: str = "two-sided") -> DataFrame:
    """HT1: z of the mean against mu with known sigma, by group, with p."""
    g = valid(df, c).groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("m"))
    z = (F.col("m") - mu) / (sigma / F.sqrt("n"))
    g = g.select(by, "n", r6("m").alias("mean"), z.alias("_z"))
    return g.withColumn("p", dist.normal_p(F.col("_z"), alternative)).withColumn("z", r6("_z")).drop("_z")


def two_sample_z(df: DataFrame, value: str, group: str, a, b, sigma_a: float, sigma_b: float) -> DataFrame:
    """HT2: z of the difference of two means with known sigmas, with p."""
    g = lambda x: F.when(F.col(group) == x, F.col(value).cast("double"))
    s = valid(df, value).agg(F.count(g(a)).alias("na"), F.avg(g(a)).alias("ma"), F.count(g(b)).alias("nb"), F.avg(g(b)).alias("mb"))
    z = (F.col("ma") - F.col("mb")) / F.sqrt(sigma_a**2 / F.col("na") + sigma_b**2 / F.col("nb"))
    s = s.select(r6(F.col("ma") - F.col("mb")).alias("diff"), z.alias("_z"))
    return s.withColumn("p", dist.normal_p(F.col("_z"))).withColumn("z", r6("_z")).drop("_z")


def paired(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """HT5: t of after - before over rows of equal key, with p."""
    d = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key).select((F.col("_a") - F.col("_b")).cast("double").alias("d"))
    s = valid(d, "d").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))
    out = s.select("n", r6("m").alias("mean_diff"), r6("s").alias("sd_diff"), (F.col("n") - 1).alias("df"), t.alias("_t"))
    return out.withColumn("p", dist.t_p(F.col("_t"), F.col("df").cast("double"))).withColumn("t", r6("_t")).drop("_t")


def goodness_of_fit(df: DataFrame, category: str, expected: dict) -> DataFrame:
    """HT6: chi-square against expected weights, rescaled to the observed total; ``low_expected`` where one is under 5.
    Categories without a weight are left out, those without rows count 0."""
    want = df.sparkSession.createDataFrame([(str(k), float(w)) for k, w in expected.items()], "category string, w double")
    c = df.groupBy(F.col(category).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    j = want.join(c, "category", "left").na.fill(0, ["n"])
    j = j.crossJoin(F.broadcast(j.agg(F.sum("n").alias("all"), F.sum("w").alias("weight")))).withColumn("e", F.col("w") / F.col("weight") * F.col("all"))
    s = j.agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("x"), (F.count(F.lit(1)) - 1).alias("df"), (F.min("e") < 5).alias("low_expected"))
    return s.withColumn("p", dist.chi2_p(F.col("x"), F.col("df").cast("double"))).withColumn("chi2", F.round("x", 4)).drop("x")


def mean_interval(df: DataFrame, c: str, by: str, level: float = 0.95) -> DataFrame:
    """HT16: interval of a mean by group, with the t quantile."""
    g = valid(df, c).groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
    half = dist.t_critical((F.col("n") - 1).cast("double"), level) * F.col("s") / F.sqrt("n")
    return g.withColumn("h", half).select(by, "n", r6("m").alias("mean"), r6(F.col("m") - F.col("h")).alias("low"), r6(F.col("m") + F.col("h")).alias("high"))


def bayes(prior: DataFrame, likelihood: DataFrame, evidence: DataFrame) -> DataFrame:
    """HT17: class posteriors of each row (naive Bayes) and the likeliest class.

    prior (class, p); likelihood (class, feature, value, p); evidence (row_id, feature, value). A pair that is missing
    counts 1e-6, and no probability less than 1e-10. One evidence row a row is a plain Bayes update.
    """
    floor = lambda c: F.ln(F.greatest(c, F.lit(1e-10)))
    cells = evidence.join(F.broadcast(prior.select("class")), how="cross")  # a few classes
    part = cells.join(likelihood.withColumnRenamed("p", "_l"), ["class", "feature", "value"], "left").groupBy("row_id", "class").agg(F.sum(floor(F.coalesce("_l", F.lit(1e-6)))).alias("s"))
    part = part.join(F.broadcast(prior), "class").withColumn("s", F.col("s") + floor(F.col("p")))
    own = Window.partitionBy("row_id")
    part = part.withColumn("e", F.exp(F.col("s") - F.max("s").over(own)))
    part = part.withColumn("posterior", F.col("e") / F.sum("e").over(own))
    first = F.row_number().over(own.orderBy(F.desc("posterior"), "class")) == 1
    return part.select("row_id", "class", r6("posterior").alias("posterior"), first.alias("chosen"))


def split_gain(df: DataFrame, feature: str, threshold: float, label: str) -> DataFrame:
    """DS10: information gain and weighted Gini reduction of the split feature <= threshold; 0 where a side is empty."""
    rows = valid(df, feature, label)
    c = rows.groupBy((F.col(feature) <= threshold).alias("left"), F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.when(F.col("left"), "L").otherwise("R").alias("side"), "c", "n").unionByName(c.groupBy("c").agg(F.sum("n").alias("n")).select(F.lit("A").alias("side"), "c", "n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("side"))
    g = sides.withColumn("p", p).groupBy("side").agg(F.sum("n").alias("n"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    t = g.agg(*[of(s, c).alias(f"{c}{s}") for s in "ALR" for c in ("n", "gini", "h")])
    drop = lambda c: F.coalesce(F.col(f"{c}A") - (F.col("nL") * F.col(f"{c}L") + F.col("nR") * F.col(f"{c}R")) / F.col("nA"), F.lit(0.0))
    return t.select(r6(drop("h")).alias("information_gain"), r6(drop("gini")).alias("gini_reduction"))


def vector_norms(df: DataFrame, vector: str, key: str) -> DataFrame:
    """DS11: L1 and L2 norm of each vector and its unit vector (null where it is zero)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))
    l2 = F.sqrt(total(lambda x: x * x))
    return df.select(key, total(F.abs).alias("l1"), l2.alias("l2"), F.when(l2 > 0, F.transform(v, lambda x: x / l2)).alias("unit"))


def vector_pairs(a: DataFrame, b: DataFrame, on: str, vector: str) -> DataFrame:
    """DS11: dot product and cosine of the vectors of equal key."""
    j = a.select(on, F.col(vector).alias("_x")).join(b.select(on, F.col(vector).alias("_y")), on)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, t: acc + t)
    d = dot("_x", "_y")
    return j.select(on, d.alias("dot"), F.try_divide(d, F.sqrt(dot("_x", "_x") * dot("_y", "_y"))).alias("cosine"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """HT7: chi-square of independence with Cramér's V, zero cells included."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb, t = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb")), c.agg(F.sum("n").alias("t"))
    # the marginals' products stand for all cells: sum n²/e - t
    j = c.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(t))
    k = ra.agg(F.count(F.lit(1)).alias("ka")).crossJoin(rb.agg(F.count(F.lit(1)).alias("kb")))
    x = j.agg((F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb") / F.col("t"))) - F.max("t")).alias("x"), F.max("t").alias("t")).crossJoin(k)
    return x.select(F.round("x", 4).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), r6(F.sqrt(ratio0(F.greatest("x", F.lit(0.0)), F.col("t") * F.least(F.col("ka") - 1, F.col("kb") - 1)))).alias("cramers_v"))


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """HT8: U of both groups (ties half), z without tie correction and rank-biserial r, from a value histogram."""
    h = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    h = prefix_sums(h, [], "v", ["nb"])
    s = h.agg(F.sum(F.col("na") * (F.col("cum_nb") - F.col("nb") + F.col("nb") / 2)).alias("u"), F.sum("na").cast("double").alias("n"), F.sum("nb").cast("double").alias("m"))
    z = (F.col("u") - F.col("n") * F.col("m") / 2) / F.sqrt(F.col("n") * F.col("m") * (F.col("n") + F.col("m") + 1) / 12)
    return s.select(F.round("u", 1).alias("u1"), F.round(F.col("n") * F.col("m") - F.col("u"), 1).alias("u2"), r6(z).alias("z"), r6(2 * F.col("u") / (F.col("n") * F.col("m")) - 1).alias("rank_biserial"))


def corrections(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """HT11, HT12: Bonferroni, and Benjamini–Hochberg with monotone adjusted p, over a table of tests.

    Equal p-values have one adjusted p, that of the last of their ranks, so ranks are running counts of a histogram. A
    null p-value counts as a test and comes last (adjusted p 1).
    """
    hist = written(tests.groupBy("p_value").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("p_value").isNotNull()))
    m = hist.agg(F.sum("n").alias("m"))
    ranks = prefix_sums(hist, ["known"], "p_value", ["n"]).where("known")
    ranks = ranks.crossJoin(F.broadcast(m)).withColumn("adj", F.least(F.lit(1.0), F.col("p_value") * F.col("m") / F.col("cum_n")))
    adjusted = suffix_min(ranks, "p_value", "adj").select("p_value", F.col("min_adj").alias("adj"))
    t = tests.join(adjusted, "p_value", "left").withColumn("adj", F.coalesce("adj", F.lit(1.0))).crossJoin(F.broadcast(m))
    return t.select("test_id", r6("p_value").alias("p_value"), r6(F.least(F.lit(1.0), F.col("p_value") * F.col("m"))).alias("bonferroni"), (F.col("p_value") < alpha / F.col("m")).alias("bonferroni_reject"), r6("adj").alias("bh"), (F.col("adj") <= alpha).alias("bh_reject"))


def mcnemar(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """HT15: paired models with continuity correction."""
    r1, r2 = F.col(y) == F.col(p1), F.col(y) == F.col(p2)
    s = df.agg(F.count_if(r1 & r2).alias("both"), F.count_if(r1 & ~r2).alias("first_only"), F.count_if(~r1 & r2).alias("second_only"), F.count_if(~r1 & ~r2).alias("neither"))
    b, c = F.col("first_only"), F.col("second_only")
    n = F.col("both") + b + c + F.col("neither")
    return s.select("*", r6(ratio0((F.abs(b - c) - 1) * (F.abs(b - c) - 1), b + c)).alias("statistic"), r6(ratio0(F.col("both") + b, n)).alias("accuracy1"), r6(ratio0(F.col("both") + c, n)).alias("accuracy2"), (b + c == 0).alias("no_discordant"))


def proportion_interval(df: DataFrame, c: str, by: str, z: float = 1.959964) -> DataFrame:
    """HT16: Wilson interval of a proportion by group."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col(c).cast("double")).alias("p"))
    n, p = F.col("n"), F.col("p")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return g.select(by, n.cast("bigint").alias("n"), r6(p).alias("p"), r6(mid - half).alias("low"), r6(mid + half).alias("high"))
