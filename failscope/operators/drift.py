"""Drift between a reference and a current cohort of long (cohort, feature, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clean, corr, prefix_sums, quantiles, r6, ratio0, valid, written


def histogram(df: DataFrame, by=("feature",)) -> DataFrame:
    """Rows of each cohort at each value, written once; null and NaN values are left out, as are rows of no cohort."""
    is_ref = F.col("cohort") == "reference"
    return written(valid(df, "value", "cohort").groupBy(*by, "value").agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur")))


def ks(df: DataFrame) -> DataFrame:
    """DR1: two-sample KS statistic of each feature with its asymptotic p, level and means. Null where a cohort is absent."""
    return ks_of(histogram(df))


def ks_of(hist: DataFrame) -> DataFrame:
    h = prefix_sums(hist, ["feature"], "value", ["ref", "cur"])
    of = lambda c: F.sum(F.col("value") * F.col(c))
    totals = hist.groupBy("feature").agg(F.sum("ref").alias("nr"), F.sum("cur").alias("nc"), of("ref").alias("mr"), of("cur").alias("mc"))
    gap = F.abs(F.try_divide(F.col("cum_ref"), F.col("nr")) - F.try_divide(F.col("cum_cur"), F.col("nc")))
    d = h.join(totals, "feature").groupBy("feature").agg(F.max(gap).alias("d"), *[F.first(c).alias(c) for c in ("nr", "nc", "mr", "mc")])
    level = F.when(F.col("d") > 0.20, "HIGH").when(F.col("d") > 0.10, "MEDIUM").when(F.col("d") > 0.05, "LOW").when(F.col("d").isNotNull(), "NONE")
    mr, mc = F.try_divide(F.col("mr"), F.col("nr")), F.try_divide(F.col("mc"), F.col("nc"))
    return d.select("feature", r6("d").alias("ks"), r6(ks_p(F.col("d"), F.col("nr").cast("double"), F.col("nc").cast("double"))).alias("p"), level.alias("level"),
                    F.round(mr, 4).alias("mean_reference"), F.round(mc, 4).alias("mean_current"))


def ks_p(d: Column, nr: Column, nc: Column, terms: int = 19) -> Column:
    """Asymptotic tail of the KS statistic, a finite series."""
    en = F.sqrt(F.try_divide(nr * nc, nr + nc))
    x = (en + 0.12 + F.try_divide(F.lit(0.11), en)) * d
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum((-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)))) * (d + 1) / (d + 1)


def quantile_bounds(df: DataFrame, bins: int = 10) -> DataFrame:
    """PR12: boundaries sorted[int(i * n / bins)], equal ones once, by feature."""
    return bounds_of(valid(df, "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), bins)


def bounds_of(hist: DataFrame, bins: int = 10, n: str = "n") -> DataFrame:
    """The boundaries of rows that a histogram counts in its column ``n``."""
    hist = written(hist)
    total = hist.groupBy("feature").agg(F.sum(n).alias("_total")).where("_total > 0")
    h = prefix_sums(hist, ["feature"], "value", [n]).join(total, "feature")
    rank = lambda i: F.floor(i * F.col("_total") / bins)
    holds = lambda k: (k < F.col(f"cum_{n}")) & (k >= F.col(f"cum_{n}") - F.col(n))
    at = h.groupBy("feature").agg(*[F.max(F.when(holds(rank(i)), F.col("value"))).alias(f"_b{i}") for i in range(1, bins)])
    return at.select("feature", F.array_sort(F.array_distinct(F.array(*[f"_b{i}" for i in range(1, bins)]))).alias("bounds"))


def bin_labels(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """PR12: rows with the label ``<feature>_bin<i>`` of the first boundary that the value is under (the last bin: above
    all); null where the value is."""
    at = F.size(F.filter("bounds", lambda x: x <= F.col("value")))
    label = F.concat(F.col("feature"), F.lit("_bin"), at.cast("string"))
    return df.join(bounds, "feature", "left").withColumn("label", F.when(F.col("value").isNotNull() & ~F.isnan("value"), label)).drop("bounds")


def psi(df: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """DR2: population stability index over quantile bins of the reference (a value under a boundary goes left). Null where
    a cohort is absent."""
    return psi_of(histogram(df), bins, eps)


def psi_bins(hist: DataFrame, bins: int = 10) -> DataFrame:
    """DR2's bin details: rows of both cohorts in every bin, empty bins kept."""
    hist = written(hist)
    bounds = bounds_of(hist, bins, "ref")
    b = hist.join(bounds, "feature").withColumn("bin", F.size(F.filter("bounds", lambda x: x <= F.col("value"))))
    c = b.groupBy("feature", "bin").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    every = bounds.select("feature", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("bin"))
    return every.join(c, ["feature", "bin"], "left").na.fill(0, ["ref", "cur"])


def psi_of(hist: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    all_ = Window.partitionBy("feature")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(all_).cast("double")) + eps
    c = psi_bins(hist, bins).select("feature", share("ref").alias("p"), share("cur").alias("q"))
    t = c.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return t.select("feature", r6("psi").alias("psi"), F.when(F.col("psi") >= 0.25, "HIGH").when(F.col("psi") >= 0.10, "MEDIUM").when(F.col("psi").isNotNull(), "LOW").alias("level"))


def psi_equal_width(df: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """DR3: population stability index over equal-width bins of the joint range; empty shares are ``floor``."""
    df = valid(df, "value", "cohort")
    ends = df.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    is_ref = F.col("cohort") == "reference"
    b = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    c = df.join(F.broadcast(ends), "feature").groupBy("feature", b.cast("int").alias("bin")).agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur"))
    every = ends.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    c = every.join(c, ["feature", "bin"], "left").na.fill(0, ["ref", "cur"])
    all_ = Window.partitionBy("feature")
    share = lambda x: F.greatest(ratio0(x, F.sum(x).over(all_)), F.lit(floor))
    c = c.select("feature", share("ref").alias("p"), share("cur").alias("q"))
    return c.groupBy("feature").agg(r6(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p")))).alias("psi"))


def categorical(df: DataFrame, category="category") -> DataFrame:
    """DR4: shares by cohort, the part of each category in chi-square (one unseen in the reference adds nothing, but counts
    in df), the whole and its degrees of freedom."""
    is_ref = F.col("cohort") == "reference"
    c = df.groupBy(category).agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur"))
    t = c.agg(F.sum("ref").alias("nr"), F.sum("cur").alias("nc"))
    c = c.crossJoin(F.broadcast(t))
    expected = F.col("ref") / F.col("nr") * F.col("nc")
    part = F.coalesce(F.try_divide((F.col("cur") - expected) * (F.col("cur") - expected), expected), F.lit(0.0))
    return c.select(F.col(category).alias("category"), "ref", "cur", r6(F.col("ref") / F.col("nr")).alias("ref_share"), r6(F.col("cur") / F.col("nc")).alias("cur_share"), F.round(part, 4).alias("chi2_part"), F.round(F.sum(part).over(Window.partitionBy(F.lit(1))), 4).alias("chi2"), (F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) - 1).alias("df"))


def label_shift(df: DataFrame, label="category") -> DataFrame:
    """DR5: two-way chi-square of labels, degrees of freedom and the sum of absolute share differences."""
    is_ref = F.col("cohort") == "reference"
    c = df.groupBy(label).agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur"))
    t = c.agg(F.sum("ref").alias("nr"), F.sum("cur").alias("nc"))
    c = c.crossJoin(F.broadcast(t))
    both = F.col("ref") + F.col("cur")
    er, ec = both * F.col("nr") / (F.col("nr") + F.col("nc")), both * F.col("nc") / (F.col("nr") + F.col("nc"))
    sq = lambda x: x * x
    return c.agg(F.round(F.sum(sq(F.col("ref") - er) / er + sq(F.col("cur") - ec) / ec), 3).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"), r6(F.sum(F.abs(F.col("ref") / F.col("nr") - F.col("cur") / F.col("nc")))).alias("share_change"))


def label_shares(df: DataFrame, label="category") -> DataFrame:
    """DR5's shares of each label in both cohorts with their difference."""
    is_ref = F.col("cohort") == "reference"
    c = df.groupBy(F.col(label).alias("label")).agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur"))
    c = c.crossJoin(F.broadcast(c.agg(F.sum("ref").alias("nr"), F.sum("cur").alias("nc"))))
    return c.select("label", r6(F.col("ref") / F.col("nr")).alias("ref_share"), r6(F.col("cur") / F.col("nc")).alias("cur_share"), r6(F.col("cur") / F.col("nc") - F.col("ref") / F.col("nr")).alias("change"))


def per_feature(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """DR12: KS with its p, PSI and status of each numeric feature, from one histogram."""
    h = histogram(df)
    j = ks_of(h).select("feature", "ks", "p").join(psi_of(h).select("feature", "psi"), "feature")
    drift = (F.col("psi") >= 0.25) | (F.col("ks") >= 0.20) | (F.col("p") < 0.001)
    warn = (F.col("psi") >= 0.10) | (F.col("ks") >= 0.10) | (F.col("p") < alpha)
    return j.withColumn("score", r6(0.5 * F.col("ks") + 0.5 * F.col("psi"))).withColumn("status", F.when(drift, "DRIFT").when(warn, "WARN").otherwise("STABLE"))


def report(df: DataFrame) -> DataFrame:
    """DR11: KS and PSI of every numeric feature, the largest of both, and the overall status: CRITICAL where over half of
    the features are high in either, WARNING where any is, MINOR where any is medium in either, else NONE."""
    t = per_feature(df)
    high, medium = (F.col("psi") >= 0.25) | (F.col("ks") > 0.20), (F.col("psi") >= 0.10) | (F.col("ks") > 0.10)
    o = t.agg(F.max("ks").alias("max_ks"), F.max("psi").alias("max_psi"), F.count_if(high).alias("_h"), F.count_if(medium).alias("_m"), F.count(F.lit(1)).alias("_n"))
    overall = F.when(F.col("_h") * 2 > F.col("_n"), "CRITICAL").when(F.col("_h") > 0, "WARNING").when(F.col("_m") > 0, "MINOR").otherwise("NONE")
    return t.crossJoin(F.broadcast(o.select("max_ks", "max_psi", overall.alias("overall"))))


def covariate_shift(df: DataFrame) -> DataFrame:
    """DR6: score 0.5 KS + 0.5 PSI of each feature (shifted over 0.1) with its rank; CRITICAL where over half shifted or
    one is over 0.3, WARNING where any shifted, else NONE."""
    t = per_feature(df).select("feature", "ks", "psi", "score").withColumn("shifted", F.col("score") > 0.1)
    o = t.agg(F.count_if("shifted").alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("score").alias("_m"))
    overall = F.when((F.col("_s") * 2 > F.col("_n")) | (F.col("_m") > 0.3), "CRITICAL").when(F.col("_s") > 0, "WARNING").otherwise("NONE")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "feature"))  # a row a feature
    return t.withColumn("rank", rank).crossJoin(F.broadcast(o.select(overall.alias("overall"))))


def alerts(status: DataFrame, domain_auc: float | None = None) -> DataFrame:
    """DR13: the features that drift or warn with a severity each, and the overall one: CRITICAL where over half drift (or a
    domain classifier's AUC is over 0.85), HIGH where any drifts, MEDIUM where any warns, else NONE."""
    o = status.agg(F.count_if(F.col("status") == "DRIFT").alias("d"), F.count_if(F.col("status") == "WARN").alias("w"), F.count(F.lit(1)).alias("n"))
    worst = (F.col("d") * 2 > F.col("n")) | F.lit(domain_auc is not None and domain_auc > 0.85)
    overall = F.when(worst, "CRITICAL").when(F.col("d") > 0, "HIGH").when(F.col("w") > 0, "MEDIUM").otherwise("NONE")
    sev = F.when(F.col("status") == "DRIFT", "HIGH").otherwise("MEDIUM")
    return status.where("status <> 'STABLE'").select("feature", "status", sev.alias("severity")).crossJoin(F.broadcast(o.select(overall.alias("overall"))))


def by_method(df: DataFrame, method: str = "psi", least: float = 0.10) -> DataFrame:
    """DR14: drift of each feature by equal-width PSI or by KS, with an alert over ``least`` and a rank."""
    t = psi_equal_width(df).select("feature", F.col("psi").alias("drift")) if method == "psi" else ks(df).select("feature", F.col("ks").alias("drift"))
    return t.select("feature", "drift", (F.col("drift") > least).alias("alert"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("drift"), "feature")).alias("rank"))


def root_causes(df: DataFrame) -> DataFrame:
    """RC1, RC2, RC4 for each feature: missing rates with their rule (a rise of over 5 points; HIGH where over 20 % are
    missing now), relative mean shift, values over the reference's upper fence and the largest value."""
    is_ref, number = F.col("cohort") == "reference", clean("value")
    h = written(df.groupBy("feature", number.alias("value")).agg(F.count_if(is_ref).alias("ref"), F.count_if(~is_ref).alias("cur")))
    none = F.col("value").isNull()
    gone = lambda side: F.try_divide(F.sum(F.when(none, F.col(side)).otherwise(0)).cast("double"), F.sum(side))
    mean = lambda side: F.try_divide(F.sum(F.col("value") * F.col(side)), F.sum(F.when(~none, F.col(side))))
    g = h.groupBy("feature").agg(gone("ref").alias("mr"), gone("cur").alias("mc"), mean("ref").alias("ar"), mean("cur").alias("ac"))
    q = quantiles(h.where("ref > 0").select("feature", "value", F.col("ref").alias("n")), ["feature"], "value", [0.25, 0.75])
    fence = q.select("feature", (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("fence"))
    beyond = F.coalesce(F.sum(F.when(F.col("value") > F.col("fence"), F.col("cur"))), F.lit(0))
    over = h.where("value is not null and cur > 0").join(fence, "feature").groupBy("feature").agg(beyond.alias("outliers"), F.max("value").alias("worst"))
    shift = F.abs(F.col("ac") - F.col("ar")) / (F.abs("ar") + 1e-9)
    rise = F.col("mc") - F.col("mr") > 0.05
    t = g.join(fence, "feature", "left").join(over, "feature", "left")
    return t.select("feature", r6("mr").alias("missing_reference"), r6("mc").alias("missing_current"), F.when(rise & (F.col("mc") > 0.20), "HIGH").when(rise, "MEDIUM").otherwise("NONE").alias("missing_level"),
                    r6(shift).alias("mean_shift"), F.when(shift > 0.25, "HIGH").when(shift > 0.10, "MEDIUM").otherwise("NONE").alias("shift_level"), r6("fence").alias("fence"), "outliers", F.round("worst", 4).alias("worst"))


def ranked_causes(df: DataFrame, categories: DataFrame | None = None, changes: DataFrame | None = None, top: int = 5) -> DataFrame:
    """RC6: the ``top`` likeliest causes with confidence and advice, from root_causes, new_categories and
    correlation_change. Confidence: 90 for a high level of missing values or of mean shift, 75 for a medium one, 80 for new
    categories, 70 for a changed correlation, 60 for outliers."""
    t = root_causes(df)
    cause = lambda d, feature, kind, confidence, advice: d.select(feature.cast("string").alias("feature"), F.lit(kind).alias("cause"), confidence.alias("confidence"), F.lit(advice).alias("advice"))
    grade = lambda c: F.when(F.col(c) == "HIGH", 90).otherwise(75)
    rows = cause(t.where("missing_level <> 'NONE'"), F.col("feature"), "missing values", grade("missing_level"), "repair the source or impute")
    rows = rows.unionByName(cause(t.where("shift_level <> 'NONE'"), F.col("feature"), "mean shift", grade("shift_level"), "retrain on recent rows"))
    rows = rows.unionByName(cause(t.where("outliers > 0"), F.col("feature"), "outliers", F.lit(60), "clip or check the source"))
    if categories is not None:
        rows = rows.unionByName(cause(categories, F.col("category"), "new category", F.lit(80), "add the category to the training rows"))
    if changes is not None:
        rows = rows.unionByName(cause(changes.where("changed"), F.col("feature"), "changed correlation", F.lit(70), "check the target's definition"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("confidence"), "cause", "feature")  # a few rows a feature
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def new_categories(df: DataFrame, category="category") -> DataFrame:
    """RC3: categories of the current cohort that the reference lacks, with their rows."""
    is_ref = F.col("cohort") == "reference"
    return df.groupBy(F.col(category).alias("category")).agg(F.count_if(is_ref).alias("_r"), F.count_if(~is_ref).alias("n")).where("_r = 0 and n > 0").drop("_r")


def correlation_change(df: DataFrame, features: list[str], target: str, cohort="cohort", least: float = 0.2) -> DataFrame:
    """RC5: change of each feature's correlation with the target between cohorts."""
    is_ref = F.col(cohort) == "reference"
    g = df.agg(*[corr(F.when(is_ref, F.col(f)), target).alias(f"r_{f}") for f in features], *[corr(F.when(~is_ref, F.col(f)), target).alias(f"c_{f}") for f in features])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r_{f}").alias("reference"), F.col(f"c_{f}").alias("current")) for f in features]))
    g = g.select(rows.alias("x")).select("x.*")
    return g.select("feature", r6("reference").alias("reference"), r6("current").alias("current"), (F.abs(F.col("reference") - F.col("current")) > least).alias("changed"))
