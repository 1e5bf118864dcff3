"""Preparation, splits and uncertainty: thresholds and codes from one aggregate, broadcast to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.core import corr, prefix_sums, quantiles, r6, ratio0, valid, written


def label_codes(df: DataFrame, c: str, key: str = "row_id") -> DataFrame:
    """PR7: dense code of a category by sorted value, null kept. Codes are running counts, so no task orders all values."""
    codes = _codes(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("one")), c)
    return df.select(key, c).join(codes, c, "left").select(key, F.col("code").cast("int").alias("code"))


def _codes(values: DataFrame, order: str) -> DataFrame:
    """values (distinct in order, with a column one of 1s) with their rank from 0 in two levels: by range, then inside it."""
    ranged = written(written(values).repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum("one").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy(order)
    return ranged.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(sizes), "_p").withColumn("code", F.col("_o") + F.col("_i")).drop("_p", "_i", "_o", "one")


def first_codes(df: DataFrame, c: str, order: str, key: str = "row_id") -> DataFrame:
    """PR6: dense code of a category by first appearance along ``order``, null kept."""
    firsts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.struct(F.min(order).alias("at"), F.col(c).alias("of")).alias("first"), F.lit(1).alias("one"))
    codes = _codes(firsts, "first").select(c, F.col("code").cast("int").alias("code"))
    return df.select(key, c).join(codes, c, "left").select(key, "code")


def binarise(df: DataFrame, c: str, key: str = "row_id", most: int = 10) -> DataFrame:
    """PR4: a 0/1 target. A number of more than ``most`` values is 1 above its median; of other targets of more than two
    classes the code by sorted value is compared with the median code; two classes are coded 0, 1 in order. Null stays."""
    values = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    number = df.schema[c].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or df.schema[c].dataType.typeName().startswith("decimal")
    codes = _codes(values.withColumn("one", F.lit(1)), c)
    k = codes.agg(F.count(F.lit(1)).alias("_k"))
    by_code = quantiles(codes.select(F.col("code").cast("double").alias("code"), "n"), [], "code", [0.5]).select(F.col("q")[0].alias("_mid"))
    rows = df.select(key, c).join(codes.select(c, "code"), c, "left").crossJoin(F.broadcast(k)).crossJoin(F.broadcast(by_code))
    coded = F.when(F.col("_k") > 2, (F.col("code") > F.col("_mid")).cast("int")).otherwise(F.col("code").cast("int"))
    if number:
        middle = quantiles(values.select(F.col(c).cast("double").alias("v"), "n"), [], "v", [0.5]).select(F.col("q")[0].alias("_median"))
        rows = rows.crossJoin(F.broadcast(middle))
        coded = F.when(F.col("_k") > most, (F.col(c).cast("double") > F.col("_median")).cast("int")).otherwise(coded)
    return rows.select(key, F.when(F.col(c).isNotNull(), coded).alias("target"))


def to_probability(df: DataFrame, c: str, key: str = "row_id") -> DataFrame:
    """PR5: [1 - p, p] of a score; only one with values outside [0, 1] is min-max normalised first. Nulls stay."""
    ends = valid(df, c).agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    p = F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col(c).cast("double")).otherwise((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9))
    return df.crossJoin(F.broadcast(ends)).select(key, F.when(p.isNotNull(), F.array(r6(1 - p), r6(p))).alias("probs"))


def fill(df: DataFrame, numbers: list[str], texts: list[str], key: str = "row_id") -> DataFrame:
    """PR8: nulls become the mean of a number, the most frequent value of a text (ties: the smallest) or MISSING where there
    is none. Each text column is counted by value first, so no buffer holds them all."""
    out = df.crossJoin(F.broadcast(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in numbers], F.lit(1).alias("_one"))))
    for c in texts:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by(c, F.struct("_n", F.lit(0))).alias("_x"), F.max("_n").alias("_n"))
        tied = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(top.select("_n"))).where("_c = _n").agg(F.min(c).alias(f"_m_{c}"))
        out = out.crossJoin(F.broadcast(tied))
    return out.select(key, *[r6(F.coalesce(c, f"_m_{c}")).alias(c) for c in numbers], *[F.coalesce(c, f"_m_{c}", F.lit("MISSING")).alias(c) for c in texts])


def cohorts(reference: DataFrame, current: DataFrame, label: str = "domain") -> DataFrame:
    """PR11: both tables as one, with label 0 for the reference and 1 for the current rows."""
    return reference.withColumn(label, F.lit(0)).unionByName(current.withColumn(label, F.lit(1)), allowMissingColumns=True)


def inject_noise(df: DataFrame, label: str, transitions: list[list[float]], key: str = "row_id", salt: str = "noise") -> DataFrame:
    """PR14: each label i becomes the first j whose running sum of row i of the transitions is over a hash draw of the key."""
    u = draw_of(key, salt)
    ends = F.array(*[F.array(*[F.lit(float(sum(row[: j + 1]))) for j in range(len(row))]) for row in transitions])
    own = F.element_at(ends, (F.col(label) + 1).cast("int"))
    new = F.least(F.size(F.filter(own, lambda e: e <= u)), F.size(own) - 1)
    return df.withColumn("noisy", F.when(F.col(label).isNotNull(), new))


def draw_of(key: str, salt: str):
    """A hash draw in [0, 1): 4 hex digits of an md5, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))), 1, 4), 16, 10).cast("int") / 65536.0


def mean_fill(df: DataFrame, cols: list[str], key: str = "row_id") -> DataFrame:
    """PR8 for numbers: nulls become the column's mean."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in cols])
    return df.crossJoin(F.broadcast(means)).select(key, *[r6(F.coalesce(c, f"_{c}")).alias(c) for c in cols])


def standardise(df: DataFrame, cols: list[str], train, key: str = "row_id") -> DataFrame:
    """PR9: mean and sample deviation of the training rows alone; a deviation under 1e-10 counts as 1."""
    fit = df.where(train).agg(*[F.avg(c).alias(f"_m{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s{c}") for c in cols])
    z = lambda c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 1e-10, F.col(f"_s{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(fit)).select(key, *[r6(z(c)).alias(c) for c in cols])


def indicators(df: DataFrame, cols: list[str], key: str = "row_id") -> DataFrame:
    """PR13: an is_missing column for each column that has nulls; one aggregate over the table decides which before the
    plan is returned, since the result's columns depend on it."""
    has = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols]).first()
    return df.select(key, *[F.col(c).isNull().cast("int").alias(f"is_missing_{c}") for c in cols if has[c]])


def label_check(df: DataFrame, label: str, expected: list, least: float = 0.05) -> DataFrame:
    """VS13: count and share of each class, whether it was expected and whether it is a small minority."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    share = ratio0("n", F.sum("n").over(Window.partitionBy()))
    return c.select("label", "n", r6(share).alias("share"), F.col("label").isin(expected).alias("expected"), (share < least).alias("minority"))


def ranked_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """LK2: absolute correlation of each feature with the target, ranked, with the 0.9 suspects marked."""
    g = df.agg(*[F.abs(corr(c, target)).alias(c) for c in cols]).unpivot([], cols, "feature", "r")
    return g.select("feature", r6("r").alias("r"), F.row_number().over(Window.orderBy(F.desc("r"), "feature")).alias("rank"), (F.col("r") > 0.9).alias("suspect"))


def prediction_sets(df: DataFrame, probs: list[str], label: str, level: float = 0.9) -> DataFrame:
    """UQ1, UQ2: conformal quantile of 1 - p[true] by exact order statistic, then coverage and mean size of the sets."""
    own = F.element_at(F.array(*probs), (F.col(label) + 1).cast("int"))
    scored = valid(df, label, *probs).select(label, *probs, (1 - own).alias("score"))
    h = written(scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    q = h.agg(F.sum("n").alias("_n"))
    h = prefix_sums(h, [], "score", ["n"]).crossJoin(F.broadcast(q))
    cut = h.where(F.col("cum_n") > F.least(F.floor(F.lit(level) * F.col("_n")), F.col("_n") - 1)).agg(F.min("score").alias("q"))
    inside = lambda p: (F.col(p) >= 1 - F.col("q") - 1e-12).cast("int")
    s = scored.crossJoin(F.broadcast(cut))
    return s.agg(r6(F.max("q")).alias("q"), r6(F.avg((F.col("score") <= F.col("q") + 1e-12).cast("double"))).alias("coverage"), r6(F.avg(sum(inside(p) for p in probs))).alias("mean_size"))


def cohens_h(df: DataFrame, c: str, group: str, a, b) -> DataFrame:
    """HT14: effect size of two proportions."""
    p = lambda x: F.avg(F.when(F.col(group) == x, F.col(c).cast("double")))
    return df.agg(p(a).alias("p1"), p(b).alias("p2")).select(r6("p1").alias("p1"), r6("p2").alias("p2"), r6(2 * F.asin(F.sqrt("p1")) - 2 * F.asin(F.sqrt("p2"))).alias("h"))


def input_checks(df: DataFrame, y_true: str, y_prob: str, least: int = 30) -> DataFrame:
    """GV3: violations of binary labels, probabilities in [0, 1] and the least number of rows."""
    return df.agg(F.count_if(~F.coalesce(F.col(y_true).isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(~F.coalesce(F.col(y_prob).between(0, 1), F.lit(False))).alias("bad_probs"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < least).alias("too_few"))


def fold_of(key, k: int, salt: str = "v"):
    """VS1, VS2: fold 0..k-1 of a key by a hash draw, the same on any partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))), 1, 4), 16, 10).cast("int")
    return F.floor(h / 65536.0 * k).cast("int")


def z_scores(df: DataFrame, c: str, key: str = "row_id") -> DataFrame:
    """DS5: each value's distance from the mean in sample deviations."""
    m = df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    return df.crossJoin(F.broadcast(m)).select(key, r6(F.try_divide(F.col(c) - F.col("_m"), F.col("_s"))).alias("z"))


def co_missing(df: DataFrame, cols: list[str], least: float = 0.5) -> DataFrame:
    """MD10: correlation of the missing indicators of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    gone = lambda c: F.col(c).isNull().cast("double")
    g = df.agg(*[corr(gone(a), gone(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return g.select(rows.alias("x")).select("x.a", "x.b", r6("x.r").alias("r"), (F.col("x.r") > least).alias("together"))


def one_sample(df: DataFrame, c: str, mu: float, by: str, level: float = 0.95) -> DataFrame:
    """HT3: one-sample t statistic with p and the t interval of the mean by group."""
    g = valid(df, c).groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
    se = F.col("s") / F.sqrt("n")
    g = g.withColumn("df", F.col("n") - 1).withColumn("_t", F.try_divide(F.col("m") - mu, se)).withColumn("_h", dist.t_critical(F.col("df").cast("double"), level) * se)
    g = g.withColumn("p", dist.t_p(F.col("_t"), F.col("df").cast("double")))
    return g.select(by, "n", r6("m").alias("mean"), r6("_t").alias("t"), "df", r6(F.col("m") - F.col("_h")).alias("low"), r6(F.col("m") + F.col("_h")).alias("high"), "p")


def filters(df: DataFrame, rules: list[dict]) -> DataFrame:
    """PR1: rows that meet every {column, op, value} rule; > and < compare as numbers (what is none meets no rule), rules on
    unknown columns are ignored."""
    for rule in rules:
        c, op, value = rule["column"], rule["op"], rule["value"]
        if c in df.columns:
            number = F.col(c).cast("string").try_cast("double")
            df = df.where(number > float(value) if op == ">" else number < float(value) if op == "<" else F.col(c).cast("string") == str(value))
    return df


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 12) -> DataFrame:
    """Count and mean of y per equal-width, right-closed bin of x (the least value falls into the first). Nulls of x are left out."""
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    at = F.ceil((F.col(x) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) - 1
    d = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends))
    d = d.withColumn("bin", F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1))).cast("int"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(y), 6).alias("mean"))
