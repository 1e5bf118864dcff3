"""Label noise: confident learning over predicted probabilities, transitions and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import r6, ratio0, valid, written
from . import folds


def noise_thresholds(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    """LN1: mean probability of each class over the rows that bear its label."""
    return df.agg(*[F.avg(F.when(F.col(label) == k, F.col(p))).alias(f"t{k}") for k, p in enumerate(probs)])


def confident(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    """LN2, LN3, LN5, LN8 for each row: confident class, error flag, margin and self-confidence."""
    t = df.crossJoin(F.broadcast(noise_thresholds(df, label, probs)))
    best = F.lit(None).cast("struct<p:double,k:int>")
    over = [F.when(F.col(p) >= F.col(f"t{k}"), F.struct(F.col(p).alias("p"), F.lit(-k).alias("k"))) for k, p in enumerate(probs)]
    best = F.greatest(*over)
    own = F.element_at(F.array(*probs), (F.col(label) + 1).cast("int"))
    mine = F.element_at(F.array(*[f"t{k}" for k in range(len(probs))]), (F.col(label) + 1).cast("int"))
    other = F.array_max(F.transform(F.array(*probs), lambda p, i: F.when(i != F.col(label), p)))
    cls = -best["k"]
    return t.select("row_id", F.col(label).alias("label"), cls.alias("confident"), F.when(best.isNull(), own < mine).otherwise(cls != F.col(label)).alias("is_issue"), r6(own - other).alias("margin"), r6(own).alias("quality"))


def joint(flags: DataFrame) -> DataFrame:
    """LN2: rows of each label and confident class."""
    return flags.where("confident is not null").groupBy("label", "confident").agg(F.count(F.lit(1)).alias("n"))


def error_fraction(flags: DataFrame) -> DataFrame:
    """LN4: share and number of flagged rows."""
    return flags.agg(r6(F.avg(F.col("is_issue").cast("double"))).alias("fraction"), F.count_if("is_issue").alias("issues"))


def transitions(counts: DataFrame, classes: int) -> DataFrame:
    """LN6: (i, j, t): share of label j among rows of confident class i; a class without rows keeps its label."""
    spine = counts.sparkSession.range(classes).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("j"))
    c = counts.select(F.col("confident").cast("int").alias("i"), F.col("label").cast("int").alias("j"), "n")
    t = spine.join(F.broadcast(c), ["i", "j"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("i"))
    return t.select("i", "j", r6(F.when(total == 0, (F.col("i") == F.col("j")).cast("double")).otherwise(F.col("n") / total)).alias("t"))


def asymmetry(t: DataFrame) -> DataFrame:
    """LN7: spread of the off-diagonal transitions (asymmetric over 0.05), severity (1 - mean diagonal) and noisiest class."""
    off, on = F.when(F.col("i") != F.col("j"), F.col("t")), F.when(F.col("i") == F.col("j"), F.col("t"))
    g = t.agg(F.stddev_pop(off).alias("s"), F.avg(on).alias("d"), F.min_by("i", F.struct(F.coalesce(on, F.lit(2.0)), "i")).alias("noisiest"))
    return g.select(r6("s").alias("spread"), (F.col("s") > 0.05).alias("asymmetric"), r6(1 - F.col("d")).alias("severity"), "noisiest")


def cleaned(df: DataFrame, flags: DataFrame, key: str = "row_id") -> DataFrame:
    """LN9: rows that are not flagged; rows without a flag stay."""
    return df.join(flags.where("is_issue").select(key), key, "left_anti")


def agreement(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """LN10: sizes of two sets of keys, of what they share and their Jaccard similarity (1 where both are empty)."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    g = j.agg(F.count("_a").alias("n_first"), F.count("_b").alias("n_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("_u"))
    return g.select("n_first", "n_second", "n_both", r6(F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("_u").cast("double")), F.lit(1.0))).alias("jaccard"))


def audit(flags: DataFrame, classes: int, ids: int = 100) -> DataFrame:
    """LN11: one row: counts, error fraction, mean quality, asymmetry, severity (over 0.05, 0.15 and 0.30) and the first
    ``ids`` flagged ids (a bounded top-k)."""
    g = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_issue").alias("issues"), r6(F.avg("quality")).alias("mean_quality"))
    first = flags.where("is_issue").select("row_id").orderBy("row_id").limit(ids).agg(F.array_sort(F.collect_list("row_id")).alias("first_ids"))
    g = g.withColumn("fraction", r6(ratio0("issues", "n"))).crossJoin(F.broadcast(asymmetry(transitions(joint(flags), classes)).select("spread", "asymmetric")))
    level = F.when(F.col("fraction") > 0.30, "CRITICAL").when(F.col("fraction") > 0.15, "HIGH").when(F.col("fraction") > 0.05, "MEDIUM").otherwise("LOW")
    return g.withColumn("severity", level).crossJoin(F.broadcast(first))


def out_of_fold(df: DataFrame, label: str, probs: list[str]) -> DataFrame:
    """LN12's rule over out-of-fold probabilities: an issue where the likeliest class (ties: the first) is not the label, or
    no probability reaches 0.5."""
    df = valid(df, label, *probs)
    best = F.array_max(F.array(*[F.struct(F.col(p).alias("p"), F.lit(-k).alias("k")) for k, p in enumerate(probs)]))
    cls = -best["k"]
    return df.select("row_id", F.col(label).alias("label"), cls.alias("likeliest"), r6(best["p"]).alias("p"), ((cls != F.col(label)) | (best["p"] < 0.5)).alias("is_issue"))


def residual_noise(df: DataFrame, y: str = "y", yhat: str = "yhat", key: str = "row_id") -> DataFrame:
    """LN13's rule: absolute residuals over their mean by more than three sample deviations."""
    e = F.abs(F.col(y) - F.col(yhat))
    rows = valid(df, y, yhat).select(key, e.alias("e"))
    m = rows.agg(F.avg("e").alias("_m"), F.stddev_samp("e").alias("_s"))
    return rows.crossJoin(F.broadcast(m)).select(key, r6("e").alias("residual"), F.coalesce(F.col("e") > F.col("_m") + 3 * F.col("_s"), F.lit(False)).alias("is_issue"))


def found_out_of_fold(df: DataFrame, features: list[str], label: str, classes: int, key: str = "row_id", k: int = 5) -> DataFrame:
    """LN12 from features alone: the rule over probabilities of models that have not seen the row (linear discriminants of
    the other folds), so nothing has to be given but labels and features."""
    scored = folds.out_of_fold_classes(df, features, label, classes, key, k).withColumnRenamed(key, "row_id")
    return out_of_fold(scored, "label", [f"p{c}" for c in range(classes)])


def confident_out_of_fold(df: DataFrame, features: list[str], label: str, classes: int, key: str = "row_id", k: int = 5) -> DataFrame:
    """Confident learning (LN1–LN3, LN5, LN8) over the same out-of-fold probabilities."""
    scored = written(folds.out_of_fold_classes(df, features, label, classes, key, k).withColumnRenamed(key, "row_id"))
    return confident(scored, "label", [f"p{c}" for c in range(classes)])


def residuals_out_of_fold(df: DataFrame, features: list[str], y: str, key: str = "row_id", k: int = 5) -> DataFrame:
    """LN13 from features alone: residuals of linear models of the other folds."""
    return residual_noise(folds.out_of_fold(df, features, y, key, k), "y", "yhat", key)


def noise_matrix(df: DataFrame, clean: str, noisy: str, classes: int) -> DataFrame:
    """LN14: share of each noisy label in every clean class."""
    share = lambda k: r6(F.avg((F.col(noisy) == k).cast("double"))).alias(f"to{k}")
    return valid(df, clean, noisy).groupBy(F.col(clean).alias("y_true")).agg(*[share(k) for k in range(classes)])


def prior_matrix(spark, classes: int, keep: float = 0.9) -> DataFrame:
    """LN14 without clean labels: ``keep`` on the diagonal, what is left shared by the other classes (0.05 each of three)."""
    other = (1 - keep) / max(1, classes - 1)
    cell = lambda k: F.when(F.col("id") == k, keep).otherwise(other).alias(f"to{k}")
    return spark.range(classes).select(F.col("id").cast("int").alias("y_true"), *[cell(k) for k in range(classes)])


def target_type(df: DataFrame, label: str, most: int = 20) -> DataFrame:
    """LN15: regression where the label is a fraction or has more than ``most`` values, else classification."""
    fractional = df.schema[label].dataType.typeName() in ("double", "float")
    whole = F.col(label) == F.floor(F.col(label)) if fractional else F.lit(True)
    g = valid(df, label).agg(F.count_distinct(label).alias("values"), F.count_if(~whole).alias("fractions"))
    return g.select("values", F.when((F.col("fractions") > 0) | (F.col("values") > most), "regression").otherwise("classification").alias("kind"))


def noise_severity(fraction):
    """LN15's levels of an error fraction."""
    return F.when(fraction > 0.20, "CRITICAL").when(fraction > 0.10, "HIGH").when(fraction > 0.05, "MEDIUM").otherwise("LOW")
