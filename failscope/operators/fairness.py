"""Fairness: rates by group in one aggregate, gaps over the small result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import r6, valid, written
from .evaluation import binary_counts
from .neighbours import near_lists


def group_rates(df: DataFrame, group="grp", y_true="y_true", y_pred="y_pred", by=()) -> DataFrame:
    """FA1: counts and rates of each group; denominators are at least 1."""
    c = binary_counts(df, y_true, y_pred, by=[*by, group])
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n, over = tp + fp + tn + fn, lambda a, b: a / F.greatest(b, F.lit(1.0))
    return c.select(*by, F.col(group).alias("grp"), n.cast("bigint").alias("n"), "tp", "fp", "tn", "fn", over(tp, tp + fn).alias("tpr"), over(fp, fp + tn).alias("fpr"), over(tn, tn + fp).alias("tnr"), over(fn, tp + fn).alias("fnr"),
                    over(tp, tp + fp).alias("ppv"), over(tn, tn + fn).alias("npv"), over(tp + fn, n).alias("base_rate"), over(tp + fp, n).alias("selection_rate"), over(tp + tn, n).alias("accuracy"))


def gaps(rates: DataFrame, by=()) -> DataFrame:
    """FA2–FA5: gaps of selection rate, true and false positive rates and precision, with verdicts at 0.1, and the
    ratio of the smallest to the largest selection rate."""
    gap = lambda c: F.max(c) - F.min(c)
    g = rates.groupBy(*by).agg(gap("selection_rate").alias("dp"), gap("tpr").alias("tp"), gap("fpr").alias("fp"), gap("ppv").alias("pp"), (F.min("selection_rate") / F.greatest(F.max("selection_rate"), F.lit(1e-10))).alias("di"))
    return g.select(*by, r6("dp").alias("dp_gap"), (F.col("dp") < 0.1).alias("parity"), r6("tp").alias("tpr_gap"), r6("fp").alias("fpr_gap"), r6(F.greatest("tp", "fp")).alias("eo_gap"), (F.greatest("tp", "fp") < 0.1).alias("equalized"),
                    r6("pp").alias("ppv_gap"), r6("di").alias("di_ratio"))


def disparate_impact(rates: DataFrame, privileged, unprivileged) -> DataFrame:
    """FA6: ratio of selection rates with the four-fifths rule; fails where a group is absent."""
    rate = lambda g: F.max(F.when(F.col("grp") == g, F.col("selection_rate")))
    r = rates.agg(rate(privileged).alias("priv"), rate(unprivileged).alias("unpriv"))
    ratio = F.when(F.col("priv").isNull() | F.col("unpriv").isNull(), F.raise_error(F.lit("a group is absent"))).otherwise(F.col("unpriv") / F.greatest("priv", F.lit(1e-10)))
    return r.select(r6("priv").alias("priv_rate"), r6("unpriv").alias("unpriv_rate"), r6(ratio).alias("ratio"), ratio.between(0.8, 1.25).alias("passes"))


def gap_severity(gap: Column) -> Column:
    return F.when(gap <= 0.05, "LOW").when(gap <= 0.10, "MEDIUM").when(gap <= 0.20, "HIGH").otherwise("CRITICAL")


def ratio_severity(ratio: Column) -> Column:
    return F.when(ratio >= 0.95, "LOW").when(ratio >= 0.90, "MEDIUM").when(ratio >= 0.80, "HIGH").otherwise("CRITICAL")


def audit(df: DataFrame, axes: list[str], y_true="y_true", y_pred="y_pred", small: int = 30) -> DataFrame:
    """FA9, FA10: every attribute in one pass over unpivoted axes: gaps with severities, worst group (farthest from the mean
    selection rate), small groups, and the axis of the largest gap. A null group is a group; rows without label or
    prediction take no part."""
    long = df.select(y_true, y_pred, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot([y_true, y_pred], axes, "axis", "grp")
    rates = group_rates(long, "grp", y_true, y_pred, by=["axis"])
    mean = rates.groupBy("axis").agg(F.avg("selection_rate").alias("_m"))
    far = rates.join(F.broadcast(mean), "axis").groupBy("axis").agg(F.max_by("grp", F.struct(F.round(F.abs(F.col("selection_rate") - F.col("_m")), 9), "grp")).alias("worst_group"), F.count_if(F.col("n") < small).alias("small_groups"))
    t = gaps(rates, ["axis"]).join(far, "axis").select("axis", "dp_gap", "eo_gap", "di_ratio", gap_severity(F.col("dp_gap")).alias("dp_severity"), gap_severity(F.col("eo_gap")).alias("eo_severity"),
                                                       ratio_severity(F.col("di_ratio")).alias("di_severity"), "worst_group", "small_groups")
    worst = t.agg(F.max_by("axis", F.struct(F.greatest("dp_gap", "eo_gap"), "axis")).alias("worst_axis"))
    return t.crossJoin(F.broadcast(worst))


def report(df: DataFrame, group="grp", y_true="y_true", y_pred="y_pred") -> DataFrame:
    """FA8: (criterion, value, passes) of FA2 to FA6 (the ratio of the rates of the least to the most selected group), with
    the number of violations, the status (OK, MEDIUM, HIGH, CRITICAL for 0, 1, 2, 3 or more) and whether base rates are
    within 0.05, so that all criteria can hold at once."""
    r = group_rates(df, group, y_true, y_pred)
    g = gaps(r).crossJoin(F.broadcast(r.agg((F.max("base_rate") - F.min("base_rate")).alias("_b"))))
    rules = [("demographic_parity", "dp_gap", F.col("dp_gap") < 0.1), ("equalized_odds", "eo_gap", F.col("eo_gap") < 0.1), ("equal_opportunity", "tpr_gap", F.col("tpr_gap") < 0.1),
             ("predictive_parity", "ppv_gap", F.col("ppv_gap") < 0.1), ("disparate_impact", "di_ratio", F.col("di_ratio") >= 0.8)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(c).alias("value"), ok.alias("passes")) for n, c, ok in rules]))
    bad = sum((~ok).cast("int") for _, _, ok in rules)
    status = F.when(bad == 0, "OK").when(bad == 1, "MEDIUM").when(bad == 2, "HIGH").otherwise("CRITICAL")
    return g.select(rows.alias("x"), bad.alias("violations"), status.alias("status"), (F.col("_b") < 0.05).alias("base_rates_close")).select("x.*", "violations", "status", "base_rates_close")


# The advice for each criterion.
ADVICE = {
    "demographic_parity": "compare selection by group and review the threshold",
    "equalized_odds": "use thresholds by group or reweigh the training rows",
    "equal_opportunity": "raise recall in the group of the lowest true positive rate",
    "predictive_parity": "calibrate the score in each group",
    "disparate_impact": "check the selection against the four-fifths rule",
}


def recommendations(report_: DataFrame) -> DataFrame:
    """FA12: the criteria that fail, with advice, the worst miss first."""
    advice = F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("criterion"))
    miss = F.when(F.col("criterion") == "disparate_impact", 0.8 - F.col("value")).otherwise(F.col("value") - 0.1)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_miss"), "criterion")  # five rows at most
    return report_.where("not passes").withColumn("_miss", miss).select(F.row_number().over(order).alias("rank"), "criterion", "value", "status", advice.alias("advice"))


def individual(df: DataFrame, features: list[str], y_pred: str, key: str, k: int = 5) -> DataFrame:
    """FA7: 1 - mean absolute difference of the prediction to the k nearest other rows (Euclidean, on features scaled to
    [0, 1]; ties to the smaller key), passing at 0.8. Neighbours are exact, see :mod:`neighbours`. Rows whose prediction or a
    feature is null or NaN take no part; a row has fewer neighbours where there are not k others. Keys are whole numbers."""
    rows = written(valid(df, y_pred, *features).where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(y_pred).cast("double").alias("v"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]))
    names = range(len(features))
    ends = rows.agg(*[f(f"f{i}").alias(f"{n}{i}") for i in names for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [(F.coalesce(F.try_divide(F.col(f"f{i}") - F.col(f"lo{i}"), F.col(f"hi{i}") - F.col(f"lo{i}")), F.lit(0.0)) + 0.0).alias(f"x{i}") for i in names]
    near = near_lists(rows.crossJoin(F.broadcast(ends)).select("k", "v", *scaled), len(features), k)
    each = near.where(F.size("near") > 0).select((F.aggregate("near", F.lit(0.0), lambda a, r: a + F.abs(F.col("v") - r["v"])) / F.size("near")).alias("gap"))
    score = 1 - F.avg("gap")
    return each.agg(r6(score).alias("consistency"), (score >= 0.8).alias("passes"))


def fair_threshold(df: DataFrame, group="grp", y_true="y_true", y_prob="y_prob", criterion: str = "demographic_parity", steps: int = 50) -> DataFrame:
    """FA14: of ``steps`` thresholds from 0.01 to 0.99 the one of the smallest gap between groups (selection rates, or true
    positive rates for equal_opportunity, or the larger of both rates' gaps for equalized_odds); ties go to the better F1,
    then the lower threshold. One pass counts rows by group and the last threshold they reach; the rest is suffix sums."""
    at = F.floor((F.col(y_prob) - 0.01) / (0.98 / (steps - 1)) + 1e-9)
    c = valid(df, y_true, y_prob).groupBy(F.col(group).alias("g"), F.least(F.greatest(at, F.lit(-1)), F.lit(steps - 1)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum(y_true).alias("pos"))
    spine = c.select("g").distinct().select("g", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("i"))
    c = spine.join(c, F.expr("true") & spine["g"].eqNullSafe(c["g"]) & (spine["i"] == c["i"]), "left").select(spine["g"], spine["i"], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    down = Window.partitionBy("g").orderBy(F.desc("i"))  # steps + 1 rows a group
    whole = Window.partitionBy("g")
    c = c.select("g", "i", F.sum("n").over(down).alias("sel"), F.sum("pos").over(down).alias("tp"), F.sum("n").over(whole).alias("n"), F.sum("pos").over(whole).alias("pos")).where("i >= 0")
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    c = c.select("*", over("sel", "n").alias("sr"), over("tp", "pos").alias("tpr"), ((F.col("sel") - F.col("tp")) / F.greatest(F.col("n") - F.col("pos"), F.lit(1))).alias("fpr"))
    gap = lambda x: F.max(x) - F.min(x)
    of = {"demographic_parity": gap("sr"), "equal_opportunity": gap("tpr"), "equalized_odds": F.greatest(gap("tpr"), gap("fpr"))}[criterion]
    f1 = F.coalesce(F.try_divide(2.0 * F.sum("tp"), (F.sum("sel") + F.sum("pos")).cast("double")), F.lit(0.0))
    t = c.groupBy("i").agg(r6(of).alias("gap"), r6(f1).alias("f1"))
    best = t.agg(F.min(F.struct("gap", (-F.col("f1")).alias("f"), "i")).alias("x"))
    return best.select(F.round(0.01 + F.col("x.i") * (0.98 / (steps - 1)), 6).alias("threshold"), F.col("x.gap").alias("gap"), (-F.col("x.f")).alias("f1"))


def intersectional(df: DataFrame, axes: list[str], y_true="y_true", y_pred="y_pred", least: int = 20) -> DataFrame:
    """FA11: all attributes combined, groups under ``least`` left out, distance from the mean selection rate."""
    r = group_rates(df.withColumn("_g", F.concat_ws("|", *axes)), "_g", y_true, y_pred).where(F.col("n") >= least)
    mean = r.agg(F.avg("selection_rate").alias("_m"))
    return r.crossJoin(F.broadcast(mean)).select("grp", "n", r6("selection_rate").alias("selection_rate"), r6(F.abs(F.col("selection_rate") - F.col("_m"))).alias("distance"))


def default_groups(df: DataFrame, group: str) -> DataFrame:
    """FA13: the most and the least frequent group."""
    c = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max_by("g", F.struct("n", "g")).alias("privileged"), F.min_by("g", F.struct("n", "g")).alias("unprivileged"))
