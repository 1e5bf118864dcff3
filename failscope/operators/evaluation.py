"""Model evaluation: counts by group in one aggregate; order-based measures from a score histogram.

Rows whose label, prediction or score is null or NaN take no part; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import count_if, join_on, prefix_sums, quantiles, ratio, ratio0, r6, valid, written


def confusion(df: DataFrame, y_true="y_true", y_pred="y_pred", by=()) -> DataFrame:
    """EV1: long confusion matrix."""
    return valid(df, y_true, y_pred).groupBy(*by, F.col(y_true).alias("actual"), F.col(y_pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_counts(df: DataFrame, y_true="y_true", y_pred="y_pred", by=(), pos=1) -> DataFrame:
    """EV2: tp, fp, tn, fn by group."""
    t, p = F.col(y_true) == pos, F.col(y_pred) == pos
    return valid(df, y_true, y_pred).groupBy(*by).agg(count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"), count_if(~t & ~p).alias("tn"), count_if(t & ~p).alias("fn"))


def rates(c: DataFrame, beta: float = 1.0) -> DataFrame:
    """EV3–EV5: rates over counts; 0 where a denominator is 0 (kappa 1 where chance agreement is 1)."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall, spec = ratio0(tp, tp + fp), ratio0(tp, tp + fn), ratio0(tn, tn + fp)
    f = lambda b: ratio0((1 + b * b) * precision * recall, b * b * precision + recall)
    chance = ratio0((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.select(
        "*", r6(ratio0(tp + tn, n)).alias("accuracy"), r6(precision).alias("precision"), r6(recall).alias("recall"), r6(f(1.0)).alias("f1"), r6(f(2.0)).alias("f2"), r6(spec).alias("specificity"),
        r6((recall + spec) / 2).alias("balanced_accuracy"), r6(ratio0(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        r6(F.when(chance == 1, 1.0).otherwise(ratio0(ratio0(tp + tn, n) - chance, 1 - chance))).alias("kappa"))


def score_histogram(df: DataFrame, y_true="y_true", y_prob="y_prob", by=()) -> DataFrame:
    """(by, neg_score, pos, n): rows and positives at each distinct score, negated so that the highest comes first; written
    once. Every measure of an order of scores reads this table and not the rows."""
    h = valid(df, y_true, y_prob).groupBy(*by, (-F.col(y_prob)).alias("neg_score"))
    return written(h.agg(F.sum(y_true).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n")))


def threshold_table(df: DataFrame, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """EV6: counts and rates at each distinct score (predicted where score >= threshold), from prefix sums."""
    return threshold_table_of(score_histogram(df, y_true, y_prob))


def threshold_table_of(h: DataFrame) -> DataFrame:
    total = h.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    t = prefix_sums(h, [], "neg_score", ["pos", "n"]).crossJoin(F.broadcast(total))
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    t = t.select((-F.col("neg_score")).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_n") - F.col("all_pos") - fp).alias("tn"), (F.col("all_pos") - tp).alias("fn"))
    return rates(t).select("threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy", "specificity")


def best_f1(table: DataFrame) -> DataFrame:
    """EV7: the threshold of the best F1, compared at 4 places; ties go to the higher threshold."""
    return table.select("threshold", F.round("f1", 4).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def best_gmean(table: DataFrame) -> DataFrame:
    """EV8: the threshold of the best geometric mean of recall and specificity."""
    return table.select("threshold", F.round(F.sqrt(F.col("recall") * F.col("specificity")), 6).alias("gmean")).orderBy(F.desc("gmean"), F.desc("threshold")).limit(1)


def roc_points(table: DataFrame) -> DataFrame:
    """EV9: false and true positive rates at each threshold, with both ends."""
    p = table.select(r6(ratio0("fp", F.col("fp") + F.col("tn"))).alias("fpr"), r6(ratio0("tp", F.col("tp") + F.col("fn"))).alias("tpr"))
    ends = table.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    return p.unionByName(ends).distinct()


def auc(df: DataFrame, y_true="y_true", y_prob="y_prob", by=()) -> DataFrame:
    """EV10: area under the ROC curve by rank sums (ties half), 0.5 where one class is missing."""
    return auc_of(score_histogram(df, y_true, y_prob, list(by)), list(by))


def auc_of(h: DataFrame, by=()) -> DataFrame:
    """A positive beats the negatives that come after it, and half of those at its score."""
    h = prefix_sums(h, list(by), "neg_score", ["n", "pos"])
    neg, pos = (F.col("n") - F.col("pos")).cast("double"), F.col("pos").cast("double")
    tied_or_before = (F.col("cum_n") - F.col("cum_pos")).cast("double")
    lost = F.sum(pos * (tied_or_before - neg / 2))
    share = F.try_divide(lost, F.sum(pos) * F.sum(neg))
    return h.groupBy(*by).agg(r6(F.coalesce(1 - share, F.lit(0.5))).alias("auc"))


def average_precision(df: DataFrame, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """EV12: sum of precision times the step in recall, one step for each distinct score."""
    return average_precision_of(score_histogram(df, y_true, y_prob))


def average_precision_of(h: DataFrame) -> DataFrame:
    h = prefix_sums(h, [], "neg_score", ["pos", "n"])
    return h.agg(r6(F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos"))).alias("average_precision"))


def log_loss(df: DataFrame, y_true="y_true", y_prob="y_prob", by=()) -> DataFrame:
    """EV14: mean log loss, probabilities clipped at 1e-15."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(y_prob)))
    return valid(df, y_true, y_prob).groupBy(*by).agg(r6(-F.avg(F.when(F.col(y_true) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))


def class_report(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """EV15: precision, recall, F1 and support of each class, then their plain ("macro") and support-weighted means and the
    accuracy (as all three rates), told apart by ``row``."""
    c = confusion(df, y_true, y_pred)
    rows = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    j = rows.join(cols, "class", "full").na.fill(0, ["support", "hit", "claimed"])
    p, r = ratio0("hit", "claimed"), ratio0("hit", "support")
    f = ratio0(2 * p * r, p + r)
    rates_ = j.select("class", "support", "hit", p.alias("p"), r.alias("r"), f.alias("f"))
    n = F.sum("support").cast("double")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / n
    whole = rates_.agg(F.sum("support").alias("support"), F.struct(*[F.avg(c).alias(c) for c in "prf"]).alias("macro"), F.struct(*[mean(c).alias(c) for c in "prf"]).alias("weighted"),
                       F.struct(*[(F.sum("hit") / n).alias(c) for c in "prf"]).alias("accuracy"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("row"), F.col(k).alias("v")) for k in ("macro", "weighted", "accuracy")]))
    whole = whole.select("support", rows.alias("x")).select(F.col("x.row").alias("row"), "support", *[F.col(f"x.v.{c}").alias(c) for c in "prf"])
    out = rates_.select(F.col("class").cast("string").alias("row"), "support", "p", "r", "f").unionByName(whole)
    return out.select("row", "support", r6("p").alias("precision"), r6("r").alias("recall"), r6("f").alias("f1"))


def kappa(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """EV5 for any classes: agreement beyond chance; 1 where chance agreement is 1."""
    c = confusion(df, y_true, y_pred)
    side = lambda x: c.groupBy(F.col(x).alias("class")).agg(F.sum("n").cast("double").alias(x[0]))
    j = side("actual").join(side("predicted"), "class", "full").na.fill(0.0, ["a", "p"])
    t = c.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    t = j.agg(F.sum(F.col("a") * F.col("p")).alias("chance")).crossJoin(t).select((F.col("hit") / F.col("n")).alias("o"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("e"))
    return t.select(r6("o").alias("agreement"), r6("e").alias("chance"), r6(F.when(F.col("e") == 1, 1.0).otherwise((F.col("o") - F.col("e")) / (1 - F.col("e")))).alias("kappa"))


def pr_points(table: DataFrame) -> DataFrame:
    """EV11: recall and precision at each threshold, with the start (0, 1)."""
    start = table.sparkSession.createDataFrame([(0.0, 1.0)], "recall double, precision double")
    return table.select("recall", "precision").unionByName(start).distinct()


def pr_auc(df: DataFrame, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """EV13: area under the precision-recall curve by trapezoids, ties collapsed, from (0, 1) to (1, prevalence)."""
    h = score_histogram(df, y_true, y_prob)
    t = h.agg(F.sum("pos").alias("P"))
    h = prefix_sums(h, [], "neg_score", ["pos", "n"])
    before = F.col("cum_n") - F.col("n")
    now, last = F.col("cum_pos") / F.col("cum_n"), F.when(before > 0, (F.col("cum_pos") - F.col("pos")) / before).otherwise(1.0)
    return h.crossJoin(F.broadcast(t)).agg(r6(F.sum(F.try_divide(F.col("pos"), F.col("P")) * (now + last) / 2)).alias("pr_auc"))


def summary(df: DataFrame, y_true="y_true", y_prob="y_prob", cut: float = 0.5) -> DataFrame:
    """EV16: one row of counts, rates, AUC, average precision, log loss, ECE and the threshold of the best F1."""
    h = score_histogram(df, y_true, y_prob)
    p, pos, n = -F.col("neg_score"), F.col("pos"), F.col("n")
    above = lambda c: F.coalesce(F.sum(F.when(p >= cut, c)), F.lit(0))
    below = lambda c: F.coalesce(F.sum(F.when(p < cut, c)), F.lit(0))
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    loss = F.sum(pos * F.ln(clipped) + (n - pos) * F.ln(1 - clipped))
    t = h.agg(above(pos).alias("tp"), above(n - pos).alias("fp"), below(n - pos).alias("tn"), below(pos).alias("fn"), r6(F.try_divide(-loss, F.sum("n"))).alias("log_loss"))
    unit = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    bins = h.groupBy(F.least(F.floor(unit * 10), F.lit(9)).alias("bin")).agg(F.abs(F.sum(pos) - F.sum(unit * n)).alias("gap"), F.sum("n").alias("n"))
    ece = bins.agg(r6(F.try_divide(F.sum("gap"), F.sum("n"))).alias("ece"))
    best = best_f1(threshold_table_of(h)).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    t = rates(t)
    for part in (auc_of(h), average_precision_of(h), ece, best):
        t = t.crossJoin(F.broadcast(part))  # one row each
    return t


def regression(df: DataFrame, y="y", yhat="yhat", by=(), features: int = 1) -> DataFrame:
    """EV17–EV19: errors, r2 (0 where y is constant), residual mean, spread and bias, explained variance, median error."""
    e, y_, p = F.col(y) - F.col(yhat), F.col(y), F.col(yhat)
    df = valid(df, y, yhat)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs(y_), F.lit(1e-8))).alias("mape"),
        F.avg(2 * F.abs(e) / F.greatest(F.abs(y_) + F.abs(p), F.lit(1e-8))).alias("smape"), F.var_pop(y_).alias("vy"), F.var_pop(e).alias("ve"), F.avg(e).alias("me"), F.stddev_samp(e).alias("se"), F.max(F.abs(e)).alias("worst"))
    middle = quantiles(df.groupBy(*by, F.abs(e).alias("_e")).agg(F.count(F.lit(1)).alias("n")), list(by), "_e", [0.5]).select(*by, F.col("q")[0].alias("medae"))
    g = join_on(g, middle, list(by)) if by else g.crossJoin(F.broadcast(middle))
    r2 = F.when(F.col("vy") == 0, 0.0).otherwise(1 - ratio("mse", "vy"))
    n = F.col("n").cast("double")
    return g.select(*by, "n", F.round("mse", 2).alias("mse"), F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("mape").alias("mape"), r6("smape").alias("smape"), r6(r2).alias("r2"),
                    r6(1 - (1 - r2) * ratio(n - 1, n - features - 1)).alias("adjusted_r2"), F.round("me", 3).alias("mean_residual"), F.round("se", 3).alias("std_residual"), F.round("worst", 4).alias("max_abs_error"),
                    (F.abs("me") > 2 * F.col("se") / F.sqrt(n)).alias("biased"), r6(1 - ratio("ve", "vy")).alias("explained_variance"), F.round("medae", 4).alias("median_abs_error"))


def grade(score: Column) -> Column:
    """EV20: letter grade of an AUC, F1 or r2."""
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def compare_models(df: DataFrame, preds: list[str], y_true="y_true") -> DataFrame:
    """EV21: rates of several models in one pass, the best by F1 marked."""
    long = df.select(y_true, *preds).unpivot([y_true], preds, "model", "_p")
    t = rates(binary_counts(long, y_true, "_p", by=["model"]))
    best = t.agg(F.max_by("model", F.struct("f1", "model")).alias("_best"))
    return t.crossJoin(F.broadcast(best)).select("model", "accuracy", "precision", "recall", "f1", (F.col("model") == F.col("_best")).alias("best"))


def regression_check(current: DataFrame, baseline: DataFrame, key: str, metric: str, tol: float = 0.01) -> DataFrame:
    """EV22: change of a metric against a baseline with REGRESSION, WARNING or OK."""
    j = current.select(key, F.col(metric).alias("now")).join(baseline.select(key, F.col(metric).alias("base")), key)
    d = F.col("now") - F.col("base")
    return j.select(key, "now", "base", r6(d).alias("delta"), F.when(d < -2 * tol, "REGRESSION").when(d < -tol, "WARNING").otherwise("OK").alias("status"))


def confusion_patterns(df: DataFrame, y_true="y_true", y_pred="y_pred", top: int = 3) -> DataFrame:
    """EV23: the most frequent wrong classes of each class with their rates, and the class's recall and precision."""
    c = confusion(df, y_true, y_pred)
    total, claimed = Window.partitionBy("actual"), Window.partitionBy("predicted")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    c = c.withColumn("rate", r6(F.col("n") / F.sum("n").over(total))).withColumn("recall", r6(F.sum(hit).over(total) / F.sum("n").over(total)))
    own = c.select("*", F.sum("n").over(claimed).alias("_c")).where("actual = predicted").select(F.col("actual").alias("_a"), r6(F.col("n") / F.col("_c")).alias("precision"))
    c = c.where("actual <> predicted").join(own, F.col("actual") == F.col("_a"), "left").drop("_a").na.fill(0.0, ["precision"])
    order = Window.partitionBy("actual").orderBy(F.desc("n"), "predicted")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("actual", "predicted", "n", "rate", "rank", "recall", "precision")
