"""Splits of rows for fitting and testing, and audits of a split."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import corr, prefix_sums, r6, ratio0, valid, written
from . import drift
from .prep import draw_of

#: Folds that are fitted side by side.
AT_ONCE = 4


def train_test(df: DataFrame, key: str = "row_id", test: float = 0.2, salt: str = "split") -> DataFrame:
    """VS1: role train or test by a hash draw of the key: disjoint, the same on every run and partitioning."""
    return df.withColumn("role", F.when(draw_of(key, salt) < test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, salt: str = "f") -> DataFrame:
    """VS3: folds dealt round-robin inside each class, in hash order, numbered in two levels."""
    d = df.select(key, label, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))).alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    n = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    at = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
    out = d.withColumn("_i", at).join(n, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return out.select(key, ((F.col("_o") + F.col("_i")) % k).cast("int").alias("fold"))


def _cut(df: DataFrame, order: str, at: Column) -> DataFrame:
    """The value of ``order`` at the position ``at`` (a column over n, the number of rows), by order statistic."""
    v = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    h = written(df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count(F.lit(1)).alias("n")).withColumn("_v", v))
    total = h.agg(F.sum("n").alias("_all")).select(at.alias("_k"))
    h = prefix_sums(h, [], "_v", ["n"])
    return h.crossJoin(F.broadcast(total)).where((F.col("_k") < F.col("cum_n")) & (F.col("_k") >= F.col("cum_n") - F.col("n"))).select(F.col(order).alias("cut"))


def ordered_split(df: DataFrame, order: str, fraction: float = 0.5) -> DataFrame:
    """PR10, VS5: reference (train) before the row at position int(n * fraction) along ``order``, current (test) from it
    on; rows that tie with it are current. Rows without an order value have no part."""
    cut = _cut(df, order, F.floor(F.col("_all") * fraction))
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(order) < F.col("cut"), "reference").when(F.col(order) >= F.col("cut"), "current")).drop("cut")


def time_series_splits(df: DataFrame, order: str, key: str, splits: int = 3, gap: int = 0) -> DataFrame:
    """VS4: (split, role, key): of n rows along ``order`` (ties by key) each split tests on the next n / (splits + 1) and
    trains on all before, less ``gap`` rows. Positions are numbered in two levels; a row is in at most ``splits`` splits."""
    d = df.where(F.col(order).isNotNull()).select(key, F.struct(F.col(order).alias("at"), F.col(key).alias("of")).alias("_o"))
    d = written(d.repartitionByRange("_o").withColumn("_p", F.spark_partition_id()))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1).join(F.broadcast(sizes), "_p").withColumn("_i", F.col("_i") + F.col("_b"))
    size = F.floor(F.col("_all") / (splits + 1))
    out = d.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    role = F.when(F.col("_i") < size * F.col("split") - gap, "train").when((F.col("_i") >= size * F.col("split")) & (F.col("_i") < size * (F.col("split") + 1)), "test")
    return out.select("split", role.alias("role"), key).where("role is not null")


def scaling_leakage(df: DataFrame, features: list[str], role: str = "role", tolerance: float = 0.05) -> DataFrame:
    """VS8: features whose training and test rows both have a mean near 0 and a deviation near 1 already, so that they were
    scaled together, with the gap of means in deviations; risk HIGH where that is so for over half of them."""
    long = df.select(role, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([role], features, "feature", "v")
    side = lambda f, r: f(F.when(F.col(role) == r, F.col("v")))
    g = long.groupBy("feature").agg(*[side(f, r).alias(f"{n}_{r}") for r in ("train", "test") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    flat = lambda r: (F.abs(f"m_{r}") <= tolerance) & (F.abs(F.col(f"s_{r}") - 1) <= tolerance)
    g = g.select("feature", r6("m_train").alias("mean_train"), r6("m_test").alias("mean_test"), r6(F.try_divide(F.abs(F.col("m_train") - F.col("m_test")), F.col("s_train"))).alias("z_gap"), F.coalesce(flat("train") & flat("test"), F.lit(False)).alias("scaled"))
    risk = g.agg(F.when(F.count_if("scaled") * 2 > F.count(F.lit(1)), "HIGH").when(F.count_if("scaled") > 0, "MEDIUM").otherwise("LOW").alias("risk"))
    return g.crossJoin(F.broadcast(risk))


def target_leakage(df: DataFrame, features: list[str], target: str, least: float = 0.95) -> DataFrame:
    """VS9: features of which the correlation with the target is at least ``least`` in absolute value, in one aggregate."""
    g = df.agg(*[F.abs(corr(c, target)).alias(c) for c in features]).unpivot([], features, "feature", "r")
    return g.select("feature", r6("r").alias("r"), F.coalesce(F.col("r") >= least, F.lit(False)).alias("leaks"))


def temporal_order(df: DataFrame, ts: str, role: str = "role") -> DataFrame:
    """VS10: the last training time, the first test time, and the test rows that are not after the former."""
    last = df.agg(F.max(F.when(F.col(role) == "train", F.col(ts))).alias("train_max"))
    late = (F.col(role) == "test") & (F.col(ts) <= F.col("train_max"))
    g = df.crossJoin(F.broadcast(last)).agg(F.first("train_max").alias("train_max"), F.min(F.when(F.col(role) == "test", F.col(ts))).alias("test_min"), F.count_if(late).alias("overlap"), F.count_if(F.col(role) == "test").alias("n_test"))
    return g.select("train_max", "test_min", "overlap", r6(ratio0("overlap", "n_test")).alias("violation_rate"), (F.col("overlap") == 0).alias("ordered"))


def overlap(df: DataFrame, columns: list[str], role: str = "role") -> DataFrame:
    """VS12: distinct rows (of these columns, null equal to null) that are both in training and test, by one grouping."""
    side = lambda r: F.max((F.col(role) == r).cast("int"))
    g = df.groupBy(*columns).agg(side("train").alias("_a"), side("test").alias("_b"))
    return g.agg(F.count_if(F.col("_a") == 1).alias("train_rows"), F.count_if(F.col("_b") == 1).alias("test_rows"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("shared"))


def validate(df: DataFrame, features: list[str], label: str, role: str = "role") -> DataFrame:
    """VS11: (check, value, passed): test share in 10 to 40 %, gap of the label's mean under 0.05, features of KS over 0.1
    between the parts (none), shared rows (none)."""
    is_test = F.col(role) == "test"
    y = F.col(label).cast("double")
    g = df.agg(F.avg(is_test.cast("double")).alias("share"), F.abs(F.avg(F.when(is_test, y)) - F.avg(F.when(~is_test, y))).alias("gap"))
    long = df.select(F.when(is_test, "current").otherwise("reference").alias("cohort"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["cohort"], features, "feature", "value")
    shifted = drift.ks(long).agg(F.count_if(F.col("ks") > 0.1).cast("double").alias("shifted"))
    t = g.crossJoin(F.broadcast(shifted)).crossJoin(F.broadcast(overlap(df, [*features, label], role).select(F.col("shared").cast("double"))))
    checks = [("test_share", "share", F.col("share").between(0.1, 0.4)), ("label_gap", "gap", F.col("gap") < 0.05), ("shifted_features", "shifted", F.col("shifted") == 0), ("shared_rows", "shared", F.col("shared") == 0)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), r6(c).alias("value"), ok.alias("passed")) for n, c, ok in checks]))
    return t.select(rows.alias("x")).select("x.*")


def cross_validate(df: DataFrame, fit, score: Column, key: str = "row_id", k: int = 5) -> DataFrame:
    """VS6: per fold the mean of ``score`` (a column over the fitted model's output) on the fold that was left out, then
    their mean, sample deviation and 1.96 interval. ``fit`` takes training rows and returns a model with ``transform``, so
    preparation is fitted on training rows alone; folds are by hash of the key. The folded rows are written once, folds run
    side by side."""
    parts = _fold_scores(written(df.withColumn("_fold", _fold(key, "v", k))), fit, score, k)
    s = parts.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    half = 1.96 * F.col("std") / float(k) ** 0.5
    return parts.crossJoin(F.broadcast(s)).select("fold", "score", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def _fold(key: str, salt: str, k: int) -> Column:
    return F.floor(draw_of(key, salt) * k).cast("int")


def _together(spark, jobs: list) -> list:
    """Results of calls, a few at a time, in their order."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _fold_scores(folded: DataFrame, fit, score: Column, k: int) -> DataFrame:
    """(fold, score) as a table of a row a fold, from rows with ``_fold``."""
    one = lambda i: fit(folded.where(F.col("_fold") != i)).transform(folded.where(F.col("_fold") == i)).agg(F.avg(score)).first()[0]
    spark = folded.sparkSession
    got = _together(spark, [lambda i=i: one(i) for i in range(k)])
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(got)], "fold int, score double")


def nested(df: DataFrame, fit, grid: list[dict], score: Column, key: str = "row_id", outer: int = 3, inner: int = 3) -> DataFrame:
    """VS7: for each outer fold the parameters of ``grid`` that score best on inner folds of its training rows, and the
    outer score of a model fitted with them. ``fit`` takes rows and the parameters. The folded rows are written once, outer
    folds run side by side."""
    folded = written(df.withColumn("_outer", _fold(key, "outer", outer)).withColumn("_fold", _fold(key, "v", inner)))
    spark = folded.sparkSession

    def one(i: int) -> tuple:
        rest, tried = folded.where(F.col("_outer") != i), []
        for n, g in enumerate(grid):
            got = [fit(rest.where(F.col("_fold") != j), g).transform(rest.where(F.col("_fold") == j)).agg(F.avg(score)).first()[0] for j in range(inner)]
            got = [v for v in got if v is not None]
            tried.append((n, sum(got) / len(got) if got else float("-inf")))
        best = max(tried, key=lambda t: (t[1], -t[0]))[0]
        v = fit(rest, grid[best]).transform(folded.where(F.col("_outer") == i)).agg(F.avg(score)).first()[0]
        return i, str(grid[best]), None if v is None else float(v)

    return spark.createDataFrame(_together(spark, [lambda i=i: one(i) for i in range(outer)]), "fold int, parameters string, score double")


def balance(df: DataFrame, label: str, role: str = "role") -> DataFrame:
    """Share of each label in every part of a split."""
    c = valid(df, label).groupBy(role, label).agg(F.count(F.lit(1)).alias("n"))
    return c.select(role, label, "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy(role))).alias("share"))
